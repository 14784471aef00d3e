"""What the operators share: the folder all executors see, Arrow batches, and crc32 folds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.sources.tables import clear_folders, new_folder, settle, shared_dir

__all__ = ["clear_folders", "new_folder", "settle", "shared_dir"]

#: Most bytes of text that a worker handles at a time; one longer text is handled alone.
CHUNK_BYTES = 1 << 19


#: Fixed: schemes that Hadoop and pyarrow name differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def file_system(path: str):
    """The pyarrow file system and the path in it of a folder that Spark names with or without a scheme."""
    from pyarrow import fs

    scheme, mark, rest = path.partition(":")
    if not mark or "/" in scheme:
        return fs.FileSystem.from_uri(f"file://{path}")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def first_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, about those with the smallest hash of ``key``, in that order.

    The hash is compared with a bound that twice as many rows are expected to pass, before anything is sorted, so what
    meets in one task doesn't grow with the number of partitions.  Null keys are left out.
    """
    n = df.where(F.col(key).isNotNull()).count()
    h = F.xxhash64(key)
    if n > 2 * rows:
        df = df.where(h < F.lit(-(2**63) + int(2**64 * (2 * rows / n))))
    return df.where(F.col(key).isNotNull()).orderBy(h, key).limit(rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_map(df: DataFrame, column: str, scan: Callable[[list[bytes]], dict[str, pa.Array]], schema: str, most: int = CHUNK_BYTES) -> DataFrame:
    """``df`` without ``column`` but with what ``scan`` returns for it, a value for each text.

    ``scan`` gets the UTF-8 of a few texts at a time, so memory is bounded by ``most`` bytes or the longest text.
    """
    from pyspark.sql.types import StructType

    from clausewright.llm.wordhash import chunks

    kept = [f for f in df.schema.fields if f.name != column]
    out = StructType(kept + StructType.fromDDL(schema).fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(batch.schema.get_field_index(column)))
            rest = batch.select([f.name for f in kept])
            for a, b in chunks(texts, most):
                got = scan(texts[a:b])
                part = rest.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *got.values()], names=[*rest.schema.names, *got])

    return df.mapInArrow(run, out)


def with_text(df: DataFrame, text: str, keep: dict[str, Column]) -> DataFrame:
    """Only the named columns and the text, so that extra columns of any name or type never reach Python."""
    return df.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("_text"))
