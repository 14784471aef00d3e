"""Substring search in stored changes through an index of trigrams, so that a rare needle opens few files.

The index has, for each three characters in a row of a file's texts in lower case, the file.  A needle is only in files that
have all its trigrams; those are read and verified.  Files that came after the index was brought up to date are read too, and
those that are gone are ignored, so an index is never wrong, only slow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators.reports import filtered

#: Fixed: the columns that a search looks in.
COLUMNS = ["change_summary", "old_requirement", "new_requirement"]
#: Folders that the postings are dealt into by trigram; a search opens at most one for each of its trigrams.
BUCKETS = 64


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _folder(table: str) -> str:
    return "/" + table.rstrip("/").rsplit("/", 1)[-1] + "/"


def _name(path: str, table: str) -> str:
    """A file's place in its table: its name, after the folder of a comparison where there is one."""
    return unquote(path).rsplit(_folder(table), 1)[-1]


def grams_of(texts: list[str]) -> list[str]:
    """All three characters in a row that a text has, each once."""
    n = np.array([len(t) for t in texts], np.int64)
    u = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(u) < 3:
        return []
    within = np.ones(len(u), bool)
    ends = np.cumsum(n)
    for back in (1, 2):
        within[(ends - back)[n >= back]] = False
    letters = np.flatnonzero(np.bincount(u))
    code = np.zeros(letters[-1] + 1, np.int64)
    code[letters] = np.arange(len(letters))
    c, base = code[u], len(letters)
    key = ((c[:-2] * base + c[1:-1]) * base + c[2:])[within[:-2]]
    if base**3 <= 1 << 24:
        seen = np.zeros(base**3, bool)
        seen[key] = True
        key = np.flatnonzero(seen)
    else:
        key = np.unique(key)
    chars = [chr(x) for x in letters]
    return [chars[a] + chars[b] + chars[d] for a, b, d in zip((key // base**2).tolist(), (key // base % base).tolist(), (key % base).tolist(), strict=True)]


def _file_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, gram) of the texts of each file in a batch."""
    for b in batches:
        t = pa.Table.from_batches([b])
        for file in t["file"].unique().to_pylist():
            own = t.filter(pa.compute.equal(t["file"], file))
            grams = grams_of([x for c in COLUMNS for x in own[c].to_pylist() if x])
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(grams), pa.string()), pa.array(grams, pa.string())], names=["file", "gram"])


def table_files(spark: SparkSession, table: str) -> set[str]:
    return {_name(f, table) for f in spark.read.parquet(table).inputFiles()}


def _read(spark: SparkSession, table: str, files: list[str]) -> DataFrame:
    return spark.read.schema(spark.read.parquet(table).schema).option("basePath", table).parquet(*[f"{table}/{f}" for f in files])


def _index(spark: SparkSession, index: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(index)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema("gram string, file string, bucket int").parquet(index) if there else None


def update_index(spark: SparkSession, table: str, index: str) -> int:
    """Adds the files of ``table`` that ``index`` hasn't got, and returns how many.  An empty gram marks a file as indexed."""
    known = _index(spark, index)
    done = {r.file for r in known.where(F.col("bucket") == -1).select("file").distinct().collect()} if known is not None else set()
    new = sorted(table_files(spark, table) - done)
    if not new:
        return 0
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    rows = _read(spark, table, new).select(F.substring_index(path, _folder(table), -1).alias("file"), *[F.lower(c).alias(c) for c in COLUMNS])
    found = rows.mapInArrow(_file_grams, "file string, gram string").distinct().withColumn("bucket", _bucket(F.col("gram")))
    marks = spark.createDataFrame([("", f, -1) for f in new], "gram string, file string, bucket int")
    found.select("gram", "file", "bucket").unionByName(marks).hint("rebalance", "bucket").write.partitionBy("bucket").mode("append").parquet(index)
    return len(new)


def files_for(spark: SparkSession, table: str, index: str, needle: str) -> list[str]:
    """The files that a search for ``needle`` has to read: all of them for fewer than three characters."""
    every, needle, known = table_files(spark, table), needle.lower(), _index(spark, index)
    grams = sorted({needle[k : k + 3] for k in range(len(needle) - 2)})
    if not grams or known is None:
        return sorted(every)
    done = {r.file for r in known.where(F.col("bucket") == -1).select("file").distinct().collect()}
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").withColumn("bucket", _bucket(F.col("gram")))
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]
    postings = known.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    have = postings.groupBy("file").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("file").collect()
    return sorted(({r.file for r in have} & every) | (every - done))


def search(spark: SparkSession, table: str, index: str, needle: str, **equal: object) -> DataFrame:
    """As ``reports.filtered`` on the whole table, for a needle that isn't empty, reading the files that can have it."""
    files = files_for(spark, table, index, needle)
    rows = _read(spark, table, files) if files else spark.read.parquet(table).limit(0)
    return filtered(rows, needle, **equal)
