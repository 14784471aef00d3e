"""Line dedup: line hashes probe a sharded minimal perfect hash over all distinct ones, and the hits go back to the texts.

1. Documents are dealt into buckets of about a megabyte by a hash of the whole row.  One pass over the texts gives
   each bucket's distinct line keys as 128-bit hashes with the number of its documents that have them.
2. Sums by hash are the index's counts.  The distinct hashes go to shards; each becomes a minimal perfect hash (hash
   and displace: keys of a bin share a seed that sends them to free slots), an array of 64-bit fingerprints and an
   array of counts, both in slot order, in a file of the shared folder.
3. A task per shard opens that one file and probes for all buckets: slot from the seed, then the fingerprint must be
   equal, then the count must reach ``min_docs``.  Slot and fingerprint come from independent halves of the hash.
   A line that a third of all documents have is one row per bucket here, not one per document.
4. Hits and texts meet by bucket, a megabyte at a time.

There is one plan for every size: no worker holds more than one shard or one bucket, and nothing comes to the driver
but sums.  Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import as_bytes, file_system, new_folder, settle, with_text
from clausewright.llm.wordhash import chunks, mix

_STRIP = b" \t\n\x0b\x0c\r"
#: Keys of one shard, about, until there are MOST_SHARDS, and more beyond; a shard's arrays take some 14 bytes a key.
SHARD_KEYS, MOST_SHARDS = 1 << 17, 20_000
#: Bytes of text in a bucket of documents, about; a longer text is in a larger one.
BUCKET_BYTES = 1 << 20
_BIN, _ROUNDS = 4, 100
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _pair(digests: list[bytes]) -> np.ndarray:
    """(n, 2) halves of digests."""
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _slot(low: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (mix(low + (seed.astype(np.uint64) + np.uint64(1)) * _GOLD) % np.uint64(n)).astype(np.int64)


def _bin(low: np.ndarray, bins: int) -> np.ndarray:
    return (mix(low ^ _GOLD) % np.uint64(bins)).astype(np.int64)


def _fits(at: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Rows of slots that are all free and all different."""
    free = ~taken[at].any(1)
    if at.shape[1] > 1:
        ranked = np.sort(at, 1)
        free &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
    return free


def build_shard(low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> bytes:
    """Seeds, fingerprints and counts of distinct keys whose halves are ``low`` and ``high``."""
    n = len(low)
    bins = max(1, -(-n // _BIN))
    by = _bin(low, bins)
    order = np.argsort(by, kind="stable")
    starts = np.searchsorted(by[order], np.arange(bins + 1))
    seeds, taken, slots = np.zeros(bins, np.uint32), np.zeros(n, bool), np.empty(n, np.int64)
    sizes = np.diff(starts)

    def place(own: np.ndarray, keys: np.ndarray, at: np.ndarray, seed) -> None:
        seeds[own], slots[keys], taken[at] = seed, at, True

    for size in sorted(set(sizes.tolist()) - {0}, reverse=True):
        own = np.flatnonzero(sizes == size)
        keys = order[starts[own][:, None] + np.arange(size)]
        for seed in range(_ROUNDS):  # all bins of a size try a seed at once; of those that want one slot the first gets it
            at = _slot(low[keys], np.full(keys.shape, seed), n)
            rows = np.flatnonzero(_fits(at, taken))
            first = np.zeros(len(rows) * size, bool)
            first[np.unique(at[rows].ravel(), return_index=True)[1]] = True
            rows = rows[first.reshape(-1, size).all(1)]
            place(own[rows], keys[rows], at[rows], seed)
            own, keys = np.delete(own, rows), np.delete(keys, rows, 0)
            if not len(own):
                break
        for b, few in zip(own.tolist(), keys, strict=True):  # the rest one by one, many seeds at once
            seed, step = _ROUNDS, 256
            while True:
                at = _slot(low[few][None, :], np.arange(seed, seed + step)[:, None], n)
                fits = _fits(at, taken)
                if fits.any():
                    k = int(fits.argmax())
                    place(np.array([b]), few, at[k], seed + k)
                    break
                seed, step = seed + step, min(step * 4, 1 << 14)
    fingerprints, held = np.empty(n, np.uint64), np.empty(n, np.uint32)
    fingerprints[slots], held[slots] = high, np.minimum(counts, 2**32 - 1)
    out = io.BytesIO()
    np.savez(out, seeds=seeds, fingerprints=fingerprints, counts=held)
    return out.getvalue()


class Shard:
    """A shard read back."""

    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as z:
            self.seeds, self.fingerprints, self.counts = z["seeds"], z["fingerprints"], z["counts"]

    def probe(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of documents of each key, 0 for keys that aren't indexed."""
        if not len(self.fingerprints):
            return np.zeros(len(low), np.int64)
        at = _slot(low, self.seeds[_bin(low, len(self.seeds))], len(self.fingerprints))
        return np.where(self.fingerprints[at] == high, self.counts[at].astype(np.int64), 0)


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _keys(text: bytes, min_chars: int) -> list[bytes]:
    """Hashes of a text's distinct keys."""
    return [key_hash(k) for k in {line_key(x) for x in text.split(b"\n")} if _long(k, min_chars)]


def bucket_lines(bucketed: DataFrame, min_chars: int = 1) -> DataFrame:
    """(bucket, low, high, n): the number of a bucket's documents that have a line key, by the halves of its hash."""

    def count(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            buckets, texts = batch.column(0).to_numpy(), as_bytes(batch.column(1))
            for a, b in chunks(texts, 8 << 20):
                each = [_keys(t, min_chars) for t in texts[a:b]]
                flat = [k for ks in each for k in ks]
                if flat:
                    halves = _pair(flat).view(np.int64)
                    owner = np.repeat(buckets[a:b], [len(ks) for ks in each])
                    order = np.lexsort((halves[:, 1], halves[:, 0], owner))
                    halves, owner = halves[order], owner[order]
                    at = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (halves[1:] != halves[:-1]).any(1))))
                    yield pa.RecordBatch.from_arrays([pa.array(owner[at]), pa.array(halves[at, 0]), pa.array(halves[at, 1]), pa.array(np.diff(np.concatenate((at, [len(owner)]))))], names=["bucket", "low", "high", "n"])

    rows = bucketed.select("_bucket", "_text").mapInArrow(count, "bucket bigint, low bigint, high bigint, n bigint")
    return rows.groupBy("bucket", "low", "high").agg(F.sum("n").alias("n"))


def build_index(lines: DataFrame) -> tuple[str, int]:
    """Writes an index over the distinct hashes of ``bucket_lines``; returns (folder, number of shards)."""
    counted = settle(lines.groupBy("low", "high").agg(F.sum("n").alias("n")))
    shards = max(1, min(MOST_SHARDS, math.ceil(counted.count() / SHARD_KEYS)))
    folder = new_folder(counted.sparkSession, "lines")

    def build(batches: Iterable[pa.RecordBatch]):
        rows = [b for b in batches if b.num_rows]
        if rows:
            low, high, n, shard = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(shard[:1]), pa.array([build_shard(low.view(np.uint64), high.view(np.uint64), n)], pa.binary())], names=["shard", "data"])

    dealt = counted.withColumn("shard", _shard(shards)).repartitionById(shards, F.col("shard"))
    dealt.mapInArrow(build, "shard int, data binary").write.partitionBy("shard").parquet(folder)
    return folder, shards


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("high"), F.lit(shards)).cast("int")


def open_shard(folder: str, shard: int) -> Shard:
    """A shard, read by whichever file system its folder names."""
    import pyarrow.dataset as ds

    system, path = file_system(folder)
    data = ds.dataset(f"{path}/shard={shard}", filesystem=system, format="parquet").to_table(columns=["data"]).column("data")
    return Shard(data[0].as_py())


def frequent_lines(lines: DataFrame, folder: str, shards: int, min_docs: int) -> DataFrame:
    """(bucket, low, high) of the lines that the index has in ``min_docs`` documents or more; a task probes one shard."""

    def probe(batches: Iterable[pa.RecordBatch]):
        shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = shard or open_shard(folder, batch.column("shard")[0].as_py())
            n = shard.probe(batch.column("low").to_numpy().view(np.uint64), batch.column("high").to_numpy().view(np.uint64))
            yield batch.select(["bucket", "low", "high"]).filter(pa.array(n >= min_docs))

    dealt = lines.select("bucket", "low", "high", _shard(shards).alias("shard")).repartitionById(shards, F.col("shard"))
    return dealt.mapInArrow(probe, "bucket bigint, low bigint, high bigint")


_RESULT = "text string, n_lines bigint, n_dropped bigint, kept_sha256 string"


def _result(texts: list[bytes], drop: set[bytes], min_chars: int) -> dict[str, pa.Array]:
    """Texts without the lines whose key hash is in ``drop``."""
    left, n, gone = [], [], []
    for t in texts:
        lines = t.split(b"\n")
        n.append(len(lines))
        if drop:
            lines = [x for x in lines if not (_long(k := line_key(x), min_chars) and key_hash(k) in drop)]
        gone.append(n[-1] - len(lines))
        left.append(b"\n".join(lines))
    return {"text": pa.array(left, pa.binary()).cast(pa.string()), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(gone, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())}


def drop_lines(documents: DataFrame, keep: dict[str, Column], text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document: ``keep``, text (without frequent lines), n_lines, n_dropped, kept_sha256.

    Frequent: a key of ``min_chars`` code points or more in ``min_docs`` documents or more; each row counts as
    a document, also one that repeats another.  A null or empty text is one empty line.  A document that loses all lines
    has an empty text.  Extra columns are ignored.
    """
    from pyspark.sql.types import StructType

    rows = with_text(documents, text, keep).withColumn("_text", F.coalesce("_text", F.lit("")))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_text", *keep), F.lit(buckets)).cast("bigint"))
    lines = settle(bucket_lines(rows, min_chars))
    hits = frequent_lines(lines, *build_index(lines), min_docs)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        drop = {x.tobytes() for x in np.column_stack([right.column("low").to_numpy(), right.column("high").to_numpy()])}
        texts = left.column("_text").combine_chunks()
        got = _result(as_bytes(texts), drop, min_chars)
        return pa.Table.from_arrays([*(left.column(f.name) for f in kept), *got.values()], names=[*(f.name for f in kept), *got])

    return rows.groupBy("_bucket").cogroup(hits.groupBy("bucket")).applyInArrow(finish, StructType(kept + StructType.fromDDL(_RESULT).fields))
