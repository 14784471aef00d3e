"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all 13-word windows of the benchmark items (an item of fewer words is one window).
Patterns of one length share a SHIFT table, keyed by blocks of three words: how far the search may
jump when it sees that block at the window's end, and a full jump where no pattern has the block.
Shift 0 leads to the bucket of patterns that end in the block, and a direct comparison of all their
words confirms.  Most positions of clean text are jumped over.

Tables are built from the benchmark alone, in blocks of about ``block_words`` words.  Spark writes the blocks to the
shared folder and workers read them there, so the driver never holds a benchmark; a worker builds the tables of a block
once and keeps those of a few blocks.  With more blocks than that it takes a larger stretch of documents through one
block after the other, so what it holds doesn't grow with a benchmark either.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import CHUNK_BYTES, file_system, new_folder, text_map, with_text

#: ASCII letters and digits and everything beyond ASCII are word bytes; A-Z is lower-cased.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return text.translate(_TO_WORDS).split()


class Patterns:
    """Windows of items, searched by Wu-Manber."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = 13, block: int = 3):
        by_length: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                by_length[size][tuple(words[i : i + size])].add(item)
        self.tables = [self._table(size, patterns, min(block, size)) for size, patterns in sorted(by_length.items())]

    @staticmethod
    def _table(size: int, patterns: dict, block: int):
        shift: dict[tuple[bytes, ...], int] = {}
        buckets: dict[tuple[bytes, ...], dict] = defaultdict(dict)
        for words, items in patterns.items():
            for end in range(block, size + 1):
                key = words[end - block : end]
                shift[key] = min(shift.get(key, size), size - end)
            buckets[words[-block:]][words] = tuple(items)
        return size, block, shift, dict(buckets)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans (start, stop) of words inside occurrences, and the items that occur."""
        spans, found, n = [], set(), len(words)
        for size, block, shift, buckets in self.tables:
            jump, pos, get = size - block + 1, size, shift.get
            while pos <= n:
                key = tuple(words[pos - block : pos])
                step = get(key, jump)
                if step:
                    pos += step
                    continue
                if items := buckets[key].get(tuple(words[pos - size : pos])):
                    spans.append((pos - size, pos))
                    found.update(items)
                pos += 1
        return spans, found


def covered(spans: list[tuple[int, int]]) -> int:
    """Number of positions in the union of spans."""
    total, upto = 0, 0
    for a, b in sorted(spans):
        if b > upto:
            total += b - max(a, upto)
            upto = b
    return total


#: Blocks whose tables a worker keeps, and the bytes of texts that pass through one block after the other beyond that.
HELD, STRETCH = 4, 32 << 20
_built: OrderedDict[str, Patterns] = OrderedDict()


def _write_blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> tuple[str, int]:
    """The folder with a part for each block of items, and their number."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    words = rows.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(words / block_words))
    folder = new_folder(benchmark.sparkSession, "benchmark")
    rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(folder)
    return folder, blocks


def _patterns(folder: str, block: int, window: int) -> Patterns:
    """The tables of a block, from the worker's own or built from its file."""
    import pyarrow.dataset as ds

    at = f"{folder}/block={block}:{window}"
    if at not in _built:
        while len(_built) >= HELD:
            _built.popitem(last=False)
        system, path = file_system(folder)
        kinds = pa.schema([("item", pa.string()), ("text", pa.string()), ("block", pa.int64())])
        rows = ds.dataset(path, schema=kinds, filesystem=system, format="parquet", partitioning=ds.partitioning(pa.schema([kinds.field("block")]), flavor="hive")).to_table(columns=["item", "text"], filter=ds.field("block") == block)
        _built[at] = Patterns([(k, t.encode()) for k, t in zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True)], window)
    _built.move_to_end(at)
    return _built[at]


def decontaminate(documents: DataFrame, benchmark: DataFrame, keep: dict[str, Column], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 200_000) -> DataFrame:
    """Per document: ``keep``, n_words, n_hit, n_items, items_sha256, spans, contaminated.

    A null or empty text has no words and is clean; null or wordless items have no windows; repeated
    items and documents count each; an empty benchmark leaves all clean.  Extra columns are ignored.
    All documents are scanned whole in one pass, with no shuffle.  Item ids that are null are left out of ``n_items``.
    """
    folder, blocks = _write_blocks(benchmark, item, item_text, block_words)
    stretch = STRETCH if blocks > HELD else CHUNK_BYTES
    span_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def scan(texts: list[bytes]) -> dict[str, pa.Array]:
        spans, names, counts = [[] for _ in texts], [set() for _ in texts], [0] * len(texts)
        for block in range(blocks):
            patterns = _patterns(folder, block, window)
            for i, t in enumerate(texts):
                words = words_of(t)
                counts[i] = len(words)
                hit, found = patterns.search(words)
                spans[i] += hit
                names[i] |= found
        listed = [sorted(x for x in n if x is not None) for n in names]
        hits = [covered(s) for s in spans]
        return {
            "n_words": pa.array(counts, pa.int64()),
            "n_hit": pa.array(hits, pa.int64()),
            "n_items": pa.array(map(len, listed), pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], pa.string()),
            "spans": pa.array([[{"a": x, "b": y} for x, y in sorted(s)] for s in spans], span_type),
            "contaminated": pa.array([h > 0 and 20 * h >= n for h, n in zip(hits, counts, strict=True)], pa.bool_()),
        }

    return text_map(with_text(documents, text, keep), "_text", scan, _OUT, stretch)


_OUT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, spans array<struct<a:bigint,b:bigint>>, contaminated boolean"
