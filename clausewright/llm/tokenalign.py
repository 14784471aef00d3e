"""Cross-tokenizer alignment: two tokenizers' tokens of each text, linked where their bytes overlap, weighted by the corpus.

1. One pass over whole texts.  Both tokenizers always start a token at a lone space or line feed between other
   characters, so a text falls into stretches, and each distinct stretch is encoded and linked once per worker.  About
   CHUNK_BYTES of texts are a chunk; it leaves a row for each document, and its postings: for each pair of ids the
   documents of the chunk that have it linked, and how often.  Postings are dealt by the A id, the side id, into shards,
   in sorted rows of at most POSTINGS entries.  All of it is a table in the shared folder.
2. Counts.  A pair's documents in each chunk go to the shard of its A id, where sorted streams are added up: a pair that a third of
   all documents have is one number from each chunk.  The shard's counts, and which of them are their A id's highest, are a file.
3. Postings, ranged by shard and chunk so that a shard with a hot id spreads over tasks, meet the file of their shard; spilling is Spark's
   sort.  Each row of postings gives what it adds to its documents.
4. Those contributions meet the documents by chunk and are summed.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clausewright.llm.packing import _by_rank, _byte_letters
from clausewright.llm.shared import as_bytes, file_system, new_folder, with_text
from clausewright.llm.wordhash import chunks, mix

#: Bytes of text in a chunk and documents in it at most; entries in a row of postings; bytes of text for which there is one shard.
CHUNK_BYTES, CHUNK_ROWS, POSTINGS, SHARD_BYTES = 4 << 20, 1 << 16, 1 << 16, 32 << 20
#: Distinct stretches that a worker knows before it starts anew.
KNOWN = 400_000
#: A lone space or line feed between other characters: before the space, and on both sides of the line feed.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
#: Where white space is more than that, or may be; other texts are cut by replacing.
_ODD = re.compile(r"[^\n\x20-\x7e¡-¬®-ɏ]|[ \n][ \n]|^[ \n]|[ \n]$")


def stretches(text: str) -> list[str]:
    """A space and the text, cut where both tokenizers start anew."""
    if _ODD.search(text):
        return _CUT.split(" " + text)
    return f" {text}".replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")[1:]


class Tokenizers:
    """Both tokenizers: ids of a stretch, and the bytes of an id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        special = [t.content for t in a.get_added_tokens_decoder().values()]
        fast = _by_rank(json.loads(a.to_str())["model"], special)
        self.encode_a = fast.encode_ordinary if fast else lambda x: a.encode(x, add_special_tokens=False).ids
        letters = {chr(v): k for k, v in _byte_letters().items()}
        self.a_bytes = {i: bytes(letters[c] for c in piece) for piece, i in a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in piece)}
        self.a_size = {i: len(x) for i, x in self.a_bytes.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.b_size = [len(x) for x in self.b_bytes]
        self.names = [str(i) for i in range(1 + max(len(self.b_bytes), *self.a_bytes))]

    def encode_b(self, stretch: str) -> list[int]:
        """Ids in a text: a space before the text is B's own, and other stretches follow something, as after a line feed."""
        return self.b.encode(stretch[1:]) if stretch.startswith(" ") else self.b.encode("\n" + stretch)[2:]


class Known(dict):
    """Number of each stretch, and by number what it holds; -1 where a tokenizer changes bytes."""

    def __init__(self, tokenizers: Tokenizers):
        super().__init__()
        self.t = tokenizers
        self.n_a, self.n_b, self.n_groups, self.n_links, self.n_pairs, self.pairs, self.times = (array("q") for _ in range(7))
        self.groups: list[bytes] = []

    def __missing__(self, stretch: str) -> int:
        t = self.t
        a, b = t.encode_a(stretch), t.encode_b(stretch)
        data = stretch.encode()
        if b"".join([t.a_bytes[x] for x in a]) != data or b"".join([t.b_bytes[x] for x in b]) != data:
            self[stretch] = -1
            return -1
        i, j, n_links, groups, times = 0, 0, 0, [], {}
        while i < len(a):  # a group: tokens of both up to the next common end
            x, y = a[i], b[j]
            end_a, end_b, first_i, first_j = t.a_size[x], t.b_size[y], i, j
            while True:
                n_links += 1
                pair = x << 20 | y
                times[pair] = times.get(pair, 0) + 1
                if end_a == end_b:
                    break
                if end_a < end_b:
                    i += 1
                    x = a[i]
                    end_a += t.a_size[x]
                else:
                    j += 1
                    y = b[j]
                    end_b += t.b_size[y]
            i, j = i + 1, j + 1
            groups.append(f"{','.join([t.names[x] for x in a[first_i:i]])}|{','.join([t.names[y] for y in b[first_j:j]])}")
        k = self[stretch] = len(self.groups)
        self.groups.append(";".join(groups).encode())
        self.n_a.append(len(a))
        self.n_b.append(len(b))
        self.n_groups.append(len(groups))
        self.n_links.append(n_links)
        self.n_pairs.append(len(times))
        self.pairs.extend(times)
        self.times.extend(times.values())
        return k


_DOCUMENT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_POSTING = "_chunk bigint, _doc int, _shard int, _data binary"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, each in the smallest kind that holds it."""
    out = []
    for c in columns:
        top = int(c.max(initial=0))
        kind = next(k for k in "BHIQ" if top < 1 << 8 * np.dtype(k).itemsize)
        out.append(f"{kind}{len(c)} ".encode() + c.astype(f"<{np.dtype(kind).str[1:]}").tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for _ in range(columns):
        space = data.index(b" ", at)
        kind, n = np.dtype(chr(data[at])), int(data[at + 1 : space])
        out.append(np.frombuffer(data, kind, n, space + 1).astype(np.int64))
        at = space + 1 + n * kind.itemsize
    return out


def _shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return (mix(a.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _postings(docs: np.ndarray, numbers: np.ndarray, known: Known, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, packed postings) of stretches ``numbers`` in documents ``docs``: pairs, documents of each, documents, times."""
    n_pairs, pairs, times = (np.frombuffer(x, np.int64) for x in (known.n_pairs, known.pairs, known.times))
    first = np.concatenate(([0], np.cumsum(n_pairs)))
    both, often = np.unique(docs << 32 | numbers, return_counts=True)
    doc, number = both >> 32, both & 0xFFFFFFFF
    size = n_pairs[number]
    at = np.repeat(first[number] - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(size.sum())
    key, n, doc = pairs[at], times[at] * np.repeat(often, size), np.repeat(doc, size)
    for s in range(shards) if shards == 1 else np.unique(shard := _shard_of(key >> 20, shards)).tolist():
        own = slice(None) if shards == 1 else shard == s
        k, m, d = key[own], n[own], doc[own]
        order = np.lexsort((d, k))
        k, m, d = k[order], m[order], d[order]
        new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]))))
        k, d, m = k[new], d[new], np.add.reduceat(m, new)
        for a in range(0, len(k), POSTINGS):
            part = k[a : a + POSTINGS]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            yield s, _pack(np.diff(part[at], prepend=0), np.diff(np.append(at, len(part))), d[a : a + POSTINGS], m[a : a + POSTINGS])


def _encode(rows: DataFrame, a_path: str, b_path: str, shards: int) -> DataFrame:
    """A row per document with its numbers, and rows of postings in which all other columns are null."""
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    names = [*(f.name for f in kept), *(c.split()[0] for c in f"{_DOCUMENT}, {_POSTING}".split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizers = Tokenizers(a_path, b_path)
        known, chunk = Known(tokenizers), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = as_bytes(batch.column(batch.num_columns - 1))
            for first, last in chunks(texts, CHUNK_BYTES):
                for a in range(first, last, CHUNK_ROWS):
                    b, chunk = min(last, a + CHUNK_ROWS), chunk + 1
                    if len(known) > KNOWN:
                        known = Known(tokenizers)
                    numbers = [list(map(known.__getitem__, stretches(t.decode()))) if t else [] for t in texts[a:b]]
                    numbers = [[] if -1 in x else x for x in numbers]
                    sha = [hashlib.sha256(b";".join([known.groups[k] for k in x])).hexdigest() if x else "" for x in numbers]
                    flat = np.fromiter((k for x in numbers for k in x), np.int64)
                    docs = np.repeat(np.arange(b - a), [len(x) for x in numbers])
                    sums = []
                    for column in (known.n_a, known.n_b, known.n_groups, known.n_links):
                        total = np.zeros(b - a, np.int64)
                        np.add.at(total, docs, np.frombuffer(column, np.int64)[flat] if len(flat) else 0)
                        sums.append(pa.array(total))
                    none = [pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(len(kept))), *sums, pa.array(sha, pa.string()), pa.array(np.full(b - a, chunk)), pa.array(np.arange(b - a, dtype=np.int32)), *none], names=names)
                    found = list(_postings(docs, flat, known, shards)) if len(flat) else []
                    n = len(found)
                    if n:
                        empty = [pa.nulls(n, batch.column(c).type) for c in range(len(kept))] + [pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, pa.string())]
                        yield pa.RecordBatch.from_arrays([*empty, pa.array(np.full(n, chunk)), pa.nulls(n, pa.int32()), pa.array([s for s, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=names)

    nullable = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)) if kept else StructType()
    return rows.mapInArrow(run, StructType(nullable.fields + StructType.fromDDL(f"{_DOCUMENT}, {_POSTING}").fields))


def _added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the sums of their counts."""
    k, n = np.concatenate(pairs), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[at], np.add.reduceat(n, at)


def write_counts(postings: DataFrame, shards: int) -> str:
    """A folder with a file for each shard: its pairs, in how many documents each is, and whether its A id has none in more."""

    def light(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for x in b.column("_data").to_pylist():
                k, n, _, _ = _unpack(x, 4)
                data.append(_pack(k, n))
            yield pa.RecordBatch.from_arrays([b.column("_shard"), pa.array(data, pa.binary())], names=["_shard", "_data"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pairs, counts, held, room = None, [], [], 0, 1 << 21
        for b in batches:
            for x in b.column("_data").to_pylist():
                shard = b.column("_shard")[0]
                k, n = _unpack(x, 2)
                pairs.append(np.cumsum(k))
                counts.append(n)
                held += len(k)
                if held > room:
                    k, n = _added(pairs, counts)
                    pairs, counts, held, room = [k], [n], len(k), max(room, 2 * len(k))
        if pairs:
            k, n = _added(pairs, counts)
            at = np.flatnonzero(np.concatenate(([True], k[1:] >> 20 != k[:-1] >> 20)))
            best = n == np.repeat(np.maximum.reduceat(n, at), np.diff(np.append(at, len(k))))
            yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int32()), pa.array([_pack(np.diff(k, prepend=0), n, best.astype(np.int64))], pa.binary())], names=["_shard", "_data"])

    folder = new_folder(postings.sparkSession, "pairs")
    rows = postings.select("_shard", "_data").mapInArrow(light, "_shard int, _data binary").repartitionById(shards, F.col("_shard"))
    rows.mapInArrow(add, "_shard int, _data binary").write.partitionBy("_shard").parquet(folder)
    return folder


def _open(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import pyarrow.dataset as ds

    system, path = file_system(folder)
    k, n, best = _unpack(ds.dataset(f"{path}/_shard={shard}", filesystem=system, format="parquet").to_table(columns=["_data"])["_data"][0].as_py(), 3)
    return np.cumsum(k), n, best


def contributions(postings: DataFrame, folder: str) -> DataFrame:
    """(_chunk, _data): documents of a chunk, and what a row of postings adds to their n_best and count_sum."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, table = None, None
        for b in batches:
            out = []
            for s, data in zip(b.column("_shard").to_pylist(), b.column("_data").to_pylist(), strict=True):
                if s != shard:
                    shard, table = s, _open(folder, s)
                k, n, doc, times = _unpack(data, 4)
                at = np.repeat(np.searchsorted(table[0], np.cumsum(k)), n)
                some, own = np.unique(doc, return_inverse=True)
                best, total = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
                np.add.at(best, own, times * table[2][at])
                np.add.at(total, own, times * table[1][at])
                out.append(_pack(some, best, total))
            yield pa.RecordBatch.from_arrays([b.column("_chunk"), pa.array(out, pa.binary())], names=["_chunk", "_data"])

    tasks = max(postings.rdd.getNumPartitions(), int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = postings.select("_chunk", "_shard", "_data").repartitionByRange(tasks, "_shard", F.xxhash64("_chunk", "_data")).sortWithinPartitions("_shard")
    return dealt.mapInArrow(run, "_chunk bigint, _data binary")


def align(documents: DataFrame, keep: dict[str, Column], a_path: str, b_path: str, text: str = "text", shards: int | None = None) -> DataFrame:
    """Per document: ``keep``, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    A encodes a space and the text, B the text, to which it adds that space; strings of special tokens in texts are plain
    text.  Null and empty texts, and those whose tokens don't give back their bytes, have no tokens: zeros, and an empty
    groups_sha256.  Each row counts as a document, also one that repeats another.  A text of any length is encoded whole; a
    stretch without spaces is one call of each tokenizer.  An empty table gives no rows; extra columns are ignored.  ``shards`` is
    for tests: one for each SHARD_BYTES of text otherwise.
    """
    rows = with_text(documents, text, keep)
    if shards is None:
        shards = max(1, math.ceil(rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0] / SHARD_BYTES))
    folder = new_folder(documents.sparkSession, "aligned")
    _encode(rows, a_path, b_path, shards).write.parquet(folder)
    table = documents.sparkSession.read.parquet(folder)
    postings = table.where("_data IS NOT NULL").select("_chunk", "_shard", "_data")
    added = contributions(postings, write_counts(postings, shards))
    names = [n for n in table.columns if n not in ("_shard", "_data")]
    found = table.where("_doc IS NOT NULL").select(*names)
    kept = [f for f in found.schema.fields if not f.name.startswith("_") or f.name in keep]

    def finish(docs: pa.Table, parts: pa.Table) -> pa.Table:
        best, total = np.zeros((2, (docs["_doc"].to_numpy().max(initial=-1)) + 1), np.int64)
        for x in parts["_data"].to_pylist():
            at, b, t = _unpack(x, 3)
            best[at] += b
            total[at] += t
        own = docs["_doc"].to_numpy()
        return docs.select([f.name for f in kept]).append_column("n_best", pa.array(best[own])).append_column("count_sum", pa.array(total[own]))

    return found.groupBy("_chunk").cogroup(added.groupBy("_chunk")).applyInArrow(finish, StructType(kept + StructType.fromDDL("n_best bigint, count_sum bigint").fields))
