"""Removal of strings that an earlier document has, through suffix arrays of shards of text.

1. Documents become chunks of about CHUNK_BYTES in the shared folder.  Every window of ``width`` bytes has an anchor, the
   smallest hash of the KMER-byte strings in it, which equal windows share; consecutive windows with one anchor are a stretch.
2. A task per chunk counts its documents with each anchor; the counts go to shards by the anchor, and those with two documents or more
   come back to their chunks.
3. A task per chunk sends the stretches of those anchors, each distinct one once with its smallest and largest doc_id, to shards by
   the anchor, so equal windows meet.  A stretch of an anchor that has HOT different ones more than chunks is sent window by window,
   dealt by its bytes: a passage that a third of all documents share is some rows from each chunk, and what stands around it is spread.
4. A shard's different stretches become one text, whose suffixes external induced sorting puts in order with their common
   prefixes (``inducedsort``).  Neighbours that share ``width`` bytes are equal windows, whose smallest doc_id holds for all.
   Where an anchor has one stretch only, its windows have that stretch's documents without sorting.
5. The smallest doc_ids come back to the chunks, which find their stretches again and remove what they cover.

Texts are written once and never shuffled; stretches are, once.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clausewright.llm.inducedsort import Text, sort_suffixes
from clausewright.llm.shared import as_bytes, file_system, new_folder, settle, with_text
from clausewright.llm.wordhash import _BASE, _BASE_INV, _BYTE, _power_table, chunks, mix

#: Bytes of a chunk and of the text for which there is one shard; bytes hashed at a time; most windows of a stretch.
CHUNK_BYTES, SHARD_BYTES, PART_BYTES, LONGEST = 8 << 20, 8 << 20, 1 << 20, 64
#: Bytes of an anchor, at most; different stretches, beyond one a chunk, from which an anchor's windows are dealt one by one.
KMER, HOT = 28, 4096
_NO_ID = 2**63 - 1


def _blob(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in small types, compressed."""
    small = [a if isinstance(a, bytes) or not len(a) or a.min() < 0 else a.astype(np.min_scalar_type(int(a.max()))) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([a if isinstance(a, bytes) else (a.dtype.str, a.tobytes()) for a in small]))


def _arrays(data: bytes) -> list:
    return [a if isinstance(a, bytes) else np.frombuffer(a[1], a[0]) for a in pickle.loads(zstandard.ZstdDecompressor().decompress(data))]


def _sums(raw: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' hashes, from which that of any string follows."""
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * _power_table(_BASE, len(raw)), out=total[1:])
    return total


def _anchors(raw: np.ndarray, width: int, total: np.ndarray | None = None) -> np.ndarray:
    """The anchor of every window."""
    n, k = len(raw), min(KMER, width)
    total = _sums(raw) if total is None else total
    least = mix((total[k:] - total[:-k]) * _power_table(_BASE_INV, n - k + 1))
    span, windows = 1, width - k + 1
    while span < windows:
        step = min(span, windows - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least


def stretches(texts: list[bytes], width: int, hashed: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first window, windows, anchor) of the stretches of ``texts``, part by part; a long text is in several parts that overlap.

    ``hashed`` adds a hash of each stretch.
    """
    for a, b in chunks(texts, PART_BYTES):
        longest = max(map(len, texts[a:b])) if b - a == 1 else 0
        for start in range(0, max(longest, 1), PART_BYTES):
            parts = [texts[a][start : start + PART_BYTES + width - 1]] if longest else texts[a:b]
            raw = np.frombuffer(b"".join(parts), np.uint8)
            if len(raw) < width:
                continue
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            base = np.cumsum(size) - size
            total = _sums(raw)
            anchor = _anchors(raw, width, total)
            doc = np.repeat(np.arange(len(parts)), size)
            inside = doc[: len(anchor)] == doc[width - 1 :]
            cut = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1 : len(anchor)] != doc[: len(anchor) - 1]) | (inside[1:] != inside[:-1])))
            first = np.flatnonzero(cut)
            n = np.diff(np.append(first, len(anchor)))
            pieces = -(-n // LONGEST)  # runs of one string have one anchor
            if pieces.max() > 1:
                k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first, n = np.repeat(first, pieces) + k * LONGEST, np.minimum(np.repeat(n, pieces) - k * LONGEST, LONGEST)
            own = inside[first]
            first, n = first[own], n[own]
            found = a + doc[first], first - base[doc[first]] + start, n, anchor[first]
            yield (*found, mix((total[first + n + width - 1] - total[first]) * _power_table(_BASE_INV, len(raw))[first])) if hashed else found


def write_chunks(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> str:
    """A folder with a file for each chunk of ``rows``, whose last column is ``_text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            length = np.array([len(x) for x in as_bytes(b.column(b.num_columns - 1))], np.int64)
            at = np.empty(len(length), np.int64)
            for i, n in enumerate(length.tolist()):
                if size and size + n > chunk_bytes:
                    chunk, size = chunk + 1, 0
                size, at[i] = size + n, chunk
            yield b.append_column("_chunk", pa.array(at))

    folder = new_folder(rows.sparkSession, "chunks")
    rows.mapInArrow(run, StructType(rows.schema.fields + StructType.fromDDL("_chunk bigint").fields)).write.partitionBy("_chunk").parquet(folder)
    return folder


def _open(folder: str, chunk: int) -> pa.Table:
    import pyarrow.dataset as ds

    system, path = file_system(folder)
    return ds.dataset(f"{path}/_chunk={chunk}", filesystem=system, format="parquet").to_table()


def _texts(table: pa.Table) -> list[bytes]:
    return as_bytes(table["_text"].combine_chunks()) if len(table) else []


def _ids(table: pa.Table) -> np.ndarray:
    """doc_ids, with null after all others."""
    return table["_id"].fill_null(_NO_ID).to_numpy().astype(np.int64)


def count_anchors(chunk_ids: DataFrame, folder: str, width: int, shards: int) -> DataFrame:
    """(shard, chunk, data): a chunk's anchors in a shard, as 32 bits of them in order, in how many documents each is, and how many different stretches it has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in b.column(0).to_pylist():
                anchors, docs, forms = [], [], []
                for doc, _, _, anchor, form in stretches(_texts(_open(folder, chunk)), width, hashed=True):
                    by = np.lexsort((form, anchor))
                    anchor, doc, form = anchor[by], doc[by], form[by]
                    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (form[1:] != form[:-1])))[: len(doc)]
                    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))[: len(doc)])
                    # documents of a part are known by smallest and largest: none other is asked than whether there are two
                    few = (np.maximum.reduceat(doc, first) > np.minimum.reduceat(doc, first)) + 1 if len(doc) else first
                    several = np.zeros(len(doc), np.int64)
                    several[first] = few
                    anchors.append(anchor[new])
                    docs.append(several[new])
                    forms.append(form[new])
                if not anchors:
                    continue
                anchor, n, form = np.concatenate(anchors), np.concatenate(docs), np.concatenate(forms)
                key = _shard(anchor, shards).astype(np.uint64) << np.uint64(32) | anchor & np.uint64(0xFFFFFFFF)
                by = np.lexsort((form, key))
                anchor, n, form, key = anchor[by], n[by], form[by], key[by]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
                if not len(first):
                    continue
                different = np.add.reduceat(np.concatenate(([1], ((key[1:] != key[:-1]) | (form[1:] != form[:-1])).astype(np.int64))), first)
                anchor, n = anchor[first], np.add.reduceat(n, first)
                shard = _shard(anchor, shards)
                edges = np.searchsorted(shard, np.arange(shards + 1))
                some = np.flatnonzero(np.diff(edges))
                data = [_blob(anchor[i:j] & np.uint64(0xFFFFFFFF), n[i:j], different[i:j]) for i, j in zip(edges[some], edges[some + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), chunk)), pa.array(data, pa.binary())], names=["shard", "chunk", "data"])

    return chunk_ids.mapInArrow(run, "shard int, chunk bigint, data binary")


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def shared_anchors(counts: DataFrame, hot: int = HOT) -> DataFrame:
    """(shard, chunk, data) as count_anchors, with those anchors alone that two documents or more have, and which of them are hot.

    A chunk sends each different stretch once, so an anchor has as many rows as its chunks' counts of them together.  It is hot where
    these are ``hot`` more than its chunks: a passage that stands in the same words in very many documents is not, a passage between
    ever different words is.
    """

    def run(t: pa.Table) -> pa.Table:
        parts = [_arrays(x) for x in t["data"].to_pylist()]
        anchor, n, forms = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3))
        known, own = np.unique(anchor, return_inverse=True)
        total, rows = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        np.add.at(total, own, n)
        np.add.at(rows, own, forms - 1)
        edges, data = np.cumsum([0, *(len(p[0]) for p in parts)]), []
        for k, p in enumerate(parts):
            at = own[edges[k] : edges[k + 1]]
            shared = total[at] > 1
            data.append(_blob(p[0][shared], (rows[at[shared]] >= hot).astype(np.int64)))
        return pa.table({"shard": t["shard"], "chunk": t["chunk"], "data": pa.array(data, pa.binary())})

    return counts.groupBy("shard").applyInArrow(run, "shard int, chunk bigint, data binary")


def _dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """``df`` by ``key`` in as many tasks as groups: by its few bytes adaptive execution would put costly groups into one task."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(20_000, max(least, groups)), key)


class _Found:
    """A chunk's stretches that may repeat: document, first window and windows of each, and which of the distinct ones it is."""

    def __init__(self, texts: list[bytes], hits: pa.Table, width: int, shards: int):
        known, hot = [], []
        for s, data in zip(hits["shard"].to_pylist(), hits["data"].to_pylist(), strict=True):
            anchor, is_hot = _arrays(data)
            known.append(np.uint64(s) << np.uint64(32) | anchor.astype(np.uint64))
            hot.append(is_hot.astype(bool))
        key = np.concatenate([*known, np.zeros(0, np.uint64)])
        by = np.argsort(key)
        key, hot = key[by], np.concatenate([*hot, np.zeros(0, bool)])[by]
        docs, firsts, sizes, dealt, index = [], [], [], [], {}
        which: list[int] = []
        for doc, first, n, anchor in stretches(texts, width) if len(key) else ():
            own = _shard(anchor, shards).astype(np.uint64) << np.uint64(32) | anchor & np.uint64(0xFFFFFFFF)
            at = np.minimum(np.searchsorted(key, own), len(key) - 1)
            some = np.flatnonzero(key[at] == own)
            doc, first, n, shard, single = doc[some], first[some], n[some], (own[some] >> np.uint64(32)).astype(np.int64), hot[at[some]]
            if single.any():
                times = np.where(single, n, 1)
                k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                doc, shard, single = np.repeat(doc, times), np.repeat(shard, times), np.repeat(single, times)
                first, n = np.repeat(first, times) + k, np.where(single, 1, np.repeat(n, times))
            for d, f, m, s, one in zip(doc.tolist(), first.tolist(), n.tolist(), shard.tolist(), single.tolist(), strict=True):
                data = texts[d][f : f + m + width - 1]
                k = index.get(data)
                if k is None:
                    k = index[data] = len(index)
                    dealt.append(int.from_bytes(hashlib.blake2b(data, digest_size=6).digest()) % shards if one else s)
                which.append(k)
            docs.append(doc)
            firsts.append(first)
            sizes.append(n)
        join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
        self.doc, self.first, self.windows, self.which = join(docs), join(firsts), join(sizes), np.array(which, np.int64)
        self.distinct, self.shard = list(index), np.array(dealt, np.int64)


def send_stretches(hits: DataFrame, folder: str, width: int, shards: int, n_chunks: int = 1) -> DataFrame:
    """(shard, chunk, data): a chunk's distinct stretches for a shard: their numbers, lengths, texts, smallest and largest doc_ids."""

    def run(t: pa.Table) -> pa.Table:
        chunk = t["chunk"][0].as_py()
        table = _open(folder, chunk)
        found, ids = _Found(_texts(table), t, width, shards), _ids(table)
        least, most = np.full(len(found.distinct), _NO_ID), np.full(len(found.distinct), -_NO_ID - 1)
        np.minimum.at(least, found.which, ids[found.doc])
        np.maximum.at(most, found.which, ids[found.doc])
        order = np.argsort(found.shard, kind="stable")
        some, edges = np.unique(found.shard[order], return_index=True)
        data = []
        for part in np.split(order, edges[1:]) if len(order) else ():
            texts = [found.distinct[k] for k in part.tolist()]
            wide = np.flatnonzero(least[part] != most[part])
            data.append(_blob(np.diff(part, prepend=0), np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts), least[part], wide, most[part][wide]))
        return pa.table({"shard": pa.array(some, pa.int32()), "chunk": pa.array(np.full(len(some), chunk)), "data": pa.array(data, pa.binary())})

    return _dealt(hits, "chunk", n_chunks).groupBy("chunk").applyInArrow(run, "shard int, chunk bigint, data binary")


def smallest_ids(texts: list[bytes], least: np.ndarray, width: int) -> list[np.ndarray]:
    """For each distinct text the smallest of ``least`` over all texts with each of its windows, by a suffix array of all of them.

    Texts of an anchor that no other one has aren't sorted.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    start = np.cumsum(size) - size
    anchor = _anchors(raw, width)[start]
    by = np.argsort(anchor, kind="stable")
    same = anchor[by][1:] == anchor[by][:-1]
    alone = np.ones(len(texts), bool)
    alone[by[np.flatnonzero(same)]] = alone[by[np.flatnonzero(same) + 1]] = False
    out = [least[k : k + 1] for k in range(len(texts))]
    many = np.flatnonzero(~alone)
    if len(many):
        top = int(raw.max()) + 2
        text = np.zeros(int(size[many].sum()) + len(many) + 1, np.uint8 if top <= 256 else np.uint16)
        at = np.cumsum(size[many] + 1) - size[many]  # a separator before each, and one at the end
        inside = np.arange(size[many].sum()) - np.repeat(np.cumsum(size[many]) - size[many], size[many])
        text[np.repeat(at, size[many]) + inside] = raw[np.repeat(start[many], size[many]) + inside].astype(text.dtype) + 1
        order, lcp = sort_suffixes(Text(text, top, width, separated=True))
        windows = size[many] - width + 1
        owner = np.full(len(text), -1, np.int32)
        first = np.cumsum(windows) - windows
        place = np.repeat(at, windows) + np.arange(windows.sum()) - np.repeat(first, windows)
        owner[place] = np.repeat(np.arange(len(many)), windows)
        # a suffix that isn't a window shares less than a window with its neighbours
        is_window = np.flatnonzero(owner[order] >= 0)
        new = np.flatnonzero(lcp[is_window] < width)
        held = np.minimum.reduceat(least[many][owner[order[is_window]]], new)
        value = np.empty(len(text), np.int64)
        value[order[is_window]] = np.repeat(held, np.diff(np.append(new, len(is_window))))
        for j, k in enumerate(many.tolist()):
            out[k] = value[at[j] : at[j] + windows[j]]
    return out


def sort_shards(sent: DataFrame, width: int, shards: int = 1) -> DataFrame:
    """(chunk, data): for a chunk's stretches that an earlier document has in part or whole, the smallest doc_id from window to window."""

    def run(t: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        parts, lowest = [], []
        for data in t["data"].to_pylist():
            part, size, text, least, wide, most = _arrays(data)
            ends = np.cumsum(size, dtype=np.int64)
            which = np.empty(len(size), np.int64)
            least = least.astype(np.int64)
            for i, (a, b, low) in enumerate(zip((ends - size).tolist(), ends.tolist(), least.tolist(), strict=True)):
                piece = text[a:b]
                k = index.get(piece)
                if k is None:
                    k = index[piece] = len(index)
                    lowest.append(low)
                elif low < lowest[k]:
                    lowest[k] = low
                which[i] = k
            top = least.copy()
            top[wide] = most
            parts.append((np.cumsum(part, dtype=np.int64), which, top))
        found = smallest_ids(list(index), np.array(lowest, np.int64), width)
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate(found)
        least = np.minimum.reduceat(flat, np.cumsum(n) - n)
        out = []
        for numbers, which, top in parts:
            some = np.flatnonzero(least[which] < top)
            numbers, which = numbers[some], which[some]
            k = n[which]
            at = np.repeat(np.cumsum(n)[which] - n[which] - np.cumsum(k) + k, k) + np.arange(k.sum())
            values, own = flat[at], np.repeat(np.arange(len(which)), k)
            new = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (own[1:] != own[:-1]))))[: len(values)]
            runs = np.bincount(own[new], minlength=len(which))
            out.append(_blob(np.diff(numbers, prepend=0), runs, np.diff(np.append(new, len(values))), values[new]))
        return pa.table({"chunk": t["chunk"], "data": pa.array(out, pa.binary())})

    return _dealt(sent, "shard", shards).groupBy("shard").applyInArrow(run, "chunk bigint, data binary")


_RESULT = "text string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _covered(texts: list[bytes], ids: np.ndarray, found: _Found, results: list[bytes], width: int) -> np.ndarray:
    """Which of all bytes of the chunk go."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(size) - size
    edge = np.zeros(int(size.sum()) + 1, np.int32)
    n = np.zeros(len(found.distinct), np.int64)
    lengths, values = [], []
    for data in results:
        numbers, runs, length, value = _arrays(data)
        numbers = np.cumsum(numbers, dtype=np.int64)
        n[numbers] = runs
        lengths.append((np.repeat(numbers, runs), length.astype(np.int64), value.astype(np.int64)))
    if not lengths:
        return np.zeros(int(size.sum()), bool)
    number, length, value = (np.concatenate(x) for x in zip(*lengths, strict=True))
    order = np.argsort(number, kind="stable")
    length, value = length[order], value[order]
    first = np.cumsum(n) - n
    use = np.flatnonzero(n[found.which])
    k = n[found.which[use]]
    at = np.repeat(first[found.which[use]] - np.cumsum(k) + k, k) + np.arange(k.sum())
    own = np.repeat(use, k)
    run, low = length[at], value[at]
    if len(run):
        before = np.cumsum(run) - run
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        offset = before - np.repeat(before[begin], np.diff(np.append(begin, len(own))))
        # a stretch that no other text of its anchor has got one value for all windows
        run = np.where((k[np.searchsorted(use, own)] == 1), found.windows[own], run)
        gone = low < ids[found.doc[own]]
        a = base[found.doc[own]] + found.first[own] + offset
        np.add.at(edge, a[gone], 1)
        np.add.at(edge, (a + run + width - 1)[gone], -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _cut(texts: list[bytes], gone: np.ndarray) -> dict[str, pa.Array]:
    left, removed, spans, at = [], [], [], 0
    for t in texts:
        own = gone[at : at + len(t)]
        at += len(t)
        n = int(np.count_nonzero(own))
        removed.append(n)
        spans.append(int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if n else 0)
        left.append(np.frombuffer(t, np.uint8)[~own].tobytes() if n else t)
    text = pa.array([x.decode("utf-8", "replace") for x in left], pa.string())
    return {"text": text, "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())}


def _chunk_ids(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    ids = settle(spark.read.parquet(folder).select(F.col("_chunk").cast("bigint").alias("chunk")).distinct())
    n = ids.count()
    return ids.repartition(max(1, min(20_000, n)), "chunk"), n


def remove_repeats(documents: DataFrame, keep: dict[str, Column], text: str = "text", doc_id: str = "doc_id", width: int = 50, shards: int | None = None, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: ``keep``, text (what is left), n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte of a ``width``-byte string that also starts in a document with a smaller doc_id, judged on the
    input.  Rows of one doc_id are no reason to remove from each other; a null doc_id is after all others, so of equal texts without one none
    goes.  A null text is empty; texts shorter than ``width`` stay.  Strings are bytes, so a character may be cut: ``text`` then has
    U+FFFD, and kept_sha256 is that of the bytes.  A text of any length is read part by part.  An empty table gives no rows;
    extra columns are ignored.
    """
    spark = documents.sparkSession
    rows = with_text(documents.withColumn("_row_id", F.col(doc_id).cast("bigint")), text, {f"_k{i}": c for i, c in enumerate(keep.values())} | {"_id": F.col("_row_id")})
    if shards is None:
        shards = max(1, math.ceil(rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0] / SHARD_BYTES))
    kept = [f for f in documents.select(*[c.alias(n) for n, c in keep.items()]).schema.fields]
    if rows.isEmpty():
        return spark.createDataFrame([], StructType(kept + StructType.fromDDL(_RESULT).fields))
    folder = write_chunks(rows, chunk_bytes)
    chunk_ids, n_chunks = _chunk_ids(spark, folder)
    hits = settle(shared_anchors(count_anchors(chunk_ids, folder, width, shards), hot))
    results = sort_shards(send_stretches(hits, folder, width, shards, n_chunks), width, shards)

    def finish(t: pa.Table) -> pa.Table:
        table = _open(folder, t["chunk"][0].as_py())
        texts, kind = _texts(table), t["kind"].to_numpy()
        found = _Found(texts, t.filter(pa.array(kind == 1)), width, shards)
        got = _cut(texts, _covered(texts, _ids(table), found, t.filter(pa.array(kind == 2))["data"].to_pylist(), width))
        columns = [table[f"_k{i}"] for i in range(len(kept))]
        return pa.Table.from_arrays([*columns, *got.values()], names=[*(f.name for f in kept), *got])

    own = lambda df, kind: df.select("chunk", F.lit(kind).alias("kind"), (F.col("shard") if kind == 1 else F.lit(None).cast("int")).alias("shard"), (F.col("data") if kind else F.lit(None).cast("binary")).alias("data"))
    every = own(chunk_ids, 0).unionByName(own(hits, 1)).unionByName(own(results, 2))
    return _dealt(every, "chunk", n_chunks).groupBy("chunk").applyInArrow(finish, StructType(kept + StructType.fromDDL(_RESULT).fields))
