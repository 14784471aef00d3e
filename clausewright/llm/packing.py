"""Best-fit packing after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens.  A packing depends on the pieces' lengths alone, so
the instance is the histogram of lengths: at most ``capacity`` counts however many documents there are.
On it the driver

1. fixes sets that dominate all alternatives for their largest piece: that piece alone when nothing fits
   beside it, or with the one piece that fills the sequence or is the largest of those of which only one fits, or
   with two pieces when only two fit, one is the largest that fits and no two larger than the other fit together
   (Martello and Toth's criterion);
2. packs what is left by best-fit decreasing, many equal sequences at a time.

The outcome is a list of patterns with multiplicities, bounded by the capacity too.  Pieces then learn
their rank among pieces of their length and so their sequence and place, without meeting in one task: n pieces
of a length are dealt into about sqrt(n) groups, which are ranked each by itself, and counts of groups are summed
up, so a length that a third of all pieces have is spread at any size.
"""

from __future__ import annotations

import bisect
import json
import math
import os
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm.shared import as_bytes, settle
from clausewright.llm.wordhash import chunks

#: Text in which only these occur is cut where the tokenizer's own pattern cuts it; other text goes to the tokenizer whole.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ɏ]")
#: White space before a space, or a space at the end: runs of white space that must not be cut.
_RUNS = re.compile(r"[ \n\t\r][ \t\r]|[\n\t\r]\n|[\t\r]|^[ \n]|[ \n]$| \n")


#: Fixed: how the byte-level tokenizer cuts text into the parts that it merges.
_PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, int]:
    """The tokenizer's letter for each byte: itself where it prints, else the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


def _by_rank(model: dict, special: list[str]):
    """The vocabulary as ranks, if a merge's result always has the next id; else None."""
    letters = {chr(v): k for k, v in _byte_letters().items()}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if len(vocab) != 256 + len(merged) or any(vocab[m] != 256 + k for k, m in enumerate(merged)):
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
    return tiktoken.Encoding("own", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})


class _Known(dict):
    """Values made when first asked for; emptied when full, so that memory is bounded."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The byte-level tokenizer cuts text into parts before merging, and a space or line feed between other
    characters always starts such a part.  Plain text is cut there, and each distinct stretch is encoded once, by
    a faster library over the same vocabulary where its ids are the order of merging, as is checked.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        fast = _by_rank(json.loads(self.tokenizer.to_str())["model"], self.special)
        slow = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        encode = fast.encode_ordinary if fast else slow
        self.known = _Known(lambda stretch: array("I", encode(stretch)).tobytes(), limit)

    def __call__(self, text: str) -> bytes:
        if _PLAIN.search(text) or _RUNS.search(text) or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")))


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(documents: DataFrame, keep: dict[str, Column], tokenizer: str, text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece: ``keep``, piece, start, length, ids_crc32.

    Ids of the text, then ``end_id``; null counts as empty.  Longer documents are cut so that all pieces but the
    first are full.  One narrow pass over whole texts; only the numbers leave it.
    """
    from pyspark.sql.types import StructType

    df = documents.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("_text"))
    kept = [f for f in df.schema.fields if f.name != "_text"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = Encoder(tokenizer)
        for batch in batches:
            texts = as_bytes(batch.column("_text"))
            rest = batch.select([f.name for f in kept])
            for a, b in chunks(texts, 4 << 20):
                row, piece, start, length, crc = [], [], [], [], []
                for i, t in enumerate(texts[a:b], a):
                    ids = encode(t.decode()) + end
                    n = len(ids) // 4
                    at, k = 0, 0
                    while at < n:
                        size = (n - 1) % capacity + 1 if k == 0 else capacity
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        at, k = at + size, k + 1
                part = rest.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[*part.schema.names, "piece", "start", "length", "ids_crc32"])

    return df.mapInArrow(run, StructType(kept + StructType.fromDDL(PIECES).fields))


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Sequences fixed by dominance, as (how many, lengths with copies), and the counts that are left."""
    left, fixed = {w: n for w, n in counts.items() if n}, []
    keys = sorted(left)

    def take(times: int, *lengths: int) -> None:
        fixed.append((times, dict(Counter(lengths))))
        for w in lengths:
            left[w] -= times
            if not left[w]:
                del left[w]
                keys.pop(bisect.bisect_left(keys, w))

    for w in sorted(left, reverse=True):
        while left.get(w):
            n, room = left[w], capacity - w
            left[w] -= 1  # the piece itself is set apart while its partners are looked for
            others = keys if left[w] else [k for k in keys if k != w]
            k = bisect.bisect_right(others, room)
            best = others[k - 1] if k else 0
            small = others[0] if others else 0
            second = small if others and left[small] > 1 else others[1] if len(others) > 1 else capacity
            left[w] += 1
            times = n // 2 if best == w else min(n, left.get(best, n))
            if not best:
                take(n, w)
            elif best == room or small + second > room:
                take(max(times, 1), w, best)
            else:
                third = others[1] if len(others) > 1 else small
                triples = 2 * small + (small if left[small] > 2 else third) > room
                pair = _best_pair(others, left, w, room) if triples else None
                if not pair:
                    break
                if best >= sum(pair):
                    take(times, w, best)
                elif pair[0] == best and not _larger_fit(others, left, w, pair[1], room):
                    take(min(left[k] // copies for k, copies in Counter([w, *pair]).items()), w, *pair)
                else:
                    break
    return fixed, left


def _best_pair(others: list[int], left: dict[int, int], w: int, room: int) -> tuple[int, int] | None:
    """The two other pieces (larger first) with the largest sum that fits."""
    best, i, j = None, 0, len(others) - 1
    while i <= j:
        a, b = others[i], others[j]
        if a + b > room:
            j -= 1
            continue
        if i < j or left[a] - (a == w) > 1:
            if best is None or a + b > sum(best):
                best = (b, a)
        i += 1
    return best


def _larger_fit(others: list[int], left: dict[int, int], w: int, least: int, room: int) -> bool:
    """Whether two other pieces that are both larger than ``least`` fit together."""
    k = bisect.bisect_right(others, least)
    if k == len(others):
        return False
    a = others[k]
    b = a if left[a] - (a == w) > 1 else others[k + 1] if k + 1 < len(others) else room
    return a + b <= room


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing on a histogram: (how many sequences, lengths with copies)."""
    open_: dict[int, list[list]] = {}  # by room: [how many, contents]
    rooms: list[int] = []

    def put(room: int, many: int, inside: dict[int, int]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([many, inside])

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            k = bisect.bisect_left(rooms, w)
            if k < len(rooms):
                room = rooms[k]
                many, inside = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            else:
                room, many, inside = capacity, -(-n // (capacity // w)), {}
            each = room // w
            whole = min(many, n // each)
            rest = min(n - whole * each, each - 1) if whole < many else 0
            if whole:
                put(room - each * w, whole, {**inside, w: each})
            if rest:
                put(room - rest * w, 1, {**inside, w: rest})
            if many - whole - bool(rest) > 0 and inside:
                put(room, many - whole - bool(rest), inside)
            n -= whole * each + rest
    return [(many, inside) for room in rooms for many, inside in open_[room]]



def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns with multiplicities for all pieces of the histogram."""
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length: (first rank, first rank after, first sequence, copies in a sequence, place) in order of rank."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequence = 0
    for many, inside in patterns:
        place = 0
        for w, copies in inside.items():
            rows = out.setdefault(w, [])
            first = rows[-1][1] if rows else 0
            rows.append((first, first + many * copies, sequence, copies, place))
            place += w * copies
        sequence += many
    return out


#: Most bytes of the table of patterns that tasks get; it has rows by length, so the capacity bounds it.
_MOST_BYTES = 64 << 20


def pack(cut: DataFrame, keys: list[str], capacity: int = 2048) -> DataFrame:
    """``cut`` (from pieces) with sequence_id and offset.

    ``keys`` name a piece together with piece; rows that are alike in all columns may swap places.  No rows give no
    sequences, and a document of any length is so many pieces.  The driver holds a count for each length up to ``capacity`` and the patterns, and nothing else.
    """
    spark = cut.sparkSession
    cut = settle(cut)
    totals = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slot = slots(plan(totals, capacity))
    rows = np.array([(length, a, sequence, copies, place) for length in sorted(slot) for a, _, sequence, copies, place in slot[length]], np.int64).reshape(-1, 5)
    if rows.nbytes > _MOST_BYTES:
        raise ValueError(f"{rows.nbytes} bytes of patterns are too many to send to tasks; the capacity is too large")
    starts = rows[:, 0] << 44 | rows[:, 1]

    groups = spark.createDataFrame([(n, math.isqrt(k) + 1) for n, k in totals.items()], "length bigint, _groups int")  # a row per length
    dealt = cut.join(F.broadcast(groups), "length").withColumn("_group", F.pmod(F.xxhash64(*keys, "piece"), F.col("_groups")).cast("int")).drop("_groups")
    counts = dealt.groupBy("length", "_group").count()
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("length", "_group").orderBy(*keys, "piece", "start", "ids_crc32")).cast("bigint") - 1
    ranked = dealt.withColumn("_rank", rank).join(first, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    ranked = ranked.select(*cut.columns, "_rank")

    def place(batches):
        for batch in batches:
            length, at = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            _, a, sequence, copies, offset = rows[np.searchsorted(starts, length << 44 | at, side="right") - 1].T
            q = at - a
            rest = batch.drop_columns(["_rank"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sequence + q // np.maximum(copies, 1)), pa.array(offset + q % np.maximum(copies, 1) * length)], names=[*rest.schema.names, "sequence_id", "offset"])

    from pyspark.sql.types import StructType

    return ranked.mapInArrow(place, StructType(cut.schema.fields + StructType.fromDDL("sequence_id bigint, offset bigint").fields))
