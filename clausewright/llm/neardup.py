"""MinHash near-dedup with HyperMinHash registers.

A document's set has its distinct five-word shingles.  Each of 128 registers has an order of its own over
shingles and stores the smallest value as its count of leading zeros (6 bits) and the 10 bits that follow the
first one.  Four registers are one 64-bit band key, so 32 bands miss a pair at similarity 0.75 with probability
(1 - 0.75^4)^32, 5 in a million, and pairs above it less.

1. Documents of equal sets are one class, found by the size and two 64-bit sums over the set's hashes: other sets
   agree in all three with a probability of 2^-128, far less than two shingles have one hash.  Classes are linked, not copies.
2. Every class sends its band keys to buckets.  In a bucket each member pairs with the smallest one; these pairs,
   linear in the input however large a bucket is, are confirmed on full sets, and their components taken.
3. Buckets that still join several components are searched in blocks of bounded size.  Members of the component that
   the smallest one is in, in large buckets nearly all, meet only members of others.  Pairs across components,
   each in the first band that they share, are estimated from the registers, corrected for registers that are
   equal by chance; those that may reach the threshold are confirmed on full sets, until connected.
   Nothing emits a bucket's pairs: blocks return members, and then links between components, a forest of them.
4. Components, by hooking and pointer jumping on tables; the second round joins those of the first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import as_bytes, settle, text_map
from clausewright.llm.wordhash import chunks, mix, shingle_sets

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
#: Most members of a block; a larger bucket is searched as pairs of blocks.
BLOCK = 512
_RNG = np.random.default_rng(7_919)
_MULTIPLY = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_SUMS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F886F7))
#: Fixed: the constant of the expected share of equal registers of unequal sets (HyperMinHash, one bucket).
_CHANCE = 4 * 0.169919487159739


def compress(smallest: np.ndarray) -> np.ndarray:
    """Registers of 64-bit minima: leading zeros, then the bits after the first one."""
    fraction, exponent = np.frexp((smallest >> np.uint64(11)).astype(np.float64))
    bits = np.floor(np.maximum(2 * fraction - 1, 0) * (1 << MANTISSA)).astype(np.uint16)
    return (np.minimum(53 - exponent, 63).astype(np.uint16) << np.uint16(MANTISSA)) | bits


def sketch(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Registers (n, 128) and set sums (n, 2) of the non-empty sets, in order."""
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1][sizes > 0]
    smallest = np.empty((len(starts), REGISTERS), np.uint64)
    sums = np.empty((len(starts), 2), np.uint64)
    if len(starts):
        for k in range(REGISTERS):
            smallest[:, k] = np.minimum.reduceat(sets * _MULTIPLY[k] + _ADD[k], starts)
        for k, seed in enumerate(_SUMS):
            sums[:, k] = np.add.reduceat(mix(sets ^ seed), starts)
    return compress(smallest), sums


def estimate(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from shares of equal registers and set sizes, without what is equal by chance."""
    chance = _CHANCE * 2.0**-MANTISSA * a * b / (a + b) ** 2
    return (equal - chance) / (1 - chance)


def signatures(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, set sums k1 and k2, registers (null for an empty set)."""

    def scan(texts: list[bytes]) -> dict[str, pa.Array]:
        sets, sizes = shingle_sets(texts, width)
        registers, sums = sketch(sets, sizes)
        whole = np.zeros((len(texts), 2), np.int64)
        whole[sizes > 0] = sums.view(np.int64)
        rows = iter(registers)
        return {
            "n_shingles": pa.array(sizes, pa.int64()),
            "k1": pa.array(whole[:, 0]),
            "k2": pa.array(whole[:, 1]),
            "registers": pa.array([next(rows).tobytes() if n else None for n in sizes.tolist()], pa.binary()),
        }

    df = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("_text"))
    return text_map(df, "_text", scan, "n_shingles bigint, k1 bigint, k2 bigint, registers binary")


def _full_sets(documents: DataFrame, ids: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(rep, items): the sorted shingle hashes of the documents in ``ids``."""

    def scan(texts: list[bytes]) -> dict[str, pa.Array]:
        sets, sizes = shingle_sets(texts, width)
        ends = np.cumsum(sizes)
        return {"items": pa.array([sets[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())}

    df = documents.select(F.col(doc_id).cast("bigint").alias("rep"), F.col(text).alias("_text")).join(ids, "rep", "left_semi")
    return text_map(df, "_text", scan, "items binary")


def _band_rows(nodes: DataFrame) -> DataFrame:
    """(bucket, rep): a row per band of each class."""
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _registers(batch.column(1).to_pylist()).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(mix(keys ^ salt).ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS))], names=["bucket", "rep"])

    return nodes.select("rep", "registers").mapInArrow(run, "bucket bigint, rep bigint")


def _registers(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), REGISTERS)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    n = _shared(x, y)
    return 100 * n >= percent * (len(x) + len(y) - n)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked on full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            yield batch.select(["a", "b"]).filter(pa.array([_linked(p, q, percent) for p, q in zip(x, y, strict=True)], pa.bool_()))

    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, comp, main, n_main, n_other, ...) with the group that each is searched in and the side it is on.

    In a bucket the members of the component ``main`` and the others are cut into blocks of at most BLOCK by the hash of
    rep.  Every pair of blocks of others is a group, and every pair of a block of others and one of main members, which
    are linked among themselves already.  So a main member is copied once per BLOCK others, and each of the others once
    per BLOCK members of its bucket.
    """
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    is_main = F.col("comp") == F.col("main")
    cut = rows.withColumn("_o", blocks("n_other")).withColumn("_m", blocks("n_main"))
    cut = cut.withColumn("_own", F.pmod(F.xxhash64("rep", F.lit(17)), F.when(is_main, F.col("_m")).otherwise(F.col("_o"))).cast("int"))
    own = F.col("_own")
    group = lambda kind, x, y, side: F.struct(F.lit(kind).alias("k"), x.alias("x"), y.alias("y"), side.cast("int").alias("side"))
    across = F.transform(upto("_o"), lambda i: group(1, own, i, F.lit(0)))
    among = F.transform(upto("_o"), lambda i: group(0, F.least(own, i), F.greatest(own, i), F.when(own == i, -1).otherwise(own)))
    to_main = F.transform(upto("_m"), lambda j: group(1, j, own, F.lit(1)))
    cut = cut.withColumn("_g", F.explode(F.when(is_main, across).otherwise(F.concat(among, to_main))))
    return cut.withColumn("g", F.xxhash64("bucket", "_g.k", "_g.x", "_g.y")).withColumn("side", F.col("_g.side")).drop("_o", "_m", "_own", "_g", "main", "n_main", "n_other")


def _by_group(rows: DataFrame, search, schema: str) -> DataFrame:
    """``search`` of each group's rows as a dict of lists; groups are runs of equal g in sorted partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush():
            if sum(b.num_rows for b in held) > 1:
                got = search(pa.Table.from_batches(held))
                if got is not None:
                    yield got
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column("g")[0].as_py() != int(g[a]):
                    yield from flush()
                held.append(batch.slice(a, b - a))
        yield from flush()

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)


def _open_pairs(t: pa.Table, cut: float):
    """For each member of a group, the later members that it may still have to be compared with on full sets.

    Left out: the same component or side, the bucket's smallest member (compared before), pairs that share an
    earlier band, and pairs whose estimate is under ``cut``.
    """
    registers = _registers(t.column("registers").to_pylist())
    keys = registers.view(np.uint64)
    comp, side, rep, hub, n = (t.column(c).to_numpy() for c in ("comp", "side", "rep", "hub", "n_shingles"))
    band, n = int(_band_of(keys, t.column("bucket")[0].as_py())), n.astype(np.float64)
    for i in range(len(rep) - 1):
        if rep[i] == hub[i]:
            continue
        other = np.arange(i + 1, len(rep))
        other = other[(comp[other] != comp[i]) & (rep[other] != hub[i]) & (rep[other] != rep[i]) & ((side[other] != side[i]) | (side[i] == -1))]
        if len(other):
            other = other[(keys[other, :band] != keys[i, :band]).all(1)]
        if len(other):
            equal = (registers[other] == registers[i]).mean(1)
            other = other[estimate(equal, n[other], n[i]) >= cut]
        if len(other):
            yield i, other


def _band_of(keys: np.ndarray, bucket: int) -> int:
    """The band whose bucket this is."""
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int((mix(keys[0] ^ salt).view(np.int64) == bucket).argmax())


def _search_open(cut: float):
    def search(t: pa.Table):
        flagged: set[int] = set()
        for i, other in _open_pairs(t, cut):
            flagged.add(i)
            flagged.update(other.tolist())
        if flagged:
            part = t.take(pa.array(sorted(flagged))).combine_chunks().to_batches()[0]
            return part.select(["bucket", "rep"])
        return None

    return search


def _search_links(cut: float, percent: int):
    def search(t: pa.Table):
        items = t.column("items").to_pylist()
        comp = t.column("comp").to_pylist()
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        a, b = [], []
        for i, other in _open_pairs(t, cut):
            for j in other.tolist():
                p, q = find(comp[i]), find(comp[j])
                if p != q and _linked(items[i], items[j], percent):
                    root[max(p, q)] = min(p, q)
                    a.append(comp[i])
                    b.append(comp[j])
        if a:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        return None

    return search


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of ``links`` (a, b): the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, jumps pointers twice and contracts the links; rounds end
    when no link is left.  Every round is settled, so the lineage stays short.
    """
    edges = settle(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        up = both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp"))
        for _ in range(2):
            up = up.join(up.toDF("comp", "_next"), "comp").select("node", F.col("_next").alias("comp"))
        up = settle(up)
        found = up if found is None else found.join(up.toDF("comp", "_next"), "comp", "left").select("node", F.coalesce("_next", "comp").alias("comp"))
        at_a, at_b = up.toDF("a", "_a"), up.toDF("b", "_b")
        edges = settle(edges.join(at_a, "a").join(at_b, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    return found if found is not None else edges.toDF("node", "comp")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, sigmas: float = 4.5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * shared >= ``percent`` * united shingles; component_id is the smallest doc_id that
    links reach, and kept says that it is the document's own.  Null, empty and wordless texts are linked with nothing.
    Rows of one doc_id count as one document; rows without doc_id have no component and are kept.  Pairs are estimated
    first with a margin of ``sigmas`` standard errors under the threshold.  Texts of any length are hashed whole.  An empty table gives
    no rows; extra columns are ignored.
    """
    share = percent / 100
    cut = share - sigmas * (share * (1 - share) / REGISTERS) ** 0.5
    sig = settle(signatures(documents, doc_id, text, width))
    filled = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    nodes = settle(filled.withColumnRenamed("doc_id", "rep").join(classes, ["rep", "k1", "k2", "n_shingles"], "left_semi").select("rep", "n_shingles", "registers").dropDuplicates(["rep", "registers"]))
    bands = _band_rows(nodes)
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("rep").alias("hub")).where("_n > 1").drop("_n")
    members = settle(bands.join(sizes, "bucket"))
    ids = members.select("rep").distinct()
    sets = settle(_full_sets(documents, ids, doc_id, text, width).dropDuplicates(["rep", "items"]))
    first = components(_confirm(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), sets, percent))
    placed = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    by_comp = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"))
    several = by_comp.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.min_by("comp", "low").alias("main"), F.min_by("n", "low").alias("n_main"), F.sum("n").alias("n")).where("comps > 1")
    open_ = settle(placed.join(several.select("bucket", "main", "n_main", (F.col("n") - F.col("n_main")).alias("n_other")), "bucket"))
    flagged = settle(_by_group(_blocks(open_.join(nodes, "rep")), _search_open(cut), "bucket bigint, rep bigint").distinct())
    left = open_.drop("n_main", "n_other").join(flagged, ["bucket", "rep"], "left_semi")
    sizes = left.groupBy("bucket").agg(F.count_if(F.col("comp") == F.col("main")).alias("n_main"), F.count_if(F.col("comp") != F.col("main")).alias("n_other"))
    rest = left.join(sizes, "bucket").join(nodes, "rep").join(sets, "rep")
    more = _by_group(_blocks(rest), _search_links(cut, percent), "a bigint, b bigint")
    second = components(more).toDF("comp", "_next")
    merged = classes.join(first.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    merged = merged.join(second, "comp", "left").select("k1", "k2", "n_shingles", F.coalesce("_next", "comp").alias("comp"))
    out = sig.join(merged, ["k1", "k2", "n_shingles"], "left")  # sets of no shingles are in no class
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component, F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
