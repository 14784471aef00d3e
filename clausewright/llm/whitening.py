"""Embedding whitening by TSQR: exact sums centre the rows, QR runs in each partition, R factors merge in a tree.

1. Entries become whole numbers x = floor(256 c).  Each distinct vector counts once, so copies, however many, weigh
   as one; ``distinct`` sums up partially, and a vector that a third of all rows have is one row from each task.
2. A task adds up each dimension as two halves of its numbers, so sums are exact, and leaves one row per dimension.
3. Rows are centred as n x - S, whole numbers again, which doubles hold exactly while they stay below 2^53.  A task
   reduces its rows to one upper triangle R; R factors are stacked MERGE at a time and reduced again until one is left.
4. The driver decomposes that triangle (as large as the vectors are wide).  Its right vectors are the components and its
   singular values their deviations; the covariance matrix is never formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clausewright.llm.shared import settle

#: Fixed: entries are counted in steps of 1/256.
STEPS = 256
#: R factors that meet in one task, and rows that a task centres at a time.
MERGE, ROWS = 16, 4096
#: A component whose deviation is below this share of the largest one has none.
NONE = 1e-12


class Whitener:
    """What a fit leaves: n, exact sums, components (columns) and their eigenvalues, and the trace."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.values, self.trace = n, sums, components, values, trace
        self.identity_error = 0.0


def whole_numbers(embedding: Column) -> Column:
    """The vector in steps; null if it is null or empty, or has an entry that is null, not finite or beyond a long."""
    scaled = F.transform(embedding.cast("array<double>"), lambda c: F.floor(c * STEPS))
    fits = F.forall(embedding.cast("array<double>"), lambda c: F.coalesce(F.abs(c) < float(2**63 // STEPS), F.lit(False)) & ~F.isnan(c))
    return F.when(F.coalesce(fits, F.lit(False)) & (F.size(embedding) > 0), scaled)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _stepped(df: DataFrame, embedding: str, keep: dict[str, Column]) -> DataFrame:
    """Kept columns and the usable vectors as ``_x``."""
    return df.select(*[c.alias(k) for k, c in keep.items()], whole_numbers(F.col(embedding)).alias("_x")).where("_x IS NOT NULL")


def _width(stepped: DataFrame) -> int:
    """The most common length, the longer one among equals; 0 without vectors."""
    row = stepped.groupBy(F.size("_x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return row.w if row else 0


def exact_sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """(n, sum of each dimension) of ``_x``, exact at any size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b in batches:
            x = _matrix(b.column(0), width)
            n, low, high = n + len(x), low + (x & 0xFFFFFF).sum(0), high + (x >> 24).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(low), pa.array(high)], names=["dim", "n", "low", "high"])

    parts = vectors.select("_x").mapInArrow(run, "dim bigint, n bigint, low bigint, high bigint")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = sorted(parts.groupBy("dim").agg(F.sum("n").alias("n"), whole("low"), whole("high")).collect(), key=lambda r: r.dim)
    return (rows[0].n if rows else 0), [int(r.low) + (int(r.high) << 24) for r in rows]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S as doubles; in Python's numbers where a long wouldn't hold them."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * top + max(map(abs, sums), default=0) < 2**62:
        return (n * x - np.array(sums, np.int64)).astype(np.float64)
    return (n * x.astype(object) - np.array(sums, object)).astype(np.float64)


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def final_r(vectors: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """The R factor of all centred rows: QR in each partition, then a tree of merges."""
    parts = vectors.rdd.getNumPartitions()

    def reduce_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for b in batches:
            x = _matrix(b.column(0), width)
            for k in range(0, len(x), ROWS):
                r = _triangle(np.vstack([r, _centred(x[k : k + ROWS], n, sums)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def merge(t: pa.Table) -> pa.Table:
        r = np.zeros((0, width))
        for at in np.argsort(t["part"].to_numpy(), kind="stable").tolist():
            r = _triangle(np.vstack([r, np.frombuffer(t["r"][at].as_py()).reshape(-1, width)]))
        return pa.table({"part": t["up"].slice(0, 1), "r": pa.array([r.tobytes()], pa.binary())})

    factors = vectors.select("_x").mapInArrow(reduce_rows, "part bigint, r binary")
    for _ in range(max(1, math.ceil(math.log(max(parts, 2), MERGE)))):
        factors = factors.withColumn("up", F.floor(F.col("part") / MERGE)).groupBy("up").applyInArrow(merge, "part bigint, r binary")
    found = [np.frombuffer(x.r).reshape(-1, width) for x in factors.sort("part").collect()]
    return _triangle(np.vstack(found)) if found else np.zeros((0, width))


def _project(x: np.ndarray, fit: Whitener) -> np.ndarray:
    return _centred(x, fit.n, fit.sums) / fit.n @ fit.components / np.sqrt(fit.values)


def fit_whitener(vectors: DataFrame, width: int, components: int = 4) -> Whitener:
    """Fits on the distinct rows of ``_x``, and measures on them how far whitened rows are from the identity."""
    n, sums = exact_sums(vectors, width)
    if not n:
        return Whitener(0, [0] * width, np.zeros((width, 0)), np.zeros(0), 0.0)
    _, s, right = np.linalg.svd(final_r(vectors, width, n, sums), full_matrices=False)
    deviation = s / n / math.sqrt(n)
    k = min(components, int((deviation > NONE * deviation[0]).sum()) if deviation[0] > 0 else 0)
    fit = Whitener(n, sums, right[:k].T.copy(), deviation[:k] ** 2, float((deviation**2).sum()))
    if not k:
        return fit

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for b in batches:
            w = _project(_matrix(b.column(0), width), fit)
            total += np.column_stack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

    rows = vectors.select("_x").mapInArrow(moments, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.array([r.v for r in sorted(rows, key=lambda r: r.cell)]).reshape(k, k + 1) / n
    fit.identity_error = float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max())
    return fit


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2; None where a long doesn't hold them."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if (n * top + max(map(abs, sums), default=0)) ** 2 * max(x.shape[1], 1) < 2**63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [v if v < 2**63 else None for v in (d * d).sum(1).tolist()]


_RESULT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, keep: dict[str, Column], embedding: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each usable vector and component: ``keep``, component (from 1), n, deviation, whitened, explained, identity_error.

    Left out are vectors that are null or empty, that have an entry which is null, not finite or beyond a long when scaled,
    and those of another length than most.  Components without variance aren't returned, so equal vectors, a single one, and an
    empty table give no rows.  Rows that repeat, ids that are null or repeat, are answered each; extra columns are ignored.
    ``deviation`` is null where a long doesn't hold it.  The fit list is checkpointed in the shared folder.
    """
    stepped = _stepped(df, embedding, keep)
    width = _width(stepped)
    stepped = stepped.where(F.size("_x") == width)
    fit = fit_whitener(settle(stepped.select("_x").distinct()), width, components)
    kept = [f for f in stepped.schema.fields if f.name != "_x"]
    k = len(fit.values)
    share = fit.values / fit.trace if k else fit.values

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if k else ():
            x = _matrix(b.column(b.num_columns - 1), width)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            rest = [b.column(c).take(at) for c in range(len(kept))]
            one = lambda v, kind: pa.array(np.full(len(at), v), kind)
            deviation = pa.array(_deviations(x, fit.n, fit.sums), pa.int64()).take(at)
            got = [pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), one(fit.n, pa.int64()), deviation, pa.array(_project(x, fit).ravel()), pa.array(np.tile(share, len(x))), one(fit.identity_error, pa.float64())]
            yield pa.RecordBatch.from_arrays([*rest, *got], names=[*(f.name for f in kept), *(c.split()[0] for c in _RESULT.split(", "))])

    return stepped.mapInArrow(run, StructType(kept + StructType.fromDDL(_RESULT).fields))
