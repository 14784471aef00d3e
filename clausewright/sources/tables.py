"""Tables that are computed once and kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary folder will do."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="clausewright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; whoever fills it makes it, and clear_folders removes it."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def is_kept(folder: str) -> bool:
    """Whether a new_folder's path hasn't been cleared."""
    return folder in _made


def clear_folders(spark: SparkSession) -> int:
    """Removes what this program has put into new_folder's paths so far, and returns how many there were.

    For when all DataFrames that read from them have been written or shown; checkpoints go with the session, where
    spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as Parquet in the shared folder: smaller than a checkpoint, and who reads few columns reads few bytes."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for costly work on rows of few bytes, which adaptive execution would put into one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def in_groups(df: DataFrame, keys: list[str], order: list, work: Callable[[pa.Table, list[tuple[int, int]]], pa.Table], schema: str) -> DataFrame:
    """``work`` on rows of whole groups of equal ``keys``, in ``order``, and on where each group begins and ends.

    Rows are dealt by key, sorted, and read as a stream, of which a batch and a group are held at a time.  So a small group costs no call of
    Spark's or Arrow's of its own, which would take longer than its work.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            differs = np.zeros(max(len(t) - 1, 0), bool)
            for c in keys:
                x, y = t[c][1:], t[c][:-1]
                differs |= pc.or_(pc.not_equal(x, y).fill_null(False), pc.xor(x.is_null(), y.is_null())).to_numpy()
            cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), *([len(t)] if last else [])]
            held = [] if last else [t.slice(cuts[-1])]
            if len(cuts) > 1:
                yield from work(t.slice(0, cuts[-1]).combine_chunks(), list(zip(cuts, cuts[1:], strict=False))).combine_chunks().to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            if held and len(t) and all(held[0][c][0].as_py() == t[c][-1].as_py() for c in keys):
                held.append(t)  # the group goes on beyond this batch
            elif len(t):
                yield from done(pa.concat_tables([*held, t]), False)
        if held:
            yield from done(pa.concat_tables(held), True)

    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by a hash of the keys, as a shuffle by the keys themselves may be left out as needless, and its input then be dealt anew by adaptive execution
    return df.repartition(tasks, F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
