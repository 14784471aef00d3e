"""What runs say of themselves, as a stream: the last state of each comparison, without repeats, and stale runs given up."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clausewright import schemas
from clausewright.operators.reports import latest_by

LIVE = "comparison_id string, status string, progress double, current_stage string, logged_at timestamp"
_FIELDS = ["status", "progress", "current_stage", "logged_at"]


class LastState(StatefulProcessor):
    """Keeps the row of a comparison that was logged last, the farther one among equals, and a timer while it runs."""

    def __init__(self, stale: timedelta):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LIVE.removeprefix("comparison_id string, "))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else None
        best = before
        for part in rows:
            for row in part[_FIELDS].itertuples(index=False, name=None):
                if best is None or (row[3], row[1]) > (best[3], best[1]):
                    best = row
        if best is None or best == before:
            return
        self.last.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best[0] not in ("completed", "failed"):
            self.handle.registerTimer(int((best[3] + self.stale).timestamp() * 1000))
        yield pd.DataFrame([(key[0], *best)], columns=["comparison_id", *_FIELDS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, stage, at = self.last.get()
        row = ("failed", 0.0, stage, at)
        self.last.update(row)
        yield pd.DataFrame([(key[0], *row)], columns=["comparison_id", *_FIELDS])

    def close(self) -> None:
        pass


def progress_stream(log: DataFrame, stale: timedelta = timedelta(hours=1), late: str = "10 minutes") -> DataFrame:
    """Updates of the last state of each comparison, from a stream of log rows.

    Repeated rows and rows older than the state change nothing; rows later than ``late`` behind the newest one aren't seen.  A run
    that logs nothing for ``stale`` has failed, until it logs again.
    """
    rows = log.where("comparison_id IS NOT NULL").select("comparison_id", "status", "progress", "current_stage", F.col("logged_at").cast("timestamp").alias("logged_at"))
    return rows.withWatermark("logged_at", late).groupBy("comparison_id").transformWithStateInPandas(statefulProcessor=LastState(stale), outputStructType=LIVE, outputMode="Update", timeMode="EventTime")


def follow(spark: SparkSession, path: str, out: str, checkpoint: str, stale: timedelta = timedelta(hours=1), late: str = "10 minutes", available_now: bool = True) -> StreamingQuery:
    """Appends updates from the log below ``path`` to ``out``, a batch at most once each; state survives restarts in ``checkpoint``."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        updates = progress_stream(spark.readStream.schema(schemas.COMPARISONS).parquet(path), stale, late)

        def append(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")  # the same folder if it is run again

        writer = updates.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).outputMode("update")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
    finally:
        spark.conf.set(key, before)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each comparison, for ``reports.with_progress``."""
    return latest_by(spark.read.parquet(f"{out}/*").withColumnRenamed("batch", "_batch"), ["comparison_id"], [F.desc("_batch")]).drop("_batch")


def first_uploads(pages: DataFrame) -> DataFrame:
    """A stream of pages without those of a document and page number that came before."""
    return pages.dropDuplicates(["document_id", "page_number"])
