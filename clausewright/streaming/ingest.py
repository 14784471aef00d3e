"""Stateless streaming ingest: new page files are normalised, scored and appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausewright import schemas
from clausewright.functions import text as T


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """Pages of Parquet files that appear below ``path``, with their quality."""
    pages = spark.readStream.schema(schemas.PAGES).parquet(path)
    return pages.withColumn("quality_score", T.quality(F.col("text")))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the stream to ``out``; each file is taken once, also after a restart."""
    writer = page_stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
