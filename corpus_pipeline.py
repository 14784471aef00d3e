"""A corpus pipeline: quality, line dedup, near-dedup, decontamination and packing, stage after stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import decontaminate, linededup, neardup, packing, quality
from clausewright.llm.shared import new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keep(*names: str) -> dict:
    return {n: F.col(n) for n in names}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier takes for bad ones; an empty text has no sign of being bad and stays."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, _keep(*COLUMNS) | {"text": F.col("text")})
    return scored.where("predicted = 1 OR coalesce(text, '') = ''").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents have; n_chars follows."""
    left = linededup.drop_lines(docs, _keep("doc_id", "lang", "source"))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the smallest doc_id, stays, and of rows with one doc_id that of the smallest text."""
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    first = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return left.join(again, "doc_id", "left_anti").unionByName(first.select("doc_id", "row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _keep(*COLUMNS) | {"text": F.col("text")})
    return found.where("NOT contaminated").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequences and places."""
    cut = packing.pieces(docs, _keep("doc_id"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(cut, ["doc_id"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of ``sf_dir``; what each but the last keeps is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: Packing, and the classifier's dictionaries, aren't SQL.
ORACLE_SQL = None
