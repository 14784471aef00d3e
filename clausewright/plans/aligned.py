"""Nodes generated from the orders table whose alignment is known in every layer, and SQL that says what it must be.

Runs of one letter have a ratio that follows from their lengths, a digest is like no other digest, and words with a
number in them occur nowhere else; so each clause can only meet its own counterpart, with a score that SQL can compute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators import align as A

#: By clause (key k): its comparison, what it is like (t), on which sides it is, and the lengths of its runs.
_BASE = "k, k {div} 60 AS cmp, k % 5 AS t, CASE WHEN k % 5 = 4 THEN k % 2 = 0 ELSE k % 11 <> 0 END AS has_o, CASE WHEN k % 5 = 4 THEN k % 2 = 1 ELSE k % 13 <> 0 END AS has_n, 1 + k % 19 AS p, 1 + c % 19 AS q"
_WORDS = "'alpha' || key || ' beta' || key || ' gamma' || key || ' delta' || key"


def nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new clause units: with a section number, with a heading only, with words only, or on one side only."""
    base = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", "o_custkey AS c").selectExpr(*_BASE.format(div="div").split(", "))
    base = base.withColumn("key", F.col("k").cast("string"))

    def side(letter: str, run: str, heading: str, words: str) -> DataFrame:
        return base.where("has_o" if letter == "O" else "has_n").selectExpr(
            "concat('CMP_', cast(cmp AS STRING)) AS comparison_id", f"concat('{letter}', key) AS node_id", "CASE WHEN t < 2 THEN key ELSE '' END AS section_number",
            f"CASE WHEN t = 2 THEN {heading} ELSE '' END AS heading", f"CASE WHEN t = 3 THEN {words} ELSE repeat('a', cast({run} AS INT)) END AS normalized_text", "cast(k AS INT) AS order",
        )

    return side("O", "p", "md5(key)", _WORDS), side("N", "q", "concat(md5(key), repeat('z', cast(k % 40 AS INT)))", f"{_WORDS} || CASE WHEN k % 3 = 0 THEN ' extra' || key ELSE '' END")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.align(*nodes(spark, sf_dir))


#: A clause with all its words on both sides has 7 terms that two nodes have (4 words, 3 pairs), and two more that one has if a word is added.
SQL = f"""base AS (SELECT {_BASE.format(div="//")}, k::STRING AS key FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)),
    sized AS (SELECT *, sum(CASE WHEN t = 3 THEN has_o::INT + has_n::INT ELSE 0 END) OVER (PARTITION BY cmp)::DOUBLE AS n, 2.0::DOUBLE * least(p, q) / (p + q) AS r, 64.0::DOUBLE / (64 + k % 40) AS h FROM base),
    scored AS (SELECT *, ln((1 + n) / 3) + 1 AS two, ln((1 + n) / 2) + 1 AS one FROM sized),
    rated AS (
        SELECT *, CASE WHEN NOT (has_o AND has_n) THEN NULL WHEN t < 2 THEN r WHEN t = 2 AND h >= 0.7 THEN 0.6 * h + 0.4 * r
            WHEN t = 3 THEN CASE WHEN k % 3 = 0 THEN sqrt(7 * two * two / (7 * two * two + 2 * one * one)) ELSE 1.0 END END AS score FROM scored),
    judged AS (SELECT *, score IS NOT NULL AND CASE WHEN t < 2 THEN score >= 0.3 ELSE score >= 0.5 END AS matched FROM rated),
    aligned AS (
        SELECT 'CMP_' || cmp AS comparison_id, 'O' || key AS old_node_id, 'N' || key AS new_node_id, 'ONE_TO_ONE' AS alignment_type, CASE WHEN t < 2 THEN 'exact' WHEN t = 2 THEN 'structural' ELSE 'lexical' END AS match_method,
            CASE WHEN t < 2 THEN least(1.0, 0.5 + 0.5 * score) ELSE score END AS confidence, score FROM judged WHERE matched
        UNION ALL SELECT 'CMP_' || cmp, 'O' || key, NULL, 'REMOVED', 'unmatched', 0.9, NULL FROM judged WHERE has_o AND NOT matched
        UNION ALL SELECT 'CMP_' || cmp, NULL, 'N' || key, 'ADDED', 'unmatched', 0.9, NULL FROM judged WHERE has_n AND NOT matched)"""
