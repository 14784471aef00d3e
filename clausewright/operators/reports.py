"""Queries over the change table: statistics, filters, ranking, reviews and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright import lexicon
from clausewright.functions import scores as S


def _sum(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def summary(changes: DataFrame, overall: str = "confidence_overall") -> DataFrame:
    """Counts of each comparison by what reports group and filter by; the functions below take it for the changes themselves.

    Rows of several comparisons, or of parts of one, add up.
    """
    keys = ["comparison_id", "category", "impact", "change_type", "is_substantive", S.confidence_band(F.col(overall)).alias("band")]
    return changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(overall), F.lit(0.0)).alias("confidence_sum"), F.count(overall).alias("confidence_n"))


def _counted(changes: DataFrame, overall: str = "confidence_overall") -> DataFrame:
    """Changes as rows that count once; a summary's rows count as often as they say."""
    if "confidence_n" in changes.columns:
        return changes
    confidence = F.col(overall) if overall in changes.columns else F.lit(None).cast("double")
    return changes.withColumns({"n": F.lit(1).cast("bigint"), "confidence_sum": F.coalesce(confidence, F.lit(0.0)), "confidence_n": F.when(confidence.isNull(), 0).otherwise(1).cast("bigint")})


def statistics(changes: DataFrame, overall: str = "confidence_overall") -> DataFrame:
    """One row of counts and mean confidence, of changes or of a summary; sums are null without changes."""
    sub, kind, level = F.col("is_substantive"), F.col("change_type"), F.col("impact")
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("bigint")
    return _counted(changes, overall).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), total(sub).alias("substantive"), total(~sub).alias("editorial"), total(kind == "ADDED").alias("added"), total(kind == "REMOVED").alias("removed"),
        total(kind.isin("MODIFIED", "REWORDED", "RELOCATED")).alias("modified"), *[total(level == x).alias(x.lower()) for x in lexicon.IMPACTS], F.try_divide(F.sum("confidence_sum"), F.sum("confidence_n")).alias("avg_confidence"),
    )


def category_distribution(changes: DataFrame, substantive_only: bool = True) -> DataFrame:
    df = _counted(changes)
    df = df.where("is_substantive") if substantive_only else df
    return df.groupBy("category").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "category")


def mean_confidence(column: str) -> Column:
    """The mean of an aggregate's rows, 0 without any."""
    return F.coalesce(F.avg(column), F.lit(0.0))


def with_bars(counts: DataFrame) -> DataFrame:
    """Counts with their share of the largest one, for bars; counts are few, one for each category."""
    return counts.withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))))


def impact_heatmap(changes: DataFrame) -> DataFrame:
    return _counted(changes).where("is_substantive").groupBy("category", "impact").agg(F.sum("n").alias("n"))


def heatmap_pivot(changes: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """A column per level; the dashboard's four unless others are named."""
    levels = levels or lexicon.IMPACTS[:4]
    return _counted(changes).where("is_substantive").groupBy("category").pivot("impact", levels).sum("n").select("category", *[F.coalesce(F.col(x), F.lit(0)).alias(x.lower()) for x in levels])


def counts_by(changes: DataFrame, column: str) -> DataFrame:
    return _counted(changes).groupBy(column).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), column)


def filtered(changes: DataFrame, search: str = "", **equal: object) -> DataFrame:
    """Conjunction of equalities (empty values are ignored) and a case-insensitive substring of summary or texts."""
    for column, value in equal.items():
        if value is not None and value != "":
            changes = changes.where(F.col(column) == F.lit(value))
    if search:
        hit = F.lit(False)
        for c in ("change_summary", "old_requirement", "new_requirement"):
            hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(search.lower())
        changes = changes.where(hit)
    return changes


def ranked(changes: DataFrame, limit: int | None = None) -> DataFrame:
    """By impact and then change id."""
    out = changes.orderBy(S.impact_rank(F.col("impact")), "change_id")
    return out.limit(limit) if limit else out


def change(changes: DataFrame, comparison_id: str, change_id: str) -> DataFrame:
    """At most one row; ids repeat across comparisons, so both parts of the key are needed."""
    return changes.where((F.col("comparison_id") == comparison_id) & (F.col("change_id") == change_id)).limit(1)


def latest_comparison(comparisons: DataFrame) -> DataFrame:
    """The newest completed comparison, else the newest of all."""
    return comparisons.orderBy(F.when(F.col("status") == "completed", 0).otherwise(1), F.desc("created_at"), "comparison_id").limit(1)


def comparisons(log: DataFrame) -> DataFrame:
    """The last row of each comparison with its first created_at, newest first."""
    first = log.groupBy("comparison_id").agg(F.min("created_at").alias("_at"))
    last = latest_by(log, ["comparison_id"], [F.desc("logged_at")])
    return last.join(first, "comparison_id").withColumn("created_at", F.col("_at")).drop("_at").orderBy(F.desc("created_at"), "comparison_id")


def missing_keys(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` in ``rows`` that no row of ``others`` has."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(others.select(key), key, "left_anti")


def with_progress(comparisons: DataFrame, live: DataFrame) -> DataFrame:
    """Stored comparisons with progress, stage and status of those that run."""
    own = live.select("comparison_id", *[F.col(c).alias(f"_{c}") for c in ("progress", "current_stage", "status")])
    out = comparisons.join(own, "comparison_id", "left")
    for c in ("progress", "current_stage", "status"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.drop("_progress", "_current_stage", "_status")


def review(spark: SparkSession, comparison_id: str, change_id: str, status: str, comment: str = "") -> DataFrame:
    """A row for the review log."""
    if status not in lexicon.REVIEW_STATUSES:
        raise ValueError(f"no review status: {status}")
    return spark.range(1).select(F.lit(comparison_id).alias("comparison_id"), F.lit(change_id).alias("change_id"), F.lit(status).alias("review_status"), F.lit(comment).alias("reviewer_comment"), F.current_timestamp().alias("reviewed_at"))


def latest_reviews(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last entry of each key, as an aggregate with partial sums."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("_r")).select(*keys, "_r.*")


def with_reviews(changes: DataFrame, log: DataFrame) -> DataFrame:
    last = latest_reviews(log, ["comparison_id", "change_id"], "reviewed_at").drop("reviewed_at")
    return changes.join(last, ["comparison_id", "change_id"], "left").withColumn("review_status", F.coalesce("review_status", F.lit("PENDING"))).withColumn("reviewer_comment", F.coalesce("reviewer_comment", F.lit("")))


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with ``rows`` put over rows of the same key."""
    return stored.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def location(ref: str) -> Column:
    place = F.coalesce(F.nullif(F.col(f"{ref}.section"), F.lit("")), F.nullif(F.col(f"{ref}.clause"), F.lit("")))
    page = F.coalesce(F.col(f"{ref}.page").cast("string"), F.lit("N/A"))
    return F.concat(F.lit("Page "), page, F.when(place.isNotNull(), F.concat(F.lit(" ("), place, F.lit(")"))).otherwise(""))


def _obligation() -> Column:
    return F.when(F.coalesce(F.col("obligation_change.direction"), F.lit("UNCHANGED")) != "UNCHANGED", F.concat_ws(": ", "obligation_change.direction", "obligation_change.explanation")).otherwise("")


def export_rows(changes: DataFrame) -> DataFrame:
    """The 17 columns of the CSV and XLSX exports."""
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in changes.columns else F.lit(default)
    return changes.select(
        F.col("change_id").alias("Change ID"), F.col("impact").alias("Impact Level"), F.col("change_type").alias("Change Type"), F.col("category").alias("Category Code"),
        S.category_name(F.col("category")).alias("Category Name"), F.when(F.col("is_substantive"), "Yes").otherwise("No").alias("Substantive"),
        F.concat(F.bround(F.coalesce(F.col("confidence.overall"), F.lit(0.0)) * 100).cast("bigint").cast("string"), F.lit("%")).alias("Confidence"), F.col("change_summary").alias("Change Summary"),
        location("old_reference").alias("Old Location"), F.col("old_requirement").alias("Old Requirement Text"), location("new_reference").alias("New Location"), F.col("new_requirement").alias("New Requirement Text"),
        S.number_text(F.col("numerical_changes")).alias("Numerical Changes"), _obligation().alias("Obligation Analysis"), has("llm_explanation", "").alias("AI Impact Explanation"),
        has("review_status", "PENDING").alias("Review Status"), has("reviewer_comment", "").alias("Reviewer Comment"),
    )


def export_rows_script(changes: DataFrame) -> DataFrame:
    """The 17 columns of the script's CSV: page and section apart, confidence without a percent sign."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return changes.select(
        F.col("change_id").alias("Change ID"), F.col("impact").alias("Impact Level"), F.col("change_type").alias("Change Type"), F.col("category").alias("Category Code"),
        S.category_name(F.col("category")).alias("Category Name"), F.when(F.col("is_substantive"), "Yes").otherwise("No").alias("Substantive"),
        F.bround(F.col("confidence.overall") * 100).cast("bigint").cast("string").alias("Confidence (%)"), text("change_summary").alias("Change Summary"),
        text("old_reference.page").alias("Old Document Location (Page)"), text("old_reference.section").alias("Old Document Section"), text("old_requirement").alias("Old Requirement Text"),
        text("new_reference.page").alias("New Document Location (Page)"), text("new_reference.section").alias("New Document Section"), text("new_requirement").alias("New Requirement Text"),
        S.number_text(F.col("numerical_changes"), titled=False).alias("Numerical Changes"), _obligation().alias("Obligation Analysis"), F.lit("").alias("Impact Explanation"),
    )


def categories(spark: SparkSession, names: dict[str, str] | None = None) -> DataFrame:
    """Codes and names: the server's, unless others are given, as the dashboard's."""
    return spark.createDataFrame(list((names or lexicon.CATEGORIES).items()), "code string, name string")
