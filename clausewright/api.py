"""A workspace of documents, comparisons, changes and reviews: one method for each thing a user can ask."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright import lexicon, schemas
from clausewright.operators import changes as CH
from clausewright.operators import reports as R
from clausewright.sources import documents as DOC
from clausewright.sources import enrich as EN
from clausewright.sources import sinks


PAGE_COLUMNS = ["document_id", "filename", "version", "total_pages", "doc_quality", "page_number", "text", "quality_score", "blocks", "tables"]


class Workspace:
    """Tables below ``path``.  Logs are appended and read back latest first, so that writers never rewrite each other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        sinks.bootstrap(spark, self.path)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def documents(self) -> DataFrame:
        return R.latest_by(self._read("documents", schemas.DOCUMENTS), ["document_id"], [F.desc("created_at")])

    def pages(self) -> DataFrame:
        return DOC.read_pages(self.spark, f"{self.path}/pages")

    def ingest(self, glob: str, version: str, extractor: DOC.Extractor) -> tuple[DataFrame, DataFrame]:
        """Stores the documents and pages of PDF files; returns what was taken and what was refused, with reasons.

        Of a file that the extractor fails on nothing is stored.
        """
        good, bad = DOC.accepted(DOC.scan_files(self.spark, glob), version)
        taken = self.ingest_pages(DOC.extract(good, extractor), good.select("document_id", F.col("path").alias("file_path")))
        unread = good.drop("content").join(taken.select("document_id"), "document_id", "left_anti").withColumn("reason", F.lit("could not be read"))
        return taken, bad.unionByName(unread)

    def ingest_pages(self, pages: DataFrame, files: DataFrame | None = None) -> DataFrame:
        """As ingest, of pages that are extracted already."""
        pages = pages.select(*PAGE_COLUMNS)
        self._append("pages", pages)
        first = pages.where("page_number = 1").withColumn("m", DOC.metadata(F.col("text")))
        taken = first.select(
            "document_id", "filename", F.col("m.title").alias("title"), F.col("m.circular_number").alias("circular_number"), F.col("m.issue_date").alias("issue_date"),
            F.element_at(F.concat(F.array(F.lit("")), "m.update_dates"), -1).alias("update_date"), "total_pages", "version", F.col("doc_quality").alias("quality_score"),
        )
        taken = taken.join(files, "document_id", "left") if files is not None else taken.withColumn("file_path", F.lit(None).cast("string"))
        rows = taken.withColumn("parsed_data", F.lit(None).cast("string")).withColumn("created_at", F.lit(datetime.now(UTC).isoformat()))
        self._append("documents", rows.select(*self._read("documents", schemas.DOCUMENTS).columns))
        return self.documents().join(pages.select("document_id").distinct(), "document_id", "left_semi")

    def start(self, comparison_id: str, old_document_id: str, new_document_id: str, embed: Callable[[DataFrame], DataFrame] | None = None, ask: Callable[[str], str] | None = None, model: str = "") -> DataFrame:
        """Compares two documents, stores changes and the comparison, and returns the stored comparison; a failure is recorded."""
        began = datetime.now(UTC).isoformat()
        asked = self.spark.createDataFrame([(comparison_id, old_document_id, new_document_id)], "comparison_id string, old_document_id string, new_document_id string")
        try:
            pages = self.pages()
            note = lambda stage, percent: self._log(asked, "processing", began, percent, None, None, None, False, None, stage)
            note("extraction", 5.0)
            out = CH.compare(pages.where(F.col("document_id") == old_document_id), pages.where(F.col("document_id") == new_document_id), asked, embed, progress=note)
            if ask:
                note("llm", 82.0)
                out = EN.enrich(out, ask, model)
            note("saving", 95.0)
            sinks.save_with_summary(out.withColumn("confidence_overall", F.col("confidence.overall")), f"{self.path}/changes", f"{self.path}/summary")
            s = self.statistics(comparison_id).first()
            self._log(asked, "completed", began, 100.0, s.total, s.substantive, s.editorial, bool(ask), None)
        except Exception as error:
            self._log(asked, "failed", began, 0.0, None, None, None, False, str(error)[:500])
            raise
        return self.comparison(comparison_id)

    def _log(self, asked: DataFrame, status: str, began: str, progress: float, total, substantive, editorial, llm: bool, error: str | None, stage: str | None = None) -> None:
        """A row of the log; a comparison is what its last row says, also while it runs."""
        now = datetime.now(UTC).isoformat()
        rows = asked.select("*", *[F.lit(v).cast(t).alias(n) for n, v, t in (("status", status, "string"), ("progress", progress, "double"), ("current_stage", stage or status, "string"), ("total_changes", total, "int"), ("substantive_changes", substantive, "int"), ("editorial_changes", editorial, "int"), ("statistics", None, "string"), ("llm_available", llm, "boolean"), ("error_message", error, "string"), ("created_at", began, "string"), ("completed_at", None if stage else now, "string"), ("logged_at", now, "string"))])
        self._append("comparisons", rows)

    def comparisons(self) -> DataFrame:
        """Latest first; a comparison that ran again keeps its first created_at."""
        return R.comparisons(self._read("comparisons", schemas.COMPARISONS))

    def comparison(self, comparison_id: str) -> DataFrame:
        return self.comparisons().where(F.col("comparison_id") == comparison_id)

    def _changes(self, comparison_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/changes").where(F.col("comparison_id") == comparison_id)

    def changes(self, comparison_id: str, search: str = "", **equal: object) -> DataFrame:
        """Ranked changes with their review; filters by category, impact, change_type, is_substantive and review_status."""
        log = self._read("reviews", schemas.REVIEWS).where(F.col("comparison_id") == comparison_id)
        return R.ranked(R.filtered(R.with_reviews(self._changes(comparison_id), log), search, **equal))

    def change(self, comparison_id: str, change_id: str) -> DataFrame:
        return R.change(self.changes(comparison_id), comparison_id, change_id)

    def _summary(self, comparison_id: str) -> DataFrame:
        """Its counts, which are kept with the changes, so that statistics read no texts."""
        return self._read("summary", schemas.SUMMARY).where(F.col("comparison_id") == comparison_id)

    def statistics(self, comparison_id: str) -> DataFrame:
        return R.statistics(self._summary(comparison_id))

    def category_distribution(self, comparison_id: str) -> DataFrame:
        return R.category_distribution(self._summary(comparison_id))

    def impact_heatmap(self, comparison_id: str) -> DataFrame:
        return R.heatmap_pivot(self._summary(comparison_id))

    def dashboard(self, comparison_id: str) -> dict[str, DataFrame]:
        """What the dashboard shows: the cards' numbers, a bar for each category, and the heatmap of the four upper levels."""
        labels = R.categories(self.spark, lexicon.UI_LABELS).withColumnRenamed("code", "category")
        bars = R.with_bars(self.category_distribution(comparison_id)).join(F.broadcast(labels), "category", "left").orderBy(F.desc("n"), "category")
        return {"cards": self.statistics(comparison_id), "bars": bars, "heatmap": self.impact_heatmap(comparison_id)}

    def export_csv(self, comparison_id: str) -> bytes:
        return sinks.csv_bytes(R.export_rows(self.changes(comparison_id)))

    def export_xlsx(self, comparison_id: str) -> bytes:
        return sinks.xlsx_bytes(R.export_rows(self.changes(comparison_id)))

    def export_json(self, comparison_id: str) -> str:
        return sinks.export_json(self._changes(comparison_id), self.statistics(comparison_id), comparison_id)

    def review(self, comparison_id: str, change_id: str, status: str, comment: str = "") -> DataFrame:
        row = R.review(self.spark, comparison_id, change_id, status, comment)
        if self.change(comparison_id, change_id).isEmpty():
            raise LookupError(f"no change {change_id} in {comparison_id}")
        self._append("reviews", row)
        return self.change(comparison_id, change_id)

    def categories(self) -> DataFrame:
        return R.categories(self.spark)
