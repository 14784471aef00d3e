"""Scans: PDF files, page tables, metadata and version order."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright import schemas
from clausewright.functions import text as T

MAX_BYTES = 50 * 1024 * 1024
#: Fixed: month names in dates of circulars.
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
#: An extractor turns a file's bytes into pages: dicts with blocks (or spans) and tables.
Extractor = Callable[[bytes], list[dict]]


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files below ``path``: path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(path)


def scan_versions(spark: SparkSession, path: str) -> DataFrame:
    """As scan_files, of a folder that must have two files or more to compare."""
    files = scan_files(spark, path)
    if len(files.select("path").limit(2).collect()) < 2:
        raise FileNotFoundError(f"two PDF files or more are needed in {path}")
    return files


def accepted(files: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Files that may be ingested, with their document ids, and those that may not, with the reason."""
    if version not in ("old", "new"):
        raise ValueError("version is old or new")
    reason = F.when(~F.lower("path").endswith(".pdf"), "not a PDF file").when(F.col("length") > MAX_BYTES, "larger than 50 MB")
    files = files.withColumn("reason", reason).withColumn("version", F.lit(version)).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    files = files.withColumn("document_id", F.concat(F.lit(f"DOC_{version}_"), F.substring(F.sha2("path", 256), 1, 8)))
    return files.where("reason IS NULL").drop("reason"), files.where("reason IS NOT NULL").drop("content")


def block_of(spans: list[list[dict]], bbox: Iterable[float] = ()) -> dict | None:
    """A block from lines of spans (text, size, font): joined text, mean size, bold by majority, commonest font."""
    text = "\n".join("".join(s["text"] for s in line) for line in spans)
    own = [s for line in spans for s in line if s["text"].strip()]
    if not text.strip():
        return None
    fonts = [s.get("font", "") for s in own]
    bold = sum("bold" in f.lower() for f in fonts)
    size = round(sum(s.get("size", T_SIZE) for s in own) / len(own), 1) if own else T_SIZE
    font = min(set(fonts), key=lambda f: (-fonts.count(f), f)) if fonts else ""
    return {"text": text, "bbox": [float(x) for x in bbox], "font_size": size, "is_bold": bold > len(own) / 2, "font_name": font, "block_type": "text"}


T_SIZE = 12.0


def clean_tables(tables: list[list[list[str | None]]]) -> list[list[list[str]]]:
    """Cells stripped, empty rows and tables dropped."""
    rows = [[[(c or "").strip() for c in r] for r in t] for t in tables]
    return [kept for t in rows if (kept := [r for r in t if any(r)])]


def extract(files: DataFrame, extractor: Extractor) -> DataFrame:
    """Pages (schemas.PAGES) of accepted files; the extractor is the caller's, as no PDF library is a dependency.

    A file that the extractor fails on has no pages.
    """

    def run(batches):
        for batch in batches:
            for f in batch.itertuples(index=False):
                try:
                    pages = extractor(bytes(f.content))
                except Exception:
                    pages = []
                rows = []
                for k, p in enumerate(pages, 1):
                    blocks = p.get("blocks") or [b for s in p.get("spans", []) if (b := block_of(s))]
                    rows.append((f.document_id, f.filename, f.version, len(pages), None, k, "\n".join(b["text"] for b in blocks if b["text"].strip()), None, blocks, clean_tables(p.get("tables", []))))
                yield pd.DataFrame(rows, columns=["document_id", "filename", "version", "total_pages", "doc_quality", "page_number", "text", "quality_score", "blocks", "tables"])

    return with_quality(files.select("document_id", "filename", "version", "content").mapInPandas(run, schemas.PAGES))


def with_quality(pages: DataFrame) -> DataFrame:
    """Pages with their quality and their document's mean."""
    from pyspark.sql import Window

    pages = pages.withColumn("quality_score", T.quality(F.col("text")))
    return pages.withColumn("doc_quality", F.coalesce(F.avg("quality_score").over(Window.partitionBy("document_id")), F.lit(0.0)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def metadata(text: Column) -> Column:
    """Struct (circular_number, title, issue_date, update_dates) of a first page; the last line that fits wins.

    The words and patterns of lines are fixed values.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), T.strip)
    circular = lambda x: x.rlike("^RBI/")
    title = lambda x: ~circular(x) & x.rlike("(?i)^Master Direction")
    update = lambda x: ~circular(x) & ~title(x) & x.contains("Updated as on")
    issue = lambda x: ~circular(x) & ~title(x) & ~update(x) & x.rlike(rf"^{_MONTH}\s+\d+")
    last = lambda test: F.element_at(F.concat(F.array(F.lit("")), F.filter(lines, test)), -1)
    dates = F.filter(F.transform(F.filter(lines, update), lambda x: F.regexp_extract(x, r"(?U)(\w+ \d+, \d{4})", 1)), lambda d: d != "")
    return F.struct(last(circular).alias("circular_number"), last(title).alias("title"), last(issue).alias("issue_date"), dates.alias("update_dates"))


def metadata_contains(text: Column) -> Column:
    """As metadata, but the title may stand anywhere in a line and there are no update dates."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), T.strip)
    circular = lambda x: x.rlike("^RBI/")
    title = lambda x: ~circular(x) & x.contains("Master Direction")
    issue = lambda x: ~circular(x) & ~title(x) & x.rlike(rf"^{_MONTH}\s+\d+")
    last = lambda test: F.element_at(F.concat(F.array(F.lit("")), F.filter(lines, test)), -1)
    return F.struct(last(circular).alias("circular_number"), last(title).alias("title"), last(issue).alias("issue_date"))


def circular_year(first_page: Column) -> Column:
    """The year of a circular's number, else of the first date, else 0."""
    head = F.substring(F.coalesce(first_page, F.lit("")), 1, 500)
    number = F.regexp_extract(head, r"RBI[/\s].*?(\d{4})-\d{2}", 1).try_cast("int")
    dated = F.regexp_extract(head, rf"{_MONTH}\s+\d{{1,2}},?\s+(\d{{4}})", 1).try_cast("int")
    return F.coalesce(number, dated, F.lit(0))


def version_order(first_pages: DataFrame, keys: list[str], text: str = "text", tie: str = "filename") -> DataFrame:
    """``first_pages`` with year and version: 1 is the oldest of those that share ``keys``, equal years by ``tie``."""
    from pyspark.sql import Window

    rows = first_pages.withColumn("year", circular_year(F.col(text)))
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy("year", tie)))


def find_document(documents: DataFrame, files: DataFrame, document_id: str) -> DataFrame:
    """The stored path of a document, else of a file whose name starts with the id."""
    stored = documents.where(F.col("document_id") == document_id).select(F.col("file_path").alias("path"), F.lit(0).alias("k"))
    named = files.where(F.element_at(F.split("path", "/"), -1).startswith(document_id)).select("path", F.lit(1).alias("k"))
    return stored.where("path IS NOT NULL").unionByName(named).orderBy("k", "path").limit(1).select("path")
