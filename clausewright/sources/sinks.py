"""Sinks: tables by comparison, and exports as CSV, XLSX and JSON."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clausewright import schemas


def bootstrap(spark: SparkSession, path: str) -> None:
    """Empty documents, comparisons, reviews, changes and summary tables where there are none."""
    for name, schema in (("documents", schemas.DOCUMENTS), ("comparisons", schemas.COMPARISONS), ("reviews", schemas.REVIEWS)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")
    for name, schema in (("changes", schemas.CHANGES), ("summary", schemas.SUMMARY)):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("comparison_id").parquet(f"{path}/{name}")


def save_changes(changes: DataFrame, path: str) -> None:
    """Writes each comparison of ``changes`` as a partition, replacing that partition only; a large one is written by several tasks."""
    _replace(changes.hint("rebalance", "comparison_id"), path)


def save_with_summary(changes: DataFrame, path: str, summary_path: str) -> None:
    """As save_changes, and the counts of each comparison beside it, in a partition that is replaced with the comparison's.

    Counts are taken from what was written, so they are those of the table; what a comparison counted before goes with its old partition.
    """
    from clausewright.operators.reports import summary

    names = changes.select("comparison_id").where("comparison_id IS NOT NULL").distinct()
    save_changes(changes, path)
    stored = changes.sparkSession.read.schema(changes.schema).parquet(path)
    _replace(summary(stored.join(names, "comparison_id", "left_semi")).repartition("comparison_id"), summary_path)


def save_all(changes: DataFrame, path: str, summary_path: str) -> None:
    """Writes a new table of many comparisons, and their counts, in files by size and not in a folder for each comparison.

    Rows stay in the order they come in, so that of changes that are numbered a comparison is in few files, which their statistics tell.
    """
    from clausewright.operators.reports import summary

    changes.write.mode("errorifexists").parquet(path)
    summary(changes.sparkSession.read.schema(changes.schema).parquet(path)).write.mode("errorifexists").parquet(summary_path)


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("comparison_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def save_keyed(stored: DataFrame, rows: DataFrame, keys: list[str], path: str) -> None:
    """Writes the upsert of ``rows`` to a new path; a stored created_at stays."""
    from clausewright.operators.reports import upsert

    if "created_at" in stored.columns and "created_at" in rows.columns:
        first = stored.select(*keys, F.col("created_at").alias("_at"))
        rows = rows.join(first, keys, "left").withColumn("created_at", F.coalesce("_at", "created_at")).drop("_at")
    upsert(stored, rows, keys).write.mode("errorifexists").parquet(path)


def _need_rows(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise LookupError("no changes to export")
    return rows


def export_csv(rows: DataFrame, path: str, parts: int | None = 1) -> None:
    """CSV with a header, in one file unless ``parts`` is None."""
    rows = _need_rows(rows)
    (rows.coalesce(parts) if parts else rows).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def csv_bytes(rows: DataFrame) -> bytes:
    """A download of one comparison: CSV with a byte order mark, streamed partition by partition."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(rows.columns)
    for row in _need_rows(rows).toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def json_parts(changes: DataFrame, stats: DataFrame, comparison_id: str) -> Iterator[str]:
    """{comparison_id, statistics, changes, exported_at} of one comparison, a change at a time."""
    own = changes.where(F.col("comparison_id") == comparison_id)
    yield f'{{"comparison_id": {json.dumps(comparison_id)}, "statistics": {json.dumps(stats.first().asDict())}, "changes": ['
    for k, row in enumerate(own.select(F.to_json(F.struct("*"))).toLocalIterator()):
        yield ("," if k else "") + row[0]
    yield f'], "exported_at": {json.dumps(datetime.now(UTC).isoformat())}}}'


def export_json(changes: DataFrame, stats: DataFrame, comparison_id: str) -> str:
    """json_parts as one text, for comparisons of document size."""
    return "".join(json_parts(changes, stats, comparison_id))


#: Fixed: the name space of a workbook's sheets.
_SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_BOOK_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>'
_STYLES = '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF1F3864"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>'


def _cell(value: object, style: int = 0) -> str:
    text = "".join(c for c in ("" if value is None else str(value)) if c in "\t\n\r" or c >= " ")
    return f'<c t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def xlsx_bytes(rows: DataFrame, sheet: str = "Regulatory Changes") -> bytes:
    """A workbook with one sheet, a styled header and column widths; rows are streamed, nothing else is held."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", _BOOK_RELS)
        z.writestr("xl/styles.xml", _STYLES)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            widths = "".join(f'<col min="{k}" max="{k}" width="{50 if "Text" in c or "Summary" in c else 18}" customWidth="1"/>' for k, c in enumerate(rows.columns, 1))
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cols>{widths}</cols><sheetData>'.encode())
            f.write(("<row>" + "".join(_cell(c, 1) for c in rows.columns) + "</row>").encode())
            for row in _need_rows(rows).toLocalIterator():
                f.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def read_xlsx(spark: SparkSession, data: bytes) -> DataFrame:
    """The first sheet of a workbook that ``xlsx_bytes`` made: the header's columns, all of text."""
    names, rows, at = None, [], f"{{{_SHEET_NS}}}"
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("xl/worksheets/sheet1.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{at}row":
                cells = ["".join(t.text or "" for t in c.iter(f"{at}t")) for c in node]
                if names is None:
                    names = cells
                else:
                    rows.append(cells)
                node.clear()
    kinds = StructType([StructField(n, StringType()) for n in names or []])
    return spark.createDataFrame(rows, kinds)
