"""Registered queries over blocks and nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import changes as CH
from clausewright.operators import structure as ST
from clausewright.plans import clauses as C
from clausewright.sources import documents as DOC
from clausewright.sources import enrich

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_LINES = "lines AS (SELECT doc_id, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL))"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    return lines.select("doc_id", F.col("i").cast("bigint").alias("i"), T.strip(F.col("x")).alias("text"))


@query("block_filter", f"WITH {_LINES} SELECT doc_id, i FROM lines WHERE length(text) >= 3 AND NOT regexp_matches(text, '^\\d{{1,3}}$') AND NOT regexp_matches(text, '\\.{{4,}}') AND NOT regexp_matches(text, '(?i)^\\s*Contents\\s*$') AND NOT (i % 2 = 0 AND regexp_matches(text, '^[A-Z][a-z]+.*\\d+\\s*$') AND length(text) < 100)")
def _(spark, d):
    return _lines(spark, d).where(ST.keeps_block(F.col("text"), F.col("i") % 2 == 0)).select("doc_id", "i")


_CONTENTS = "'Scope ' || repeat('.', cast(k % 7 AS INT)) || ' 1' || chr(10) || 'Terms ' || repeat('.', cast(c % 8 AS INT)) || ' 2' || chr(10) || 'Forms ' || repeat('.', cast((k + c) % 6 AS INT)) || ' 3' || chr(10) || 'Annex ' || repeat('.', cast(c % 11 AS INT)) || ' 4'"


@query("toc_pages", f"SELECT k FROM (SELECT k, {_CONTENTS} AS text FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)) WHERE len(regexp_extract_all(text, '\\.{{4,}}')) >= 3")
def _(spark, d):
    pages = _read(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c").selectExpr("k", f"{_CONTENTS} AS text")
    return pages.where(ST.is_toc_page(F.col("text"))).select("k")


#: A block for each order, of a kind by its key; documents are runs of 40 keys.
_BLOCK = """CASE k % 13 WHEN 0 THEN 'CHAPTER IV General ' || c WHEN 1 THEN 'Part II - Scope ' || c WHEN 2 THEN k % 90 || '. Duties of banks ' || c
    WHEN 3 THEN k % 9 || '.' || c % 9 || ' Returns and forms ' || c WHEN 4 THEN k % 9 || '.' || c % 9 || '.1 Annual returns' WHEN 5 THEN '(b) Banks file form ' || c
    WHEN 6 THEN '(iv) and keep copies ' || c WHEN 7 THEN '(' || c % 50 || ') with proof of it' WHEN 8 THEN '"Bank" means company ' || c WHEN 9 THEN 'Annex III forms ' || c
    WHEN 10 THEN 'General remarks on ' || c WHEN 11 THEN 'continued in lower case ' || c ELSE 'Plain paragraph ' || c END"""
_BLOCKS = f"blocks AS (SELECT k, c, k // 40 AS doc, k % 2 = 0 AS bold, CASE WHEN k % 5 = 0 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS size, {_BLOCK} AS text FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders))"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    base = _read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return base.selectExpr("k", "c", "k div 40 AS doc", "k % 2 = 0 AS bold", "CASE WHEN k % 5 = 0 THEN 14.0D ELSE 10.0D END AS size", f"{_BLOCK} AS text")


_RULES = [
    ("chapter", "regexp_matches(text, '(?i)^chapter\\s*[-–]?\\s*([IVXLCDM]+|\\d+)\\b')", "'Ch.' || regexp_extract(text, '(?i)^chapter\\s*[-–]?\\s*([IVXLCDM]+|\\d+)\\b', 1)", "trim(regexp_replace(text, '(?i)^chapter\\s*[-–]?\\s*([IVXLCDM]+|\\d+)\\b', ''))"),
    ("annexure", "regexp_matches(text, '(?i)^(annexure|annex|appendix|schedule)')", "'Annexure ' || regexp_extract(text, '(?i)^(?:annexure|annex|appendix|schedule)\\s*(.*)', 1)", "regexp_extract(text, '(?i)^(?:annexure|annex|appendix|schedule)\\s*(.*)', 1)"),
    ("section", "regexp_matches(text, '(?i)^part\\s*[-–]?\\s*([IVXLCDM]+|\\d+)\\b') AND heading", "'Part ' || regexp_extract(text, '(?i)^part\\s*[-–]?\\s*([IVXLCDM]+|\\d+)\\b', 1)", "regexp_extract(text, '(?i)^part\\s*[-–]?\\s*([IVXLCDM]+|\\d+)\\b\\s*[-–:]?\\s*(.*)', 2)"),
    ("subsection", "regexp_matches(text, '^\\d+\\.\\d+(\\.\\d+)?\\s')", "regexp_extract(text, '^(\\d+\\.\\d+(?:\\.\\d+)?)\\s', 1)", "CASE WHEN heading THEN regexp_replace(text, '^\\S+\\s+', '') ELSE '' END"),
    ("section", "regexp_matches(text, '^\\d+\\.\\s') AND heading", "regexp_extract(text, '^(\\d+)\\.', 1)", "regexp_replace(text, '^\\S+\\s+', '')"),
    ("clause", "regexp_matches(text, '^\\d+\\.\\s')", "regexp_extract(text, '^(\\d+)\\.', 1)", "''"),
    ("clause", "regexp_matches(text, '^\\([a-z]\\)\\s')", "regexp_extract(text, '^\\([a-z]\\)')", "''"),
    ("sub_clause", "regexp_matches(text, '^\\(([ivxlcdm]+|\\d+)\\)\\s')", "regexp_extract(text, '^\\([a-z0-9]+\\)')", "''"),
    ("definition", "regexp_matches(text, '(?i)^[\"'']([^\"'']+)[\"'']?\\s+(means|refers to|shall mean|includes)')", "''", "''"),
    ("section", "heading AND length(text) < 100 AND size > 11.0", "''", "text"),
]
_case = lambda i, other: "CASE " + " ".join(f"WHEN {r[1]} THEN {r[i] if i else chr(39) + r[0] + chr(39)}" for r in _RULES) + f" ELSE {other} END"
_CLASSIFIED = f"{_BLOCKS}, classified AS (SELECT *, {_case(0, chr(39) + 'paragraph' + chr(39))} AS content_type, {_case(2, chr(39) * 2)} AS section_number, {_case(3, chr(39) * 2)} AS heading_text FROM (SELECT *, size > 10.0 * 1.15 OR bold AS heading FROM blocks))"


def _classified(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    ten = F.lit(10.0)
    kind = ST.classify_block(F.col("text"), ST.is_heading(F.col("size"), F.col("bold"), ten), F.col("size"), ten)
    return b.withColumn("q", kind).select("k", "c", "doc", "text", "q.*")


@query("block_classify", f"WITH {_CLASSIFIED} SELECT k, content_type, section_number, heading_text AS heading FROM classified")
def _(spark, d):
    return _classified(spark, d).select("k", "content_type", "section_number", "heading")


@query("body_size", f"WITH {_BLOCKS} SELECT k, round(coalesce(avg(CASE WHEN size > 0 AND length(text) > 20 THEN size END) OVER (PARTITION BY doc), 12.0), 6) AS avg_size FROM blocks")
def _(spark, d):
    b = _blocks(spark, d).withColumnRenamed("size", "font_size")
    return b.select("k", F.round(ST.average_body_size(b, ["doc"]), 6).alias("avg_size"))


_LAST = "last_value(CASE WHEN {w} THEN k END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_HIERARCHY = f"""{_CLASSIFIED}, marked AS (SELECT *, content_type = 'section' AND section_number LIKE 'Part %' AS is_part FROM classified),
    lasts AS (SELECT *, {_LAST.format(w="content_type IN ('chapter', 'annexure')")} AS c_, {_LAST.format(w="is_part")} AS p_, {_LAST.format(w="content_type = 'section' AND NOT is_part")} AS s_, {_LAST.format(w="content_type = 'subsection'")} AS u_ FROM marked),
    valid AS (SELECT *, CASE WHEN p_ > coalesce(c_, -1) THEN p_ END AS p, CASE WHEN s_ > greatest(coalesce(c_, -1), coalesce(p_, -1)) THEN s_ END AS s, CASE WHEN u_ > greatest(coalesce(c_, -1), coalesce(p_, -1), coalesce(s_, -1)) THEN u_ END AS u FROM lasts),
    placed AS (SELECT *, CASE WHEN content_type IN ('chapter', 'annexure', 'definition') THEN NULL WHEN is_part THEN c_ WHEN content_type = 'section' THEN coalesce(p, c_) WHEN content_type = 'subsection' THEN coalesce(s, p, c_) ELSE coalesce(u, s, p, c_) END AS parent,
        CASE WHEN content_type IN ('chapter', 'annexure') THEN 1 WHEN content_type = 'definition' THEN 0 WHEN is_part THEN 2 WHEN content_type = 'section' THEN CASE WHEN p IS NULL THEN 2 ELSE 3 END WHEN content_type = 'subsection' THEN CASE WHEN p IS NULL THEN 3 ELSE 4 END
             WHEN u IS NOT NULL THEN 5 WHEN s IS NOT NULL THEN 4 ELSE 3 END AS depth FROM valid)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    rows = _classified(spark, d).withColumn("node_id", F.concat(F.lit("N"), F.col("k").cast("string"))).withColumn("order", F.col("k"))
    return ST.hierarchy(rows, ["doc"])


@query("hierarchy_parent", f"WITH {_HIERARCHY} SELECT k, 'N' || parent AS parent_id, depth FROM placed")
def _(spark, d):
    return _placed(spark, d).select("k", "parent_id", "depth")


@query("node_numbering", f"""WITH {C.SQL}, made AS (SELECT k, k // 240 AS doc, k // 40 % 6 AS p, row_number() OVER (PARTITION BY k // 240 ORDER BY k) - 1 AS place FROM olds)
    SELECT format('DOC_old_{{}}_N{{:04d}}', doc, place) AS node_id, p + 1 AS page_start, place FROM made""")
def _(spark, d):
    """Ids, pages and places of the nodes that pages become."""
    return ST.nodes(_pages(spark, d, "old"), compose=False).select("node_id", "page_start", F.col("order").alias("place"))


@query("first_sections", "SELECT 'DOC_old_' || doc AS document_id, section FROM (SELECT k // 240 AS doc, k // 40 % 9 + 1 AS section, row_number() OVER (PARTITION BY k // 240 ORDER BY k) AS r FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 11 <> 0 AND k % 40 = 1) WHERE r <= 3")
def _(spark, d):
    rows = ST.first_sections(ST.nodes(_pages(spark, d, "old"), compose=False), 3)
    return rows.select("document_id", F.col("section_number").cast("bigint").alias("section"))


@query("clause_units", f"WITH {_CLASSIFIED} SELECT k, content_type FROM classified WHERE content_type IN ('clause', 'sub_clause', 'paragraph', 'definition') AND length(text) > 10")
def _(spark, d):
    return ST.clause_units(_classified(spark, d)).select("k", "content_type")


@query("section_nodes", f"WITH {_CLASSIFIED} SELECT k, section_number FROM classified WHERE content_type IN ('chapter', 'section', 'subsection', 'annexure')")
def _(spark, d):
    return ST.sections(_classified(spark, d)).select("k", "section_number")


@query("leaf_nodes", f"WITH {_HIERARCHY} SELECT k FROM placed WHERE k NOT IN (SELECT parent FROM placed WHERE parent IS NOT NULL)")
def _(spark, d):
    return ST.leaf_nodes(_placed(spark, d)).select("k")


@query("node_children", f"WITH {_HIERARCHY} SELECT 'N' || parent AS parent_id, string_agg('N' || k, ',' ORDER BY k) AS children FROM placed WHERE parent IS NOT NULL GROUP BY parent")
def _(spark, d):
    return ST.children(_placed(spark, d)).select("parent_id", F.array_join("children_ids", ",").alias("children"))


@query("paragraph_merge", f"""WITH {_LINES}, f AS (SELECT *, CASE WHEN i > 0 AND (text = '' OR regexp_matches(text, '^(\\p{{Ll}}|[,;-])')) THEN 0 ELSE 1 END AS fresh FROM lines),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM f)
    SELECT doc_id, min(i) AS first_line, max(i) AS last_line, string_agg(text, ' ' ORDER BY i) AS text FROM g GROUP BY doc_id, island""")
def _(spark, d):
    rows = _lines(spark, d).select("doc_id", F.col("i").alias("order"), "text", F.lit("paragraph").alias("content_type"), F.lit("").alias("section_number"), F.lit("").alias("heading"), F.lit(None).cast("string").alias("parent_id"), F.col("i").alias("page_start"), F.col("i").alias("page_end"))
    return ST.merge_paragraphs(rows, ["doc_id"]).select("doc_id", F.col("page_start").alias("first_line"), F.col("page_end").alias("last_line"), "text")


@query("table_to_text", "SELECT s_suppkey, s_name || ' | ' || s_nationkey || chr(10) || 'key | ' || s_suppkey AS text FROM supplier")
def _(spark, d):
    rows = F.array(F.array(F.col("s_name"), F.col("s_nationkey").cast("string")), F.array(F.lit("key"), F.col("s_suppkey").cast("string")))
    return _read(spark, d, "supplier").select("s_suppkey", T.table_text(rows).alias("text"))


_FIRST_PAGE = "'Reserve notes' || chr(10) || 'RBI/' || (2000 + c % 25) || '-' || (10 + c % 25) || '/' || k || chr(10) || 'Master Direction on topic ' || k % 9 || chr(10) || 'March ' || (1 + k % 28) || ', ' || (1990 + k % 30) || chr(10) || 'Updated as on May ' || (1 + c % 28) || ', 2021' || chr(10) || CASE WHEN k % 3 = 0 THEN 'RBI/late/' || k ELSE 'end' END"


@query("doc_metadata", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'RBI/late/' || o_orderkey ELSE 'RBI/' || (2000 + o_custkey % 25) || '-' || (10 + o_custkey % 25) || '/' || o_orderkey END AS circular_number, 'Master Direction on topic ' || o_orderkey % 9 AS title, 'March ' || (1 + o_orderkey % 28) || ', ' || (1990 + o_orderkey % 30) AS issue_date, 'May ' || (1 + o_custkey % 28) || ', 2021' AS update_dates FROM orders")
def _(spark, d):
    pages = _read(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c").selectExpr("k", f"{_FIRST_PAGE} AS text")
    return pages.select("k", DOC.metadata(F.col("text")).alias("m")).select("k", "m.circular_number", "m.title", "m.issue_date", F.array_join("m.update_dates", ",").alias("update_dates"))


@query("doc_metadata_contains", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'RBI/late/' || o_orderkey ELSE 'RBI/' || (2000 + o_custkey % 25) || '-' || (10 + o_custkey % 25) || '/' || o_orderkey END AS circular_number, 'The Master Direction on topic ' || o_orderkey % 9 AS title, 'March ' || (1 + o_orderkey % 28) || ', ' || (1990 + o_orderkey % 30) AS issue_date FROM orders")
def _(spark, d):
    """Titles that don't begin their line."""
    pages = _read(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c").selectExpr("k", f"replace({_FIRST_PAGE}, 'Master', 'The Master') AS text")
    return pages.select("k", DOC.metadata_contains(F.col("text")).alias("m")).select("k", "m.*")


@query("version_order", "SELECT o_orderkey AS k, 2000 + o_custkey % 25 AS year, row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY 2000 + o_custkey % 25, o_orderkey) AS version FROM orders")
def _(spark, d):
    pages = _read(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c").selectExpr("k", "k div 10 AS set", f"{_FIRST_PAGE} AS text")
    return DOC.version_order(pages, ["set"], tie="k").select("k", F.col("year").cast("bigint").alias("year"), F.col("version").cast("bigint").alias("version"))


@query("llm_prompt", f"WITH {C.SQL_CHANGES} SELECT comparison_id, change_id, CASE WHEN old_requirement = '' THEN '(No old text - newly added)' ELSE old_requirement END AS old_text, CASE WHEN new_requirement = '' THEN '(No new text - removed)' ELSE new_requirement END AS new_text FROM changes WHERE is_substantive AND impact IN ('CRITICAL', 'HIGH')")
def _(spark, d):
    rows = C.changes(spark, d).where(enrich.wanted())
    rows = rows.withColumn("p", enrich.prompt(rows))
    return rows.select("comparison_id", "change_id", F.regexp_extract("p", r"OLD TEXT: (.*)", 1).alias("old_text"), F.regexp_extract("p", r"NEW TEXT: (.*)", 1).alias("new_text"))


def _pages(spark: SparkSession, d: str, side: str, numbered: bool = False) -> DataFrame:
    """Pages of 40 blocks made from the generated clauses, six pages a document; clauses have letters that repeat, or numbers."""
    rows = C.numbered_clauses(spark, d, side) if numbered else (C.old_clauses if side == "old" else C.new_clauses)(spark, d)
    text = F.col("text") if numbered else F.concat(F.lit("("), F.element_at(F.array(*[F.lit(x) for x in "abefgh"]), (F.col("k") % 6 + 1).cast("int")), F.lit(") "), F.col("text"))
    block = F.struct(F.when(F.col("k") % 40 == 1, F.concat((F.expr("k div 40 % 9") + 1).cast("string"), F.lit(". Title of section"))).otherwise(text).alias("text"), F.array().cast("array<double>").alias("bbox"), F.lit(10.0).alias("font_size"), (F.col("k") % 40 == 1).alias("is_bold"), F.lit("F").alias("font_name"), F.lit("text").alias("block_type"))
    pages = rows.groupBy(F.expr("k div 240").alias("doc"), F.expr("k div 40 % 6").alias("p")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    return pages.select(F.format_string(f"DOC_{side}_%d", "doc").alias("document_id"), F.lit("f").alias("filename"), F.lit(side).alias("version"), F.lit(6).alias("total_pages"), F.lit(1.0).alias("doc_quality"), (F.col("p") + 1).cast("int").alias("page_number"), ST.page_text(F.col("blocks")).alias("text"), F.lit(1.0).alias("quality_score"), "blocks", F.array().cast("array<array<array<string>>>").alias("tables"))


def _compared(spark: SparkSession, d: str, numbered: bool) -> DataFrame:
    old, new = _pages(spark, d, "old", numbered), _pages(spark, d, "new", numbered)
    sides = [df.select(F.regexp_extract("document_id", r"(\d+)$", 1).alias("n")).distinct() for df in (old, new)]
    comparisons = sides[0].join(sides[1], "n").select(F.concat(F.lit("CMP_"), "n").alias("comparison_id"), F.concat(F.lit("DOC_old_"), "n").alias("old_document_id"), F.concat(F.lit("DOC_new_"), "n").alias("new_document_id"))
    out = CH.compare(old, new, comparisons, compose=False)
    return out.select("comparison_id", "change_id", "change_type", "category", "is_substantive", "impact", F.round("confidence.overall", 6).alias("confidence_overall"), "change_summary", "old_requirement", "new_requirement")


@query("compare_documents")
def _(spark, d):
    """The whole comparison of generated documents: nodes, alignment, diff, classification and scores."""
    return _compared(spark, d, False)


@query("compare_pages", f"WITH {C.SQL_PAGES} SELECT comparison_id, change_id, change_type, category, is_substantive, impact, confidence_overall, change_summary, old_requirement, new_requirement FROM changes")
def _(spark, d):
    """As compare_documents, of documents whose clauses have numbers, so that SQL can follow the whole way."""
    return _compared(spark, d, True)
