"""Registered queries over clause pairs and changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright import lexicon
from clausewright.functions import compare as D
from clausewright.functions import extract as E
from clausewright.functions import scores as S
from clausewright.operators import align as A
from clausewright.operators import reports as R
from clausewright.plans import aligned as L
from clausewright.plans import clauses as C
from clausewright.sources import enrich, sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _changes(sql: str) -> str:
    return f"WITH {C.SQL_CHANGES} {sql}"


def _pairs(sql: str) -> str:
    return f"WITH {C.SQL_PAIRS} {sql}"


# --- alignment: nodes whose ratios are known, through all layers


def _align_sql(columns: str, where: str = "true") -> str:
    return f"WITH {L.SQL} SELECT {columns} FROM aligned WHERE {where}"


_ALIGNED = "comparison_id, old_node_id, new_node_id, alignment_type, match_method, round(confidence, 6) AS confidence"


@query("align_all", _align_sql(_ALIGNED))
def _(spark, d):
    return L.aligned(spark, d).select("comparison_id", "old_node_id", "new_node_id", "alignment_type", "match_method", F.round("confidence", 6).alias("confidence"))


@query("align_exact", _align_sql("old_node_id, new_node_id, round(confidence, 6) AS confidence, round(score, 6) AS text_similarity", "match_method = 'exact'"))
def _(spark, d):
    return A.exact_layer(*L.nodes(spark, d)).select("old_node_id", "new_node_id", F.round("confidence", 6).alias("confidence"), F.round(F.try_element_at("similarity_scores", F.lit("text_similarity")), 6).alias("text_similarity"))


@query("align_structural", _align_sql("old_node_id, new_node_id, round(confidence, 6) AS confidence", "match_method = 'structural'"))
def _(spark, d):
    """Headings of the nodes that have no section number; the exact layer leaves them all."""
    o, n = (df.where("section_number = ''") for df in L.nodes(spark, d))
    return A.structural_layer(o, n).select("old_node_id", "new_node_id", F.round("confidence", 6).alias("confidence"))


@query("align_removed", _align_sql("comparison_id, old_node_id", "alignment_type = 'REMOVED'"))
def _(spark, d):
    return L.aligned(spark, d).where("alignment_type = 'REMOVED'").select("comparison_id", "old_node_id")


@query("align_added", _align_sql("comparison_id, new_node_id", "alignment_type = 'ADDED'"))
def _(spark, d):
    return L.aligned(spark, d).where("alignment_type = 'ADDED'").select("comparison_id", "new_node_id")


@query("align_counts", f"WITH {L.SQL} SELECT comparison_id, count(*) FILTER (WHERE alignment_type = 'ADDED') AS added, count(*) FILTER (WHERE alignment_type = 'REMOVED') AS removed, count(*) FILTER (WHERE alignment_type = 'ONE_TO_ONE') AS matched FROM aligned GROUP BY comparison_id")
def _(spark, d):
    return A.alignment_counts(L.aligned(spark, d))


# --- numbers, dates, obligations


def _exploded(values: str, get) -> Callable:
    def run(spark, d):
        rows = C.old_clauses(spark, d).select("section", F.posexplode(get(F.col("text"))).alias("i", "v"))
        return rows.select("section", F.col("i").cast("bigint").alias("i"), "v.text", "v.value", "v.unit")

    return run


_LIST = "SELECT section, unnest(range(len(m))) AS i, unnest(m) AS text, unnest(v) AS value, unnest(u) AS unit FROM"
_D1, _D3 = ("(?:within\\s+)?(\\d+)\\s*(days?|months?|years?|weeks?|hours?)", "(?:period\\s+of\\s+)(\\d+)\\s*(days?|months?|years?)")
QUERIES["money_extract"] = _exploded("money", E.money)
ORACLES["money_extract"] = f"""WITH {C.SQL} {_LIST} (SELECT section,
    regexp_extract_all(text, '(?i)INR\\s*\\d+\\s*(?:crore|crores|lakh|lakhs|thousand|million|billion)?', 0) || regexp_extract_all(text, '(?i)\\d+\\s*(?:crore|crores|lakh|lakhs)\\b', 0) AS m,
    [lakh * 100000.0::DOUBLE, lakh * 100000.0::DOUBLE] AS v, ['lakh', 'lakh'] AS u FROM olds)"""
QUERIES["percent_extract"] = _exploded("percent", E.percentages)
ORACLES["percent_extract"] = f"""WITH {C.SQL} {_LIST} (SELECT section, regexp_extract_all(text, '(?i)(\\d+(?:\\.\\d+)?)\\s*(?:per\\s*cent|percent|%)', 0) AS m,
    list_transform(regexp_extract_all(text, '(?i)(\\d+(?:\\.\\d+)?)\\s*(?:per\\s*cent|percent|%)', 1), lambda x: cast(x AS DOUBLE)) AS v, ['%'] AS u FROM olds)"""
QUERIES["duration_extract"] = _exploded("duration", E.durations)
ORACLES["duration_extract"] = f"""WITH {C.SQL} {_LIST} (SELECT section, regexp_extract_all(text, '(?i){_D1}', 0) AS m,
    list_transform(regexp_extract_all(text, '(?i){_D1}', 1), lambda x: cast(x AS DOUBLE)) AS v, list_transform(regexp_extract_all(text, '(?i){_D1}', 2), lambda x: rtrim(lower(x), 's')) AS u FROM olds)"""


@query("date_extract", f"WITH {C.SQL} SELECT section, unnest(regexp_extract_all(text, '(?i)(\\d{{1,2}})\\s+(January|February|March|April|May|June|July|August|September|October|November|December)\\s+(\\d{{4}})', 0)) AS date_text FROM news")
def _(spark, d):
    return C.new_clauses(spark, d).select("section", F.explode(E.dates(F.col("text"))).alias("date_text"))


@query("limit_extract", "SELECT o_orderkey, unnest(regexp_extract_all(t, '(?i)(?:minimum|min\\.?)\\s+(?:of\\s+)?(?:₹|Rs\\.?|INR)?\\s*(\\d+(?:,\\d+)*(?:\\.\\d+)?)', 1) || regexp_extract_all(t, '(?i)(?:not\\s+(?:exceeding|exceed|more\\s+than))\\s+(?:₹|Rs\\.?|INR)?\\s*(\\d+(?:,\\d+)*(?:\\.\\d+)?)', 1)) AS amount FROM (SELECT o_orderkey, 'a minimum of Rs. ' || o_custkey || ',000 but not exceeding INR ' || o_orderkey AS t FROM orders)")
def _(spark, d):
    text = F.concat(F.lit("a minimum of Rs. "), F.col("o_custkey").cast("string"), F.lit(",000 but not exceeding INR "), F.col("o_orderkey").cast("string"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.explode(E.limits(text)).alias("amount"))


_NUMBERS = _pairs("""SELECT o_section AS section, 'monetary' AS field, 'INR ' || o_lakh || ' lakh' AS old_value, 'INR ' || n_lakh || ' lakh' AS new_value, o_lakh * 100000.0::DOUBLE AS old_numeric, n_lakh * 100000.0::DOUBLE AS new_numeric, 'lakh' AS unit FROM pairs
    UNION ALL SELECT o_section, 'monetary', o_lakh || ' lakh', n_lakh || ' lakh', o_lakh * 100000.0::DOUBLE, n_lakh * 100000.0::DOUBLE, 'lakh' FROM pairs
    UNION ALL SELECT o_section, 'percentage', o_pct || ' percent', n_pct || ' percent', o_pct, n_pct, '%' FROM pairs
    UNION ALL SELECT o_section, 'duration', 'within ' || o_days || ' days', 'within ' || n_days || ' days', o_days, n_days, 'day' FROM pairs""")
_CHANGED = f"SELECT *, CASE WHEN new_numeric > old_numeric THEN 'INCREASE' ELSE 'DECREASE' END AS direction, round(abs((new_numeric - old_numeric) / old_numeric * 100), 6) AS magnitude_percent FROM ({_NUMBERS}) WHERE old_numeric <> new_numeric"


@query("number_changes", _CHANGED)
def _(spark, d):
    """Values matched by unit and context."""
    rows = C.pairs(spark, d).select(F.col("o_section").alias("section"), F.explode(D.number_changes(F.col("o_text"), F.col("n_text"))).alias("n"))
    return rows.select("section", "n.*").withColumn("magnitude_percent", F.round("magnitude_percent", 6))


@query("numeric_change", f"SELECT section, field, old_numeric, new_numeric, direction, magnitude_percent FROM ({_CHANGED})")
def _(spark, d):
    return QUERIES["number_changes"](spark, d).drop("old_value", "new_value", "unit")


@query("all_numbers", f"WITH {C.SQL} SELECT section, 2 AS monetary, 1 AS percentages, 1 AS durations, day || ' March ' || year AS dates, round(2 * lakh * 100000.0::DOUBLE + pct + days, 6) AS total FROM olds")
def _(spark, d):
    n = C.old_clauses(spark, d).select("section", E.numbers(F.col("text")).alias("n"))
    sums = F.aggregate(F.flatten(F.array(F.col("n.monetary.value"), F.col("n.percentages.value"), F.col("n.durations.value"))), F.lit(0.0), lambda acc, x: acc + x)
    return n.select("section", *[F.size(f"n.{c}").alias(c) for c in ("monetary", "percentages", "durations")], F.array_join("n.dates", "; ").alias("dates"), F.round(sums, 6).alias("total"))


@query("date_cross", _pairs("SELECT o_section AS section, cast(o_day AS STRING) || ' March ' || cast(o_year AS STRING) AS old_value, cast(n_day AS STRING) || ' March ' || cast(n_year AS STRING) AS new_value FROM pairs WHERE o_day <> n_day OR o_year <> n_year"))
def _(spark, d):
    rows = C.pairs(spark, d).select(F.col("o_section").alias("section"), F.explode(E.date_changes(F.col("o_text"), F.col("n_text"))).alias("n"))
    return rows.select("section", "n.old_value", "n.new_value")


@query("obligation_terms", f"WITH {C.SQL} SELECT section, array_to_string(t, ', ') AS terms, {C._strength_sql('t')} AS strength FROM (SELECT section, {C._terms_sql('text')} AS t FROM olds)")
def _(spark, d):
    terms = E.obligation_terms(F.col("text"))
    return C.old_clauses(spark, d).select("section", F.array_join(terms, ", ").alias("terms"), E.strength(terms).alias("strength"))


@query("obligation_change", _pairs(f"""SELECT o_section AS section, {C.direction_sql("a", "b")} AS direction, {C._strength_sql("a")} AS old_strength, {C._strength_sql("b")} AS new_strength, {C.explanation_sql("a", "b", "ca", "cb")} AS explanation
    FROM (SELECT o_section, {C._terms_sql("o_text")} AS a, {C._terms_sql("n_text")} AS b, {C._conditions_sql("o_text")} AS ca, {C._conditions_sql("n_text")} AS cb FROM pairs)"""))
def _(spark, d):
    ob = E.obligation_change(F.col("o_text"), F.col("n_text"))
    return C.pairs(spark, d).select(F.col("o_section").alias("section"), ob.alias("ob")).select("section", "ob.direction", "ob.old_strength", "ob.new_strength", "ob.explanation")


@query("conditionals", f"WITH {C.SQL} SELECT section, array_to_string(list_filter([{', '.join('CASE WHEN regexp_matches(text, ' + chr(39) + '(?i)' + p.replace(' ', '[[:space:]]+') + chr(39) + ') THEN ' + chr(39) + p + chr(39) + ' END' for p in lexicon.CONDITIONALS)}], lambda x: x IS NOT NULL), ', ') AS phrases FROM news")
def _(spark, d):
    return C.new_clauses(spark, d).select("section", F.array_join(E.conditionals(F.col("text")), ", ").alias("phrases"))


# --- diffs


@query("word_diff", f"WITH {C.SQL_DIFFS} SELECT o_section AS section, round(ratio, 6) AS similarity_ratio, round(density, 6) AS change_density, added, removed, diff_sub AS is_substantive FROM diffs")
def _(spark, d):
    rows = C.pairs(spark, d).select(F.col("o_section").alias("section"), "o_text", "n_text", D.word_diff("o_text", "n_text").alias("diff"))
    return rows.select("section", F.round("diff.similarity_ratio", 6).alias("similarity_ratio"), F.round("diff.change_density", 6).alias("change_density"), F.array_join("diff.added_words", " ").alias("added"), F.array_join("diff.removed_words", " ").alias("removed"), D.is_substantive(F.col("o_text"), F.col("n_text"), F.col("diff")).alias("is_substantive"))


@query("html_diff", f"WITH {C.SQL_DIFFS} SELECT o_section AS section, old_html, new_html FROM diffs")
def _(spark, d):
    rows = C.pairs(spark, d).select(F.col("o_section").alias("section"), D.word_diff("o_text", "n_text").alias("diff"))
    return rows.select("section", D.html_diff(F.col("diff")).alias("h")).select("section", "h.old_html", "h.new_html")


@query("char_ratio", "SELECT o_orderkey, round(2.0::DOUBLE * least(p, q) / (p + q), 6) AS ratio FROM (SELECT o_orderkey, 1 + o_orderkey % 23 AS p, 1 + o_custkey % 29 AS q FROM orders)")
def _(spark, d):
    """Runs of one letter have the shorter run in common, and no more."""
    runs = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", *[F.repeat(F.lit("a"), (F.lit(1) + F.col(c) % m).cast("int")).alias(n) for n, c, m in (("a", "o_orderkey", 23), ("b", "o_custkey", 29))])
    return runs.select("o_orderkey", F.round(D.text_ratio("a", "b"), 6).alias("ratio"))


# --- classification and scores


@query("category_keywords", f"WITH {C.SQL} SELECT section, {C.keyword_category_sql('text')} AS category FROM olds")
def _(spark, d):
    return C.old_clauses(spark, d).select("section", S.keyword_category(F.lit(""), F.col("text")).alias("category"))


@query("category_added", f"WITH {C.SQL} SELECT section, {C.added_category_sql('text')} AS category FROM news")
def _(spark, d):
    return C.new_clauses(spark, d).select("section", S.added_category(F.col("text"), F.lit(False)).alias("category"))


@query("change_type", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 100 > 90 THEN 'RELOCATED' WHEN o_orderkey % 100 > 80 AND o_custkey % 2 = 0 THEN 'REWORDED' ELSE 'MODIFIED' END AS change_type FROM orders")
def _(spark, d):
    ratio = (F.col("o_orderkey") % 100) / 100
    new = F.when(F.col("o_custkey") % 3 == 0, "2").otherwise("1")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.change_type(F.lit("1"), new, ratio, F.col("o_custkey") % 2 != 0).alias("change_type"))


_REF = lambda p, there: ", ".join(f"CASE WHEN {there} THEN {v} END AS {p}_{n}" for n, v in (("page", "k % 90 + 1"), ("page_end", "k % 90 + 1 + k % 2"), ("section", {"old": "os", "new": "ns"}[p]), ("clause", {"old": "os", "new": "ns"}[p]), ("heading", C._HEADING), ("text", f"substr({p}_text, 1, 500)"), ("node", f"'{p[0].upper()}' || section")))


@query("classified_changes", _changes(f"""SELECT comparison_id, change_id, change_type, category, is_substantive, impact, change_summary, old_requirement, new_requirement, negation_changed,
    round(structural, 6) AS structural_match, round(lexical, 6) AS lexical_similarity, round(semantic, 6) AS semantic_similarity, numerical AS numerical_agreement, evidence_quality, confidence_overall,
    CASE WHEN direction <> 'UNCHANGED' THEN explanation END AS explanation, coalesce(plain_numbers, '') AS numbers, old_html, new_html, {_REF("old", "old_text IS NOT NULL")}, {_REF("new", "new_text IS NOT NULL")},
    concat_ws(' | ', substr(old_text, 1, CASE WHEN new_text IS NULL THEN 300 ELSE 200 END), substr(new_text, 1, CASE WHEN old_text IS NULL THEN 300 ELSE 200 END)) AS evidence FROM changes"""))
def _(spark, d):
    """Everything that a classified change has."""
    ref = lambda p: [F.col(f"{p}_reference.{x}").alias(f"{p}_{y}") for x, y in (("page", "page"), ("page_end", "page_end"), ("section", "section"), ("clause", "clause"), ("heading", "heading"), ("text", "text"), ("node_id", "node"))]
    html = F.get("diff_highlights", F.lit(0))
    signals = [F.round(f"confidence.{x}", 6).alias(x) for x in ("structural_match", "lexical_similarity", "semantic_similarity", "numerical_agreement", "evidence_quality")]
    return C.changes(spark, d).select(
        "comparison_id", "change_id", "change_type", "category", "is_substantive", "impact", "change_summary", "old_requirement", "new_requirement", "negation_changed", *signals, "confidence_overall",
        F.col("obligation_change.explanation").alias("explanation"), S.number_text(F.col("numerical_changes"), titled=False).alias("numbers"), html["old_html"].alias("old_html"), html["new_html"].alias("new_html"), *ref("old"), *ref("new"), F.array_join("evidence", " | ").alias("evidence"),
    )


@query("impact_score", _changes("SELECT section, category, score, impact FROM changes"))
def _(spark, d):
    score = S.impact_score(F.col("category"), F.col("direction"), F.col("numerical_changes"), F.col("change_type"))
    return C.changes(spark, d).select("section", "category", score.alias("score"), "impact")


@query("confidence_score", _changes("SELECT section, confidence_overall, CASE WHEN round_even(confidence_overall * 100, 0) >= 80 THEN 'high' WHEN round_even(confidence_overall * 100, 0) >= 50 THEN 'medium' ELSE 'low' END AS band FROM changes"))
def _(spark, d):
    return C.changes(spark, d).select("section", "confidence_overall", S.confidence_band(F.col("confidence_overall")).alias("band"))


@query("change_ids", _changes("SELECT comparison_id, change_id, section, change_type FROM changes"))
def _(spark, d):
    return C.changes(spark, d).select("comparison_id", "change_id", "section", "change_type")


@query("human_review", _changes("SELECT section, confidence_overall < 0.8 OR impact IN ('CRITICAL', 'HIGH') AS needs_review FROM changes"))
def _(spark, d):
    return C.changes(spark, d).select("section", S.needs_review(F.col("confidence_overall"), F.col("impact")).alias("needs_review"))


# --- reports


_LEVELS = ", ".join(f"sum(CASE WHEN impact = '{x}' THEN 1 ELSE 0 END)::BIGINT AS {x.lower()}" for x in lexicon.IMPACTS)


@query("stats_row", _changes(f"""SELECT count(*) AS total, sum(CASE WHEN is_substantive THEN 1 ELSE 0 END)::BIGINT AS substantive, sum(CASE WHEN is_substantive THEN 0 ELSE 1 END)::BIGINT AS editorial,
    sum(CASE WHEN change_type = 'ADDED' THEN 1 ELSE 0 END)::BIGINT AS added, sum(CASE WHEN change_type = 'REMOVED' THEN 1 ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN change_type IN ('MODIFIED', 'REWORDED', 'RELOCATED') THEN 1 ELSE 0 END)::BIGINT AS modified, {_LEVELS}, round(avg(confidence_overall), 6) AS avg_confidence FROM changes"""))
def _(spark, d):
    return R.statistics(C.changes(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("category_dist", _changes("SELECT category, count(*) AS n FROM changes WHERE is_substantive GROUP BY category"))
def _(spark, d):
    return R.category_distribution(C.changes(spark, d))


@query("category_dist_all", _changes("SELECT category, count(*) AS n FROM changes GROUP BY category"))
def _(spark, d):
    return R.category_distribution(C.changes(spark, d), substantive_only=False)


@query("impact_heatmap", _changes("SELECT category, impact, count(*) AS n FROM changes WHERE is_substantive GROUP BY category, impact"))
def _(spark, d):
    return R.impact_heatmap(C.changes(spark, d))


@query("heatmap_pivot", _changes(f"SELECT category, {', '.join(f'count(*) FILTER (WHERE impact = {chr(39)}{x}{chr(39)}) AS {x.lower()}' for x in lexicon.IMPACTS[:4])} FROM changes WHERE is_substantive GROUP BY category"))
def _(spark, d):
    return R.heatmap_pivot(C.changes(spark, d))


@query("type_counts", _changes("SELECT change_type, count(*) AS n FROM changes GROUP BY change_type"))
def _(spark, d):
    return R.counts_by(C.changes(spark, d), "change_type")


@query("changes_filter", _changes("SELECT comparison_id, change_id, section FROM changes WHERE category = 'C04' AND impact = 'HIGH' AND is_substantive AND change_type = 'MODIFIED'"))
def _(spark, d):
    return R.filtered(C.changes(spark, d), category="C04", impact="HIGH", is_substantive=True, change_type="MODIFIED", review_status=None).select("comparison_id", "change_id", "section")


@query("changes_search", _changes("SELECT comparison_id, change_id FROM changes WHERE contains(lower(change_summary), 'penalty') OR contains(lower(old_requirement), 'penalty') OR contains(lower(new_requirement), 'penalty')"))
def _(spark, d):
    return C.search(spark, d, "PENALTY").select("comparison_id", "change_id")


_RANK = "CASE impact WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


@query("changes_ranked", _changes(f"SELECT change_id, impact, section FROM changes WHERE comparison_id = 'CMP_1' ORDER BY {_RANK}, change_id"))
def _(spark, d):
    return R.ranked(R.filtered(C.changes(spark, d), comparison_id="CMP_1")).select("change_id", "impact", "section")


@query("top10", _changes(f"SELECT change_id, impact, section FROM changes WHERE comparison_id = 'CMP_1' ORDER BY {_RANK}, change_id LIMIT 10"))
def _(spark, d):
    return R.ranked(R.filtered(C.changes(spark, d), comparison_id="CMP_1"), 10).select("change_id", "impact", "section")


@query("change_detail", _changes("SELECT comparison_id, change_id, category, new_requirement FROM changes WHERE comparison_id = 'CMP_2' AND change_id = 'CHG-0007'"))
def _(spark, d):
    return R.change(C.changes(spark, d), "CMP_2", "CHG-0007").select("comparison_id", "change_id", "category", "new_requirement")


_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lexicon.CATEGORIES.items())
_EXPORT = f"""SELECT change_id AS "Change ID", impact AS "Impact Level", change_type AS "Change Type", category AS "Category Code", CASE category {_NAMES} END AS "Category Name", change_summary AS "Change Summary",
    CASE WHEN is_substantive THEN 'Yes' ELSE 'No' END AS "Substantive", CASE WHEN direction = 'UNCHANGED' THEN '' ELSE direction || ': ' || explanation END AS "Obligation Analysis",
    old_requirement AS "Old Requirement Text", new_requirement AS "New Requirement Text", """
_LOCATION = lambda text, section: f"'Page ' || CASE WHEN {text} IS NULL THEN 'N/A' ELSE (k % 90 + 1) || CASE WHEN {section} <> '' THEN ' (' || {section} || ')' ELSE '' END END"
_ROWS = _EXPORT + f"""cast(round_even(overall * 100, 0) AS INT) || '%' AS "Confidence", numbers AS "Numerical Changes", '' AS "AI Impact Explanation",
    {_LOCATION("old_text", "os")} AS "Old Location", {_LOCATION("new_text", "ns")} AS "New Location", 'PENDING' AS "Review Status", '' AS "Reviewer Comment" FROM changes"""


@query("export_rows", _changes(_ROWS))
def _(spark, d):
    return R.export_rows(C.changes(spark, d))


_SCRIPT = _EXPORT + """cast(round_even(overall * 100, 0) AS INT)::STRING AS "Confidence (%)", coalesce(plain_numbers, '') AS "Numerical Changes",
    CASE WHEN old_text IS NULL THEN '' ELSE cast(k % 90 + 1 AS STRING) END AS "Old Document Location (Page)", CASE WHEN old_text IS NULL THEN '' ELSE os END AS "Old Document Section",
    CASE WHEN new_text IS NULL THEN '' ELSE cast(k % 90 + 1 AS STRING) END AS "New Document Location (Page)", CASE WHEN new_text IS NULL THEN '' ELSE ns END AS "New Document Section", '' AS "Impact Explanation" FROM changes"""


@query("export_rows_script", _changes(_SCRIPT))
def _(spark, d):
    return R.export_rows_script(C.changes(spark, d))


def _one(d: DataFrame) -> DataFrame:
    return R.ranked(R.filtered(d, comparison_id="CMP_1"))


@query("export_csv", _changes(_SCRIPT + " WHERE comparison_id = 'CMP_1'"))
def _(spark, d):
    """The script's CSV of a comparison, written and read again."""
    folder = tables.new_folder(spark, "csv")
    sinks.export_csv(R.export_rows_script(_one(C.changes(spark, d))), folder)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder).na.fill("")


@query("export_xlsx", _changes(_ROWS + " WHERE comparison_id = 'CMP_1'"))
def _(spark, d):
    """The workbook of a comparison, written and read again."""
    return sinks.read_xlsx(spark, sinks.xlsx_bytes(R.export_rows(_one(C.changes(spark, d)))))


@query("export_json", _changes("SELECT change_id, category, impact, change_summary, confidence_overall, (SELECT count(*) FROM changes WHERE comparison_id = 'CMP_1') AS total FROM changes WHERE comparison_id = 'CMP_1'"))
def _(spark, d):
    """The JSON of a comparison, written and read again."""
    own = C.changes(spark, d).where("comparison_id = 'CMP_1'")
    text = sinks.export_json(own, R.statistics(own), "CMP_1")
    back = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", "struct<statistics:struct<total:bigint>,changes:array<struct<change_id:string,category:string,impact:string,change_summary:string,confidence_overall:double>>>").alias("j"))
    return back.select("j.statistics.total", F.inline("j.changes"))


@query("export_numbers", f"WITH {C.SQL_PAIRS} SELECT o_section AS section, {C.numbers_sql(': ', '; ')} AS numbers FROM pairs")
def _(spark, d):
    rows = C.pairs(spark, d).select(F.col("o_section").alias("section"), F.concat(D.number_changes("o_text", "n_text"), E.date_changes(F.col("o_text"), F.col("n_text"))).alias("n"))
    return rows.select("section", S.number_text(F.col("n")).alias("numbers"))


@query("summary_means", _changes("SELECT comparison_id, round(avg(confidence_overall), 6) AS mean FROM changes GROUP BY comparison_id UNION ALL SELECT 'none', 0.0"))
def _(spark, d):
    """Mean confidence by comparison, and of no changes at all."""
    df = C.changes(spark, d)
    some = df.groupBy("comparison_id").agg(F.round(R.mean_confidence("confidence_overall"), 6).alias("mean"))
    return some.unionByName(df.where("false").agg(R.mean_confidence("confidence_overall").alias("mean")).withColumn("comparison_id", F.lit("none")))


@query("category_bars", _changes("SELECT category, n, round(n / max(n) OVER (), 6) AS share FROM (SELECT category, count(*) AS n FROM changes WHERE is_substantive GROUP BY category)"))
def _(spark, d):
    return R.with_bars(R.category_distribution(C.changes(spark, d))).withColumn("share", F.round("share", 6))


@query("llm_enrich", _changes("""SELECT comparison_id, change_id, is_substantive AND impact IN ('CRITICAL', 'HIGH') AS llm_available, CASE WHEN is_substantive AND impact IN ('CRITICAL', 'HIGH') THEN 'about ' || category END AS llm_explanation,
    CASE WHEN is_substantive AND impact IN ('CRITICAL', 'HIGH') THEN 'v1' END AS prompt_version, CASE WHEN is_substantive AND impact IN ('CRITICAL', 'HIGH') THEN 'echo' END AS model_version FROM changes"""))
def _(spark, d):
    """A model that only repeats the category it is asked about, as a stand-in for one that a caller supplies."""
    def ask(p: str) -> str:
        return '{"explanation": "about ' + p.partition("CATEGORY: ")[2][:3] + '"}'

    out = enrich.enrich(C.changes(spark, d), ask, "echo")
    return out.select("comparison_id", "change_id", "llm_available", "llm_explanation", "prompt_version", "model_version")


# --- comparisons, reviews, documents


@query("latest_comparison", "SELECT o_orderkey AS comparison_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def _(spark, d):
    runs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("comparison_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return R.latest_comparison(runs).drop("status")


@query("comparisons_list", "SELECT o_custkey AS comparison_id, max(o_orderstatus) AS status, min(o_orderdate) AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1 GROUP BY o_custkey".replace("min(o_orderdate) AS created_at FROM", "(SELECT min(o.o_orderdate) FROM orders o WHERE o.o_custkey = q.o_custkey) AS created_at FROM").replace(") WHERE r = 1", ") q WHERE r = 1"))
def _(spark, d):
    """A log with several rows a comparison: the last one's status, the first one's date, newest first."""
    log = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("comparison_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("logged_at"))
    return R.comparisons(log).select("comparison_id", "status", "created_at")


@query("progress_overlay", "SELECT o_orderkey AS comparison_id, coalesce(l.v, o_totalprice) AS progress, coalesce(l.t, o_orderpriority) AS current_stage, coalesce(l.t, o_orderstatus) AS status FROM orders LEFT JOIN (SELECT user_id AS k, max(value) AS v, max(event_type) AS t FROM events GROUP BY user_id) l ON o_orderkey = l.k")
def _(spark, d):
    runs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("comparison_id"), F.col("o_totalprice").alias("progress"), F.col("o_orderpriority").alias("current_stage"), F.col("o_orderstatus").alias("status"))
    kind = F.max("event_type")
    live = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("comparison_id")).agg(F.max("value").alias("progress"), kind.alias("current_stage"), kind.alias("status"))
    return R.with_progress(runs, live)


@query("review_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) = 1")
def _(spark, d):
    log = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    return R.latest_reviews(log, ["user_id"], "ts").select("user_id", "event_id", "event_type")


@query("upsert_documents", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'revised' AS source, n_chars + 1 FROM documents WHERE doc_id % 3 = 0")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "n_chars")
    return R.upsert(docs, docs.where("doc_id % 3 = 0").withColumn("source", F.lit("revised")).withColumn("n_chars", F.col("n_chars") + 1), ["doc_id"])


@query("foreign_keys", "SELECT DISTINCT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(spark, d):
    """Keys that the other table doesn't have."""
    return R.missing_keys(spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en'"), "doc_id")


def _labelled(names: dict[str, str]) -> str:
    values = ", ".join(f"('{k}', '{v}')" for k, v in names.items())
    return _changes(f"SELECT code, name, count(c.category) AS n FROM (VALUES {values}) t(code, name) LEFT JOIN changes c ON c.category = code GROUP BY code, name")


def _used(spark: SparkSession, d: str, names: dict[str, str]) -> DataFrame:
    """All codes with their names and how many changes have them."""
    used = R.counts_by(C.summary(spark, d), "category").withColumnRenamed("category", "code")
    return R.categories(spark, names).join(used, "code", "left").select("code", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query("ui_labels", _labelled(lexicon.UI_LABELS))
def _(spark, d):
    return _used(spark, d, lexicon.UI_LABELS)


@query("categories", _labelled(lexicon.CATEGORIES))
def _(spark, d):
    return _used(spark, d, lexicon.CATEGORIES)


@query("summary_stats", ORACLES["stats_row"])
def _(spark, d):
    """As stats_row, from the counts that are stored beside the changes."""
    return R.statistics(C.summary(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("summary_heatmap", ORACLES["impact_heatmap"])
def _(spark, d):
    return R.impact_heatmap(C.summary(spark, d))


@query("summary_types", ORACLES["type_counts"])
def _(spark, d):
    return R.counts_by(C.summary(spark, d), "change_type")
