"""Old and new clauses generated from the orders table by expressions that Spark and DuckDB share, their nodes and
alignments, the changes that ``classify`` makes of them, and SQL that says what it must make.

Texts have one template, so what a word diff finds in them is known: fields that differ are one replaced segment each,
and a tail that is new is an insertion.  SQL counts words where the operators run difflib.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright import lexicon
from clausewright.operators.changes import classify
from clausewright.sources import search as index
from clausewright.sources import sinks, tables

_MODAL = "CASE WHEN k % {w} = 0 THEN 'will' ELSE CASE {c} % 6 WHEN 0 THEN 'shall' WHEN 1 THEN 'may' WHEN 2 THEN 'must' WHEN 3 THEN 'should' WHEN 4 THEN 'shall not' ELSE 'can' END END"
_VERB = "CASE k % 7 WHEN 0 THEN 'report' WHEN 1 THEN 'keep records' WHEN 2 THEN 'remit the penalty' WHEN 3 THEN 'verify each step' WHEN 4 THEN 'act under this rule' WHEN 5 THEN 'extend coverage' ELSE 'respond' END"
_TEXT = "'The entity ' || modal || ' ' || verb || ' within ' || cast(days AS STRING) || ' days and pay INR ' || cast(lakh AS STRING) || ' lakh at ' || cast(pct AS STRING) || ' percent by ' || cast(day AS STRING) || ' March ' || cast(year AS STRING) || tail"
_COLS = ["k", "c", "modal", "verb", "days", "lakh", "pct", "day", "year", "tail"]

_OLD = ["k", "c", _MODAL.format(c="c", w=31) + " AS modal", _VERB + " AS verb", "5 * (1 + k % 12) AS days", "1 + c % 20 AS lakh", "1 + k % 9 AS pct", "1 + k % 28 AS day", "2000 + c % 20 AS year", "CASE WHEN c % 8 = 0 THEN ' subject to review' ELSE '' END AS tail"]
_NEW = ["k", "c", _MODAL.format(c="(CASE WHEN c % 11 = 0 THEN c + 1 ELSE c END)", w=37) + " AS modal", _VERB + " AS verb", "5 * (1 + (CASE WHEN c % 5 = 0 THEN k + 3 ELSE k END) % 12) AS days", "1 + (CASE WHEN c % 7 = 0 THEN c + 5 ELSE c END) % 20 AS lakh", "1 + k % 9 AS pct", "1 + (CASE WHEN c % 17 = 0 THEN k + 1 ELSE k END) % 28 AS day", "2000 + c % 20 AS year", "CASE WHEN c % 13 = 0 THEN ' provided that notice is given' WHEN c % 8 = 0 THEN ' subject to review' WHEN c % 9 = 0 THEN ' as required' ELSE '' END AS tail"]


def _side(orders: DataFrame, exprs: list[str], without: int) -> DataFrame:
    base = orders.selectExpr("o_orderkey AS k", "o_custkey AS c").where(f"k % {without} <> 0")
    return base.selectExpr(*exprs).selectExpr("cast(k AS STRING) AS section", *_COLS, _TEXT + " AS text")


def old_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _side(spark.read.parquet(f"{sf_dir}/orders.parquet"), _OLD, 11)


def new_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _side(spark.read.parquet(f"{sf_dir}/orders.parquet"), _NEW, 13)


#: In pages every clause has its number before the text, and one that only one side has is too short to be like another.
_NUMBERED = "cast(k AS STRING) || '. ' || CASE WHEN k % {other} = 0 THEN 'One side' ELSE " + _TEXT + " END"


def _side_sql(exprs: list[str], without: int, other: int, numbered: bool = False) -> str:
    text, where = (_NUMBERED.format(other=other), " AND k % 40 <> 1") if numbered else (_TEXT, "")
    return f"SELECT cast(k AS STRING) AS section, {', '.join(_COLS)}, {text} AS text FROM (SELECT {', '.join(exprs)} FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders) WHERE k % {without} <> 0{where})"


def numbered_clauses(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """A side's clauses with their numbers, as they stand in pages."""
    rows = (old_clauses if side == "old" else new_clauses)(spark, sf_dir)
    return rows.withColumn("text", F.expr(_NUMBERED.format(other=13 if side == "old" else 11)))


SQL = f"olds AS ({_side_sql(_OLD, 11, 13)}), news AS ({_side_sql(_NEW, 13, 11)})"
_NAMED = [c for c in ["section", *_COLS, "text"] if c not in ("k", "c")]
_PAIRED = ", ".join(f"o.{x} AS o_{x}, n.{x} AS n_{x}" for x in _NAMED)
_PAIRS = f"pairs AS (SELECT o.k, o.c, {_PAIRED} FROM olds o JOIN news n ON o.section = n.section WHERE o.text <> n.text)"
SQL_PAIRS = f"{SQL}, {_PAIRS}"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one section whose texts differ, as o_ and n_ columns."""
    o = old_clauses(spark, sf_dir).select("k", "c", *[F.col(x).alias(f"o_{x}") for x in _NAMED])
    n = new_clauses(spark, sf_dir).select(*[F.col(x).alias(f"n_{x}") for x in _NAMED])
    return tables.spread(o.join(n, F.col("o_section") == F.col("n_section")).where("o_text <> n_text"))


#: By clause: what its nodes have besides the text, and how its sides are aligned.
_O_SECTION = "CASE WHEN k % 29 = 0 THEN '' ELSE section END"
_N_SECTION = "CASE WHEN k % 29 = 0 THEN '' WHEN k % 19 = 0 THEN 'R' || section ELSE section END"
_HEADING = "CASE WHEN k % 10 = 0 THEN 'Heading ' || cast(c AS STRING) ELSE '' END"
_KIND = "CASE WHEN k % 23 = 0 THEN 'definition' ELSE 'clause' END"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of both sides, as ``classify`` needs them."""
    def side(df: DataFrame, letter: str, section: str) -> DataFrame:
        return df.selectExpr(f"'{letter}' || section AS node_id", f"'DOC_{letter}' AS document_id", "cast(k % 90 + 1 AS INT) AS page_start", "cast(k % 90 + 1 + k % 2 AS INT) AS page_end", f"{section} AS section_number", f"{_HEADING} AS heading", "text", "lower(text) AS normalized_text", f"{_KIND} AS content_type")

    return side(old_clauses(spark, sf_dir), "O", _O_SECTION).unionByName(side(new_clauses(spark, sf_dir), "N", _N_SECTION))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of one number on both sides are aligned, by a layer that their number picks; the others are on one side."""
    o = old_clauses(spark, sf_dir).select("section", F.col("k").alias("ok"))
    n = new_clauses(spark, sf_dir).select("section", F.col("k").alias("nk"))
    both = o.join(n, "section", "full_outer").withColumn("k", F.coalesce("ok", "nk"))
    paired, score = F.col("ok").isNotNull() & F.col("nk").isNotNull(), (50 + F.col("k") % 50) / 100
    layer = F.when(paired, F.col("k") % 3).when(F.col("nk").isNull(), 4).otherwise(5).cast("int")
    pair = lambda name, value: F.create_map(F.lit(name), value)
    scores = F.when(layer == 0, F.create_map(F.lit("section_match"), F.lit(1.0), F.lit("text_similarity"), F.lit(0.9))).when(layer == 1, pair("structural_score", F.lit(0.75))).when(layer == 2, pair("tfidf_similarity", score)).otherwise(F.create_map().cast("map<string,double>"))
    return both.select(
        F.concat(F.lit("CMP_"), F.expr("k div 480").cast("string")).alias("comparison_id"),
        F.when(F.col("ok").isNotNull(), F.concat(F.lit("O"), "section")).alias("old_node_id"),
        F.when(F.col("nk").isNotNull(), F.concat(F.lit("N"), "section")).alias("new_node_id"),
        F.when(layer == 4, "REMOVED").when(layer == 5, "ADDED").otherwise("ONE_TO_ONE").alias("alignment_type"),
        F.when(layer == 0, "exact").when(layer == 1, "structural").when(layer == 2, "lexical").otherwise("unmatched").alias("match_method"),
        scores.alias("similarity_scores"), layer.alias("layer"), F.when(layer == 2, -score).otherwise(F.col("k").cast("double")).alias("rank"), F.when(layer == 2, -F.col("k")).otherwise(0).cast("int").alias("tie"),
    )


_stored: dict[tuple[str, str], str] = {}


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored changes of the generated clauses.

    Reports read a table of changes and don't make it: the first query of a session that needs it has them classified
    and saved, as a comparison would, and the queries after it read what is there.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if not tables.is_kept(_stored.get(key, "")):
        folder = tables.new_folder(spark, "changes")
        made = classify(alignments(spark, sf_dir), nodes(spark, sf_dir))
        sinks.save_all(made.withColumn("confidence_overall", F.round("confidence.overall", 6)), f"{folder}/changes", f"{folder}/summary")
        _stored[key] = folder
    df = spark.read.parquet(f"{_stored[key]}/changes")
    section = F.substring(F.coalesce("old_reference.node_id", "new_reference.node_id"), 2, 40)
    return df.withColumns({"section": section, "confidence_overall": F.round("confidence.overall", 6), "direction": F.coalesce("obligation_change.direction", F.lit("UNCHANGED"))})


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that are stored beside the changes."""
    changes(spark, sf_dir)
    return spark.read.parquet(f"{_stored[spark.sparkContext.applicationId, sf_dir]}/summary")


def search(spark: SparkSession, sf_dir: str, needle: str) -> DataFrame:
    """The stored changes that have ``needle`` in their texts, through an index that is brought up to date first."""
    changes(spark, sf_dir)
    folder = _stored[spark.sparkContext.applicationId, sf_dir]
    index.update_index(spark, f"{folder}/changes", f"{folder}/index")
    return index.search(spark, f"{folder}/changes", f"{folder}/index", needle)


def quoted(text: str) -> str:
    return text.replace("'", "''")


def _hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '(?i){quoted(pattern)}')"


def keyword_scores_sql(column: str, weight: int = 1) -> dict[str, str]:
    return {code: "(" + " + ".join(f"CASE WHEN {_hit(column, g)} THEN {weight} ELSE 0 END" for g in groups) + ")" for code, groups in lexicon.CATEGORY_GROUPS.items()}


def keyword_category_sql(column: str) -> str:
    scores = keyword_scores_sql(column)
    best = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {best} = 0 THEN 'C03' " + " ".join(f"WHEN {s} = {best} THEN '{c}'" for c, s in scores.items()) + " END"


def added_category_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {s} >= 2 THEN '{c}'" for c, s in keyword_scores_sql(f"lower({column})").items()) + " ELSE 'C01' END"


def _terms_sql(column: str) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches({column}, '(?i)\\b{t}\\b') THEN '{t}' END" for t in lexicon.OBLIGATIONS)
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


def _strength_sql(terms: str) -> str:
    levels = " ".join(f"WHEN '{t}' THEN {n}" for t, n in lexicon.OBLIGATIONS.items())
    return f"coalesce(list_max(list_transform({terms}, lambda t: CASE t {levels} END)), 0)"


def direction_sql(old: str, new: str) -> str:
    """CASE expression over columns that hold term lists a and b and strengths s and t."""
    return f"CASE WHEN len({old}) = 0 AND len({new}) > 0 THEN 'INTRODUCED' WHEN len({old}) > 0 AND len({new}) = 0 THEN 'REMOVED' WHEN {_strength_sql(old)} < {_strength_sql(new)} THEN 'STRENGTHENED' WHEN {_strength_sql(old)} > {_strength_sql(new)} THEN 'RELAXED' ELSE 'UNCHANGED' END"


def _conditions_sql(column: str) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches({column}, '(?i){p.replace(' ', '[[:space:]]+')}') THEN '{p}' END" for p in lexicon.CONDITIONALS)
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


def explanation_sql(a: str, b: str, before: str, after: str) -> str:
    """What is told about obligation terms a, b and conditions before, after."""
    s, t, ja, jb = _strength_sql(a), _strength_sql(b), f"array_to_string({a}, ', ')", f"array_to_string({b}, ', ')"
    more, less = (f"list_sort(list_filter({x}, lambda p: NOT list_contains({y}, p)))" for x, y in ((after, before), (before, after)))
    quoted_ = f" from ' || chr(39) || {ja} || chr(39) || ' to ' || chr(39) || {jb} || chr(39)"
    return f"""CASE WHEN len({a}) = 0 AND len({b}) > 0 THEN 'New obligation language introduced: ' || {jb} WHEN len({a}) > 0 AND len({b}) = 0 THEN 'Obligation language removed: ' || {ja}
        WHEN {s} < {t} THEN 'Obligation strengthened{quoted_} WHEN {s} > {t} THEN 'Obligation relaxed{quoted_}
        WHEN list_sort({a}) <> list_sort({b}) THEN 'Obligation language changed{quoted_} || ' (same strength level)' ELSE '' END
        || CASE WHEN len({more}) > 0 THEN ' New conditions added: ' || array_to_string({more}, ', ') || '.' ELSE '' END
        || CASE WHEN len({less}) > 0 THEN ' Conditions removed: ' || array_to_string({less}, ', ') || '.' ELSE '' END"""


def _marked_sql(text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in lexicon.INDICATORS) + ")"


def _words_sql(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 0 ELSE len(string_split(trim({text}), ' ')) END"


def _html_sql(side: str, css: str, head: str) -> str:
    tag = lambda field: f"CASE WHEN o_{field} <> n_{field} THEN '<span class=\"{css}\">' || {side}_{field} || '</span>' ELSE {side}_{field}::STRING END"
    tail = f"CASE WHEN {side}_tail = '' THEN '' WHEN o_tail <> n_tail THEN ' <span class=\"{css}\">' || trim({side}_tail) || '</span>' ELSE {side}_tail END"
    return f"{head}'The entity ' || {tag('modal')} || ' ' || {side}_verb || ' within ' || {tag('days')} || ' days and pay INR ' || {tag('lakh')} || ' lakh at ' || {side}_pct || ' percent by ' || {tag('day')} || ' March ' || {side}_year || {tail}"


_DIFFER = ["modal", "days", "lakh", "day"]


def _diffs_sql(head: str = "") -> str:
    """Pairs with what a word diff says of them; ``head`` is SQL of what stands before their text."""
    return f"""
    counted AS (
        SELECT *, len(string_split(o_text, ' ')) AS wo, len(string_split(n_text, ' ')) AS wn,
               {' + '.join(f"CASE WHEN o_{x} <> n_{x} THEN {_words_sql(f'o_{x}::STRING')} ELSE 0 END" for x in [*_DIFFER, 'tail'])} AS gone,
               {' + '.join(f"CASE WHEN o_{x} <> n_{x} THEN greatest({_words_sql(f'o_{x}::STRING')}, {_words_sql(f'n_{x}::STRING')}) ELSE 0 END" for x in [*_DIFFER, 'tail'])} AS touched,
               o_tail <> n_tail AND o_tail <> '' AND n_tail <> '' AS tail_replaced,
               CASE WHEN o_tail = '' THEN trim(n_tail) ELSE '' END AS added, CASE WHEN n_tail = '' THEN trim(o_tail) ELSE '' END AS removed
        FROM pairs),
    ratios AS (
        SELECT *, 2.0::DOUBLE * (wo - gone) / (wo + wn) AS ratio, touched::DOUBLE / greatest(wo, wn) AS density,
               concat_ws(' ', {', '.join(f"CASE WHEN o_{x} <> n_{x} THEN o_{x} || ' ' || n_{x} END" for x in _DIFFER)}, CASE WHEN tail_replaced THEN trim(o_tail) || ' ' || trim(n_tail) END, added, removed) AS changed
        FROM counted),
    diffs AS (
        SELECT *, CASE WHEN density < 0.08 AND NOT {_marked_sql('lower(changed)')} THEN false
                       WHEN {' OR '.join(f'o_{x} <> n_{x}' for x in _DIFFER)} OR (tail_replaced AND ({' OR '.join(f"contains(o_tail, '{w}') <> contains(n_tail, '{w}')" for w in lexicon.INDICATORS)})) THEN true
                       ELSE density > 0.20 OR ratio < 0.80 END AS diff_sub,
               {_html_sql('o', 'diff-removed', head)} AS old_html, {_html_sql('n', 'diff-added', head)} AS new_html
        FROM ratios)"""


SQL_DIFFS = f"{SQL_PAIRS}, {_diffs_sql()}"

_way = lambda x: f"CASE WHEN n_{x} > o_{x} THEN 'INCREASE' ELSE 'DECREASE' END"
_size = lambda x: f"abs(n_{x} - o_{x}) * 100.0::DOUBLE / o_{x}"
#: (field, old value, new value, direction, magnitude or null), each where its condition holds.
NUMBER_ROWS = [
    ("o_lakh <> n_lakh", "monetary", "'INR ' || {s}_lakh || ' lakh'", _way("lakh"), _size("lakh")),
    ("o_lakh <> n_lakh", "monetary", "{s}_lakh || ' lakh'", _way("lakh"), _size("lakh")),
    ("o_days <> n_days", "duration", "'within ' || {s}_days || ' days'", _way("days"), _size("days")),
    ("o_day <> n_day", "date", "{s}_day || ' March ' || {s}_year", "'CHANGED'", "NULL"),
]


def numbers_sql(head: str, between: str, capital: bool = True) -> str:
    """The changed numbers of a pair in words."""
    parts = []
    for test, field, value, way, size in NUMBER_ROWS:
        percent = "''" if size == "NULL" else f"CASE WHEN {size} <> 0 THEN ', ' || round_even({size}, 0)::BIGINT || '%' ELSE '' END"
        parts.append(f"CASE WHEN {test} THEN '{field.capitalize() if capital else field}{head}' || {value.format(s='o')} || ' -> ' || {value.format(s='n')} || ' (' || {way} || {percent} || ')' END")
    return f"concat_ws('{between}', {', '.join(parts)})"


_place = lambda section: f"CASE WHEN {section} <> '' THEN {section} ELSE 'Page ' || (k % 90 + 1) END"
_names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lexicon.CATEGORIES.items())
_base = " ".join(f"WHEN '{k}' THEN {v}" for k, v in lexicon.BASE_IMPACT.items())
_changed_scores, _full_scores = keyword_scores_sql("changed", 2), keyword_scores_sql("n_text")
_both_scores = {c: f"({_changed_scores[c]} + {_full_scores[c]})" for c in _full_scores}
_best = f"greatest({', '.join(_both_scores.values())})"
_pair_category = f"CASE WHEN {_best} = 0 THEN 'C03' " + " ".join(f"WHEN {x} = {_best} THEN '{c}'" for c, x in _both_scores.items()) + " END"
_by_size = lambda x: f"CASE WHEN o_{x} = n_{x} THEN 0 WHEN {_size(x)} >= 100 THEN 2 WHEN {_size(x)} >= 50 THEN 1 ELSE 0 END"


def _changes_sql(old_section: str, new_section: str, heading: str, layer: str, definition: str, size: int) -> str:
    """Classified changes of diffs; the arguments are SQL of what nodes and alignments have besides the texts."""
    return f"""
    told AS (
        SELECT *, {old_section.replace('section', 'o_section')} AS os, {new_section.replace('section', 'n_section')} AS ns, {_terms_sql("o_text")} AS a, {_terms_sql("n_text")} AS b,
               {_conditions_sql("o_text")} AS ca, {_conditions_sql("n_text")} AS cb, {layer} AS layer, {definition} AS definition FROM diffs),
    way_ AS (SELECT *, {direction_sql("a", "b")} AS direction, {explanation_sql("a", "b", "ca", "cb")} AS explanation FROM told),
    sub_ AS (SELECT *, o_lakh <> n_lakh OR o_days <> n_days OR o_day <> n_day OR direction <> 'UNCHANGED' OR diff_sub AS is_substantive FROM way_),
    cat_ AS (
        SELECT *, CASE WHEN NOT is_substantive THEN 'C17' WHEN definition THEN 'C12' WHEN o_lakh <> n_lakh THEN 'C04' WHEN o_days <> n_days THEN 'C05' WHEN direction IN ('STRENGTHENED', 'RELAXED') THEN 'C07' ELSE {_pair_category} END AS category,
               CASE layer WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.0 END::DOUBLE AS structural, CASE WHEN layer = 2 THEN (50 + k % 50) / 100.0 ELSE 0.0 END::DOUBLE AS semantic,
               CASE WHEN o_lakh <> n_lakh OR o_days <> n_days OR o_day <> n_day THEN 0.5 ELSE 1.0 END::DOUBLE AS numerical, CASE WHEN layer = 2 THEN 0.7 ELSE 0.9 END::DOUBLE AS evidence_quality FROM sub_),
    sum_ AS (SELECT *, 0.20 * structural + 0.25 * ratio + 0.25 * semantic + 0.15 * numerical + 0.15 * evidence_quality + CASE WHEN (structural > 0.7)::INT + (ratio > 0.7)::INT + (semantic > 0.7)::INT >= 2 THEN 0.05 ELSE 0.0 END AS total FROM cat_),
    paired AS (
        SELECT k, c, o_section AS section, o_text AS old_text, n_text AS new_text, os, ns, direction, explanation, is_substantive, category, layer, CASE WHEN layer = 2 THEN -semantic ELSE k END::DOUBLE AS rank, CASE WHEN layer = 2 THEN -k ELSE 0 END AS tie,
               CASE WHEN os <> '' AND ns <> '' AND os <> ns AND ratio > 0.9 THEN 'RELOCATED' WHEN ratio > 0.8 AND NOT diff_sub THEN 'REWORDED' ELSE 'MODIFIED' END AS change_type,
               CASE category {_base} END + CASE WHEN direction IN ('STRENGTHENED', 'INTRODUCED') THEN 2 WHEN direction = 'RELAXED' THEN 1 ELSE 0 END
                   + 2 * ({_by_size("lakh")}) + {_by_size("days")} + CASE WHEN n_days < o_days THEN 1 ELSE 0 END AS score,
               least(1.0, greatest(0.0, CASE WHEN structural < 0.2 AND semantic < 0.3 THEN total * 0.8 ELSE least(1.0, total) END)) AS overall, structural, ratio AS lexical, semantic, numerical, evidence_quality,
               concat_ws(' ', CASE WHEN {_place('os')} <> {_place('ns')} THEN 'Section ' || {_place('os')} || ' -> ' || {_place('ns')} || '.' END, 'Category: ' || CASE category {_names} END || '.',
                         CASE WHEN o_lakh <> n_lakh OR o_days <> n_days OR o_day <> n_day THEN {numbers_sql(' changed: ', ' ')} END, CASE WHEN direction <> 'UNCHANGED' THEN explanation END,
                         CASE WHEN ratio < 0.5 THEN 'Significant textual changes detected.' WHEN ratio < 0.8 THEN 'Moderate textual changes detected.' END) AS change_summary,
               {numbers_sql(': ', '; ')} AS numbers, {numbers_sql(': ', '; ', False)} AS plain_numbers, old_html, new_html, regexp_matches(o_text, '\\bnot\\b') <> regexp_matches(n_text, '\\bnot\\b') AS negation_changed FROM sum_),
    alone AS (
        SELECT coalesce(o.k, n.k) AS k, coalesce(o.c, n.c) AS c, coalesce(o.section, n.section) AS section, o.text AS old_text, n.text AS new_text FROM olds o FULL JOIN news n ON o.section = n.section WHERE o.text IS NULL OR n.text IS NULL),
    labelled AS (SELECT *, {old_section} AS os, {new_section} AS ns, CASE WHEN old_text IS NULL THEN {new_section} ELSE {old_section} END AS own, coalesce(old_text, new_text) AS text, {heading} AS heading FROM alone),
    single AS (
        SELECT *, CASE WHEN old_text IS NULL THEN CASE WHEN {added_category_sql('new_text')} <> 'C01' THEN {added_category_sql('new_text')} WHEN {definition} THEN 'C12' ELSE 'C01' END ELSE 'C02' END AS category FROM labelled),
    everything AS (
        SELECT * FROM paired UNION ALL
        SELECT k, c, section, old_text, new_text, os, ns, 'UNCHANGED', NULL, true, category, CASE WHEN old_text IS NULL THEN 5 ELSE 4 END, k, 0, CASE WHEN old_text IS NULL THEN 'ADDED' ELSE 'REMOVED' END, CASE category {_base} END + 1,
               0.9, 0.0, 0.0, 0.0, 1.0, 0.9, CASE WHEN old_text IS NULL THEN 'New content added: ' ELSE 'Content removed: ' END || CASE WHEN heading <> '' THEN heading WHEN own <> '' THEN own ELSE substr(text, 1, 80) END, '', '', NULL, NULL, false FROM single),
    changes AS (
        SELECT *, CASE WHEN NOT is_substantive THEN 'INFORMATIONAL' WHEN score >= 6 THEN 'CRITICAL' WHEN score >= 4 THEN 'HIGH' WHEN score >= 3 THEN 'MEDIUM' WHEN score >= 1 THEN 'LOW' ELSE 'INFORMATIONAL' END AS impact,
               'CMP_' || (k // {size}) AS comparison_id, coalesce(substr(old_text, 1, 500), '') AS old_requirement, coalesce(substr(new_text, 1, 500), '') AS new_requirement, round(overall, 6) AS confidence_overall,
               format('CHG-{{:04d}}', row_number() OVER (PARTITION BY k // {size} ORDER BY layer, rank, tie)) AS change_id FROM everything)"""


SQL_CHANGES = f"{SQL_DIFFS}, {_changes_sql(_O_SECTION, _N_SECTION, _HEADING, 'k % 3', 'k % 23 = 0', 480)}"
#: The changes that pages of numbered clauses make, each in the section of its number.
SQL_PAGES = f"olds AS ({_side_sql(_OLD, 11, 13, True)}), news AS ({_side_sql(_NEW, 13, 11, True)}), {_PAIRS}, " + _diffs_sql("k || '. ' || ") + ", " + _changes_sql("section", "section", "''", "0", "false", 240)
