"""From alignments to classified, scored and numbered changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright import schemas
from clausewright.functions import compare as D
from clausewright.functions import extract as E
from clausewright.functions import scores as S
from clausewright.operators import align as A
from clausewright.operators import reports, structure
from clausewright.sources.tables import settle, stored


def reference(prefix: str, text: str) -> Column:
    """Where a node stands; null without a node."""
    c = lambda n: F.col(f"{prefix}.{n}")
    made = F.struct(c("document_id").alias("document_id"), c("page_start").alias("page"), c("page_end").alias("page_end"), c("section_number").alias("section"), c("section_number").alias("clause"), c("heading").alias("heading"), F.substring(text, 1, 500).alias("text"), c("node_id").alias("node_id"))
    return F.when(c("node_id").isNotNull(), made.cast(schemas.REFERENCE))


def classify(alignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """The change table (without ids of its own runs) of ``alignments`` joined with their nodes.

    Pairs of equal normalised text are dropped before anything reaches Python; pairs of equal text are no changes.
    Changes are numbered within their comparison, in the order of layers and of what each layer reports.  They get their places in that
    order before they are classified; then pairs meet by their texts, so that texts that many pairs share are compared once, and go back to their places.
    """
    node = F.struct("node_id", "document_id", "page_start", "page_end", "section_number", "heading", "text", "normalized_text", "content_type")
    n = nodes.select(F.col("node_id").alias("_id"), node.alias("_n"))
    paired, added = F.col("alignment_type") == "ONE_TO_ONE", F.col("alignment_type") == "ADDED"
    both = _with_node(_with_node(alignments, n, "old_node_id", "new_node_id", "o"), n, "new_node_id", "old_node_id", "w")
    both = both.where(~paired | ~F.col("o.normalized_text").eqNullSafe(F.col("w.normalized_text"))).where(~paired | ~F.col("o.text").eqNullSafe(F.col("w.text")))
    both = number(placed(both.withColumns({"o": F.col("o").dropFields("normalized_text"), "w": F.col("w").dropFields("normalized_text")})))
    is_def = (F.col("o.content_type") == "definition") | (F.col("w.content_type") == "definition")
    both = both.withColumns({"_old": F.col("o.text"), "_new": F.col("w.text"), "_def": F.coalesce(is_def, F.lit(False)), "o": F.col("o").dropFields("text"), "w": F.col("w").dropFields("text")})
    score = lambda *names: F.coalesce(*[F.try_element_at("similarity_scores", F.lit(x)) for x in names], F.lit(0.0))
    both = both.withColumns({"_structural": score("section_match", "structural_score"), "_semantic": score("semantic_similarity", "tfidf_similarity"), "_evidence": F.when(F.col("match_method").isin("exact", "structural"), 0.9).otherwise(0.7)})
    both = both.drop("similarity_scores", "match_method", "layer", "rank", "tie")
    old, new = F.col("_old"), F.col("_new")
    place = lambda p: F.when(F.col(f"{p}.section_number") != "", F.col(f"{p}.section_number")).otherwise(F.concat(F.lit("Page "), F.col(f"{p}.page_start").cast("string")))
    pairs = judged(both.where(paired)).withColumn("change_type", S.change_type(F.col("o.section_number"), F.col("w.section_number"), F.col("_ratio"), F.col("_diff_sub")))
    signals = {
        "structural_match": F.col("_structural"), "lexical_similarity": F.col("_ratio"), "semantic_similarity": F.col("_semantic"),
        "numerical_agreement": F.when(F.size("numerical_changes") == 0, 1.0).otherwise(0.5), "evidence_quality": F.col("_evidence"),
    }
    pairs = pairs.withColumns({
        "confidence": F.struct(*[v.alias(k) for k, v in signals.items()], S.confidence(F.col("change_type"), *signals.values()).alias("overall")).cast(schemas.CONFIDENCE),
        "change_summary": F.concat_ws(" ", S.moved(place("o"), place("w")), "_told"),
    })
    text = F.when(added, new).otherwise(old)
    pick = lambda c: F.when(added, F.col(f"w.{c}")).otherwise(F.col(f"o.{c}"))
    label = F.when(pick("heading") != "", pick("heading")).when(pick("section_number") != "", pick("section_number")).otherwise(F.substring(text, 1, 80))
    fixed = {"structural_match": 0.0, "lexical_similarity": 0.0, "semantic_similarity": 0.0, "numerical_agreement": 1.0, "evidence_quality": 0.9, "overall": 0.9}
    single = both.where(~paired).withColumns({
        "change_type": F.col("alignment_type"), "category": F.when(added, S.added_category(new, F.col("w.content_type") == "definition")).otherwise("C02"), "is_substantive": F.lit(True), "numerical_changes": F.array().cast(D.NUMBERS),
        "confidence": F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()]).cast(schemas.CONFIDENCE), "change_summary": F.concat(F.when(added, F.lit("New content added: ")).otherwise("Content removed: "), label),
    })
    single = single.withColumn("impact", S.impact(F.lit(True), S.impact_score(F.col("category"), F.lit("UNCHANGED"), F.col("numerical_changes"), F.col("change_type"))))
    gone = ["_def", "_structural", "_semantic", "_evidence", "_ratio", "_diff_sub", "_told"]
    out = pairs.drop(*gone).unionByName(single.drop(*gone), allowMissingColumns=True)
    out = out.repartitionById(_tasks(out), F.shiftright("_at", 33).cast("int")).sortWithinPartitions("_at")
    either = lambda pair, one: F.when(paired, pair).otherwise(one)
    names = [
        "change_id", "comparison_id", "old_node_id", "new_node_id", "change_type", "category", "is_substantive", "confidence", "old_reference", "new_reference", "change_summary", "old_requirement", "new_requirement",
        "numerical_changes", "obligation_change", "evidence", "diff_highlights", "negation_changed", "impact",
    ]
    out = out.withColumns({
        "old_reference": reference("o", "_old"), "new_reference": reference("w", "_new"),
        "old_requirement": either(F.substring(old, 1, 500), F.when(added, "").otherwise(F.substring(text, 1, 500))), "new_requirement": either(F.substring(new, 1, 500), F.when(added, F.substring(text, 1, 500)).otherwise("")),
        "evidence": either(F.array(F.substring(old, 1, 200), F.substring(new, 1, 200)), F.array(F.substring(text, 1, 300))),
        "diff_highlights": either(F.array("_html"), F.array().cast("array<struct<old_html:string,new_html:string>>")), "negation_changed": F.coalesce("negation_changed", F.lit(False)),
    })
    return out.select(*names)


def _with_node(df: DataFrame, nodes: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """``df`` with the node of ``key`` as a struct, null without one; rows without a key are dealt by their ``other`` key and not all to one task."""
    found = nodes.select(F.col("_id").alias(f"_{name}"), F.col("_n").alias(name))
    return df.join(found, (F.coalesce(key, other) == F.col(f"_{name}")) & F.col(key).isNotNull(), "left").drop(f"_{name}")


#: Of pairs with the same texts so many are one row at most, a power of two; texts that more pairs have than this are dealt.
_SAME, _OFTEN = 1024, 65_536


def judged(pairs: DataFrame) -> DataFrame:
    """``pairs`` (_old, _new, _def and others) with what their texts alone decide.

    Pairs of equal texts come together, at most some hundreds a row, and each row is compared and classified once.  The most frequent
    texts, if they are many pairs', are dealt over all tasks; what is left of a text is less than a task's share of all pairs.
    """
    key, tasks = ["_old", "_new", "_def"], _tasks(pairs)
    rest = [c for c in pairs.columns if c not in key]
    rows = pairs.select(F.xxhash64("_old", "_new").alias("_h"), *key, F.struct(*rest).alias("_row"))
    often = [r["_h"] for r in rows.groupBy("_h").count().where(F.col("count") > _OFTEN).orderBy(F.desc("count"), "_h").limit(4 * tasks).collect()]
    by = ["_h"]
    if often:
        rows = rows.withColumn("_deal", F.when(F.col("_h").isin(often), F.pmod(F.xxhash64("_row._at"), F.lit(tasks))).otherwise(0))
        by.append("_deal")
    rows = rows.repartition(tasks, *by).sortWithinPartitions("_h", *key)
    rows = rows.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), _SAME.bit_length() - 1))
    same = rows.groupBy(*by, "_block", *key).agg(F.collect_list("_row").alias("_rows")).select(*key, "_rows")
    old, new = F.col("_old"), F.col("_new")
    same = same.withColumn("_compared", D.compared(old, new)).withColumn("diff", F.col("_compared.diff"))
    same = same.withColumn("numerical_changes", F.concat(D.with_direction(F.col("_compared.matches")), E.date_changes(old, new))).withColumn("_ob", E.obligation_change(old, new))
    same = same.withColumn("_diff_sub", D.is_substantive(old, new, F.col("diff")))
    words = F.concat_ws(" ", F.array_join(F.transform(F.col("diff.modified_segments"), lambda s: F.concat_ws(" ", s["old"], s["new"])), " "), F.array_join(F.col("diff.added_words"), " "), F.array_join(F.col("diff.removed_words"), " "))
    way = F.col("_ob.direction")
    same = same.withColumn("is_substantive", (F.size("numerical_changes") > 0) | (way != "UNCHANGED") | F.col("_diff_sub"))
    same = same.withColumn("category", F.when(F.col("is_substantive"), S.pair_category(F.col("_def"), F.col("numerical_changes"), way, words, new)).otherwise("C17"))
    score = S.impact_score(F.col("category"), way, F.col("numerical_changes"), F.lit("MODIFIED"))
    same = same.select(
        *key, "numerical_changes", "is_substantive", "category", "_diff_sub", F.col("diff.similarity_ratio").alias("_ratio"), S.impact(F.col("is_substantive"), score).alias("impact"),
        S.told(F.col("category"), F.col("numerical_changes"), way, F.col("_ob.explanation"), F.col("diff.similarity_ratio")).alias("_told"),
        F.when(way != "UNCHANGED", F.col("_ob").cast(schemas.OBLIGATION)).alias("obligation_change"), D.html_diff(F.col("diff")).alias("_html"), E.negation_changed(old, new).alias("negation_changed"), "_rows",
    )
    return same.select(*[c for c in same.columns if c != "_rows"], F.explode("_rows").alias("_row")).select("*", "_row.*").drop("_row")


def _tasks(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_ORDER = ["comparison_id", "layer", "rank", "tie", "old_node_id", "new_node_id"]
#: So many rows of starts go to every task; they are some dozens of bytes each.
_FEW_STARTS = 500_000


def placed(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows of changes stored in report order, over ``tasks`` ranges of comparison and order; ``_at`` has the range and the place in it."""
    tasks = tasks or _tasks(df)
    return stored(stored(df, "unplaced").repartitionByRange(tasks, *_ORDER).sortWithinPartitions(*_ORDER).withColumn("_at", F.monotonically_increasing_id()), "placed")


def number(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """CHG-0001 and so on within each comparison, in report order; rows without places are ``placed`` first, others keep theirs.

    A row's number is its place in its range and comparison plus the rows of the comparison in the ranges before, so a comparison of any
    size is spread.
    """
    kept = ["_at"] if "_at" in df.columns else []
    df = df if kept else placed(df, tasks)
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.partitionBy("comparison_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("comparison_id", part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = stored(starts.select(F.col("comparison_id").alias("_c"), "_part", (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_zero")), "starts")
    starts = F.broadcast(starts) if starts.count() <= _FEW_STARTS else starts
    found = df.withColumn("_p", part).join(starts, F.col("comparison_id").eqNullSafe(F.col("_c")) & (F.col("_p") == F.col("_part")))
    return found.withColumn("change_id", F.format_string("CHG-%04d", F.col("_at") - F.col("_zero") + 1)).drop(*({"_at", "_c", "_p", "_part", "_zero"} - set(kept)))


def compare(old_pages: DataFrame, new_pages: DataFrame, comparisons: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, compose: bool = True, progress: Callable[[str, float], None] = lambda stage, percent: None) -> DataFrame:
    """Changes between the documents of ``comparisons`` (comparison_id, old_document_id, new_document_id).

    ``progress`` is told each stage as it begins.
    Unknown documents are an error, as they can only give wrong ADDED or REMOVED rows.
    """
    asked = comparisons.select(F.explode(F.array("old_document_id", "new_document_id")).alias("document_id"))
    missing = reports.missing_keys(asked, old_pages.select("document_id").union(new_pages.select("document_id")), "document_id").limit(5).collect()
    if missing:
        raise ValueError(f"unknown documents: {[r.document_id for r in missing]}")
    progress("parsing", 15.0)
    old, new = (settle(structure.nodes(p, compose)) for p in (old_pages, new_pages))
    unit = lambda df, side: structure.clause_units(df).join(comparisons.select("comparison_id", F.col(f"{side}_document_id").alias("document_id")), "document_id")
    progress("alignment", 30.0)
    aligned = A.align(unit(old, "old"), unit(new, "new"), embed)
    progress("classification", 55.0)
    return classify(aligned, old.unionByName(new).dropDuplicates(["node_id"]))
