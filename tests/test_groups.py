import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausewright.functions import compare as D
from clausewright.operators import align as A
from clausewright.sources import tables


def test_groups_are_whole_whatever_batches_and_plans(spark):
    """Groups that end and go on at batches, with null keys, of rows that are dealt by the keys already."""
    rows = [("a", 1, k) for k in range(7)] + [("a", None, 9), (None, 1, 8), (None, None, 7), (None, None, 6)] + [(f"k{k % 5}", k % 3, k) for k in range(60)]
    df = spark.createDataFrame(rows, "k string, j int, v int")
    both = df.where("v % 2 = 0").repartition(4, "k", "j").unionByName(df.where("v % 2 = 1").repartition(4, "k", "j"))

    def listed(t, groups):
        values = t["v"].to_pylist()
        return pa.table({"k": t["k"].take(pa.array([i for i, _ in groups])), "all": pa.array([",".join(map(str, values[i:j])) for i, j in groups], pa.string())})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = tables.in_groups(both, ["k", "j"], [F.desc("v")], listed, "k string, all string")
        got = sorted((r["k"] or "", r["all"]) for r in made.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, j, v in rows:
        want.setdefault((k, j), []).append(v)
    assert got == sorted((k or "", ",".join(map(str, sorted(v, reverse=True)))) for (k, _), v in want.items())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(xxhash64(" in plan
    assert tables.in_groups(df.where("v < 0"), ["k"], [], listed, "k string, all string").collect() == []


def test_small_groups_cost_no_call_each(spark):
    nodes = spark.createDataFrame([("c", f"n{k}", "s", "head", f"some text {k}", k) for k in range(4)], "comparison_id string, node_id string, section_number string, heading string, normalized_text string, order int")
    other = nodes.withColumn("node_id", F.concat(F.lit("x"), "node_id"))
    scores = spark.createDataFrame([("c", "a", "b", 0.5, 1, 2)], "comparison_id string, old_id string, new_id string, score double, old_order int, new_order int")
    for made in (A.exact_layer(nodes, other), A.structural_layer(nodes, other), A.greedy_match(scores), A.lexical_scores(nodes, other, stop_words=[])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and "FlatMapCoGroups" not in plan


@pytest.mark.parametrize("least", [0.3, 0.5, 0.7])
def test_ratios_from_a_least_one(least):
    random.seed(11)
    for _ in range(1500):
        letters = random.choice(["ab", "abc ", "0123456789abcdef"])
        a, b = ("".join(random.choices(letters, k=random.randint(0, 60))) for _ in "ab")
        b = a[10:40] + b if random.random() < 0.3 else b
        want = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        got = D.ratio_from(a, b, least)
        assert D.ratio_of(a, b) == want and (got == want if want >= least else got < least)
        assert (D.ratio_from(a, b, least, least) > least) == (want > least)


def test_cheap_rules_equal_the_patterns(spark):
    """Texts that begin like a rule's or not, with white space of any kind, against the patterns alone; ratios are computed once where they filter."""
    import random

    from clausewright import lexicon
    from clausewright.functions import text as T
    from clausewright.operators import structure as ST

    random.seed(5)
    bits = ["12", "Page 3 of 9", "- 4 -", " ", "  ", "\n", "\t", "\x0b", "\x85", "　", "a", "Contents", "....", "Rs. 5", "₹ 9", "pre-\nfix", "\x92", "\x1c", "p"]
    rows = [("".join(random.choices(bits, k=random.randint(1, 4))),) for _ in range(500)] + [("",)]
    t = F.col("t")
    plain = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    normal = plain(T.drop_furniture(T.dehyphenate(T.fix_spaces(T.fix_artifacts(t)))))
    same = normal
    for old, new in lexicon.CURRENCIES.items():
        same = F.replace(same, F.lit(old), F.lit(new))
    got = spark.createDataFrame(rows, "t string").select("t", (T.strip(t) == plain(t)).alias("a"), (T.normalize(t, False) == normal).alias("b"), (T.normalize_for_comparison(t, False) == plain(F.lower(F.regexp_replace(same, r"(?U)\s+", " ")))).alias("c"))
    assert got.where("NOT (a AND b AND c)").collect() == []
    pages = spark.createDataFrame([("d", "old", 1, "Terms .... 1", [("(a) one", 10.0, False, "F")], [])], "document_id string, version string, page_number int, text string, blocks array<struct<text:string,font_size:double,is_bold:boolean,font_name:string>>, tables array<array<array<string>>>")
    plan = ST.nodes(pages, compose=False)._jdf.queryExecution().optimizedPlan().toString()
    exploded = plan[: plan.index("Generate")]
    assert "page_text" not in exploded
    ratios = spark.createDataFrame([("a b", "a c")], "a string, b string").withColumn("r", D.text_ratio("a", "b")).where("r >= 0.3").select((F.col("r") + 1).alias("s"), "r")
    assert ratios._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1


def test_terms_of_small_comparisons_are_not_shuffled(spark):
    """Comparisons of a few nodes are weighed in one group each, from texts; a row of a node leaves Python, not one of a term."""
    rows = [("c", k, "old" if k % 2 else "new", f"w{k % 3} w{k % 5} é{k}") for k in range(30)]
    df = spark.createDataFrame(rows, "comparison_id string, node_id bigint, side string, normalized_text string")
    made = A._tfidf(df, features=8, stop_words=[])
    packed = {(r.node_id, r.side): sorted(zip(r._at, r._w)) for r in A._tfidf(df, features=8, stop_words=[], packed=True).collect()}
    listed = {}
    for r in made.collect():
        listed.setdefault((r.node_id, r.side), []).append((r._r, r.weight))
    assert packed == {k: sorted(v) for k, v in listed.items()} and len(packed) == 30
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = A._tfidf(df, features=8, stop_words=[], packed=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("MapInArrow") == 2 and A._NODES >= 30


def test_copies_are_stored_before_they_are_read_again(spark, tmp_path):
    from clausewright.plans import text_queries as Q

    text = "documents that begin alike for forty characters and go on with"
    rows = [(k, f"{text} word{k % 2} here", "en") for k in range(4)] + [(9, "a document that is alone in its comparison", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    tables.clear_folders(spark)
    got = Q.QUERIES["lexical_pairs"](spark, str(tmp_path)).collect()
    assert [(r.old_id, r.new_id) for r in got] == [("0", "1")]
    assert [f for f in tables._made if "/copies-" in f]
