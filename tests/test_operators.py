"""Structure, matching, reports, sources and sinks."""

import random
import zipfile
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright import schemas
from clausewright.operators import align as A
from clausewright.operators import changes as CH
from clausewright.operators import reports as R
from clausewright.operators import structure as ST
from clausewright.sources import documents as DOC
from clausewright.sources import enrich, search, sinks
from clausewright.sources.tables import settle
from clausewright.streaming import ingest


def page(document, version, blocks, tables=()):
    rows = [{"text": t, "bbox": [], "font_size": 10.0, "is_bold": b, "font_name": "F", "block_type": "text"} for t, b in blocks]
    return (document, "f.pdf", version, 1, 1.0, 1, "\n".join(t for t, _ in blocks), 1.0, rows, [list(map(list, t)) for t in tables])


BLOCKS = [("CHAPTER I", False), ("1. Title", True), ("(a) Banks file returns each year", False), ("(iv) and keep copies of them", False), ("First paragraph here", False), ("continued in lower case", False)]


def test_nodes(spark):
    pages = spark.createDataFrame([page("D", "old", BLOCKS, [[["a", "b"], ["c", "d"]]])], schemas.PAGES)
    rows = ST.nodes(pages, compose=False).orderBy("order").collect()
    assert [(r.node_id, r.content_type, r.depth, r.parent_id) for r in rows] == [
        ("D_N0000", "chapter", 1, None),
        ("D_N0001", "section", 2, "D_N0000"),
        ("D_N0002", "clause", 4, "D_N0001"),
        ("D_N0003", "sub_clause", 4, "D_N0001"),
        ("D_N0004", "paragraph", 4, "D_N0001"),
        ("D_T001_0", "table", 4, "D_N0001"),
    ]
    assert rows[4].text == "First paragraph here continued in lower case"
    assert rows[5].text == "a | b\nc | d"


def sequential(kinds):
    chapter = part = section = sub = None
    out = []
    for k, kind in enumerate(kinds):
        if kind in ("chapter", "annexure"):
            out.append((None, 1))
            chapter, part, section, sub = k, None, None, None
        elif kind == "part":
            out.append((chapter, 2))
            part, section, sub = k, None, None
        elif kind == "section":
            out.append((part if part is not None else chapter, 3 if part is not None else 2))
            section, sub = k, None
        elif kind == "subsection":
            out.append((next((x for x in (section, part, chapter) if x is not None), None), 4 if part is not None else 3))
            sub = k
        elif kind == "definition":
            out.append((None, 0))
        else:
            out.append((next((x for x in (sub, section, part, chapter) if x is not None), None), 5 if sub is not None else 4 if section is not None else 3))
    return out


def test_hierarchy_is_the_sequential_one(spark):
    rng = random.Random(3)
    kinds = ["chapter", "annexure", "part", "section", "subsection", "clause", "paragraph", "definition"]
    docs = [[rng.choice(kinds) for _ in range(rng.randint(1, 25))] for _ in range(60)]
    rows = [(d, k, str(k), "section" if x == "part" else x, x == "part") for d, xs in enumerate(docs) for k, x in enumerate(xs)]
    got = ST.hierarchy(spark.createDataFrame(rows, "doc int, order int, node_id string, content_type string, is_part boolean"), ["doc"]).orderBy("doc", "order").collect()
    want = [x for xs in docs for x in sequential(xs)]
    assert [(None if r.parent_id is None else int(r.parent_id), r.depth) for r in got] == want


def scan(scores):
    old, new, out = set(), set(), set()
    for s, i, j in sorted(((s, i, j) for (i, j), s in scores.items()), reverse=True):
        if i not in old and j not in new:
            old.add(i), new.add(j), out.add((i, j))
    return out


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 5), st.integers(0, 5)), st.sampled_from([0.5, 0.6, 0.7, 0.9]), min_size=1, max_size=20))
def test_greedy_is_the_scan(spark, scores):
    df = spark.createDataFrame([("c", i, j, s) for (i, j), s in scores.items()], "comparison_id string, old_id int, new_id int, score double")
    assert {(r.old_id, r.new_id) for r in A.greedy(df, settle=settle).collect()} == scan(scores)
    grouped = df.withColumn("old_order", F.col("old_id")).withColumn("new_order", F.col("new_id"))
    assert {(r.old_id, r.new_id) for r in A.greedy_grouped(grouped).collect()} == scan(scores)


def test_compare_covers_every_clause_once(spark):
    old = [("(a) The bank shall report within 30 days", False), ("(b) The entity may submit the return now", False), ("(c) only the old text has this clause", False), ("(e) same words in both of them", False)]
    new = [("(a) The bank shall report within 15 days", False), ("(b) The entity shall submit the return now", False), ("(d) quite another rule without likeness", False), ("(e) Same words in both of them", False)]
    pages = lambda d, v, b: spark.createDataFrame([page(d, v, b)], schemas.PAGES)
    comparisons = spark.createDataFrame([("C", "O", "N")], "comparison_id string, old_document_id string, new_document_id string")
    got = CH.compare(pages("O", "old", old), pages("N", "new", new), comparisons, compose=False)
    rows = {r.change_id: r for r in got.collect()}
    assert sorted(rows) == ["CHG-0001", "CHG-0002", "CHG-0003", "CHG-0004"]
    assert [(rows[k].change_type, rows[k].category, rows[k].impact) for k in sorted(rows)] == [("MODIFIED", "C05", "HIGH"), ("MODIFIED", "C07", "CRITICAL"), ("REMOVED", "C02", "HIGH"), ("ADDED", "C01", "HIGH")]
    assert all(0 <= r.confidence.overall <= 1 for r in rows.values())
    assert len(R.export_rows(got).columns) == 17 and len(R.export_rows_script(got).columns) == 17
    assert R.export_rows(got).where("`Change ID` = 'CHG-0004'").first()["Old Location"] == "Page N/A"
    with pytest.raises(ValueError, match="unknown documents"):
        CH.compare(pages("O", "old", old), pages("N", "new", new), comparisons.withColumn("old_document_id", F.lit("?")))


def changes(spark):
    rows = [("C", "CHG-0001", "MODIFIED", "C04", True, "HIGH", "limit 100% up", 0.8), ("C", "CHG-0002", "ADDED", "C01", True, "CRITICAL", "new_thing", 0.9), ("C", "CHG-0003", "REWORDED", "C17", False, "INFORMATIONAL", "words", 0.5)]
    df = spark.createDataFrame(rows, "comparison_id string, change_id string, change_type string, category string, is_substantive boolean, impact string, change_summary string, confidence_overall double")
    return df.withColumn("old_requirement", F.lit("")).withColumn("new_requirement", F.lit(""))


def test_reports(spark):
    df = changes(spark)
    assert [r.change_id for r in R.ranked(df).collect()] == ["CHG-0002", "CHG-0001", "CHG-0003"]
    assert [r.change_id for r in R.filtered(df, search="0% U", category="").collect()] == ["CHG-0001"]
    assert R.filtered(df, search="_").count() == 1
    s = R.statistics(df).first()
    assert (s.total, s.substantive, s.editorial, s.modified) == (3, 2, 1, 2)
    assert sum(s[x.lower()] for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFORMATIONAL")) == 3
    assert R.statistics(df.limit(0)).first().substantive is None
    log = R.review(spark, "C", "CHG-0001", "ACCEPTED", "fine")
    assert {r.change_id: r.review_status for r in R.with_reviews(df, log).collect()} == {"CHG-0001": "ACCEPTED", "CHG-0002": "PENDING", "CHG-0003": "PENDING"}
    with pytest.raises(ValueError):
        R.review(spark, "C", "CHG-0001", "MAYBE")
    assert R.categories(spark).count() == 17


def test_sinks(spark, tmp_path):
    df = changes(spark)
    sinks.save_changes(df, str(tmp_path / "c"))
    sinks.save_changes(df.withColumn("comparison_id", F.lit("D")), str(tmp_path / "c"))
    sinks.save_changes(df.limit(1), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).groupBy("comparison_id").count().orderBy("comparison_id").collect()[0]["count"] == 1
    assert sinks.csv_bytes(df.select("change_id"))[:12] == b"\xef\xbb\xbfchange_id"
    (tmp_path / "x.xlsx").write_bytes(sinks.xlsx_bytes(df.select("change_id", "change_summary")))
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        assert z.testzip() is None and b"CHG-0003" in z.read("xl/worksheets/sheet1.xml")
    assert '"total": 3' in sinks.export_json(df, R.statistics(df), "C")
    with pytest.raises(LookupError):
        sinks.csv_bytes(df.limit(0))
    sinks.bootstrap(spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "documents")).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    good, bad = DOC.accepted(DOC.scan_files(spark, str(tmp_path)), "old")
    span = lambda t, f: {"text": t, "size": 11.04, "font": f}
    pages = DOC.extract(good, lambda data: [{"spans": [[[span("RBI/1", "X-Bold"), span(" ", "Y")]]], "tables": [[[" a ", None], ["", ""]]]}])
    row = pages.first()
    assert bad.count() == 0 and row.document_id.startswith("DOC_old_") and row.tables == [[["a", ""]]]
    assert (row.blocks[0].font_size, row.blocks[0].is_bold, row.blocks[0].font_name) == (11.0, True, "X-Bold")
    assert DOC.block_of([[span(" ", "Y")]]) is None
    m = spark.range(1).select(DOC.metadata(F.lit("RBI/a\nMaster Direction X\nMay 5, 2020\nUpdated as on June 6, 2021\nRBI/b")).alias("m")).first().m
    assert (m.circular_number, m.title, m.issue_date, m.update_dates) == ("RBI/b", "Master Direction X", "May 5, 2020", ["June 6, 2021"])
    with pytest.raises(ValueError):
        DOC.accepted(good, "newest")


def test_enrich(spark):
    rows = {r.change_id: r for r in enrich.enrich(changes(spark), lambda p: 'well {"explanation": "e"} so' if "C04" in p else 1 / 0, "m").collect()}
    assert rows["CHG-0001"].llm_explanation == "e" and rows["CHG-0001"].model_version == "m"
    assert not rows["CHG-0002"].llm_available and not rows["CHG-0003"].llm_available
    v = enrich.embed_texts(spark.createDataFrame([("a",), ("a",), (None,)], "text string"), lambda: lambda ts: [[3.0, 4.0] for _ in ts]).collect()
    assert len(v) == 3 and all(abs(r.embedding[0] - 0.6) < 1e-6 for r in v)


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([page("D", "old", BLOCKS)], schemas.PAGES).write.parquet(source)
    for _ in range(2):
        ingest.ingest(spark, source, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_folders_are_cleared(spark):
    from clausewright.sources import tables

    tables.clear_folders(spark)
    folder = tables.new_folder(spark, "kept")
    spark.range(3).write.parquet(folder)
    tables.new_folder(spark, "never made")
    assert spark.read.parquet(folder).count() == 3 and tables.clear_folders(spark) == 1
    assert not list(Path(folder.removeprefix("file:")).parent.glob("kept-*"))


def test_numbers_do_not_depend_on_tasks(spark):
    """One comparison over many tasks has the numbers that a scan gives; so have small and nameless ones beside it."""
    rng = random.Random(31)
    rows = [(c, rng.randrange(4), round(rng.random(), 2), rng.randrange(3), rng.choice([None, f"o{k}"]), f"n{k}") for c, n in (("large", 3000), ("small", 2), (None, 5)) for k in range(n)]
    df = spark.createDataFrame(rows, "comparison_id string, layer int, rank double, tie int, old_node_id string, new_node_id string")
    got = {r.new_node_id + str(r.comparison_id): int(r.change_id[4:]) for r in CH.number(df.repartition(9), 64).collect()}
    for c in ("large", "small", None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (*r[1:4], r[4] or "", r[5]))
        assert [got[r[5] + str(c)] for r in own] == list(range(1, len(own) + 1))
    assert len(got) == len(rows) and CH.number(df.where("layer > 9")).collect() == []


def first_fit_by_loops(old, new):
    """Old nodes in order take the first new one, in order, of their section whose text is like theirs."""
    from clausewright.functions.compare import ratio_of

    free, out = sorted((r for r in new if r[2]), key=lambda r: (r[5], r[1])), set()
    for a in sorted((r for r in old if r[2]), key=lambda r: (r[5], r[1])):
        for b in free:
            if b[2] == a[2] and ratio_of(a[4], b[4]) >= 0.3:
                out.add((a[1], b[1]))
                free.remove(b)
                break
    return out


def structural_by_loops(old, new):
    """Old nodes in order take the best new one that is left by heading and text, the first in order among equals."""
    from clausewright.functions.compare import ratio_of

    free, out = sorted((r for r in new if r[3]), key=lambda r: (r[5], r[1])), set()
    for a in sorted((r for r in old if r[3]), key=lambda r: (r[5], r[1])):
        scored = [(0.6 * h + 0.4 * ratio_of(a[4], b[4]), -k) for k, b in enumerate(free) if (h := ratio_of(a[3].lower(), b[3].lower())) >= 0.7]
        score, k = max(scored, default=(0.0, 0))
        if score >= 0.5:
            out.add((a[1], free.pop(-k)[1]))
    return out


def test_repeated_sections_and_headings_are_the_sequential_scans(spark):
    """Labels such as (a) that repeat, and headings that compete, against loops: by a scan for each comparison and in rounds over tables."""
    rng = random.Random(41)
    words = ["returns", "audit", "capital", "Audit", "report", "ing", "s", "of", "branch", "deposit"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = {}
    for side in "ON":
        rows[side] = [(c, f"{c}{side}{k}", rng.choice(["", "(a)", "(b)", "1.1", f"9.{k}"]), some(rng.randrange(1, 4)) if rng.random() < 0.7 else "", some(rng.randrange(1, 7)), rng.randrange(60)) for c in ("X", "Y", "Z") for k in range(40)]
    schema = "comparison_id string, node_id string, section_number string, heading string, normalized_text string, order int"
    old, new = (spark.createDataFrame(rows[s], schema).repartition(5) for s in "ON")
    per = lambda f: set().union(*(f([r for r in rows["O"] if r[0] == c], [r for r in rows["N"] if r[0] == c]) for c in ("X", "Y", "Z")))
    taken = lambda df: {(r.old_node_id, r.new_node_id) for r in df.collect()}
    assert taken(A.exact_layer(old, new)) == per(first_fit_by_loops)
    want = per(structural_by_loops)
    assert len(want) > 30
    for most in (10_000, 0):
        assert taken(A.structural_layer(old, new, most)) == want
    many = A.heading_pairs(old, new, block=7).collect()
    assert len(many) == len({tuple(r) for r in many})


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(1, 4)), max_size=30, unique_by=lambda r: r[:2]))
def test_in_turn_is_the_scan(spark, scores):
    df = spark.createDataFrame([("c", f"o{a}", f"n{b}", a, b, s / 4) for a, b, s in scores], "comparison_id string, old_id string, new_id string, old_order int, new_order int, score double")
    want, used = set(), set()
    for a in sorted({x[0] for x in scores}):
        best = max(((s, -b) for x, b, s in scores if x == a and b not in used), default=None)
        if best:
            used.add(-best[1])
            want.add((f"o{a}", f"n{-best[1]}"))
    assert {(r.old_id, r.new_id) for r in A.in_turn(df).collect()} == want


def test_summaries_follow_the_changes(spark, tmp_path):
    """After a comparison is replaced, the summary gives what the changes give; the others' counts stay."""
    rng = random.Random(3)
    table, counts = str(tmp_path / "changes"), str(tmp_path / "summary")

    def save(n, names):
        rows = [(c, rng.choice(["C04", "C05", "C17"]), rng.choice(["HIGH", "LOW", "CRITICAL"]), rng.choice(["ADDED", "MODIFIED", "REMOVED"]), rng.random() < 0.7, rng.choice([None, round(rng.random(), 3)])) for c in names for _ in range(n)]
        sinks.save_with_summary(spark.createDataFrame(rows, "comparison_id string, category string, impact string, change_type string, is_substantive boolean, confidence_overall double"), table, counts)

    save(40, "AB")
    save(9, "B")
    save(25, "C")
    both = [spark.read.parquet(table), spark.read.parquet(counts)]
    assert both[0].groupBy("comparison_id").count().orderBy("comparison_id").collect() == spark.createDataFrame([("A", 40), ("B", 9), ("C", 25)], "comparison_id string, count bigint").collect()
    for f in (R.category_distribution, R.impact_heatmap, R.heatmap_pivot, lambda df: R.counts_by(df, "change_type"), lambda df: R.statistics(df).withColumn("avg_confidence", F.round("avg_confidence", 9))):
        for own in ("comparison_id = 'B'", "true", "comparison_id = 'nobody'"):
            a, b = (sorted(map(str, f(df.where(own)).collect())) for df in both)
            assert a == b


def test_search_reads_few_files(spark, tmp_path):
    """Through the index as without it, before and after comparisons are replaced; what is read is counted."""
    table, index = str(tmp_path / "changes"), str(tmp_path / "index")
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeÉ") for _ in range(5))

    def save(names, needle=None):
        rows = [(c, f"CHG-{k}", f"{word()} {word()}", rng.choice([None, word()]), needle if k == 3 else word()) for c in names for k in range(8)]
        sinks.save_changes(spark.createDataFrame(rows, "comparison_id string, change_id string, change_summary string, old_requirement string, new_requirement string"), table)

    def check(needle, most):
        rows = spark.read.parquet(table)
        want = {(r.comparison_id, r.change_id) for r in R.filtered(rows, needle).collect()}
        assert {(r.comparison_id, r.change_id) for r in search.search(spark, table, index, needle).collect()} == want
        assert len(search.files_for(spark, table, index, needle)) <= most
        return len(want)

    save([f"C {k}:x+%" for k in range(20)])
    save(["rare"], "the Zymurgy clause")
    files = len(search.table_files(spark, table))
    assert check("ZYMURGY", files) == 1 and search.update_index(spark, table, index) == files and search.update_index(spark, table, index) == 0
    assert check("ZYMURGY", 1) == 1 and check("zymurgist", 0) == 0 and check("zy", files) == 1 and check("abc", files) >= 0 and check("é", files) > 0
    save(["C 3:x+%"], "a new Zymurgy")
    save(["rare"])
    assert check("zymurgy", 2) == 1
    assert search.update_index(spark, table, index) == 2 and check("zymurgy", 1) == 1


def test_many_comparisons_are_no_folders(spark, tmp_path):
    """A table of many comparisons has as many files as tasks, its counts are those of the changes, and a search finds what a scan does."""
    rows = [(f"C{k % 700}", f"CHG-{k}", ["C04", "C17"][k % 2], ["HIGH", "LOW"][k % 3 == 0], "MODIFIED", k % 5 > 0, k / 2000, "penalty" if k == 77 else f"text {k}", None, "É") for k in range(2000)]
    df = spark.createDataFrame(rows, "comparison_id string, change_id string, category string, impact string, change_type string, is_substantive boolean, confidence_overall double, change_summary string, old_requirement string, new_requirement string")
    table, counts = str(tmp_path / "changes"), str(tmp_path / "summary")
    sinks.save_all(df.repartitionByRange(3, "comparison_id"), table, counts)
    assert len(search.table_files(spark, table)) == 3 and not [p for at in (table, counts) for p in Path(at).iterdir() if p.is_dir()]
    a, b = (spark.read.parquet(p) for p in (table, counts))
    assert sorted(map(str, R.impact_heatmap(a).collect())) == sorted(map(str, R.impact_heatmap(b).collect())) and R.statistics(b).first().total == 2000
    index = str(tmp_path / "index")
    assert search.update_index(spark, table, index) == 3 and search.update_index(spark, table, index) == 0
    assert len(search.files_for(spark, table, index, "PENALTY")) == 1
    assert [r.change_id for r in search.search(spark, table, index, "PENALTY").collect()] == ["CHG-77"]


@given(st.lists(st.text("abcÉ😀\0", max_size=9), max_size=9))
def test_grams_are_those_of_each_text(texts):
    assert sorted(search.grams_of(texts)) == sorted({t[k : k + 3] for t in texts for k in range(len(t) - 2)})


def test_classify_joins_nodes_once(spark, monkeypatch):
    """Pairs and single nodes come from one stored join, not from one each; F7, F9 to F24."""
    from clausewright.operators import changes
    from clausewright.plans import clauses

    monkeypatch.setattr(changes, "number", lambda df: df.withColumn("change_id", F.lit("")))
    df = changes.classify(*(f(spark, "/root/testdata/sf0.001") for f in (clauses.alignments, clauses.nodes)))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() > 0


def test_changes_are_placed_before_they_are_classified(spark, monkeypatch):
    """What is made of a change is not stored on the way; only its texts and its place are; F10 to F23."""
    from clausewright.operators import changes
    from clausewright.plans import clauses

    kept = []
    monkeypatch.setattr(changes, "stored", lambda df, name="table", real=changes.stored: kept.append(df.columns) or real(df, name))
    df = changes.classify(*(f(spark, "/root/testdata/sf0.001") for f in (clauses.alignments, clauses.nodes)))
    assert kept and not any("change_summary" in c or "numerical_changes" in c for c in kept)
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    assert df.groupBy("comparison_id").agg((F.countDistinct("change_id") == F.count("*")).alias("x")).where("NOT x").isEmpty()


def _shared_texts(spark):
    """40 pairs in four comparisons that share two pairs of texts, a pair with a null text, and 30 added nodes."""
    texts = [("The bank shall report within 5 days", "The bank may report within 15 days"), ("Pay INR 3 lakh", "Pay INR 8 lakh, if asked")]
    nodes, pairs = [], []
    for k in range(40):
        for side, text in zip("ON", texts[k % 2], strict=True):
            nodes.append((f"{side}{k}", f"DOC_{side}", k, k, f"{k}", "", text, text.lower(), "clause"))
        pairs.append((f"C{k % 4}", f"O{k}", f"N{k}", "ONE_TO_ONE", "exact", {"section_match": 1.0}, 0, float(k), 0))
    nodes += [("Ox", "DOC_O", 1, 1, "", "", None, None, "clause"), ("Nx", "DOC_N", 1, 1, "", "", "Some text", "some text", "definition")]
    pairs.append(("C0", "Ox", "Nx", "ONE_TO_ONE", "lexical", {}, 2, -0.5, 0))
    for k in range(30):
        nodes.append((f"A{k}", "DOC_N", 1, 1, "", "", f"Added {k}", f"added {k}", "clause"))
        pairs.append(("C1", None, f"A{k}", "ADDED", "unmatched", {}, 5, float(k), 0))
    a = spark.createDataFrame(pairs, "comparison_id string, old_node_id string, new_node_id string, alignment_type string, match_method string, similarity_scores map<string,double>, layer int, rank double, tie int")
    return a, spark.createDataFrame(nodes, "node_id string, document_id string, page_start int, page_end int, section_number string, heading string, text string, normalized_text string, content_type string")


def test_texts_that_pairs_share_are_compared_once(spark, monkeypatch, tmp_path):
    """However many pairs have them, and once a task at most if they are frequent; the changes are the same; F11 to F22."""
    import pyarrow as pa

    from clausewright.functions import compare as D

    def told(calls):
        @F.arrow_udf(f"struct<diff:{D.DIFF},matches:{D.MATCHES}>")
        def compared(old: pa.Array, new: pa.Array) -> pa.Array:
            with open(calls, "a") as f:
                f.write("x" * len(old))
            return pa.array([{"diff": D.diff_of(a, b), "matches": D.number_matches_of(a, b)} for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True)], D._ARROW)

        return compared

    rows = {}
    for often, same in ((CH._OFTEN, CH._SAME), (5, 2)):
        calls = tmp_path / f"{often}"
        monkeypatch.setattr(CH.D, "compared", told(str(calls)))
        monkeypatch.setattr(CH, "_OFTEN", often)
        monkeypatch.setattr(CH, "_SAME", same)
        rows[often] = sorted(map(str, CH.classify(*_shared_texts(spark)).collect()))
        assert len(rows[often]) == 71
        assert calls.read_text().count("x") == 3 if often > 5 else calls.read_text().count("x") > 3
    assert len(set(map(str, rows.values()))) == 1
    assert sum("category='C04'" in r for r in rows[5]) == 20 and sum("change_type='ADDED'" in r for r in rows[5]) == 30


def test_rows_without_a_node_are_in_no_single_task(spark):
    """A row without a key gets no node, though the key it is dealt by is one, and all such rows don't meet; F11 to F22."""
    a, nodes = _shared_texts(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = CH._with_node(a, nodes.select(F.col("node_id").alias("_id"), F.struct("node_id").alias("_n")), "old_node_id", "new_node_id", "o")
        got = found.select("old_node_id", "o.node_id", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 71 and all(r.old_node_id == r.node_id for r in got)
    assert len({r.p for r in got if r.old_node_id is None}) > 1
