"""Hand-derived cases of the column functions, and properties against Python."""

import difflib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright import lexicon
from clausewright.functions import compare, extract, scores
from clausewright.functions import text as T
from clausewright.operators import structure as ST


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_normalize(spark):
    assert one(spark, T.normalize_for_comparison(F.col("t")), t="Rs. 5,000\n\n12\n") == "inr 5,000"
    assert one(spark, T.normalize(F.col("t")), t="regu-\n lated") == "regulated"
    assert one(spark, T.normalize(F.col("t")), t="é “a” �") == "é \"a\""
    assert one(spark, T.normalize(F.lit(None).cast("string"))) == ""


def test_quality_and_sentences(spark):
    assert abs(one(spark, T.quality(F.lit("ab©d"))) - 0.625) < 1e-9
    assert one(spark, T.quality(F.lit(" \n"))) == 0.0
    assert one(spark, T.sentences(F.lit("See Sec. 5 now. It ends! (Or not) no."))) == ["See Sec. 5 now.", "It ends!", "(Or not) no."]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab -\n\t1é .", max_size=14), min_size=1, max_size=6))
def test_spaces_like_python(spark, texts):
    def python(t):
        t = re.sub(r"[^\S\n]+", " ", t)
        t = re.sub(r"\n{3,}", "\n\n", t)
        t = "\n".join(x.rstrip() for x in t.split("\n"))
        return re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", t)

    got = [r.x for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.dehyphenate(T.fix_spaces(F.col("t"))).alias("x")).orderBy("k").collect()]
    assert got == [python(t) for t in texts]


def test_extraction(spark):
    values = lambda c: [(v.text, v.value, v.unit) for v in one(spark, c)]
    assert values(extract.money(F.lit("INR 7 lakhs"))) == [("INR 7 lakh", 7e5, "lakh"), ("7 lakhs", 7e5, "lakhs")]
    assert values(extract.money(F.lit("5 customers 3 crore"))) == [("rs 3 crore", 3e7, "crore"), ("3 crore", 3e7, "crore")]
    assert values(extract.durations(F.lit("period of 30 days"))) == [("30 days", 30.0, "day"), ("period of 30 days", 30.0, "day")]
    assert values(extract.durations(F.lit("30 working days"))) == [("30 working days", 30.0, "day")]
    assert values(extract.percentages(F.lit("5 per cent or 7%"))) == [("5 per cent", 5.0, "%"), ("7%", 7.0, "%")]
    got = one(spark, extract.date_changes(F.lit("1 May 2020"), F.lit("1 May 2020 and 2 May 2021")))
    assert [(r.old_value, r.new_value, r.direction) for r in got] == [("1 May 2020", "2 May 2021", "CHANGED")]


def test_obligations(spark):
    terms = one(spark, extract.obligation_terms(F.lit("Banks Shall Not pay")))
    assert terms == ["shall not", "shall"]
    ob = one(spark, extract.obligation_change(F.lit("may pay"), F.lit("shall pay, provided  that it can")))
    assert (ob.direction, ob.old_strength, ob.new_strength) == ("STRENGTHENED", 2, 5)
    assert ob.explanation.endswith("New conditions added: provided that.")
    assert one(spark, extract.obligation_change(F.lit("not allowed"), F.lit("x"))).direction == "REMOVED"


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*lexicon.OBLIGATIONS, "Shall", "MUST", "not", "permit", "x", "maybe", "\u00e9may"]), max_size=7), min_size=1, max_size=8))
def test_terms_are_words(spark, rows):
    texts = [" ".join(r) for r in rows] + ["shall  not", "must not permitted", "can.may,should"]
    got = [r.x for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", extract.obligation_terms(F.col("t")).alias("x")).orderBy("k").collect()]
    assert got == [[t for t in lexicon.OBLIGATIONS if re.search(rf"\b{t}\b", x, re.IGNORECASE)] for x in texts]


def pair(spark, old, new):
    df = spark.createDataFrame([(old, new)], "o string, n string")
    df = df.withColumn("diff", compare.word_diff("o", "n")).withColumn("nums", compare.number_changes("o", "n")).withColumn("ob", extract.obligation_change(F.col("o"), F.col("n")))
    return df.withColumn("sub", compare.is_substantive(F.col("o"), F.col("n"), F.col("diff"))).first()


def test_pairs(spark):
    r = pair(spark, "The bank shall report within 30 days", "The bank shall report within 15 days")
    assert abs(r.diff.similarity_ratio - 0.857143) < 1e-5
    assert [(n.field, n.old_numeric, n.new_numeric, n.direction, n.magnitude_percent) for n in r.nums] == [("duration", 30.0, 15.0, "DECREASE", 50.0)]
    r = pair(spark, "A fine of Rs. 5 lakh applies", "A fine of Rs. 10 lakh applies")
    assert [n.magnitude_percent for n in r.nums] == [100.0, 100.0]
    r = pair(spark, "The bank, shall report", "The bank shall report")
    assert r.diff.similarity_ratio == 0.75 and not r.sub and not r.nums
    r = pair(spark, None, "")
    assert not r.diff.has_changes and r.diff.diff_ops == []


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("ab c", max_size=12), st.text("ab c", max_size=12)), min_size=1, max_size=5))
def test_ratio_is_difflibs(spark, rows):
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string").select("k", compare.text_ratio("a", "b").alias("x")).orderBy("k").collect()
    assert [g.x for g in got] == [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in rows]


def test_scores(spark):
    numbers = compare.number_changes(F.lit("within 30 days"), F.lit("within 15 days"))
    df = spark.range(1).select(numbers.alias("n"))
    assert df.select(scores.impact_score(F.lit("C05"), F.lit("UNCHANGED"), F.col("n"), F.lit("MODIFIED")).alias("x")).first().x == 5
    assert one(spark, scores.impact(F.lit(True), F.lit(6))) == "CRITICAL"
    overall = one(spark, scores.confidence(F.lit("MODIFIED"), F.lit(1.0), F.lit(0.857143), F.lit(0.0), F.lit(0.5), F.lit(0.9)))
    assert abs(overall - 0.674286) < 1e-5
    assert one(spark, scores.confidence(F.lit("ADDED"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.9))) == 0.9
    assert one(spark, scores.added_category(F.lit("nothing here"), F.lit(False))) == "C01"
    assert one(spark, scores.category_name(F.lit("C99"))) == "C99"
    assert set(lexicon.BASE_IMPACT) == set(lexicon.CATEGORIES)


def kind(spark, text, bold=False, size=10.0):
    k = one(spark, ST.classify_block(F.lit(text), ST.is_heading(F.lit(size), F.lit(bold), F.lit(10.0)), F.lit(size), F.lit(10.0)))
    return k.content_type, k.section_number, k.heading


def test_block_rules(spark):
    assert kind(spark, "CHAPTER I") == ("chapter", "Ch.I", "")
    assert kind(spark, "1. Title", bold=True) == ("section", "1", "Title")
    assert kind(spark, "1. Title") == ("clause", "1", "")
    assert kind(spark, "(a) Banks file") == ("clause", "(a)", "")
    assert kind(spark, "(iv) and keep") == ("sub_clause", "(iv)", "")
    assert kind(spark, "(i) one letter") == ("clause", "(i)", "")
    assert kind(spark, "Scheduled banks are listed") == ("annexure", "Annexure d banks are listed", "d banks are listed")
    assert kind(spark, '"Bank" means one') == ("definition", "", "")
    assert kind(spark, "General", size=12.0) == ("section", "", "General")
    assert kind(spark, "General", bold=True) == ("paragraph", "", "")
    assert kind(spark, "1.1. Title") == ("paragraph", "", "")


@settings(max_examples=300, deadline=None)
@given(st.text("ab 1", min_size=0, max_size=30), st.lists(st.text("ab 1", min_size=0, max_size=30), max_size=6))
def test_closest_context_is_the_largest_ratio(x, others):
    """Bounds leave out no context that a full search would choose, also among equals and at the threshold."""
    scored = [(difflib.SequenceMatcher(None, x, y).ratio(), -j) for j, y in enumerate(others)]
    best = max(scored, default=(0.0, 0))
    want = -best[1] if best[0] > 0.3 else None
    assert compare.closest(compare._Context(x), [(j, compare._Context(y)) for j, y in enumerate(others)]) == want
    assert compare.closest(compare._Context(x * 12), [(j, compare._Context(y * 12)) for j, y in enumerate(others)]) == _full(x * 12, [y * 12 for y in others])


def _full(x, others):
    best = max(((difflib.SequenceMatcher(None, x, y).ratio(), -j) for j, y in enumerate(others)), default=(0.0, 0))
    return -best[1] if best[0] > 0.3 else None


_NUMBERS = st.lists(st.sampled_from(["INR 5 lakh", "INR 7 lakh", "5 crore", "Rs. 9", "3 percent", "4%", "within 5 days", "6 days", "2 months", "pay", "and report", "x" * 70]), max_size=9).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(_NUMBERS, _NUMBERS)
def test_numbers_of_one_value_need_no_contexts(old, new):
    """As a loop that compares all contexts of a unit; and none is made where a unit has one value."""
    want = []
    for kind, patterns in (("monetary", lexicon.MONEY), ("percentage", lexicon.PERCENT), ("duration", lexicon.DURATION)):
        near = lambda text, x: text[max(0, x["at"][0] - 30) : x["at"][1] + 30].lower()
        free = list(compare._found(new, patterns, kind))
        for x in compare._found(old, patterns, kind):
            own = [y for y in free if y["unit"] == x["unit"]]
            at = _full(near(old, x), [near(new, y) for y in own])
            if at is not None:
                free.remove(own[at])
                if own[at]["value"] != x["value"]:
                    want.append((kind, x["text"], own[at]["text"]))
    assert [(m["field"], m["old_value"], m["new_value"]) for m in compare.number_matches_of(old, new)] == want


def test_equal_numbers_compare_no_contexts(monkeypatch):
    monkeypatch.setattr(compare, "_Context", None)
    assert compare.number_matches_of("pay INR 5 lakh within 6 days at 3 percent", "the bank pays INR 5 lakh in 6 days, or 3 percent") == []


def test_contexts_with_a_common_part_need_no_matcher():
    """One candidate is taken by its longest common part, wherever that stands, and as a matcher would say; F7, F9 to F24."""
    import random
    from difflib import SequenceMatcher

    from clausewright.functions import compare as D

    x, y = D._Context("qq within thirty days and pay zz"), D._Context("ww within thirty days and pay kkk")
    assert D.closest(x, [(4, y)]) == 4
    assert y.matcher is None
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 30))) for _ in "ab")
        want = 1 if SequenceMatcher(None, a, b).ratio() > 0.3 else None
        assert D.closest(D._Context(a), [(1, D._Context(b))]) == want, (a, b)


def test_numbers_are_found_as_by_all_patterns():
    """Patterns are left out only where none of their words is in an ASCII text; long s and the Kelvin sign fold to letters."""
    import re

    from clausewright import lexicon
    from clausewright.functions import compare as D

    texts = ["", "5", "INR 5 lakh within 30 DAYS at 7 Per Cent", "rs. 1,000 and Rupees 7 CRORES", "9 p.c. in a period of 3 months", "4 business days", "5 la\u212ah", "12 day\u017f", "8 \u212a per cent", "\u20b9 9 million", "1\x1f2 hours", "7 percent\u0130"]
    for kind, patterns in (("monetary", lexicon.MONEY), ("percentage", lexicon.PERCENT), ("duration", lexicon.DURATION)):
        for t in texts:
            want = [m.span() for p in patterns for m in re.finditer(p, t, re.IGNORECASE)]
            assert [x["at"] for x in D._found(t, patterns, kind)] == want, t


def test_categories_of_ascii_and_other_texts(spark):
    """ASCII texts take patterns without Unicode rules, and others don't; both find the same."""
    from clausewright.functions import scores as S

    texts = ["", "a REPORT of the penalty", "non-compliance\twith 30 days", "records_kept keep", "rule\x1f5", "See section 5, vide RBI/ab/12", "time-limit cap", '"x" means', "act", "reacting"]
    rows = [(t, t + " \u00e9") for t in texts]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.keyword_category(F.lit(""), F.col("a")).alias("a"), S.keyword_category(F.lit(""), F.col("b")).alias("b"), S.keyword_category(F.col("a"), F.col("b")).alias("c"), S.keyword_category(F.col("b"), F.col("b")).alias("d"))
    for t, r in zip(texts, got.collect(), strict=True):
        assert r.a == r.b and r.c == r.d, (t, r)
    assert got.select("a")._jdf.queryExecution().optimizedPlan().toString().count("octet_length") > 0


def _opcodes(a, b):
    matcher = difflib.SequenceMatcher(None, a, b)
    return matcher.get_opcodes(), matcher.ratio()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("a b c dd 5 10".split()), max_size=14), st.lists(st.sampled_from("a b c dd 5 10".split()), max_size=14))
def test_short_comparisons_are_difflibs(a, b):
    """Opcodes and ratios of words and of characters, also beyond the length from which difflib drops frequent elements; F10 to F23."""
    assert compare.opcodes_of(a, b) == _opcodes(a, b)
    assert compare.opcodes_of(a * 18, b * 18) == _opcodes(a * 18, b * 18)
    x, y = " ".join(a), " ".join(b)
    assert compare.ratio_of(x, y) == (difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0)
    assert compare._Context(x).ratio(compare._Context(y)) == difflib.SequenceMatcher(None, x, y).ratio()


def test_short_texts_need_no_matcher(monkeypatch):
    """Texts of clauses are compared without difflib's loops; F10 to F23."""
    old, new = "The bank shall pay INR 5 lakh within 30 days and file", "The bank must pay INR 15 lakh within 30 days"
    want = _opcodes(old.split(), new.split())
    monkeypatch.setattr(compare, "SequenceMatcher", None)
    got = compare.diff_of(old, new)
    assert [o["type"] for o in got["diff_ops"]] == [o[0] for o in want[0]] and got["similarity_ratio"] == want[1]
    assert [(m["old_value"], m["new_value"]) for m in compare.number_matches_of(old, new)] == [("INR 5 lakh", "INR 15 lakh"), ("5 lakh", "15 lakh")]


_PIECES = ["1", "25", "1,000", "2.5", ".", ",", " ", "  ", "\n", "\x1f", "INR", "rs.", "Rupees", "lakh", "Crores", "percent", "per  cent", "%", "p.c.", "within", "Within ", "days", "month", "hours", "working", "calendar", "period of ", "x", "_"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=12).map("".join))
def test_plain_patterns_find_the_same_numbers(text):
    for kind, patterns in (("monetary", lexicon.MONEY), ("percentage", lexicon.PERCENT), ("duration", lexicon.DURATION)):
        got = [(x["at"], x["text"], x["unit"]) for x in compare._found(text, patterns, kind)]
        want = [(m.span(), m[0].strip(), {"percentage": lambda m: "%", "monetary": lambda m: m[2] or "INR", "duration": lambda m: m[2].lower().rstrip("s")}[kind](m)) for p in patterns for m in re.finditer(p, text, re.IGNORECASE)]
        assert got == want, text


def test_groups_have_a_part_of_their_own():
    """No keyword group matches an ASCII text without one of the parts that are looked for first; F10 to F23."""
    for pattern, parts in scores._PARTS.items():
        body = pattern.replace(r"\b", "").replace(r"\d+", "7").replace(r"\w+", "ab").replace(r"\s*", " ").replace('[^"]+', "q")
        options = [body]
        while any("(?:" in x for x in options):
            options = [x[: m.start()] + o + x[m.end() :] for x in options for m in [re.search(r"\(\?:([^()]*)\)", x)] for o in (m[1].split("|") if m else [])]
        texts = {re.sub(r"\\?\.", ".", re.sub(r"(\w|\.)\?", keep, x)) for x in options for keep in (r"\1", "")}
        hits = [t for t in texts if t.isascii() and re.search(pattern, t, re.IGNORECASE)]
        assert len(hits) >= sum(x.isascii() for x in options) and all(any(p in t.lower() for p in parts) for t in hits), (pattern, texts)


def test_ascii_and_other_texts_have_the_same_results(spark):
    """Dates, terms, conditions and editorial changes of ASCII texts, which need no Unicode rules, and of the same with one other letter."""
    texts = ["", "by 26 March 2014 or March 5, 2015", "12.05.2020 and 2020-01-31", "may 5 2020 maybe", "Shall  not, must not_permitted; CAN", "shall not permitted", "PROVIDED  that, Subject\nto", "subject_to in case of", "rule 15", "rule 51", "Rule, 15", "rule1 5", "not 5"]
    rows = [(a, b, a + " \u00e9", b + " \u00e9") for a in texts for b in texts if a != b]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string").withColumns({"x": compare.word_diff("a", "b"), "y": compare.word_diff("c", "d")})
    two = lambda f: F.struct(f(F.col("a"), F.col("b"), F.col("x")).alias("v")) == F.struct(f(F.col("c"), F.col("d"), F.col("y")).alias("v"))
    dates, terms = (lambda a, b, x: extract.dates(a)), (lambda a, b, x: extract.obligation_change(a, b))
    flat = lambda t: F.regexp_replace(t, r"(?U)[^\w\s]", "")
    same = lambda a, b: (F.lower(a) == F.lower(b)) | (T.strip(F.regexp_replace(a, r"(?U)\s+", " ")) == T.strip(F.regexp_replace(b, r"(?U)\s+", " "))) | (flat(a) == flat(b))
    got = df.select("a", "b", two(dates).alias("dates"), two(terms).alias("terms"), (compare._other_letters(F.col("a"), F.col("b"), F.col("x")) & same(F.col("a"), F.col("b"))).alias("wrong"), compare._other_letters(F.col("a"), F.col("b"), F.col("x")).alias("other")).collect()
    assert all(r.dates and r.terms and not r.wrong for r in got), [r for r in got if not (r.dates and r.terms) or r.wrong]
    assert any(r.other for r in got)
