"""Change type, category, impact and confidence, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright import lexicon
from clausewright.functions.text import is_plain, once


def category_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in lexicon.CATEGORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def _hit(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?iU)" + pattern)


#: By keyword group: parts of words of which an ASCII text in lower case must have one for the group to match.  A part costs far less to look for.
_PARTS = dict(zip(
    [g for groups in lexicon.CATEGORY_GROUPS.values() for g in groups],
    (
        ("rs", "inr", "crore", "lakh", "percent", "%"), ("threshold", "limit", "ceiling", "floor", "cap"),
        ("within", "deadline", " date", "commence"), ("day", "month", "year", "week"), ("period", "time"),
        ("ligib", "qualif"), ("entitle", "disqualif"), ("compl", "adherence"), ("obligation", "binding", "compulsory"),
        ("report", "return", "statement", "submi", "furnish"), ("fiu", "str", "ctr", "suspicious"),
        ("document", "record", "certificate", "proof", "evidence"), ("maintain", "retention", "preserve", "keep"),
        ("penal", "fine", "sanction", "action", "punish", "revoke", "cancel"), ("suspension", "restriction", "debarment", "prohibition"),
        ("scope", "applicab", "coverage", "extend", "expand"), ("clude", "exempt", "apply"),
        ("mean", "defin", "include", "refer"), ('"',), ("exce", "exempt", "waiver", "relaxation"), ("provided", "notwithstanding", "unless"),
        ("proce", "method", "mechanism", "manner", "mode"), ("step", "stage", "workflow", "verification", "validation"),
        ("circular", "direction", "notification", "regulation", "act", "rule", "section"), ("refer", "pursuant", "accordance", "vide"), ("rbi/",),
    ),
    strict=True,
))


def _plain_hit(low: Column, pattern: str) -> Column:
    """As _hit of an ASCII text, whose lower case is ``low``."""
    has = F.lit(False)
    for part in _PARTS[pattern]:
        has = has | low.contains(part)
    return has & low.rlike(pattern.lower())


def _category_scores(changed, full) -> Column:
    """array<struct<score,order,code>>: 2 for a group that ``changed`` hits, 1 for one that ``full`` hits."""
    out = []
    for k, (code, groups) in enumerate(lexicon.CATEGORY_GROUPS.items()):
        score = F.lit(0)
        for g in groups:
            score = score + F.when(changed(g), 2).otherwise(0) + F.when(full(g), 1).otherwise(0)
        out.append(F.struct(score.alias("score"), F.lit(-k).alias("order"), F.lit(code).alias("code")))
    return F.array(*out)


def category_scores(changed: Column, full: Column) -> Column:
    """array<struct<score,order,code>>: 2 for a group in the changed words, 1 for one in the full text."""
    return _category_scores(lambda g: _hit(changed, g), lambda g: _hit(full, g))


def keyword_category(changed: Column, full: Column) -> Column:
    """The category with the most hits, the first declared among equals; C03 without a hit."""
    texts = F.struct(*[F.coalesce(t, F.lit("")).alias(n) for t, n in ((changed, "c"), (full, "f"))], *[F.lower(F.coalesce(t, F.lit(""))).alias(n) for t, n in ((changed, "lc"), (full, "lf"))])
    plain = lambda x: _category_scores(lambda g: _plain_hit(x["lc"], g), lambda g: _plain_hit(x["lf"], g))
    best = once(texts, lambda x: F.array_max(F.when(is_plain(x["c"], x["f"]), plain(x)).otherwise(category_scores(x["c"], x["f"]))))
    return once(best, lambda b: F.when(b["score"] > 0, b["code"]).otherwise("C03"))


def pair_category(is_definition: Column, numbers: Column, direction: Column, changed: Column, full: Column) -> Column:
    """The category of a changed pair: definition, first number that isn't a date, obligation, keywords."""
    first = F.get(F.filter(numbers, lambda n: n["field"] != "date"), F.lit(0))["field"]
    return (
        F.when(is_definition, "C12")
        .when(first.isin("monetary", "percentage"), "C04")
        .when(first == "duration", "C05")
        .when(direction.isin("STRENGTHENED", "RELAXED"), "C07")
        .otherwise(keyword_category(changed, full))
    )


def added_category(text: Column, is_definition: Column) -> Column:
    """The first category with two groups in the text, else C12 for definitions, else C01."""

    def first(hit) -> Column:
        out = F.lit(None).cast("string")
        for code, groups in reversed(lexicon.CATEGORY_GROUPS.items()):
            hits = sum((F.when(hit(g), 1).otherwise(0) for g in groups), F.lit(0))
            out = F.when(hits >= 2, code).otherwise(out)
        return out

    some = lambda low: F.when(is_plain(low), first(lambda g: _plain_hit(low, g))).otherwise(first(lambda g: _hit(low, g)))
    return F.coalesce(once(F.lower(F.coalesce(text, F.lit(""))), some), F.when(is_definition, "C12").otherwise("C01"))


def change_type(old_section: Column, new_section: Column, ratio: Column, substantive: Column) -> Column:
    moved = (old_section != "") & (new_section != "") & (old_section != new_section) & (ratio > 0.9)
    return F.when(moved, "RELOCATED").when((ratio > 0.8) & ~substantive, "REWORDED").otherwise("MODIFIED")


def impact_score(category: Column, direction: Column, numbers: Column, kind: Column) -> Column:
    base = F.create_map(*[F.lit(x) for pair in lexicon.BASE_IMPACT.items() for x in pair])
    by_number = F.aggregate(
        numbers,
        F.lit(0),
        lambda acc, n: acc
        + F.when(n["magnitude_percent"] >= 100, 2).when(n["magnitude_percent"] >= 50, 1).otherwise(0)
        + F.when((n["field"] == "duration") & (n["direction"] == "DECREASE"), 1).otherwise(0),
    )
    return (
        F.coalesce(F.try_element_at(base, category), F.lit(1))
        + F.when(direction.isin("STRENGTHENED", "INTRODUCED"), 2).when(direction == "RELAXED", 1).otherwise(0)
        + F.coalesce(by_number, F.lit(0))
        + F.when(kind.isin("ADDED", "REMOVED"), 1).otherwise(0)
    )


def impact(substantive: Column, score: Column) -> Column:
    return F.when(~substantive, "INFORMATIONAL").when(score >= 6, "CRITICAL").when(score >= 4, "HIGH").when(score >= 3, "MEDIUM").when(score >= 1, "LOW").otherwise("INFORMATIONAL")


def impact_rank(level: Column) -> Column:
    out = F.lit(4)
    for k, name in enumerate(lexicon.IMPACTS[:4]):
        out = F.when(level == name, k).otherwise(out)
    return out


def confidence(kind: Column, structural: Column, lexical: Column, semantic: Column, numerical: Column, evidence: Column) -> Column:
    """Overall confidence of a change from its five signals."""
    total = 0.20 * structural + 0.25 * lexical + 0.25 * semantic + 0.15 * numerical + 0.15 * evidence
    high = sum(((x > 0.7).cast("int") for x in (structural, lexical, semantic)), F.lit(0))
    total = F.when(high >= 2, F.least(F.lit(1.0), total + 0.05)).otherwise(total)
    total = F.when((structural < 0.2) & (semantic < 0.3), total * 0.8).otherwise(total)
    return F.when(kind.isin("ADDED", "REMOVED"), F.greatest(F.lit(0.85), evidence)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def confidence_band(overall: Column) -> Column:
    percent = F.bround(overall * 100)
    return F.when(percent >= 80, "high").when(percent >= 50, "medium").otherwise("low")


def needs_review(overall: Column, level: Column) -> Column:
    return (overall < 0.80) | level.isin("CRITICAL", "HIGH")


def number_text(numbers: Column, titled: bool = True) -> Column:
    """'Field: old -> new (DIRECTION, n%)' for every number change, joined by semicolons."""

    def one(n: Column) -> Column:
        name = F.initcap(n["field"]) if titled else n["field"]
        size = F.when(F.coalesce(n["magnitude_percent"], F.lit(0.0)) != 0, F.concat(F.lit(", "), F.bround(n["magnitude_percent"]).cast("bigint").cast("string"), F.lit("%"))).otherwise("")
        return F.concat(name, F.lit(": "), n["old_value"], F.lit(" -> "), n["new_value"], F.lit(" ("), n["direction"], size, F.lit(")"))

    return F.array_join(F.transform(numbers, one), "; ")


def moved(old_place: Column, new_place: Column) -> Column:
    """Where a changed pair stood and stands; null if that is the same."""
    return F.when(old_place != new_place, F.concat(F.lit("Section "), old_place, F.lit(" -> "), new_place, F.lit(".")))


def told(category: Column, numbers: Column, direction: Column, explanation: Column, ratio: Column) -> Column:
    """Readable sentences about the texts of a changed pair."""

    def one(n: Column) -> Column:
        size = F.when(F.coalesce(n["magnitude_percent"], F.lit(0.0)) != 0, F.concat(F.lit(", "), F.bround(n["magnitude_percent"]).cast("bigint").cast("string"), F.lit("%"))).otherwise("")
        return F.concat(F.initcap(n["field"]), F.lit(" changed: "), n["old_value"], F.lit(" -> "), n["new_value"], F.lit(" ("), n["direction"], size, F.lit(")"))

    return F.concat_ws(
        " ",
        F.concat(F.lit("Category: "), category_name(category), F.lit(".")),
        F.when(F.size(numbers) > 0, F.array_join(F.transform(numbers, one), " ")),
        F.when(direction != "UNCHANGED", explanation),
        F.when(ratio < 0.5, F.lit("Significant textual changes detected.")).when(ratio < 0.8, F.lit("Moderate textual changes detected.")),
    )
