"""Amounts, percentages, durations, dates, limits and obligation language, as column functions without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright import lexicon
from clausewright.functions.text import is_plain, once, strip


def _all(text: Column, pattern: str, group: int, flags: str = "(?iU)") -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _values(text: Column, pattern: str, unit, factor=None) -> Column:
    """Structs (text, value, unit) of the pattern's matches; unit takes (match, last group)."""
    rows = F.arrays_zip(_all(text, pattern, 0).alias("m"), _all(text, pattern, 1).alias("n"), (_all(text, pattern, 2) if factor or unit is not None else _all(text, pattern, 1)).alias("u"))
    return F.transform(rows, lambda x: F.struct(strip(x["m"]).alias("text"), (_number(x["n"]) * (factor(x["u"]) if factor else F.lit(1.0))).alias("value"), unit(x["u"]).alias("unit")))


def _factor(unit: Column) -> Column:
    out = F.lit(1.0)
    for word, by in lexicon.MULTIPLIERS.items():
        out = F.when(F.lower(unit) == word, F.lit(by)).otherwise(out)
    return out


def money(text: Column) -> Column:
    """array<struct<text,value,unit>>: currency first, then crore and lakh amounts; one amount may be found by both."""
    unit = lambda u: F.when(F.coalesce(u, F.lit("")) == "", F.lit("INR")).otherwise(u)
    return F.concat(*[_values(text, p, unit, _factor) for p in lexicon.MONEY])


def percentages(text: Column) -> Column:
    def values(pattern: str) -> Column:
        rows = F.arrays_zip(_all(text, pattern, 0).alias("m"), _all(text, pattern, 1).alias("n"))
        return F.transform(rows, lambda x: F.struct(strip(x["m"]).alias("text"), _number(x["n"]).alias("value"), F.lit("%").alias("unit")))

    return F.concat(*map(values, lexicon.PERCENT))


def durations(text: Column) -> Column:
    return F.concat(*[_values(text, p, lambda u: F.regexp_replace(F.lower(u), "s+$", "")) for p in lexicon.DURATION])


#: What an ASCII text must have for each date pattern to match.
_DATE_SIGNS = [r"\d\s+[A-Za-z]+\s+\d{4}", r"[A-Za-z]\s+\d{1,2},?\s+\d{4}", r"\d[./]\d{4}", r"\d{4}-\d"]


def dates(text: Column) -> Column:
    """Date texts, by pattern and then by place; a pattern is tried on ASCII texts that have its figures."""
    some = lambda t: F.concat(*[F.when(t.rlike(sign), _all(t, p, 0, "(?i)")).otherwise(F.array().cast("array<string>")) for p, sign in zip(lexicon.DATES, _DATE_SIGNS, strict=True)])
    return once(text, lambda t: F.when(is_plain(t) & t.isNotNull(), some(t)).otherwise(F.transform(F.concat(*[_all(t, p, 0) for p in lexicon.DATES]), strip)))


def limits(text: Column) -> Column:
    return F.concat(*[_all(text, p, 1) for p in lexicon.LIMITS])


def numbers(text: Column) -> Column:
    return F.struct(money(text).alias("monetary"), percentages(text).alias("percentages"), durations(text).alias("durations"), dates(text).alias("dates"))


_CHANGE = "struct<field:string,old_value:string,new_value:string,old_numeric:double,new_numeric:double,unit:string,direction:string,magnitude_percent:double>"


def date_changes(old: Column, new: Column) -> Column:
    """Every old date with every other new date, if the lists differ at all."""
    a, b = dates(old), dates(new)

    def change(x: Column, y: Column) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(F.lit("date").alias("field"), x.alias("old_value"), y.alias("new_value"), none.alias("old_numeric"), none.alias("new_numeric"), F.lit("date").alias("unit"), F.lit("CHANGED").alias("direction"), none.alias("magnitude_percent"))

    rows = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: y != x), lambda y: change(x, y))))
    return F.when(a != b, rows).otherwise(F.array().cast(f"array<{_CHANGE}>"))


def magnitude(old: Column, new: Column) -> Column:
    """Percent of the old value; null if that is 0."""
    return F.abs((new - old) / F.nullif(old, F.lit(0.0)) * 100)


def direction(old: Column, new: Column) -> Column:
    return F.when(new > old, "INCREASE").when(new < old, "DECREASE")


#: Where a term begins, the longest one there; terms may overlap, so none is consumed.
_TERMS = r"(?=\b(" + "|".join(sorted(lexicon.OBLIGATIONS, key=lambda t: (-len(t), t))) + r")\b)"


def _by_text(text: Column, plain, other) -> Column:
    """``plain`` of the lower case of an ASCII text, ``other`` of any text; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return once(F.struct(t.alias("t"), F.lower(t).alias("low")), lambda x: F.when(is_plain(x["t"]), plain(x["low"])).otherwise(other(x["t"])))


def obligation_terms(text: Column) -> Column:
    """The terms that occur as words, each once, in the lexicon's order; a term is in a longer one that begins with it."""
    longer = {t: [x for x in lexicon.OBLIGATIONS if x == t or x.startswith(t + " ")] for t in lexicon.OBLIGATIONS}
    some = lambda f: F.array_compact(F.array(*[F.when(F.arrays_overlap(f, F.array(*map(F.lit, xs))), F.lit(t)) for t, xs in longer.items()]))
    plain = lambda low: F.array_compact(F.array(*[F.when(low.contains(t) & low.rlike(rf"\b{t}\b"), F.lit(t)) for t in lexicon.OBLIGATIONS]))
    return _by_text(text, plain, lambda t: once(F.transform(_all(t, _TERMS, 1), F.lower), some))


def strength(terms: Column) -> Column:
    levels = F.create_map(*[F.lit(x) for pair in lexicon.OBLIGATIONS.items() for x in pair])
    return F.coalesce(F.array_max(F.transform(terms, lambda t: F.try_element_at(levels, t))), F.lit(0))


def conditionals(text: Column) -> Column:
    spaced = [(p, p.split()[0], p.replace(" ", r"\s+")) for p in lexicon.CONDITIONALS]
    plain = lambda low: F.array_compact(F.array(*[F.when(low.contains(first) & low.rlike(x), F.lit(p)) for p, first, x in spaced]))
    return _by_text(text, plain, lambda t: F.array_compact(F.array(*[F.when(t.rlike("(?iU)" + x), F.lit(p)) for p, _, x in spaced])))


def obligation_change(old: Column, new: Column) -> Column:
    """Struct of terms, strengths, direction and explanation."""
    found = F.struct(obligation_terms(old).alias("a"), obligation_terms(new).alias("b"), conditionals(old).alias("c"), conditionals(new).alias("d"))
    same = lambda a: once(strength(a), lambda s: F.struct(a.alias("old_terms"), a.alias("new_terms"), s.alias("old_strength"), s.alias("new_strength"), F.lit("UNCHANGED").alias("direction"), F.lit("").alias("explanation")))
    return once(found, lambda x: F.when((x["a"] == x["b"]) & (x["c"] == x["d"]), same(x["a"])).otherwise(_obligation_change(x["a"], x["b"], x["c"], x["d"])))


def _obligation_change(a: Column, b: Column, before: Column, after: Column) -> Column:
    s, t = strength(a), strength(b)
    ja, jb = F.array_join(a, ", "), F.array_join(b, ", ")
    no_a, no_b = F.size(a) == 0, F.size(b) == 0
    way = F.when(no_a & ~no_b, "INTRODUCED").when(~no_a & no_b, "REMOVED").when(s < t, "STRENGTHENED").when(s > t, "RELAXED").otherwise("UNCHANGED")
    quoted = lambda head, tail="": F.concat(F.lit(head + " from '"), ja, F.lit("' to '"), jb, F.lit("'" + tail))
    told = (
        F.when(no_a & ~no_b, F.concat(F.lit("New obligation language introduced: "), jb))
        .when(~no_a & no_b, F.concat(F.lit("Obligation language removed: "), ja))
        .when(s < t, quoted("Obligation strengthened"))
        .when(s > t, quoted("Obligation relaxed"))
        .when(F.array_sort(a) != F.array_sort(b), quoted("Obligation language changed", " (same strength level)"))
        .otherwise("")
    )
    more, less = F.array_sort(F.array_except(after, before)), F.array_sort(F.array_except(before, after))
    told = F.concat(
        told,
        F.when(F.size(more) > 0, F.concat(F.lit(" New conditions added: "), F.array_join(more, ", "), F.lit("."))).otherwise(""),
        F.when(F.size(less) > 0, F.concat(F.lit(" Conditions removed: "), F.array_join(less, ", "), F.lit("."))).otherwise(""),
    )
    return F.struct(a.alias("old_terms"), b.alias("new_terms"), s.alias("old_strength"), t.alias("new_strength"), way.alias("direction"), told.alias("explanation"))


def negation_changed(old: Column, new: Column) -> Column:
    """Whether 'not' stands in one text only: a change that strengths alone can't tell."""
    has = lambda t: F.lower(F.coalesce(t, F.lit(""))).contains("not") & F.coalesce(t, F.lit("")).rlike(r"(?iU)\bnot\b")
    return has(old) != has(new)
