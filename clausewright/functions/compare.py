"""Comparison of two texts by difflib, in Arrow batches: the only place where ratios must equal Python's own."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright import lexicon
from clausewright.functions import extract as E
from clausewright.functions.text import is_plain, strip

DIFF = "struct<has_changes:boolean,added_words:array<string>,removed_words:array<string>,modified_segments:array<struct<old:string,new:string,type:string>>,similarity_ratio:double,change_density:double,diff_ops:array<struct<type:string,old_text:string,new_text:string>>>"
MATCHES = "array<struct<field:string,old_value:string,new_value:string,old_numeric:double,new_numeric:double,unit:string>>"
NUMBERS = "array<struct<field:string,old_value:string,new_value:string,old_numeric:double,new_numeric:double,unit:string,direction:string,magnitude_percent:double>>"


#: From this length of the second text on, difflib leaves frequent elements out.
_POPULAR = 200


def blocks_of(a: str, b: str) -> list[tuple[int, int, int]]:
    """difflib's matching blocks (i, j, length) in order, adjacent ones not joined, for ``b`` of less than 200 characters.

    The longest common part, the first in ``a`` and then in ``b`` among equals, and the same on both sides of it; each is found by
    substring tests, which cost a small part of a loop over places.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        at, to, size = _longest(a[i:m], b[j:n])
        if size:
            p, q = i + at, j + to
            out.append((p, q, size))
            if i < p and j < q:
                todo.append((i, p, j, q))
            if p + size < m and q + size < n:
                todo.append((p + size, m, q + size, n))
    out.sort()
    return out


def _longest(x: str, y: str) -> tuple[int, int, int]:
    """Where the longest common part begins in ``x`` and in ``y``, the first among equals, and its length.

    A place in ``x`` counts only if a longer part than the best one begins there; where the end of such a part isn't in ``y``, no part
    that has it need be tried.
    """
    at, size, k, n = 0, 0, 0, len(x)
    while (end := k + size + 1) <= n:
        if size > 6 and x[end - (size >> 1) : end] not in y:
            k = end - (size >> 1) + 1
        elif x[k:end] in y:
            at = k
            size += 1
        else:
            k += 1
    return at, y.find(x[at : at + size]), size


def _matched(x: str, y: str) -> int:
    """How many characters matching blocks have."""
    at, to, size = _longest(x, y)
    return size + _between(x[:at], y[:to]) + _between(x[at + size :], y[to + size :]) if size else 0


#: Parts of texts up to this length in all are looked up, as words and phrases between common parts repeat.
_PHRASE = 60
_phrase = lru_cache(1 << 16)(_matched)


def _between(x: str, y: str) -> int:
    if not x or not y:
        return 0
    if x == y:
        return len(x)
    return (_phrase if len(x) + len(y) <= _PHRASE else _matched)(x, y)


def _ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio()."""
    if len(b) >= _POPULAR or not (a or b):
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _between(a, b) / (len(a) + len(b))


def ratio_from(a: str | None, b: str | None, least: float, enough: float = 2.0) -> float:
    """ratio_of where it is ``least`` or more, else some value below ``least``; or any value above ``enough`` that it reaches.

    The search ends as soon as the parts that are left can't change that.
    """
    if not a or not b:
        return 0.0
    if a == b or len(b) >= _POPULAR:
        return ratio_of(a, b)
    total = len(a) + len(b)
    todo, sure, left = [(a, b)], 0, min(len(a), len(b))
    while todo and 2.0 * (sure + left) / total >= least and 2.0 * sure / total <= enough:
        x, y = todo.pop()
        left -= min(len(x), len(y))
        at, to, size = _longest(x, y)
        sure += size
        if size:
            for p, q in ((x[:at], y[:to]), (x[at + size :], y[to + size :])):
                if p and q:
                    todo.append((p, q))
                    left += min(len(p), len(q))
    return 2.0 * (sure + left) / total if 2.0 * (sure + left) / total < least else 2.0 * sure / total


def opcodes_of(a: list[str], b: list[str]) -> tuple[list[tuple[str, int, int, int, int]], float]:
    """SequenceMatcher's opcodes and ratio of two lists of words; short ones are compared as texts of a character a word."""
    if len(b) >= _POPULAR or len(a) > 50 * _POPULAR or not (a or b):
        matcher = SequenceMatcher(None, a, b)
        return matcher.get_opcodes(), matcher.ratio()
    ids: dict[str, str] = {}
    x, y = ("".join([ids.setdefault(w, chr(len(ids))) for w in words]) for words in (a, b))
    blocks = blocks_of(x, y)
    out, i, j = [], 0, 0
    for p, q, n in [*blocks, (len(a), len(b), 0)]:
        if i < p or j < q:
            out.append(("replace" if i < p and j < q else "delete" if i < p else "insert", i, p, j, q))
        if n and out and out[-1][0] == "equal" and i == p and j == q:
            out[-1] = ("equal", out[-1][1], p + n, out[-1][3], q + n)
        elif n:
            out.append(("equal", p, p + n, q, q + n))
        i, j = p + n, q + n
    return out, 2.0 * sum(n for _, _, n in blocks) / (len(a) + len(b))


def ratio_of(a: str | None, b: str | None) -> float:
    """Twice the characters that matching blocks have, over all; 0 if either text is empty."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else _ratio(a, b)


def ratio_bound(a: str | None, b: str | None) -> float:
    """At least ratio_of: by the characters that both texts have, wherever they stand."""
    if not a or not b:
        return 0.0
    if 2 * min(len(a), len(b)) / (len(a) + len(b)) < 0.3:
        return 2 * min(len(a), len(b)) / (len(a) + len(b))
    return 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))


def _udf(schema: str, kind=F.pandas_udf, costly: bool = False):
    """A pandas or Arrow UDF made when it is first used, as schemas in words need a session.

    A costly one is said to be not deterministic, so that a filter on its result isn't pushed below it, where it would run once more.
    """

    def wrap(f):
        made: list = []

        def call(*columns):
            if not made:
                made.append(kind(f, schema).asNondeterministic() if costly else kind(f, schema))
            return made[0](*columns)

        call.__doc__, call.__name__ = f.__doc__, f.__name__
        return call

    return wrap


@_udf("double", costly=True)
def text_ratio(old: pd.Series, new: pd.Series) -> pd.Series:
    """Character similarity, 0 if either text is empty."""
    return pd.Series([ratio_of(a, b) for a, b in zip(old, new, strict=True)], dtype="float64")


def diff_of(old: str | None, new: str | None) -> dict:
    """Word operations between two texts with what they add, remove and replace."""
    old, new = old or "", new or ""
    out = {"has_changes": old != new, "added_words": [], "removed_words": [], "modified_segments": [], "similarity_ratio": 1.0 if old and old == new else 0.0, "change_density": 0.0, "diff_ops": []}
    if old == new:
        return out
    a, b = old.split(), new.split()
    changed = 0
    opcodes, out["similarity_ratio"] = opcodes_of(a, b)
    for kind, i, j, k, m in opcodes:
        before, after = " ".join(a[i:j]), " ".join(b[k:m])
        out["diff_ops"].append({"type": kind, "old_text": before, "new_text": after})
        if kind == "insert":
            out["added_words"] += b[k:m]
        elif kind == "delete":
            out["removed_words"] += a[i:j]
        elif kind == "replace":
            out["modified_segments"].append({"old": before, "new": after, "type": kind})
        if kind != "equal":
            changed += max(j - i, m - k)
    out["change_density"] = changed / max(len(a), len(b), 1)
    return out


@_udf(DIFF)
def word_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    rows = [diff_of(a, b) for a, b in zip(old, new, strict=True)]
    return pd.DataFrame(rows, columns=["has_changes", "added_words", "removed_words", "modified_segments", "similarity_ratio", "change_density", "diff_ops"])


#: Patterns of numbers, and words of which an ASCII text must have one for a pattern to match.
_NEEDED = dict(zip(
    (*lexicon.MONEY, *lexicon.PERCENT, *lexicon.DURATION),
    (("rs", "inr", "rupees"), ("crore", "lakh"), ("cent", "%"), ("p.c.",), ("day", "month", "year", "week", "hour"), ("calendar", "working", "business"), ("period",)),
    strict=True,
))
_COMPILED = {p: re.compile(p, re.IGNORECASE) for p in _NEEDED}


def _plain(pattern: str) -> re.Pattern:
    """A pattern of numbers for ASCII texts in lower case, which finds the same faster: it ignores no case, and takes runs of digits and spaces whole.

    No part after such a run can begin with what the run has, so none is given back; and a number begins with the first digit of its run.
    """
    out = pattern.lower().replace("₹|", "")
    if out.startswith(r"(\d+"):
        out = out.replace(r"(\d+", r"(\d(?<!\d\d)\d*+", 1)
    return re.compile(out.replace(r"\d+)", r"\d++)").replace(r"\s*", r"\s*+").replace(r"\s+", r"\s++"))


#: Patterns that may begin with "within" are found by the rest.
_HEAD = r"(?:within\s+)?"
_PLAIN = {p: _plain(p.removeprefix(_HEAD)) for p in _NEEDED}


def _spans(pattern: str, low: str) -> Iterator[tuple[re.Match, int]]:
    """Matches of a pattern in an ASCII text in lower case, and where each begins."""
    for m in _PLAIN[pattern].finditer(low):
        start = m.start()
        if pattern.startswith(_HEAD):
            k = start
            while k and low[k - 1].isspace():
                k -= 1
            if k < start and low.endswith("within", 0, k):
                start = k - 6
        yield m, start


def _found(text: str, patterns: list[str], kind: str, low: str | None = None) -> list[dict]:
    """Numbers of a text; ``low`` is its lower case, for ASCII texts."""
    out = []
    if low is None and text.isascii():
        low = text.lower()
    for pattern in patterns:
        if low is not None and not any([w in low for w in _NEEDED[pattern]]):
            continue
        for m, start in _spans(pattern, low) if low is not None else ((m, m.start()) for m in _COMPILED[pattern].finditer(text)):
            value, unit = float(m[1].replace(",", "")), "%"
            if kind == "monetary":
                unit = text[m.start(2) : m.end(2)] if m[2] else "INR"
                value *= lexicon.MULTIPLIERS.get((m[2] or "").lower(), 1)
            elif kind == "duration":
                unit = m[2].lower().rstrip("s")
            out.append({"text": text[start : m.end()].strip(), "value": value, "unit": unit, "at": (start, m.end())})
    return out


def _near(text: str, x: dict) -> _Context:
    """The words around a number of ``text``."""
    return _Context(text[max(0, x["at"][0] - 30) : x["at"][1] + 30].lower())


class _Context:
    """The words around a number, prepared for many comparisons."""

    def __init__(self, text: str):
        self.text = text
        self.letters: Counter | None = None
        self.matcher: SequenceMatcher | None = None

    def bound(self, other: _Context) -> float:
        """At least the ratio of ``self`` to ``other``."""
        for x in (self, other):
            if x.letters is None:
                x.letters = Counter(x.text)
        total = len(self.text) + len(other.text)
        return 2 * sum([min(n, other.letters[c]) for c, n in self.letters.items()]) / total if total else 1.0

    def ratio(self, other: _Context) -> float:
        """The ratio of ``self`` to ``other``; a longer text's index of places is made once."""
        if len(other.text) < _POPULAR:
            return _ratio(self.text, other.text)
        if other.matcher is None:
            other.matcher = SequenceMatcher(None, "", other.text)
        other.matcher.set_seq1(self.text)
        return other.matcher.ratio()


def closest(x: _Context, others: list[tuple[int, _Context]], least: float = 0.3) -> int | None:
    """The number of the one whose ratio to ``x`` is largest, the first among equals; None if no ratio is above ``least``.

    Those come first whose letters could give the largest ratio, and the search ends when the others' can't.  The only one left just has to
    be above ``least``, which a few common parts may show.
    """
    if len(others) == 1:
        j, y = others[0]
        if len(y.text) < _POPULAR and x.text and y.text:
            return j if ratio_from(x.text, y.text, least, least) > least else None
        return j if x.bound(y) > least and x.ratio(y) > least else None
    bounds = sorted((-x.bound(y), j, y) for j, y in others)
    best, at = least, None
    for bound, j, y in bounds:
        if -bound < best or (at is None and -bound <= best) or (-bound == best and at is not None and j > at):
            break
        ratio = x.ratio(y)
        if ratio > best or (ratio == best and at is not None and j < at):
            best, at = ratio, j
    return at


def number_matches_of(old: str | None, new: str | None) -> list[dict]:
    """Amounts, percentages and durations of equal unit and most similar context whose values differ.

    A number only meets those of its unit, so where all of a unit have one value in both texts no contexts are compared.
    """
    out = []
    old, new = old or "", new or ""
    lows = [t.lower() if t.isascii() else None for t in (old, new)]
    for kind, patterns in (("monetary", lexicon.MONEY), ("percentage", lexicon.PERCENT), ("duration", lexicon.DURATION)):
        before = _found(old, patterns, kind, lows[0])
        after = _found(new, patterns, kind, lows[1]) if before else []
        values: dict[str, set[float]] = {}
        for x in (*before, *after):
            values.setdefault(x["unit"], set()).add(x["value"])
        free = {j: (y, _near(new, y)) for j, y in enumerate(after) if len(values[y["unit"]]) > 1}
        for x in before:
            others = [(j, c) for j, (y, c) in free.items() if y["unit"] == x["unit"]] if free else None
            at = closest(_near(old, x), others) if others else None
            if at is None:
                continue
            y, _ = free.pop(at)
            if x["value"] != y["value"]:
                out.append({"field": kind, "old_value": x["text"], "new_value": y["text"], "old_numeric": x["value"], "new_numeric": y["value"], "unit": x["unit"]})
    return out


@_udf(MATCHES)
def _number_matches(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([number_matches_of(a, b) for a, b in zip(old, new, strict=True)])


_WORDS = pa.list_(pa.string())
_STRUCTS = lambda kind, *names: pa.list_(pa.struct([(n, kind.get(n, pa.string())) for n in names]))
_ARROW = pa.struct([
    ("diff", pa.struct([
        ("has_changes", pa.bool_()), ("added_words", _WORDS), ("removed_words", _WORDS), ("modified_segments", _STRUCTS({}, "old", "new", "type")),
        ("similarity_ratio", pa.float64()), ("change_density", pa.float64()), ("diff_ops", _STRUCTS({}, "type", "old_text", "new_text")),
    ])),
    ("matches", _STRUCTS({"old_numeric": pa.float64(), "new_numeric": pa.float64()}, "field", "old_value", "new_value", "old_numeric", "new_numeric", "unit")),
])


@_udf(f"struct<diff:{DIFF},matches:{MATCHES}>", F.arrow_udf)
def compared(old: pa.Array, new: pa.Array) -> pa.Array:
    """The word diff and the matched numbers of two texts, in one pass."""
    return pa.array([{"diff": diff_of(a, b), "matches": number_matches_of(a, b)} for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True)], _ARROW)


def with_direction(matches: Column) -> Column:
    """Matched numbers with the way and the size of their change."""
    return F.transform(matches, lambda m: F.struct(*[m[c].alias(c) for c in ("field", "old_value", "new_value", "old_numeric", "new_numeric", "unit")], E.direction(m["old_numeric"], m["new_numeric"]).alias("direction"), E.magnitude(m["old_numeric"], m["new_numeric"]).alias("magnitude_percent")))


def number_changes(old, new) -> Column:
    """Numbers matched by unit and context whose values differ, with direction and magnitude."""
    return with_direction(_number_matches(old, new))


def _flat(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w\s]", "")


def _other_letters(old: Column, new: Column, diff: Column) -> Column:
    """Whether the changed words of ASCII texts differ in how often they have some letter or digit, so that no rule for editorial changes can hold."""
    ops = F.filter(diff["diff_ops"], lambda o: o["type"] != "equal")
    letters = lambda field: F.array_sort(F.split(F.lower(F.regexp_replace(F.array_join(F.transform(ops, lambda o: o[field]), ""), "[^A-Za-z0-9]", "")), ""))
    return is_plain(old, new) & (letters("old_text") != letters("new_text"))


def is_substantive(old: Column, new: Column, diff: Column) -> Column:
    """Whether a word diff changes more than wording; the first rule that applies decides."""
    old, new = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    squeeze = lambda t: strip(F.regexp_replace(t, r"(?U)\s+", " "))
    editorial = ~_other_letters(old, new, diff) & ((F.lower(old) == F.lower(new)) | (squeeze(old) == squeeze(new)) | (_flat(old) == _flat(new)))
    words = F.array(*map(F.lit, lexicon.INDICATORS))
    segments = diff["modified_segments"]
    touched = F.lower(F.concat_ws(" ", F.array_join(F.transform(segments, lambda s: F.concat_ws(" ", s["old"], s["new"])), " "), F.array_join(diff["added_words"], " "), F.array_join(diff["removed_words"], " ")))
    marked = F.exists(words, lambda w: touched.contains(w))
    figures = lambda t: F.regexp_extract_all(t, F.lit(r"(?U)(\d+(?:\.\d+)?)"), F.lit(1))

    def decisive(s: Column) -> Column:
        a, b = F.lower(s["old"]), F.lower(s["new"])
        return (a != b) & ((figures(a) != figures(b)) | F.exists(words, lambda w: a.contains(w) != b.contains(w)))

    many = (F.size(diff["added_words"]) > 10) | (F.size(diff["removed_words"]) > 10)
    return (
        F.when(editorial, False)
        .when((diff["change_density"] < 0.08) & ~marked, False)
        .when(F.exists(segments, decisive), True)
        .otherwise(many | (diff["change_density"] > 0.20) | (diff["similarity_ratio"] < 0.80))
    )


def html_diff(diff: Column) -> Column:
    """Struct (old_html, new_html) with removed and added spans; texts aren't escaped."""

    def side(field: str, css: str, skip: str) -> Column:
        ops = F.filter(diff["diff_ops"], lambda o: o["type"] != skip)
        return F.array_join(F.transform(ops, lambda o: F.when(o["type"] == "equal", o[field]).otherwise(F.concat(F.lit(f'<span class="{css}">'), o[field], F.lit("</span>")))), " ")

    return F.struct(side("old_text", "diff-removed", "insert").alias("old_html"), side("new_text", "diff-added", "delete").alias("new_html"))
