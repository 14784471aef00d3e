"""Text normalisation and measures, as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright import lexicon


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition; no built-in function has it."""
    return F.pandas_udf(_nfc, "string")(text)


#: What Java calls white space: what \\s matches with (?U).
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(t: Column) -> Column:
    """Without white space of any kind at both ends; trim() only takes spaces."""
    return F.btrim(t, F.lit(_WHITE))


def once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, in an expression whose generated code stays small."""
    return F.transform(F.array(value), f)[0]


def is_plain(*texts: Column) -> Column:
    """Whether texts are ASCII, so that patterns need no Unicode rules, which cost more than all the rest of a match."""
    out = F.lit(True)
    for t in texts:
        out = out & (F.octet_length(F.coalesce(t, F.lit(""))) == F.length(F.coalesce(t, F.lit(""))))
    return out


def fix_artifacts(t: Column) -> Column:
    kept = {k: v for k, v in lexicon.ARTIFACTS.items() if v}
    gone = "".join(k for k, v in lexicon.ARTIFACTS.items() if not v)
    return F.translate(t, "".join(kept) + gone, "".join(kept.values()))


def fix_spaces(t: Column) -> Column:
    """Runs of white space become a space, three line feeds or more two, lines lose trailing spaces."""
    t = F.regexp_replace(t, r"(?U)[^\S\n]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?md) +$", "")


def dehyphenate(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def drop_furniture(t: Column) -> Column:
    """Without lines that are page numbers, 'Page x of y' or '- n -'."""
    pattern = "(?iU)" + "|".join(lexicon.FURNITURE)
    return F.array_join(F.filter(F.split(t, "\n"), lambda line: ~line.rlike(pattern)), "\n")


def _is_even(t: Column) -> Column:
    """Whether a text is ASCII and its only white space are single spaces, so that no rule for spaces, lines or odd characters applies."""
    out = is_plain(t)
    for x in ("  ", "\n", "\t", "\r", "\f", "\x0b"):
        out = out & ~t.contains(x)
    return out


def normalize(text: Column, compose: bool = True) -> Column:
    """Empty for null.  ``compose=False`` leaves out NFC, the one step that needs Python, for text known to be composed."""
    t = F.coalesce(text, F.lit(""))
    if compose:
        t = nfc(t)
    begins = F.substring(t, 1, 1).isin(*" 0123456789pP-")  # as all furniture does
    even = F.when(begins & t.rlike("(?iU)" + "|".join(lexicon.FURNITURE)), F.lit("")).otherwise(t)
    return strip(F.when(_is_even(t), even).otherwise(drop_furniture(dehyphenate(fix_spaces(fix_artifacts(t))))))


def normalize_for_comparison(text: Column, compose: bool = True) -> Column:
    return for_comparison(normalize(text, compose))


def for_comparison(t: Column) -> Column:
    """As normalize_for_comparison, of a text that is normalised already."""
    for old, new in lexicon.CURRENCIES.items():
        t = F.replace(t, F.lit(old), F.lit(new))
    return once(t, lambda x: strip(F.lower(F.when(_is_even(x), x).otherwise(F.regexp_replace(x, r"(?U)\s+", " ")))))


def sentences(text: Column) -> Column:
    """Sentences, cut after . ! ? before a capital or bracket, but not after known abbreviations."""
    t = F.coalesce(text, F.lit(""))
    for words in lexicon.ABBREVIATIONS:
        t = F.regexp_replace(t, rf"(?iU)\b({words})\.", "$1<DOT>")
    parts = F.split(t, r"(?U)(?<=[.!?])\s+(?=[A-Z(])")
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit("<DOT>"), F.lit(".")))), lambda s: s != "")


def is_substantive_text(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return (F.length(t) >= 10) & ~t.rlike(r"(?U)^[\d\s.,-]+$")


def quality(text: Column) -> Column:
    """Share of letters, numbers and plain punctuation, less half the share of odd characters, in [0, 1]; 0 if blank."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    good = n - F.length(F.regexp_replace(t, r"[\p{L}\p{N} .,;:()/\-\n\t]", ""))
    odd = F.length(F.regexp_replace(t, r"[\x00-\x7Fऀ-ॿ₹]", ""))
    score = good / n - 0.5 * odd / n
    return F.when(strip(t) == "", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(\S+)"), F.lit(1))


def table_text(rows: Column) -> Column:
    """Cells joined by bars, rows by line feeds."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "")), "\n")


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
