"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once for each document and stores the measurements and one bit per failed rule.
``apply_policy`` turns a ledger into verdicts under a named version of a policy, which is a mask of the rules that
count, and ``ablation`` finds what each rule alone removes, from bitwise aggregates over the ledger; neither
reads a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bit of each rule; bits are never given a new meaning.
RULES = {"few_words": 0, "repeated_windows": 1, "symbols": 2, "duplicate_lines": 3, "short_words": 4, "long_words": 5}

#: Masks of the rules that a version counts.
POLICIES = {
    "base": 0b000011,
    "v1": 0b001111,
    "v2": 0b111111,
}

_SPACE = "[\\x20\\x09-\\x0D]"


def _repeated(hashes: Column, window: int) -> Column:
    """Words in windows whose hash is found twice or more: sorted windows, those equal to a neighbour, and their union."""
    n = F.size(hashes)
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: a["h"] == b["h"])
        flags = F.transform(same, lambda x: F.coalesce(x, F.lit(False)))
        twice = F.zip_with(s, F.concat(F.array(F.lit(False)), F.slice(flags, 1, F.greatest(F.size(flags) - 1, F.lit(0)))), lambda x, before: F.struct(x["i"].alias("i"), before.alias("f")))
        both = F.zip_with(twice, flags, lambda x, f: F.when(x["f"] | f, x["i"]))
        return F.array_sort(F.filter(both, lambda x: x.isNotNull()))

    def union(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    with_places = F.transform(F.array(ranked), places)
    some = F.size(F.array_distinct(hashes)) < n
    return F.when(some, F.transform(with_places, union)[0]).otherwise(F.lit(0).cast("bigint"))


def _window_hashes(words: Column) -> Column:
    """Hashes of all 8-word windows, by doubling: of one word, of two, of four, of eight."""

    def paired(step: int):
        return lambda a: F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    h = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        h = F.transform(F.array(h), paired(step))[0]
    return F.transform(F.array(h), lambda a: F.slice(a, 1, F.greatest(F.size(a) - 7, F.lit(0))))[0]


def ledger(documents: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Per document: ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed (bits).

    Words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none and fail few_words.  Whole texts are measured where
    they are, equal rows alike; nothing is shuffled, and extra columns never get into the plan.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = documents.select(*[c.alias(n) for n, c in keep.items()], t.alias("_t"))
    df = df.withColumn("_w", F.filter(F.split("_t", _SPACE + "+"), lambda w: w != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.select(
        *keep,
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("bigint").alias("n_dup_lines"),
        F.transform(F.array(_window_hashes(F.col("_w"))), lambda h: _repeated(h, 8))[0].alias("n_repeat_words"),
        (F.length("_t") - F.length(F.translate("_t", "\n", "")) + 1).cast("bigint").alias("n_lines"),
    )
    w, c = F.col("n_words"), F.col("word_chars")
    fails = {
        "few_words": w < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * w,
        "symbols": 100 * F.col("n_symbols") > 5 * c,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "short_words": c < 2 * w,
        "long_words": c > 15 * w,
    }
    bits = sum((F.when(x, F.lit(1 << RULES[name])).otherwise(F.lit(0)) for name, x in fails.items()), F.lit(0))
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", bits.cast("bigint").alias("failed"))


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """A ledger with base_failed and kept under the policy; the base rules always count."""
    base, mask = POLICIES["base"], POLICIES[policy] | POLICIES["base"]
    return rows.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(base)) != 0).withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask)) == 0)


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: rule, bit, failed (documents), alone (those that only this rule removes).

    Documents are counted by their masks first, at most 2^rules of them, so an aggregate of any ledger stays small.
    An empty ledger gives zeros.
    """
    mask = POLICIES[policy]
    masks = rows.select(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).groupBy("m").count()
    used = [(n, b) for n, b in RULES.items() if mask >> b & 1]
    sums = masks.agg(*[F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(F.lit(1 << b)) != 0, F.col("count"))), F.lit(0)).alias(f"f{b}") for _, b in used], *[F.coalesce(F.sum(F.when(F.col("m") == (1 << b), F.col("count"))), F.lit(0)).alias(f"a{b}") for _, b in used])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit"), F.col(f"f{b}").alias("failed"), F.col(f"a{b}").alias("alone")) for n, b in used])))
