"""Secret scans in DataFrame functions only: fixed patterns, and sliding-window entropy of candidate strings.

Matches and the stretches between them give the places of all matches, in code points.  Candidates of the
entropy scan are long runs of token characters with letters and digits.  Each belongs to a character class with
its own alphabet and threshold; a window moves over it with a count for each character, and the sum of
count * log2(count) that entropy comes from changes only by the counts of the character that leaves and the one
that enters.  The counts are packed into a few integers, so a step costs the same at any length and a run of a
megabyte is read once.  A candidate whose highest window is over the threshold is a span, unless an allow-list
pattern fits it or it touches a fixed match.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed: the patterns of the base kinds, in their order.
ASSIGN = "(" + "|".join(map(_either_case, ["password", "passwd", "secret", "token", "api_?key"])) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
#: Runs that may be secrets: (class, pattern of the whole run, least bits in some window).
CLASSES = [("hex", "^[0-9A-Fa-f]+$", 3.2), ("token", "^[A-Za-z0-9+/_=-]+$", 3.85)]
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Runs that are no secrets: UUIDs, numbers with separators, slugs of words with numbers, paths of words.
ALLOW = [
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^[0-9+/_=-]+$",
    "^[A-Za-z]*+[0-9]*+([-_/=+]++([A-Za-z]?[0-9]+|[A-Za-z]*))++$",
]

_SPAN = "array<struct<start:int,kind:int,stop:int>>"


#: Matches whose places are summed up together; longer lists are walked in pieces of this length.
_PIECE = 256


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _places(text: Column, pattern: str, kind: int, passes) -> Column:
    """Spans of the non-overlapping matches that pass, in code points; ``passes`` gets the match and its last group.

    Places are sums of lengths: within pieces of the list of matches first, and then of the pieces.
    """
    group = 2 if kind == 0 else 0
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"), inner.alias("g"))
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(x["m"].isNotNull() & passes(x["m"], x["g"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def walk(piece: Column) -> Column:
        return F.aggregate(piece, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def shifted(piece: Column, by: Column) -> Column:
        return F.transform(piece, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["stop"] + by).alias("stop")))

    def join(acc: Column, piece: Column) -> Column:
        return F.struct((acc["at"] + piece["at"]).alias("at"), F.concat(acc["out"], F.array(shifted(piece["out"], acc["at"]))).alias("out"))

    def all_(rows: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.size(rows), F.lit(_PIECE))
        walked = F.transform(cuts, lambda at: walk(F.slice(rows, at, _PIECE)))
        return F.flatten(F.aggregate(walked, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), join, lambda acc: acc["out"]))

    return F.when(text.rlike(pattern), _once(rows, all_)).otherwise(none)


#: Characters of runs; each has a count of 5 bits in one of the integers, twelve in each.
_SIGNS = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "+/_=-"
_BITS, _EACH = 5, 12
_WORDS = -(-len(_SIGNS) // _EACH)
#: By count: what the last of so many equal characters adds to the sum of count * log2(count), in units of 2^-40, so that sums stay exact.
_ADDS = [0] + [round(2**40 * (n * math.log2(n) - (n - 1) * math.log2(n - 1 or 1))) for n in range(1, WINDOW + 1)]


_CODE = "struct<n:int,b:int," + ",".join(f"u{k}:bigint" for k in range(_WORDS)) + ">"


def _code(n: int) -> dict:
    """Where the count of the n-th sign is: its place in an integer, and by integer what one more adds; zeros for none."""
    at, k = (n % _EACH * _BITS, n // _EACH) if n >= 0 else (0, -1)
    return {"n": n, "b": at} | {f"u{i}": (1 << at) if i == k else 0 for i in range(_WORDS)}


def _constant(value, schema: str) -> Column:
    """A literal of many parts, which the optimizer folds into one."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _reaches(run: Column, bits: Column) -> Column:
    """Whether some window of ``run``, which has WINDOW characters or more, has an entropy of ``bits`` or more."""
    w = WINDOW
    codes = _constant([_code(_SIGNS.find(chr(c))) for c in range(128)], f"array<{_CODE}>")
    adds = _constant(_ADDS, "array<bigint>")

    def count(acc: Column, x: Column) -> Column:
        """The count of a character in the window."""
        word = F.lit(0).cast("bigint")
        for k in range(_WORDS):
            word = word.bitwiseOR(acc[f"c{k}"].bitwiseAND(x[f"u{k}"] * ((1 << _BITS) - 1)))
        return F.call_function("shiftright", word, x["b"]).cast("int")

    def moved(acc: Column, i: Column, o: Column) -> Column:
        have = count(acc, i) - (i["n"] == o["n"]).cast("int")
        s = acc["s"] - F.get(adds, count(acc, o)) + F.get(adds, have + 1)
        return F.struct(*[(acc[f"c{k}"] + i[f"u{k}"] - o[f"u{k}"]).alias(f"c{k}") for k in range(_WORDS)], s.alias("s"), (acc["at"] + 1).alias("at"))

    def search(x: Column) -> Column:
        """The sum where it is first low enough, else of the last window; steps after the first such window do nothing."""
        entering = F.transform(F.split(x["run"], ""), lambda c: F.get(codes, F.ascii(c)))

        def run_over(signs: Column) -> Column:
            leaving = F.concat(F.array_repeat(_constant(_code(-1), _CODE), w), F.slice(signs, 1, F.size(signs) - w))
            pairs = F.zip_with(signs, leaving, lambda i, o: F.struct(i.alias("i"), o.alias("o")))
            zero = F.lit(0).cast("bigint")
            start = F.struct(*[zero.alias(f"c{k}") for k in range(_WORDS)], zero.alias("s"), F.lit(0).alias("at"))
            done = lambda acc: (acc["at"] >= w) & (acc["s"] <= x["most"])
            return F.aggregate(pairs, start, lambda acc, p: F.when(done(acc), acc).otherwise(moved(acc, p["i"], p["o"])), done)

        return _once(entering, run_over)

    most = F.floor((F.log2(F.lit(float(w))) - bits) * (w * 2.0**40))
    return _once(F.struct(run.alias("run"), most.alias("most")), search)


def _is_secret(run: Column) -> Column:
    """Letters and digits, not allowed, and a window over the class's threshold."""
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | run.rlike(pattern)
    least = F.lit(99.0)
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(run.rlike(pattern), F.lit(bits)).otherwise(least)
    plausible = run.rlike("[0-9]") & run.rlike("[A-Za-z]") & ~allowed
    return F.when(plausible, _reaches(run, least)).otherwise(F.lit(False))


def _touches(spans: Column, x: Column) -> Column:
    """Whether one of ``spans``, which are in order and apart, overlaps ``x``: a binary search for the last one that begins before it ends."""
    start = F.struct(F.lit(0).alias("a"), F.size(spans).alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.call_function("shiftright", acc["a"] + acc["b"], F.lit(1))
        before = F.get(spans, mid)["start"] < x["stop"]
        return F.when(acc["a"] >= acc["b"], acc).when(before, F.struct((mid + 1).alias("a"), acc["b"].alias("b"))).otherwise(F.struct(acc["a"].alias("a"), mid.alias("b")))

    last = F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(spans)))), start, halve, lambda acc: acc["a"] - 1)
    return F.coalesce(F.get(spans, last)["stop"] > x["start"], F.lit(False))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(documents: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Per document: ``keep``, n_assign, n_access, n_hex, base_sha256, spans, found (structs of all spans).

    Spans are kind:start:end, end exclusive, in code points, by start and then kind.  Null counts as empty, and a text
    without secrets has an empty string.  Whole texts are scanned where they are, equal rows alike; nothing is shuffled.
    An empty table gives no rows; extra columns are ignored, whatever their names.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = documents.select(*[c.alias(n) for n, c in keep.items()], t.alias("_t"))
    df = df.select(
        *keep,
        _places(F.col("_t"), ASSIGN, 0, lambda m, g: F.length(g) >= 8).alias("_assign"),
        _places(F.col("_t"), ACCESS, 1, lambda m, g: F.length(m) >= 16).alias("_access"),
        _places(F.col("_t"), HEX, 2, lambda m, g: F.length(m) >= 32).alias("_hex"),
        _places(F.col("_t"), CANDIDATE, 3, lambda m, g: _is_secret(m)).alias("_more"),
    )
    df = df.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    apart = F.filter("_more", lambda x: ~(_touches(F.col("_assign"), x) | _touches(F.col("_access"), x) | _touches(F.col("_hex"), x)))
    df = df.withColumn("found", F.array_sort(F.concat("_base", F.when(F.size("_more") > 0, apart).otherwise(F.col("_more")))))
    return df.select(
        *keep,
        F.size("_assign").cast("bigint").alias("n_assign"),
        F.size("_access").cast("bigint").alias("n_access"),
        F.size("_hex").cast("bigint").alias("n_hex"),
        F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        "found",
    )
