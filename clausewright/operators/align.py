"""Clause alignment: exact, structural, lexical and semantic layers, each on what the layers before it left over."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.compare import ratio_bound, ratio_from, ratio_of, text_ratio
from clausewright.functions.scores import once
from clausewright.functions.text import is_plain
from clausewright.operators import similarity
from clausewright.sources import tables

#: Ratios and scores from which nodes are aligned, and terms that count.
EXACT_RATIO, HEADING_RATIO, ACCEPT, FEATURES = 0.3, 0.7, 0.5, 5000
#: About so many nodes of a side meet in a task.
BLOCK = similarity.BLOCK
#: Most pairs, or headings of a side, of a comparison that one task matches; larger ones are matched over tables.
GROUP = 50_000


def english_stop_words(df: DataFrame) -> list[str]:
    """Spark's own English list; pass another one where results must equal a tool with a longer list."""
    jvm = df.sparkSession.sparkContext._jvm
    return list(jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("english"))


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(fields, columns, strict=True)})


_FITTED = [("comparison_id", pa.string()), ("old_id", pa.string()), ("new_id", pa.string()), ("old_order", pa.int32()), ("sim", pa.float64())]


def exact_layer(old: DataFrame, new: DataFrame) -> DataFrame:
    """First-fit one-to-one pairs of equal section number and text ratio of EXACT_RATIO or more, in document order.

    Sections that are unique on both sides, nearly all, pair by a plain join.  Only sections that repeat need the order,
    and each of those is a small group of its own.
    """
    key = ["comparison_id", "section_number"]
    o, n = old.where("section_number <> ''"), new.where("section_number <> ''")
    counts = o.groupBy(*key).agg(F.count(F.lit(1)).alias("_o")).join(n.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), key)
    cols = lambda p: [F.col("node_id").alias(f"{p}_id"), F.col("order").alias(f"{p}_order"), F.col("normalized_text").alias(f"{p}_text")]
    single = o.join(counts.where("_o = 1 AND _n = 1"), key).select(*key, *cols("old")).join(n.select(*key, *cols("new")), key)
    single = single.withColumn("sim", text_ratio("old_text", "new_text")).where(F.col("sim") >= EXACT_RATIO).select("comparison_id", "old_id", "new_id", "old_order", "sim")
    repeated = counts.where("_o > 1 OR _n > 1").select(*key)
    side = lambda df, flag: df.join(repeated, key, "left_semi").select(*key, "node_id", "order", "normalized_text", F.lit(flag).alias("is_old"))

    def first_fit(t: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        rows = list(zip(*[t[c].to_pylist() for c in ("comparison_id", "node_id", "order", "normalized_text", "is_old")], strict=True))
        out = []
        for i, j in groups:
            free = [r for r in rows[i:j] if not r[4]]
            for comparison, node, order, text, is_old in rows[i:j]:
                for k, b in enumerate(free if is_old else ()):
                    sim = ratio_of(text, b[3])
                    if sim >= EXACT_RATIO:
                        out.append((comparison, node, free.pop(k)[1], order, sim))
                        break
        return _table(out, _FITTED)

    fitted = tables.in_groups(side(o, True).unionByName(side(n, False)), key, ["order", "node_id"], first_fit, "comparison_id string, old_id string, new_id string, old_order int, sim double")
    both = single.withColumn("old_order", F.col("old_order").cast("int")).unionByName(fitted)
    scores = F.create_map(F.lit("section_match"), F.lit(1.0), F.lit("text_similarity"), F.col("sim"))
    return both.select("comparison_id", F.col("old_id").alias("old_node_id"), F.col("new_id").alias("new_node_id"), F.least(F.lit(1.0), 0.5 + 0.5 * F.col("sim")).alias("confidence"), F.lit("exact").alias("match_method"), scores.alias("similarity_scores"), F.col("old_order").cast("double").alias("rank"), F.lit(0).alias("tie"))


def structural_layer(old: DataFrame, new: DataFrame, most: int = GROUP) -> DataFrame:
    """Pairs of similar headings; each old node in order takes the best new one that is left.

    Comparisons of at most ``most`` pairs of headings are matched by a scan each.  Larger ones get candidates from an index of
    headings, and are matched in rounds over tables.
    """
    cols = ["comparison_id", "node_id", "order", "heading", "normalized_text"]
    o, n = old.where("heading <> ''").select(*cols), similarity.renamed(new.where("heading <> ''").select(*cols))
    size = lambda df, c: df.groupBy("comparison_id").agg(F.count(F.lit(1)).alias(c))
    large = tables.settle(size(o, "_o").join(size(n, "_n"), "comparison_id").where(F.col("_o") * F.col("_n") > most).select("comparison_id"))
    if large.isEmpty():
        return _structural_scan(o, n)
    of = lambda df, how: similarity.renamed(df.join(large, "comparison_id", how))
    taken = in_turn(heading_scores(of(o, "left_semi"), of(n, "left_semi")))
    pairs = taken.select("comparison_id", F.col("old_id").alias("old_node_id"), F.col("new_id").alias("new_node_id"), F.col("score").alias("confidence"), F.lit("structural").alias("match_method"), F.create_map(F.lit("structural_score"), F.col("score")).alias("similarity_scores"), F.col("old_order").cast("double").alias("rank"), F.lit(0).alias("tie"))
    return _structural_scan(of(o, "left_anti"), of(n, "left_anti")).unionByName(pairs)


def _structural_scan(o: DataFrame, n: DataFrame) -> DataFrame:
    def search(t: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        every = list(zip(*[t[c].to_pylist() for c in ("comparison_id", "node_id", "order", "normalized_text", "is_old", "heading")], strict=True))
        out = []
        for i, j in groups:
            rows = [(*r[:5], r[5].lower(), Counter(r[5].lower())) for r in every[i:j]]
            free = [r for r in rows if not r[4]]
            for comparison, node, order, text, is_old, heading, letters in rows:
                best, at = 0.0, None
                for k, (_, _, _, found, _, h, others) in enumerate(free if is_old else ()):
                    total = len(heading) + len(h)
                    if 2 * min(len(heading), len(h)) / total < HEADING_RATIO or 2 * sum([min(c, others[x]) for x, c in letters.items()]) / total < HEADING_RATIO:
                        continue
                    like = ratio_from(heading, h, HEADING_RATIO)
                    if like >= HEADING_RATIO and 0.6 * like + 0.4 * ratio_bound(text, found) > best:
                        score = 0.6 * like + 0.4 * ratio_of(text, found)
                        if score > best:
                            best, at = score, k
                if at is not None and best >= ACCEPT:
                    out.append((comparison, node, free.pop(at)[1], best, float(order)))
        return _table(out, _SCANNED)

    side = lambda df, is_old: df.select("comparison_id", "node_id", "order", "heading", "normalized_text", F.lit(is_old).alias("is_old"))
    found = tables.in_groups(side(o, True).unionByName(side(n, False)), ["comparison_id"], ["order", "node_id"], search, "comparison_id string, old_node_id string, new_node_id string, confidence double, rank double")
    scores = F.create_map(F.lit("structural_score"), F.col("confidence"))
    return found.select("comparison_id", "old_node_id", "new_node_id", "confidence", F.lit("structural").alias("match_method"), scores.alias("similarity_scores"), "rank", F.lit(0).alias("tie"))


_SCANNED = [("comparison_id", pa.string()), ("old_node_id", pa.string()), ("new_node_id", pa.string()), ("confidence", pa.float64()), ("rank", pa.float64())]


def heading_pairs(old: DataFrame, new: DataFrame, least: float = HEADING_RATIO, block: int = BLOCK) -> DataFrame:
    """(comparison_id, a, b) of distinct headings in lower case whose letters allow a ratio of ``least``.

    A ratio of r needs lengths within (2 - r) / r of each other, so headings meet only those of their own and the next band of
    lengths, in blocks; there their letters are counted into a few cells, whose common counts bound what can match.
    """
    base = np.log((2 - least) / least) + 1e-9
    band = F.floor(F.log(F.length("h")) / F.lit(float(base))).cast("int")
    distinct = lambda df: df.select("comparison_id", F.lower("heading").alias("h")).distinct().withColumn("_b", band)
    o, n = tables.settle(distinct(old)), tables.settle(similarity.renamed(distinct(new)))
    sizes = lambda df, c: df.groupBy("comparison_id", "_b").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(c))
    near = lambda df: df.withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    key = ["comparison_id", "_b", "_o", "_n"]
    k = sizes(o, "_ok").join(sizes(near(n), "_nk"), ["comparison_id", "_b"])
    own = lambda c: F.pmod(F.xxhash64("h"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    o = o.join(k, ["comparison_id", "_b"]).withColumn("_o", own("_ok")).withColumn("_n", every("_nk")).select(*key, "h")
    n = similarity.renamed(near(n).join(similarity.renamed(k), ["comparison_id", "_b"]).withColumn("_n", own("_nk")).withColumn("_o", every("_ok")).select(*key, "h"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = a["h"].to_pylist(), b["h"].to_pylist()
        p, q = np.zeros((len(x), 64), np.int16), np.zeros((len(y), 64), np.int16)
        for counts, texts in ((p, x), (q, y)):
            for i, t in enumerate(texts):
                np.add.at(counts[i], np.fromiter((ord(c) * 40503 % 65521 % 64 for c in t), np.int64, len(t)), 1)
        common = np.zeros((len(x), len(y)), np.int32)
        for cell in range(64):
            if p[:, cell].any() and q[:, cell].any():
                common += np.minimum(p[:, cell][:, None], q[:, cell][None, :])
        total = np.array([len(t) for t in x])[:, None] + np.array([len(t) for t in y])[None, :] if x and y else common
        i, j = np.nonzero(2 * common >= (least - 1e-9) * total)
        first = a["comparison_id"].slice(0, 1).to_pylist() or [None]
        return pa.table({"comparison_id": pa.array(first * len(i), pa.string()), "a": pa.array([x[k] for k in i], pa.string()), "b": pa.array([y[k] for k in j], pa.string())})

    return o.groupBy(*key).cogroup(n.groupBy(*key)).applyInArrow(meet, "comparison_id string, a string, b string")


def heading_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """(comparison_id, old_id, new_id, old_order, new_order, score) of nodes whose headings are similar and whose score is accepted."""
    h = tables.spread(heading_pairs(old, new)).withColumn("h", text_ratio("a", "b")).where(F.col("h") >= HEADING_RATIO)
    h = tables.settle(h)
    side = lambda df, c, p: similarity.renamed(df.select("comparison_id", F.lower("heading").alias(c), F.col("node_id").alias(f"{p}_id"), F.col("order").alias(f"{p}_order"), F.col("normalized_text").alias(f"{p}_text")))
    both = tables.spread(h.join(side(old, "a", "old"), ["comparison_id", "a"]).join(side(new, "b", "new"), ["comparison_id", "b"]))
    scored = both.withColumn("score", 0.6 * F.col("h") + 0.4 * text_ratio("old_text", "new_text")).where(F.col("score") >= ACCEPT)
    return tables.settle(scored.select("comparison_id", "old_id", "new_id", "old_order", "new_order", "score"))


def in_turn(scores: DataFrame) -> DataFrame:
    """One-to-one pairs: each old node, in its order, takes the best new one that is left, the first in order among equals.

    In rounds over the table: an old node takes its best one as soon as no earlier old node that is left has a score with it.  Each round
    settles at least the first old node of each comparison.
    """
    left, taken = scores, None
    turn = F.struct("old_order", "old_id")
    while not left.isEmpty():
        best = Window.partitionBy("comparison_id", "old_id").orderBy(F.desc("score"), "new_order", "new_id")
        ranked = left.withColumn("_r", F.row_number().over(best)).withColumn("_first", F.min(turn).over(Window.partitionBy("comparison_id", "new_id")))
        now = tables.settle(ranked.where((F.col("_r") == 1) & (F.col("_first") == turn)).drop("_r", "_first"))
        taken = now if taken is None else taken.unionByName(now)
        gone = lambda c: similarity.renamed(now.select("comparison_id", c))
        left = tables.settle(left.join(gone("old_id"), ["comparison_id", "old_id"], "left_anti").join(gone("new_id"), ["comparison_id", "new_id"], "left_anti"))
    return scores if taken is None else taken


def words(text: Column, stop_words: list[str]) -> Column:
    """Words of two letters or more that aren't stop words."""
    found = lambda pattern: F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
    return F.filter(F.when(is_plain(text), found(r"(\b\w\w+\b)")).otherwise(found(r"(?U)(\b\w\w+\b)")), lambda w: ~w.isin(stop_words))


def terms(text: Column, stop_words: list[str]) -> Column:
    """Words of two letters or more that aren't stop words, and pairs of neighbours among them."""
    rest = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    return once(words(text, stop_words), lambda w: F.concat(w, F.zip_with(F.slice(w, 1, rest(w)), F.slice(w, 2, rest(w)), lambda a, b: F.concat_ws(" ", a, b))))


def tfidf(df: DataFrame, text: str = "normalized_text", features: int = FEATURES, stop_words: list[str] | None = None) -> DataFrame:
    """(comparison_id, node_id, side, term, weight): L2-normalised weights over both sides of a comparison.

    The ``features`` most frequent terms of each comparison count, equal ones by the alphabet.
    """
    return _tfidf(df, text, features, stop_words).drop("_r")


#: About so many nodes of a comparison meet its terms in a task; comparisons of no more nodes and characters are weighed whole in one.
_NODES, _CHARACTERS = 200, 2_000_000


def _tfidf(df: DataFrame, text: str = "normalized_text", features: int = FEATURES, stop_words: list[str] | None = None, packed: bool = False) -> DataFrame:
    """As tfidf, with the term's place in its comparison in ``_r``; ``packed``: a row per node, with places in ``_at`` and weights in ``_w``.

    What the nodes of a small comparison weigh is in their own texts, so only texts are shuffled, and none of a node that is alone; terms
    are counted over tables for larger ones.
    """
    stop = english_stop_words(df) if stop_words is None else stop_words
    n = df.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("_length"))
    rows = df.select("comparison_id", "node_id", "side", text).where("node_id IS NOT NULL AND side IS NOT NULL").join(n, "comparison_id")
    key = ["comparison_id", "node_id", "side"]
    said = F.array_join(words(F.col(text), stop), "\n").alias("_words")
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key) + (", _at array<int>, _w array<double>" if packed else ", _terms array<struct<term:string,weight:double,_r:int>>")
    alone = rows.where("n = 1").select(*key, said).mapInArrow(_weights_alone(features, packed), schema)
    is_small = (F.col("n") <= _NODES) & (F.col("_length") <= _CHARACTERS)
    small = tables.in_groups(rows.where((F.col("n") > 1) & is_small).select(*key, "n", said), ["comparison_id"], [], lambda t, groups: _weights_together(t, groups, features, packed), schema)

    rows = rows.where((F.col("n") > 1) & ~is_small)
    tf = rows.select(*key, "n", F.explode(terms(F.col(text), stop)).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("n").alias("n"))
    vocab = tf.groupBy("comparison_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.first("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("comparison_id").orderBy(F.desc("cf"), "term"))
    idf = (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")
    blocks = F.ceil(F.col("n") / _NODES).cast("int")
    vocab = vocab.withColumn("_r", rank).where(F.col("_r") <= features).select("comparison_id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_b"), "term", "_r", idf)
    dealt = similarity.renamed(rows.select("comparison_id", F.pmod(F.xxhash64("node_id"), blocks).cast("int").alias("_b"), "node_id", "side", said))
    large = dealt.groupBy("comparison_id", "_b").cogroup(vocab.groupBy("comparison_id", "_b")).applyInArrow(lambda nodes, vocab: _weights_of(nodes, vocab, packed), schema)
    out = alone.unionByName(small).unionByName(large)
    return out if packed else out.select(*key, F.inline("_terms"))


def _counts(said: str | None) -> Counter:
    """How often each term of ``terms`` is in words that are joined by line feeds."""
    w = said.split("\n") if said else []
    return Counter(w + list(map(" ".join, zip(w, w[1:], strict=False))))


def _ranked(times: dict[str, int], most: int) -> list[str]:
    """The most frequent terms, equal ones by the alphabet."""
    return sorted(sorted(times), key=times.__getitem__, reverse=True)[:most]


_Rows = list[tuple[int, list[str], list[float], list[int]]]


def _weights(nodes: pa.RecordBatch | pa.Table, rows: _Rows, packed: bool) -> pa.Table:
    """A row with the weights of each node (place in ``nodes``, terms, weights, places of terms) that has any."""
    rows = [r for r in rows if r[1]]
    own = {c: nodes.column(c).take(pa.array([r[0] for r in rows], pa.int64())) for c in ("comparison_id", "node_id", "side")}
    weights, places = pa.array([w for r in rows for w in r[2]], pa.float64()), pa.array([p for r in rows for p in r[3]], pa.int32())
    ends = pa.array(np.cumsum([0, *(len(r[1]) for r in rows)]), pa.int32())
    if packed:
        return pa.table(own | {"_at": pa.ListArray.from_arrays(ends, places), "_w": pa.ListArray.from_arrays(ends, weights)})
    terms_ = pa.array([t for r in rows for t in r[1]], pa.string())
    return pa.table(own | {"_terms": pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([terms_, weights, places], ["term", "weight", "_r"]))})


def _weights_alone(features: int, packed: bool, most: int = 50_000) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Terms and weights of nodes that are alone in their comparison: each idf is 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, size = [], 0
            for i, said in enumerate(b.column(3)):
                tf = _counts(said.as_py())
                top = _ranked(tf, features)
                times = [tf[t] for t in top]
                norm = sum([x * x for x in times]) ** 0.5
                made.append((i, top, [x / norm for x in times], range(1, len(top) + 1)))
                size += len(top)
                if size >= most:
                    yield from _weights(b, made, packed).to_batches()
                    made, size = [], 0
            yield from _weights(b, made, packed).to_batches()

    return run


def _own_counts(nodes: pa.Table) -> list[dict]:
    """By row, how often its node has each term; rows of one node are one text, whose first row has all and the others none."""
    first: dict[tuple, Counter] = {}
    out = []
    for key, said in zip(zip(nodes["comparison_id"].to_pylist(), nodes["node_id"].to_pylist(), nodes["side"].to_pylist(), strict=True), nodes["_words"].to_pylist(), strict=True):
        own = _counts(said)
        if key in first:
            first[key].update(own)
            own = {}
        else:
            first[key] = own
        out.append(own)
    return out


def _weighed(i: int, tf: dict, known: dict[str, tuple[int, float]]) -> tuple[int, list[str], list[float], list[int]]:
    found = [t for t in tf if t in known]
    w = [tf[t] * known[t][1] for t in found]
    norm = sum([x * x for x in w]) ** 0.5
    return i, found, [x / norm for x in w], [known[t][0] for t in found]


def _weights_of(nodes: pa.Table, vocab: pa.Table, packed: bool) -> pa.Table:
    """Terms and weights of a block of a comparison's nodes, with its terms (term, _r, idf)."""
    known = dict(zip(vocab["term"].to_pylist(), zip(vocab["_r"].to_pylist(), vocab["idf"].to_pylist(), strict=True), strict=True))
    return _weights(nodes, [_weighed(i, tf, known) for i, tf in enumerate(_own_counts(nodes))], packed)


def _weights_together(nodes: pa.Table, groups: list[tuple[int, int]], features: int, packed: bool) -> pa.Table:
    """As _weights_of, of all nodes of comparisons (n of them, with those that have no id), whose terms are counted here."""
    out = []
    for i, j in groups:
        own, n = _own_counts(nodes.slice(i, j - i)), nodes["n"][i].as_py()
        df, cf = {}, {}
        for tf in own:
            for t, times in tf.items():
                df[t] = df.get(t, 0) + 1
                cf[t] = cf.get(t, 0) + times
        top = _ranked(cf, features)
        idf = {k: math.log((1 + n) / (1 + k)) + 1 for k in set(df.values())}
        known = {t: (r, idf[df[t]]) for r, t in enumerate(top, 1)}
        out += [_weighed(i + k, tf, known) for k, tf in enumerate(own)]
    return _weights(nodes, out, packed)


def lexical_scores(old: DataFrame, new: DataFrame, least: float = ACCEPT, stop_words: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(comparison_id, old_id, new_id, score) of pairs with cosine of ``least`` or more."""
    long_ = F.length("normalized_text") > 20
    cols = ["comparison_id", "node_id", "normalized_text"]
    both = old.where(long_).select(*cols, F.lit("old").alias("side")).unionByName(new.where(long_).select(*cols, F.lit("new").alias("side")))
    v = tables.settle(_tfidf(both, stop_words=stop_words, packed=True))
    return similarity.sparse_join(v.where("side = 'old'").drop("side"), v.where("side = 'new'").drop("side"), least, block)


def distinct_texts(nodes: DataFrame) -> DataFrame:
    """(comparison_id, node_id, rep): the smallest node of each text in a comparison stands for its copies."""
    key = ["comparison_id", F.md5("normalized_text").alias("_text")]
    reps = nodes.groupBy(*key).agg(F.min("node_id").alias("rep"))
    return nodes.select("node_id", *key).join(reps, ["comparison_id", "_text"]).select("comparison_id", "node_id", "rep")


def lexical_links(nodes: DataFrame, least: float = ACCEPT, stop_words: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """As lexical_scores, for each two different texts of a comparison whatever their side.

    ``node_id`` is a number; the representatives of distinct_texts are linked, the smaller one as old, and copies, which
    all count in the weights, have their representative's links.
    """
    long_ = nodes.where(F.length("normalized_text") > 20)
    reps = distinct_texts(long_).where("node_id = rep").select("comparison_id", "node_id")
    v = tables.settle(_tfidf(long_, stop_words=stop_words, packed=True).join(reps, ["comparison_id", "node_id"], "left_semi").select("comparison_id", "node_id", "_at", "_w"))
    return similarity.sparse_join(v, v, least, block, within=True)


def semantic_scores(old: DataFrame, new: DataFrame, least: float = ACCEPT, block: int = BLOCK) -> DataFrame:
    """(comparison_id, old_id, new_id, score) of unit vectors in ``embedding`` whose product is ``least`` or more."""
    return similarity.dense_join(old, new, least, block)


def semantic_top(old: DataFrame, new: DataFrame, k: int = 3, least: float = ACCEPT, block: int = BLOCK) -> DataFrame:
    """As semantic_scores, the ``k`` best new nodes of each old node with their rank; all pairs are never formed."""
    return similarity.dense_top(old, new, k, least, block)


def top_matches(scores: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best new nodes of each old node."""
    return similarity.top(scores, k)


def greedy(scores: DataFrame, old_order: str = "old_id", new_order: str = "new_id", settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One-to-one pairs, best score first and later rows first among equals, as a loop over the whole table.

    A pair that is first for both its nodes is what a sequential scan would take; pairs that touch it go, and the rest
    is searched again.  This equals the scan because the order is total.  Each round is settled.
    """
    settle = settle or tables.settle
    order = [F.desc("score"), F.desc(old_order), F.desc(new_order)]
    left, taken = settle(scores), None
    while not left.isEmpty():
        ranked = left.withColumn("_a", F.row_number().over(Window.partitionBy("comparison_id", "old_id").orderBy(*order))).withColumn("_b", F.row_number().over(Window.partitionBy("comparison_id", "new_id").orderBy(*order)))
        best = settle(ranked.where("_a = 1 AND _b = 1").drop("_a", "_b"))
        taken = best if taken is None else taken.unionByName(best)
        left = settle(left.join(best.select("comparison_id", "old_id"), ["comparison_id", "old_id"], "left_anti").join(best.select("comparison_id", "new_id"), ["comparison_id", "new_id"], "left_anti"))
    return taken if taken is not None else left


def greedy_match(scores: DataFrame, most: int = GROUP) -> DataFrame:
    """As greedy by ``old_order`` and ``new_order``: comparisons of at most ``most`` pairs by a scan each, others by the loop over tables."""
    scores = tables.settle(scores)
    n = scores.groupBy("comparison_id").count().where(F.col("count") > most).select("comparison_id")
    if n.isEmpty():
        return greedy_grouped(scores)
    n = tables.settle(n)
    large = greedy(scores.join(n, "comparison_id", "left_semi"), "old_order", "new_order")
    return greedy_grouped(scores.join(n, "comparison_id", "left_anti")).unionByName(large.select(*scores.columns))


def greedy_grouped(scores: DataFrame) -> DataFrame:
    """As greedy, by a scan in one group per comparison; for comparisons of document size."""

    def scan(t: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        olds, news, kept = t["old_id"].to_pylist(), t["new_id"].to_pylist(), []
        for i, j in groups:
            seen_old, seen_new = set(), set()
            for k in range(i, j):
                if olds[k] not in seen_old and news[k] not in seen_new:
                    seen_old.add(olds[k])
                    seen_new.add(news[k])
                    kept.append(k)
        return t.take(pa.array(kept, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scores.schema)
    return tables.in_groups(scores, ["comparison_id"], [F.desc("score"), F.desc("old_order"), F.desc("new_order")], scan, schema)


def _as_pairs(taken: DataFrame, method: str, key: str) -> DataFrame:
    return taken.select("comparison_id", F.col("old_id").alias("old_node_id"), F.col("new_id").alias("new_node_id"), F.col("score").alias("confidence"), F.lit(method).alias("match_method"), F.create_map(F.lit(key), F.col("score")).alias("similarity_scores"), (-F.col("score")).alias("rank"), (-F.col("old_order")).cast("int").alias("tie"))


def _left(df: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    return df.join(pairs.select("comparison_id", F.col(column).alias("node_id")), ["comparison_id", "node_id"], "left_anti")


def align(old: DataFrame, new: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Alignments of clause units with comparison_id: matched, REMOVED and ADDED, and the place of each in the report.

    ``embed`` adds unit vectors in ``embedding``; without it the semantic layer is left out.  Every unit is in one row.
    """
    found: list[DataFrame] = []
    new = new.select(*[F.col(c).alias(c) for c in new.columns])  # both sides may come from one table

    def add(layer: DataFrame, k: int) -> None:
        nonlocal old, new
        layer = tables.settle(layer.withColumn("layer", F.lit(k)))
        found.append(layer)
        old, new = _left(old, layer, "old_node_id"), _left(new, layer, "new_node_id")

    def with_order(scores: DataFrame) -> DataFrame:
        o = old.select("comparison_id", F.col("node_id").alias("old_id"), F.col("order").alias("old_order"))
        n = new.select("comparison_id", F.col("node_id").alias("new_id"), F.col("order").alias("new_order"))
        return scores.join(o, ["comparison_id", "old_id"]).join(n, ["comparison_id", "new_id"])

    add(exact_layer(old, new), 0)
    add(structural_layer(old, new), 1)
    add(_as_pairs(greedy_match(with_order(lexical_scores(old, new))), "lexical", "tfidf_similarity"), 2)
    if embed:
        add(_as_pairs(greedy_match(with_order(semantic_scores(embed(old), embed(new)))), "semantic", "semantic_similarity"), 3)
    none = F.lit(None).cast("string")
    empty = F.create_map().cast("map<string,double>")
    rest = lambda df, kind, o, n, k: df.select("comparison_id", o.alias("old_node_id"), n.alias("new_node_id"), F.lit(0.9).alias("confidence"), F.lit("unmatched").alias("match_method"), empty.alias("similarity_scores"), F.col("order").cast("double").alias("rank"), F.lit(0).alias("tie"), F.lit(k).alias("layer"), F.lit(kind).alias("alignment_type"))
    out = rest(old, "REMOVED", F.col("node_id"), none, 4).unionByName(rest(new, "ADDED", none, F.col("node_id"), 5))
    for layer in found:
        out = layer.withColumn("alignment_type", F.lit("ONE_TO_ONE")).unionByName(out)
    return out


def alignment_counts(aligned: DataFrame) -> DataFrame:
    """Per comparison: added, removed, matched."""
    kind = F.col("alignment_type")
    return aligned.groupBy("comparison_id").agg(F.count_if(kind == "ADDED").alias("added"), F.count_if(kind == "REMOVED").alias("removed"), F.count_if(kind == "ONE_TO_ONE").alias("matched"))
