"""Pruned joins against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from clausewright.operators import align as A
from clausewright.operators import similarity as S


def sparse_rows(rng, n, comparison, vocabulary):
    out = []
    for i in range(n):
        terms = np.unique(np.minimum((rng.zipf(1.4, 14) - 1) % vocabulary, vocabulary - 1)) + 1
        if i % 5 == 0 and out:
            terms = np.unique(np.append(out[rng.integers(len(out))][2], rng.integers(1, vocabulary)))
        w = rng.random(len(terms)) * np.log(2 + np.asarray(terms, float))
        out.append((comparison, int(i), [int(x) for x in terms], (w / np.linalg.norm(w)).tolist()))
    return out


def product(a, b):
    other = dict(zip(b[2], b[3], strict=True))
    return sum(w * other.get(t, 0.0) for t, w in zip(a[2], a[3], strict=True))


def test_sparse_join_is_all_pairs(spark):
    rng = np.random.default_rng(5)
    old = sparse_rows(rng, 120, "sparse", 4000) + sparse_rows(rng, 90, "dense", 8) + sparse_rows(rng, 7, "small", 50) + [("one side", 1, [1], [1.0]), ("small", 900, [], [])]
    new = sparse_rows(rng, 150, "sparse", 4000) + sparse_rows(rng, 80, "dense", 8) + sparse_rows(rng, 9, "small", 50)
    new += [("sparse", 1000 + i, o[2], o[3]) for i, o in enumerate(old[:40])]
    schema = "comparison_id string, node_id bigint, _at array<int>, _w array<double>"
    o, n = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    plan = {r.comparison_id: r for r in S.index_plan(o, n, 0.5, 32).collect()}
    assert {c: r["mode"] for c, r in plan.items()} == {"sparse": "index", "dense": "blocks", "small": "whole"}
    want = {(a[0], a[1], b[1]): product(a, b) for a in old for b in new if a[0] == b[0]}
    for least in (0.5, 0.9):
        got = {(r.comparison_id, r.old_id, r.new_id): r.score for r in S.sparse_join(o, n, least, 32).collect()}
        assert set(got) == {k for k, v in want.items() if v >= least} and all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    made = S.candidates(o.where("comparison_id = 'sparse'"), n.where("comparison_id = 'sparse'"), 0.5, 32).collect()
    assert len(made) == len({tuple(r) for r in made}) < 0.2 * 120 * 190
    one = o.where("comparison_id = 'sparse'")
    links = {(r.old_id, r.new_id) for r in S.sparse_join(one, one, 0.5, 32, within=True).collect()}
    own = [a for a in old if a[0] == "sparse"]
    assert links == {(a[1], b[1]) for a in own for b in own if a[1] < b[1] and product(a, b) >= 0.5}


def dense_rows(rng, n, comparison, first):
    kinds = rng.normal(size=(6, 12))
    v = kinds[rng.integers(6, size=n)] + 0.15 * rng.normal(size=(n, 12))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(comparison, first + i, x.tolist()) for i, x in enumerate(v)]


def test_dense_joins_are_all_pairs(spark):
    rng = np.random.default_rng(8)
    many = dense_rows(rng, 500, "many", 0)
    noise = rng.normal(size=(90, 12)) / 3
    noise = [("noise", i, x.tolist()) for i, x in enumerate(noise)]
    old = noise[:40] + many[:240] + dense_rows(rng, 5, "few", 0) + [("many", 900, [0.0] * 12), ("many", 901, [1.0, 2.0]), ("many", 902, None), ("many", 903, many[0][2])]
    new = noise[40:] + many[240:] + dense_rows(rng, 6, "few", 50) + [("many", 990, many[0][2]), ("many", 991, many[0][2]), ("many", 992, [3.0, 1.0]), ("none", 1, many[0][2])]
    schema = "comparison_id string, node_id bigint, embedding array<double>"
    o, n = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    want = {(a[0], a[1], b[1]): float(np.dot(a[2], b[2])) for a in old for b in new if a[0] == b[0] and a[2] and len(a[2]) == len(b[2])}
    for least in (0.5, -2.0):
        got = {(r.comparison_id, r.old_id, r.new_id): r.score for r in S.dense_join(o, n, least, 20, 12).collect()}
        assert set(got) == {k for k, v in want.items() if v >= least} and all(abs(want[k] - v) < 1e-12 for k, v in got.items())
    assert S._planned(o, n, 0.5, 20, 12)[1][2].select("comparison_id").distinct().collect() == [("many",)]
    met = S.ball_pairs(*S._balls_of(o.where("comparison_id = 'many'"), n.where("comparison_id = 'many'"), 20, 12))
    share = met.agg(F.sum(F.when(F.col("bound") >= 0.5, F.col("n_old") * F.col("n_new")).otherwise(0)) / F.sum(F.col("n_old") * F.col("n_new"))).first()[0]
    assert share <= 0.5
    for k in (1, 3):
        best = {}
        for (c, a, b), v in want.items():
            if v >= 0.25:
                best.setdefault((c, a), []).append((-round(v, 12), b))
        got = {(r.comparison_id, r.old_id, r.rank): r.new_id for r in S.dense_top(o, n, k, 0.25, 20, 12).collect()}
        assert got == {(*x, i): b for x, v in best.items() for i, (_, b) in enumerate(sorted(v)[:k], 1)}
    assert S.dense_join(o.where("node_id < 0"), n, 0.5).collect() == []


def test_terms_of_nodes_alone_are_not_shuffled(spark):
    """Comparisons of one node against a loop, among others; the one-node ones never reach an exchange of terms."""
    import math
    from collections import Counter

    texts = {(f"c{k}", k, "old"): " ".join(f"w{(k * j) % 7}é" for j in range(k % 9)) for k in range(1, 30)} | {("both", 100, "old"): "aa bb aa", ("both", 101, "new"): "bb cc"} | {("many", k, "new"): f"w{k % 3} w{k % 5} w{k % 7}" for k in range(200, 650)}
    df = spark.createDataFrame([(*key, t) for key, t in texts.items()], "comparison_id string, node_id bigint, side string, normalized_text string")
    want = {}
    for key, t in texts.items():
        mates = [Counter((w := x.split()) + [f"{p} {q}" for p, q in zip(w, w[1:])]) for k, x in texts.items() if k[0] == key[0]]
        own = Counter((w := t.split()) + [f"{p} {q}" for p, q in zip(w, w[1:])])
        cf, df_ = sum(mates, Counter()), Counter(x for m in mates for x in m)
        vocab = sorted(cf, key=lambda x: (-cf[x], x))[:4]
        w = {x: own[x] * (math.log((1 + len(mates)) / (1 + df_[x])) + 1) for x in vocab if x in own}
        norm = math.sqrt(sum(v * v for v in w.values()))
        want |= {(*key, x): (v / norm, vocab.index(x) + 1) for x, v in w.items()}
    got = {(r.comparison_id, r.node_id, r.side, r.term): (r.weight, r._r) for r in A._tfidf(df, features=4, stop_words=[]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    plan = A._tfidf(df, features=4, stop_words=[])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
