"""Whitening, tokenizer alignment and suffix-array dedup against brute force."""

import bisect
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clausewright.llm import inducedsort, suffixdedup, tokenalign, whitening


def whitened_by_numpy(rows, k):
    """Rows of (id, vector) as the contract has them, by the covariance matrix."""
    used = [(i, [math.floor(256.0 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in used}), dtype=float)
    n, mean = len(fit), fit.mean(0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    top = np.argsort(values)[::-1][:k]
    sums = [sum(int(x) for x in c) for c in fit.T]
    out = {}
    for i, x in used:
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), (np.array(x) - mean) @ vectors[:, top] / np.sqrt(values[top])))
    return n, out, values[top] / values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(6, 6)) * np.array([3, 2, 1, 0.6, 0.3, 0.1])
    rows = [(i, (rng.normal(size=6) @ basis).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, []), (None, rows[3][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], "vec_id bigint, embedding array<double>, n int, component int, _x double").repartition(40)
    got = whitening.whiten(df, {"vec_id": F.col("vec_id")}).collect()
    n, want, explained = whitened_by_numpy(rows, 4)
    assert {r.n for r in got} == {n} and len(got) == 4 * sum(map(len, want.values()))
    signs = {}
    for r in got:
        deviation, value = want[r.vec_id][0]
        v = value[r.component - 1]
        sign = signs.setdefault(r.component, 1 if v * r.whitened >= 0 else -1)
        assert r.deviation == deviation and abs(r.whitened * sign - v) < 1e-9 and abs(r.explained - explained[r.component - 1]) < 1e-9
        assert r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    run = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema), {"vec_id": F.col("vec_id")}).collect()
    assert run([]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(1, None), (2, [])]) == [] and run([(1, [1.0]), (2, [1.0])]) == []
    two = run([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (4, [5.0])])
    assert {(r.vec_id, r.component) for r in two} == {(1, 1), (2, 1), (3, 1)} and {round(abs(r.whitened), 9) for r in two} == {0.0, round(math.sqrt(1.5), 9)}
    large = run([(1, [2.0**50, 0.0]), (2, [-(2.0**50), 1.0]), (3, [0.0, 3.0])])
    assert {r.deviation for r in large} == {None, 2 * 0 + (3 * 768 - 1024) ** 2} and all(math.isfinite(r.whitened) for r in large)


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_by_loops(texts):
    """Whole texts through both tokenizers, and every link, one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    a_bytes = {i: bytes(letters[c] for c in p) for p, i in a_tok.get_vocab(with_added_tokens=False).items() if all(c in letters for c in p)}
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, in_docs = [], Counter()
    for t in texts:
        a, b = (a_tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        pa_, pb = [a_bytes[x] for x in a], [b_bytes(x) for x in b]
        want = (" " + (t or "")).encode()
        if not t or b"".join(pa_) != want or b"".join(pb) != want:
            docs.append(None)
            continue
        a_end, b_end = np.cumsum([len(x) for x in pa_]).tolist(), np.cumsum([len(x) for x in pb]).tolist()
        links = Counter()
        for i, x in enumerate(a):
            start = a_end[i - 1] if i else 0
            j = bisect.bisect_right(b_end, start)
            while j < len(b) and (b_end[j - 1] if j else 0) < a_end[i]:
                links[x, b[j]] += 1
                j += 1
        groups, i, j = [], 0, 0
        for end in sorted(set(a_end) & set(b_end)):
            p, q = a_end.index(end) + 1, b_end.index(end) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        docs.append((len(a), len(b), groups, links))
        in_docs.update(set(links))
    top = defaultdict(int)
    for (x, _), n in in_docs.items():
        top[x] = max(top[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(m for (x, y), m in links.items() if in_docs[x, y] == top[x]), sum(m * in_docs[p] for p, m in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def test_token_alignment(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeiouthrsné") for _ in range(rng.randrange(1, 9)))
    texts = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "x\ny z\n", "\tq", "<|endoftext|> <s> </s>", "▁a ▁", "日本語 テキスト。\u3000全角", "e\u0301 é ﬁ", "don't it's we'll  they're", "\u00a0nb\u00a0sp\x85x\x1cy", "naïve\x01x \x01 y", "🙂 emoji 🙂🙂", "a" * 30_000, "same words here", "same words here"]
    texts += [" ".join(word() + rng.choice(["", "", ".", ",", "!?"]) for _ in range(rng.randrange(1, 120))) for _ in range(80)] + ["\n".join(" ".join(word() for _ in range(9)) for _ in range(300))]
    df = spark.createDataFrame([(k, t, "x", 7, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, _chunk string, n_a int, _doc int").repartition(3)
    want = aligned_by_loops(texts)
    for shards in (1, 7):
        got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in tokenalign.align(df, {"doc_id": F.col("doc_id")}, A, B, shards=shards).collect()}
        assert len(got) == len(texts)
        for k, w in enumerate(want):
            assert got[k] == w, (k, (texts[k] or "")[:40])
    assert tokenalign.align(df.where("doc_id < 0"), {"doc_id": F.col("doc_id")}, A, B).collect() == []
    empty = tokenalign.align(df.where("doc_id < 2"), {"doc_id": F.col("doc_id")}, A, B).collect()
    assert sorted((r.doc_id, r.n_links, r.groups_sha256) for r in empty) == [(0, 0, ""), (1, 0, "")]


def suffixes_by_loops(t, limit, separated=False):
    """Sorted suffixes and common prefixes; separators differ, the last one first and then by place."""
    items = [(x, i if i < len(t) - 1 else -1) if separated and x == 0 else (x, 0) for i, x in enumerate(t)]
    order = sorted(range(len(t)), key=lambda i: items[i:])
    lcp = [0] * len(t)
    for k in range(1, len(t)):
        a, b = items[order[k - 1] :], items[order[k] :]
        while lcp[k] < min(limit, len(a), len(b)) and a[lcp[k]] == b[lcp[k]]:
            lcp[k] += 1
    return order, lcp


@pytest.mark.parametrize(("memory", "block"), [(48 << 20, 1 << 18), (200, 16), (0, 1)])
def test_induced_sorting(monkeypatch, memory, block):
    """In memory, and with all queues and arrays in files and every level of the recursion induced."""
    monkeypatch.setattr(inducedsort, "MEMORY", memory)
    monkeypatch.setattr(inducedsort, "BLOCK", block)
    rng = random.Random(11)
    cases = [b"", b"a", b"aa", b"ab", b"ba", b"banana", b"mississippi", b"abcabcabc" * 9, b"\0a\0b\0\0", b"a" * 90]
    for _ in range(150):
        t = [rng.randrange(rng.choice([1, 2, 4, 30])) for _ in range(rng.randrange(1, 150))]
        cases.append(bytes(t + t[5 : len(t) // 2] + t if rng.random() < 0.5 else t))
    for t in cases:
        for limit in (50, 7):
            order, lcp = inducedsort.sort_suffixes(inducedsort.Text(np.frombuffer(t, np.uint8), 256, limit))
            assert (order.tolist(), lcp.tolist()) == suffixes_by_loops(t, limit)
    for _ in range(60):
        t = b"\0".join([b"", *(bytes(rng.randrange(1, 4) for _ in range(rng.randrange(1, 20))) for _ in range(12)), b""])
        order, lcp = inducedsort.sort_suffixes(inducedsort.Text(np.frombuffer(t, np.uint8), 256, 9, separated=True))
        want = suffixes_by_loops(t, 9, True)
        n = t.count(0)  # the order of the separators themselves doesn't count
        assert order.tolist()[n:] == want[0][n:] and lcp.tolist()[n:] == want[1][n:]


def test_induced_sorting_of_a_large_alphabet():
    rng = np.random.default_rng(2)
    t = (rng.zipf(1.3, 4000) - 1) % 900
    t = np.concatenate([t, t[:1500], t[700:900]])
    order, lcp = inducedsort.sort_suffixes(inducedsort.Text(t.astype(np.int32), 900, 50))
    assert (order.tolist(), lcp.tolist()) == suffixes_by_loops(t.tolist(), 50)


def cut_by_loops(rows, width):
    """(doc_id, text) rows without what a smaller id has, window by window."""
    least = {}
    known = [(math.inf if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in known:
        for p in range(len(t) - width + 1):
            s = t[p : p + width]
            least[s] = min(least.get(s, math.inf), i)
    out = []
    for i, t in known:
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if least[t[p : p + width]] < i:
                gone[p : p + width] = [True] * width
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("shards", "hot"), [(1, 4096), (5, 4096), (5, 6)])
def test_suffix_dedup(spark, shards, hot):
    rng = random.Random(17)
    words = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(n))
    passage, licence = words(40), words(12)
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 51, "x" * 400, "ab" * 300, "x" * 130 + "y", licence, licence[:49], licence[1:]]
    texts += [words(rng.randrange(5, 60)) + (passage if k % 3 == 0 else "") + words(8) + (licence + licence if k % 4 == 0 else "") for k in range(60)]
    base = texts[20]
    texts += [base, base, base[:30] + "!" + base[30:], base.replace("a", "b", 1), "ü" * 60, "é" + "ü" * 60, words(6000), words(30) + passage * 3, "\0" * 120, "\0" * 60 + "a"]
    rows = [(k * 3 % 101 - 20, t) for k, t in enumerate(texts)] + [(None, passage), (None, passage), (7, base), (7, base), (2**62, base), (-(2**63), words(50) + licence)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, k, 1) for k, r in enumerate(rows)], "doc_id bigint, text string, row int, _chunk int").repartition(3)
    got = {r.row: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(df, {"row": F.col("row"), "doc_id": F.col("doc_id")}, shards=shards, hot=hot, chunk_bytes=20_000).collect()}
    want = cut_by_loops(rows, 50)
    assert len(got) == len(rows)
    for k, w in enumerate(want):
        assert got[k] == w, (k, rows[k])
    if shards == 1:
        assert suffixdedup.remove_repeats(df.where("row < 0"), {"doc_id": F.col("doc_id")}).collect() == []


def test_suffix_dedup_in_parts(monkeypatch):
    """Stretches of texts longer than a part, hot anchors window by window, and shards put together by hand."""
    monkeypatch.setattr(suffixdedup, "PART_BYTES", 300)
    rng = random.Random(23)
    long_ = "".join(rng.choice("ab ") for _ in range(2000)).encode()
    texts = [long_, b"", long_[100:180], b"z" * 700, b"q" + b"z" * 60]
    for doc, first, n, _ in suffixdedup.stretches(texts, 50):
        assert all(f + m + 49 <= len(texts[d]) for d, f, m in zip(doc.tolist(), first.tolist(), n.tolist(), strict=True))
    seen = sorted((d, w) for doc, first, n, _ in suffixdedup.stretches(texts, 50) for d, f, m in zip(doc.tolist(), first.tolist(), n.tolist(), strict=True) for w in range(f, f + m))
    assert seen == [(d, w) for d, t in enumerate(texts) for w in range(len(t) - 49)]
    distinct = sorted({texts[d][f : f + m + 49] for doc, first, n, _ in suffixdedup.stretches(texts, 50) for d, f, m in zip(doc.tolist(), first.tolist(), n.tolist(), strict=True)})
    least = np.array([hash(x) % 1000 for x in distinct])
    want = {}
    for t, v in zip(distinct, least.tolist(), strict=True):
        for p in range(len(t) - 49):
            want[t[p : p + 50]] = min(v, want.get(t[p : p + 50], v))
    for t, values in zip(distinct, suffixdedup.smallest_ids(distinct, least, 50), strict=True):
        values = np.broadcast_to(values, len(t) - 49) if len(values) == 1 else values
        assert [want[t[p : p + 50]] for p in range(len(t) - 49)] == values.tolist()


def test_hot_anchors_are_those_of_many_different_stretches(spark):
    """A passage that many documents have in the same words is no reason to send its windows one by one; F1."""
    rng = random.Random(29)
    words = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(n))
    passage = words(40)

    def hot(texts):
        df = spark.createDataFrame([(k, None, t) for k, t in enumerate(texts)], "_k0 bigint, _id bigint, _text string").repartition(2)
        folder = suffixdedup.write_chunks(df, 2000)
        chunk_ids, n = suffixdedup._chunk_ids(spark, folder)
        assert n > 2
        rows = suffixdedup.shared_anchors(suffixdedup.count_anchors(chunk_ids, folder, 50, 3), 12).collect()
        return sum(int(suffixdedup._arrays(r.data)[1].sum()) for r in rows)

    assert hot([passage] * 60) == 0
    assert hot([words(5) + passage[k % 7 :] + words(5) for k in range(60)]) > 0
