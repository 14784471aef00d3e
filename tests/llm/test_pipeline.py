"""The pipeline's rows against loops over the documents, and its stages on odd tables."""

import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from clausewright.llm import quality
from tests.llm.test_text_operators import LOW, components_of

DATA = Path("/root/testdata/sf0.001")


def kept_by_quality(model, texts):
    by = [zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    out = {}
    for k, t in texts.items():
        raw = (t or "").encode()
        good, bad = (sum(len(c.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)) for c in by)
        z = model.weights[0] + 20 * (model.weights[1] * (bad - good) / (len(raw) + 64) + model.weights[2] * (bad - good) / (good + bad + 64))
        if not raw or 1 / (1 + math.exp(-z)) >= 0.3:
            out[k] = t
    return out


def without_common_lines(texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    count = Counter(k for t in texts.values() for k in {key(x) for x in (t or "").split("\n")} if k)
    return {k: "\n".join(x for x in (t or "").split("\n") if count[key(x)] < 10) for k, t in texts.items()}


def first_of_each_group(texts):
    ids = sorted(texts)
    groups = components_of([texts[k] for k in ids])
    return {k: texts[k] for i, k in enumerate(ids) if groups[i][2]}


def uncontaminated(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = defaultdict(set)
    for v in map(words, items):
        n = min(13, len(v))
        if n:
            windows[n] |= {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
    out = {}
    for k, t in texts.items():
        w = words(t)
        hit = {j for n, own in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in own for j in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            out[k] = t
    return out


def pieces_of(texts):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    for k, t in texts.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        ends = list(range(len(ids), 0, -2048))[::-1]
        for piece, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            out.add((k, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_rows_are_those_of_loops(spark):
    import corpus_pipeline as P

    table = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    docs = {r.doc_id: r.text for r in table("documents").collect()}
    model = quality.fit(table("documents"), table("labels"))
    texts = kept_by_quality(model, docs)
    sizes = [len(docs), len(texts)]
    for step in (without_common_lines, first_of_each_group, lambda t: uncontaminated(t, [r.text for r in table("benchmark").collect()])):
        texts = step(texts)
        sizes.append(len(texts))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4]
    rows = P.run(spark, str(DATA)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == pieces_of(texts)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) + 1


ODD = [(1, None, None, None, None, 7), (2, "", "en", "s", 0, 7), (None, "a text without an id", "en", None, 20, 7), (3, "the same text twice over and over " * 9, "en", "s", 315, 7), (3, "the same text twice over and over " * 9, "en", "s", 315, 7), (4, "The same TEXT twice over and over " * 9, "de", "s", 315, 7), (5, "x" * 300_000, "fr", "s", 300_000, 7)]
ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text int"


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline as P

    spark.createDataFrame([(k, 1, 0) for k in (1, 2, 3, 5)] + [(4, 0, 0), (None, 1, 0), (9, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of its own"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, ODD_SCHEMA)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == P.COLUMNS, name
        if name == "MinHash near-dedup" and rows:
            assert ids(out) == [1, 2, 3, 5, None]
        elif name != "quality classifier":
            assert ids(out) == ids(docs), name
    packed = P.best_fit_packing(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in rows)
    assert spark.createDataFrame(rows, ODD_SCHEMA).where(F.col("_text") > 0).count() == len(rows)
