"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams of each word with its boundaries.  Each is hashed to a row of an embedding
table; a text's vector is the mean of its subwords' rows, and a linear layer with softmax gives the languages.
Both are trained together by stochastic gradient descent in numpy on a bounded sample.  The probabilities are
then calibrated on the whole texts of rows held back from training: one temperature, and for each language the
probability under which a prediction is rejected, so that at most a stated share of right ones is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import fold, text_map, with_text
from clausewright.llm.wordhash import chunks

BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (1, 2, 3, 4)
#: Bytes that aren't letters, below 128, are one boundary; letters are lower-cased where they are ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  #: (BUCKETS, languages): the embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    least: np.ndarray  #: by language


def grams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """By n-gram size: hashed subwords of all texts, concatenated, and how many each text has."""
    clean = [b" " + b" ".join(t.translate(_FOLD).split()) + b" " for t in texts]
    raw = np.frombuffer(b"".join(clean), np.uint8)
    owner = np.repeat(np.arange(len(clean)), np.fromiter(map(len, clean), np.int64, len(clean)))
    out, h = [], np.zeros(len(raw), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        keep = len(raw) - n + 1
        if keep <= 0:
            break
        h = h[:keep] * np.uint32(16777619) + raw[n - 1 :] + np.uint32(1)
        if n not in GRAMS:
            continue
        ok = owner[:keep] == owner[n - 1 :]
        if n > 2:  # no boundary inside
            for j in range(1, n - 1):
                ok &= raw[j : j + keep] != 32
        mixed = h[ok] ^ (h[ok] >> np.uint32(15))
        mixed = (mixed * np.uint32(2246822519) + np.uint32(n)) >> np.uint32(17)
        out.append((mixed.astype(np.int32), np.bincount(owner[:keep][ok], minlength=len(clean))))
    return out


def _by_text(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All sizes' subwords of each text together, and how many."""
    sized = grams(texts)
    owner = np.concatenate([np.repeat(np.arange(len(texts)), n) for _, n in sized])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([c for c, _ in sized])[order], np.bincount(owner, minlength=len(texts))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), values.shape[1]), values.dtype)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = 3, rate: float = 2.0, batch: int = 32, seed: int = 0) -> Model:
    """A model of ``texts``, not calibrated."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return Model(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), 1.0, np.zeros(len(languages)))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    code, counts = _by_text(texts)
    starts = np.concatenate(([0], np.cumsum(counts)))
    use = np.arange(len(texts))
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    steps, step = epochs * -(-len(use) // batch), 0
    for _ in range(epochs):
        rng.shuffle(use)
        for at in range(0, len(use), batch):
            own = use[at : at + batch]
            rows = np.concatenate([code[starts[i] : starts[i + 1]] for i in own])
            n = counts[own]
            mean = _sums(embed[rows], n) / n[:, None]
            error = _softmax(mean @ layer + bias)
            error[np.arange(len(own)), y[own]] -= 1
            lr = rate * (1 - step / steps)
            back = error @ layer.T
            layer -= lr * mean.T @ error / len(own)
            bias -= lr * error.mean(0)
            np.subtract.at(embed, rows, np.repeat((lr * back / n[:, None]).astype(np.float32), n, axis=0))
            step += 1
    return Model(languages, embed @ layer, bias, 1.0, np.zeros(len(languages)))


def calibrate(model: Model, z: np.ndarray, labels: list[str], reject: float = 0.01) -> None:
    """Sets temperature and bounds by the logits ``z`` of texts that weren't trained on."""
    known = np.array([x in model.languages for x in labels], bool)
    z, truth = z[known], np.array([model.languages.index(x) for x in labels if x in model.languages], int)
    if not len(z):
        return
    grid = np.geomspace(0.05, 20, 121)
    model.temperature = float(grid[np.argmin([-np.log(_softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean() for t in grid])])
    p = _softmax(z / model.temperature)
    best = p.argmax(1)
    for k in range(len(model.languages)):
        right = p[(best == k) & (truth == k), k]
        model.least[k] = np.quantile(right, reject) if len(right) else 0.0


def totals(weights: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the subwords' weights, and numbers of subwords."""
    total, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), np.int64)
    for code, counts in grams(texts):
        total += _sums(weights[code], counts)
        n += counts
    return total, n


def logits(model: Model, texts: list[bytes]) -> np.ndarray:
    """One row a text; a text of many megabytes is taken in slices whose subwords are summed."""
    weights = model.weights.astype(np.float32)
    total, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for i, part in _slices(texts):
        sums, counts = totals(weights, part)
        total[i : i + len(part)] += sums
        n[i : i + len(part)] += counts
    return total / np.maximum(n, 1)[:, None] + model.bias


def has_letter(text: str) -> bool:
    """Whether a character is a letter, as \\p{L} has it."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


_ASCII_LETTER = re.compile("[A-Za-z]")
#: A long text's sample for training: so many stretches from places anywhere in it, each of so many characters.
_STRETCHES, _STRETCH = 4, 250


def fit(documents: DataFrame, folds: int = 3, held: int = 1, rows: int = 1000) -> Model:
    """A model from documents with a language whose crc32 fold isn't ``held``.

    Bounded: of each language about the ``rows`` documents with the smallest hash of doc_id, so that a rare language is
    learned too.  Seven of eight train, with stretches of 1000 characters together from places anywhere in the text (a
    shorter text whole); the eighth calibrates by whole texts, which are scored where they are.  Rows without language,
    id or letters are ignored; of rows with one doc_id and language the first text counts.  With fewer than 64 documents, or if a
    language would have none to train with, all of them both train and calibrate.  Without any row the only language is ``und``.
    """
    h = F.xxhash64("doc_id")
    own = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held)).select("doc_id", F.col("text").alias("_text"), "lang")
    own = own.where(F.col("_text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return Model(["und"], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, np.zeros(1))
    spark = documents.sparkSession
    most = [(x, 2**63 - 1 if n <= rows else -(2**63) + int(2**64 * rows / n)) for x, n in sorted(counts.items())]
    bounds = F.broadcast(spark.createDataFrame(most, "lang string, _most bigint"))  # a row per language
    picked = own.join(bounds, "lang").where(h <= F.col("_most")).drop("_most")
    last = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(8)) == 7
    n = F.length("_text")
    size = _STRETCHES * _STRETCH
    places = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(n - _STRETCH, F.lit(1))) + 1 for k in range(_STRETCHES)]
    some = F.when(n <= size, F.col("_text")).otherwise(F.concat_ws(" ", *[F.substring("_text", p.cast("int"), F.lit(_STRETCH)) for p in places]))
    sample = picked.select("doc_id", "lang", some.alias("text"), last.alias("last")).groupBy("doc_id", "lang", "last").agg(F.min("text").alias("text"))
    got = sample.toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    texts, langs, held_ = [x.encode() for x in got.column("text").to_pylist()], got.column("lang").to_pylist(), got.column("last").to_pylist()
    few = len(texts) < 64 or len({x for x, y in zip(langs, held_, strict=True) if not y}) < len(counts)
    model = train([t for t, y in zip(texts, held_, strict=True) if few or not y], [x for x, y in zip(langs, held_, strict=True) if few or not y])
    scored = _with_logits(picked.where(F.lit(True) if few else last).select("doc_id", "lang", "_text"), model).groupBy("doc_id", "lang").agg(F.min("z").alias("z")).orderBy("doc_id", "lang").collect()
    calibrate(model, np.array([r.z for r in scored]), [r.lang for r in scored])
    return model


def _with_logits(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with the logits of ``_text``, which goes."""
    return text_map(rows, "_text", lambda texts: {"z": pa.array(logits(model, texts).tolist(), pa.list_(pa.float64()))}, "z array<double>")


def identify(documents: DataFrame, model: Model, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Per document: ``keep``, lang_pred, score, rejected.

    lang_pred is ``und`` with score 0 where the text is null or has no letter; else the likeliest learned language and its
    calibrated probability.  rejected: that is under the language's bound (always for ``und``).  Texts are read
    whole; equal rows get equal answers.  An empty table gives no rows; extra columns are ignored.
    """
    languages = np.array(model.languages, object)

    def scan(texts: list[bytes]) -> dict[str, pa.Array]:
        p = _softmax(logits(model, texts) / model.temperature)
        best = p.argmax(1)
        some = np.array([has_letter(t.decode()) for t in texts], bool)
        top = np.where(some, p[np.arange(len(p)), best], 0.0)
        return {
            "lang_pred": pa.array(np.where(some, languages[best], "und"), pa.string()),
            "score": pa.array(top, pa.float64()),
            "rejected": pa.array(~some | (top < model.least[best]), pa.bool_()),
        }

    return text_map(with_text(documents, text, keep), "_text", scan, "lang_pred string, score double, rejected boolean")


def _slices(texts: list[bytes], size: int = 1 << 18):
    """(first text, texts): runs of short texts, and slices of long ones, of about ``size`` bytes."""
    for a, b in chunks(texts, size):
        if b - a == 1 and len(texts[a]) > size:
            for at in range(0, len(texts[a]), size):
                yield a, [texts[a][at : at + size]]
        else:
            yield a, texts[a:b]
