"""Quality classifier by compression with zstandard dictionaries.

One dictionary is built from pieces of good and one from pieces of bad labelled text.  A text is cut into blocks, every
block is compressed with either dictionary, and the difference of the sizes says which kind of text it is like; nothing
else does.  It is normalised twice, by the text's bytes and by the compressed ones, as text that repeats itself is small
under either dictionary.  Blocks keep the dictionary's weight the same in a text of any length, and every byte counts.
A logistic curve fitted on other labelled rows than the dictionaries' turns the difference into a calibrated score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import first_by_hash, fold, text_map, with_text

BLOCK = 2048
LEVEL = 12
#: Bytes that every text is taken to have besides its own, so that a few bytes more or less say little of a short text.
_PADDING = 64
#: Pieces of a labelled text that may get into a dictionary, and their characters.
_PIECES, _PIECE = 4, 256


@dataclass
class Model:
    """Two dictionaries, the curve's weights over (1, 20 * difference, 20 * relative), and the share of label 1, the score of texts without bytes."""

    good: bytes
    bad: bytes
    weights: list[float]
    prior: float


#: Bytes of a text at which its difference counts for half.
EVIDENCE = 16


class _Sizer:
    """Compressed sizes with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) for d in map(_dictionary, (good, bad))]

    def differences(self, text: bytes) -> tuple[float, float]:
        """What the bad dictionary needs more than the good one, over the text's bytes and over the sizes; positive: like good text."""
        good, bad = (sum(len(c.compress(text[at : at + BLOCK])) for at in range(0, len(text), BLOCK)) for c in self.by)
        return (bad - good) / (len(text) + _PADDING), (bad - good) / (good + bad + _PADDING)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(data or b"\n" * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return d


def _curve(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + 20 * x @ weights[1:], -30, 30)))


def _drawn(score: np.ndarray, prior: float, share: np.ndarray) -> np.ndarray:
    """``share`` of the way from the prior to the score, in log odds."""
    odds = lambda p: np.log(p) - np.log1p(-p)
    p = float(np.clip(prior, 1e-6, 1 - 1e-6))
    return 1 / (1 + np.exp(-(odds(p) + (odds(score) - odds(p)) * share)))


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Logistic regression by Newton's method with a little ridge."""
    design, w = np.column_stack([np.ones(len(x)), 20 * x]), np.zeros(3)
    for _ in range(50):
        p = _curve(x, w)
        grad = design.T @ (weight * (p - y)) + 1e-3 * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _differences(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """``rows`` with the differences of ``_text``, which goes."""
    made: list[_Sizer] = []

    def scan(texts: list[bytes]) -> dict[str, pa.Array]:
        if not made:
            made.append(_Sizer(good, bad))
        x = np.array([made[0].differences(t) for t in texts]).reshape(-1, 2)
        return {"difference": pa.array(x[:, 0]), "relative": pa.array(x[:, 1])}

    return text_map(rows, "_text", scan, "difference double, relative double")


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, rows: int = 4000, dictionary: int = 128 << 10) -> Model:
    """A model from the labelled documents whose crc32 fold is not 0.

    Bounded: at most ``rows`` ids of each label, those with the smallest hash.  Half of them, by another hash, give the
    dictionaries pieces of 256 characters from up to four places anywhere in their text, the first place of all rows before the second of
    any, until ``dictionary`` bytes are full; of the others the whole texts are
    compressed where they are, for the curve.  Ids are broadcast, pieces and differences come to the driver, texts
    don't.  Rows that share an id count once: their smallest piece, their mean difference, their smallest label.  Null
    ids, null and empty texts and labels other than 0 and 1 are ignored; where that half has one label only, all rows fit the curve; without rows of both labels all scores are
    the share of label 1 (0.5 without any row).
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.min(label).alias("label"))
    n = {0: 0, 1: 0} | {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    prior = n[1] / (n[0] + n[1]) if n[0] or n[1] else 0.5
    picked = [first_by_hash(own.where(F.col("label") == k), "doc_id", rows) for k in (0, 1)]
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    ids = F.broadcast(picked[0].union(picked[1]).withColumn("half", half))
    texts = documents.where(F.length("text") > 0).select("doc_id", F.col("text").alias("_text")).join(ids, "doc_id")
    places = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("_text") - _PIECE, F.lit(1))) + 1 for k in range(_PIECES)]
    cut = texts.where("half = 0").select("doc_id", "label", F.array(*[F.substring("_text", p.cast("int"), F.lit(_PIECE)) for p in places]).alias("pieces"))
    cut = cut.groupBy("doc_id", "label").agg(F.min("pieces").alias("pieces")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    good, bad = (b"".join(r.pieces[k].encode() for k in range(_PIECES) for r in cut if r.label == kind)[:dictionary] for kind in (1, 0))
    if not good or not bad:
        return Model(b"", b"", [], prior)
    rows_of = lambda t: _differences(t.select("doc_id", "label", "_text"), good, bad).groupBy("doc_id", "label").agg(F.avg("difference").alias("difference"), F.avg("relative").alias("relative")).orderBy("doc_id").collect()
    seen = rows_of(texts.where("half = 1"))
    if len({r.label for r in seen}) < 2:
        seen = rows_of(texts)
    x, y = np.array([[r.difference, r.relative] for r in seen]), np.array([float(r.label) for r in seen])
    weight = np.where(y == 1, n[1] / (y == 1).sum(), n[0] / (y == 0).sum())
    return Model(good, bad, _fit_curve(x, y, weight / weight.mean()), prior)


def score(documents: DataFrame, model: Model, keep: dict[str, Column], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per document: ``keep``, difference, relative, score in [0, 1] and predicted (1 if score >= threshold).

    Null and empty texts have no difference to go by and score the share of label 1; few bytes say little, so the curve's argument is
    drawn to that share, by half at EVIDENCE bytes and by a sixteenth at four times as many.  An empty table gives no rows; extra columns are ignored.  Long texts are read whole, block
    by block.  Rows are scored each by itself, so equal rows score equal.  One narrow pass; nothing is shuffled.
    """
    good, bad, weights, prior = model.good, model.bad, np.array(model.weights), model.prior
    made: list[_Sizer] = []

    def scan(texts: list[bytes]) -> dict[str, pa.Array]:
        x, s = np.zeros((len(texts), 2)), np.full(len(texts), prior)
        if len(weights):
            if not made:
                made.append(_Sizer(good, bad))
            some = np.array([bool(t) for t in texts], bool)
            x[some] = np.array([made[0].differences(t) for t in texts if t]).reshape(-1, 2)
            size = np.array([len(t) for t in texts if t], float)
            s[some] = _drawn(_curve(x[some], weights), prior, size**2 / (size**2 + EVIDENCE**2))
        return {"difference": pa.array(x[:, 0]), "relative": pa.array(x[:, 1]), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return text_map(with_text(documents, text, keep), "_text", scan, "difference double, relative double, score double, predicted int")
