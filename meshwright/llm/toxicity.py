"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters (ASCII letters and all bytes above 127), lower-cased. Features of
a text are its distinct words, word pairs, and pairs with one word between them, hashed.
McMahan et al., "Ad Click Prediction" (2013): rates by coordinate, L1 sparsity. The few
weights that are not zero are what executors get: at most ``FEATURES`` of 12 bytes.

Training reads at most ``SAMPLE`` labelled documents of each class; scoring reads all of
every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_sample, fold, map_texts, sampled_texts, slices, utf8
from .wordhash import LOWER, mix, span_hashes, word_spans

#: Labelled documents of each class that are learnt from; feature space; score from which a text counts as toxic.
SAMPLE, FEATURES, TOXIC = 2048, 1 << 20, 0.7
_SEPARATOR = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(44)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every occurrence of a word, pair or skip pair."""
    data = LOWER[data]
    starts, ends, doc = word_spans(data, offsets, _SEPARATOR)
    h = span_hashes(data, starts, ends)
    docs, feats = [doc], [h >> _SHIFT]
    for gap, seed in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            feats.append(mix(h[:-gap][same] * seed + h[gap:][same]) >> _SHIFT)
            docs.append(doc[:-gap][same])
    return np.concatenate(docs), np.concatenate(feats).astype(np.int64)


@dataclass
class Model:
    """The weights that are not zero, by feature, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def scorer(self):
        """A function of (bytes, offsets) to scores; the dense table is made once for a task."""
        table = np.zeros(FEATURES, np.float64)
        table[self.index] = self.weight

        def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            n = len(offsets) - 1
            doc, feat = features(data, offsets)
            hit = table[feat] != 0
            keys = np.unique(doc[hit] * FEATURES + feat[hit])  # presence, not frequency
            total = np.bincount(keys // FEATURES, weights=table[keys % FEATURES], minlength=n) + self.bias
            return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

        return score


def fit_ftrl(
    rows: list[np.ndarray], y: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0, epochs: int = 10, seed: int = 9
) -> Model:
    """FTRL-proximal on binary features; each row holds a text's distinct features."""
    z, n = np.zeros(FEATURES), np.zeros(FEATURES)
    zb = nb = 0.0

    def weights(zi, ni):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    bias = 0.0
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f = rows[i]
            w = weights(z[f], n[f])
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -40, 40)))
            g = p - y[i]
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
    w = weights(z, n)
    index = np.flatnonzero(w)
    return Model(index, w[index], float(-zb / ((beta + np.sqrt(nb)) / alpha)))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = utf8(batch.column(0))
        out = [np.unique(features(data[offs[i] : offs[i + 1]], offs[i : i + 2] - offs[i])[1]).astype(np.int32).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_pydict({"label": batch.column(1), "ids": out}, pa.schema([("label", pa.int32()), ("ids", pa.binary())]))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of each class among labels where ``learn`` holds.

    By default those whose crc32 of the id as text, modulo 3, is not 1. The sample is
    balanced; the bias is then moved to the ratio of the classes among all labels there.
    An id counts once for each class, with the least of its texts where rows repeat it.
    Without both classes the model scores every text by that ratio (0 without labels).
    """
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(True))
    known = labels.where(~held if learn is None else learn).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    number = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(number) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 40.0 if 1 in number else -40.0)
    picked = bounded_sample(known, "toxic", "doc_id", sample)
    rows = sampled_texts(docs.select("doc_id", "text"), picked).mapInArrow(_training_rows, "label int, ids binary").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.ids)))
    y = np.array([r.label for r in rows])
    model = fit_ftrl([np.frombuffer(r.ids, np.int32).astype(np.int64) for r in rows], y)
    in_sample = max(1, int(y.sum())) / max(1, int((1 - y).sum()))
    model.bias += float(np.log(number[1] / number[0]) - np.log(in_sample))
    return model


def _score(model: Model):
    def work():
        score = model.scorer()

        def judge(texts: pa.Array) -> list[pa.Array]:
            data, offs = utf8(texts)
            parts = [score(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs)]
            return [pa.array(np.concatenate([*parts, np.zeros(0)]))]

        return judge

    return work


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], toxic: float = TOXIC) -> DataFrame:
    """The columns ``keep`` of every row, score (0 to 1) and predicted (1 from ``toxic`` on).

    Null and empty texts have no features and get the score of the bias. Repeated rows get
    equal scores; an empty table gives no rows. A kept column called like a result gives way.
    """
    out = map_texts(docs, [c for c in keep if c != "predicted"], _score(model), "score double")
    return out.withColumn("predicted", (F.col("score") >= toxic).cast("int"))


def rate_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learnt from the labels not held out."""
    model = train(docs, labels, sample=sample)
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return score_toxicity(docs.select("doc_id", held, "text"), model, ["doc_id", "held_out"])
