"""Language identification by error-correcting output codes.

Every language has a binary codeword. For each bit a logistic classifier over hashed byte
n-grams of the text's words (orders 1 to 3 of the lower-cased UTF-8, with a separator at
both ends) says how likely the bit is set. A text gets the language whose codeword has the
least loss, the bits weighted by how well their classifiers did on the training sample; the
softmax of the negative losses is the score, and a low score flags the text as ambiguous.

Training reads at most ``SAMPLE`` documents of each language, the same at any input size;
prediction reads all of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_sample, fold, map_texts, sampled_texts, slices, utf8
from .wordhash import LOWER, span_hashes, word_spans

#: Documents of each language that are learnt from; hashed features; score under which a text is ambiguous.
SAMPLE, FEATURES, AMBIGUOUS = 512, 1 << 15, 0.4
#: Documents that are learnt from in all: with very many languages each has a smaller sample.
SAMPLE_IN_ALL = 16_384
#: Text of which each distinct word is looked up once; its words' n-grams take some 60 bytes a byte.
SLICE = 1 << 20
UNKNOWN = "und"
_ORDERS = (1, 2, 3)
_MUL = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k distinct rows of bits: the exhaustive code up to 6 classes, else a random code.

    The exhaustive code has 2 ** (k - 1) - 1 columns, every split of the classes once. The
    random one keeps the widest-spaced of 64 drawn codes of 10 log2(k) columns.
    """
    if k == 1:
        return np.ones((1, 1), bool)
    if k <= 6:
        splits = np.arange(1, 1 << (k - 1))
        return np.stack([np.zeros(len(splits), bool)] + [(splits >> i & 1).astype(bool) for i in range(k - 1)])
    rng = np.random.Generator(np.random.PCG64(seed))
    width, best, gap = int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(64):
        code = rng.random((k, width)) < 0.5
        near = (code[:, None] != code[None]).sum(2)
        least = near[~np.eye(k, dtype=bool)].min()
        if least > gap and code.any(0).all() and not code.all(0).any():
            best, gap = code, least
    if best is None:
        raise ValueError("no code found")
    return best


def word_buffer(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given words one after the other, a separator before each and after the last, and where each one's separator is."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1] + 1, 0x20, np.uint8)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at[:-1] + 1, size) + inner] = data[np.repeat(starts, size) + inner]
    return out, at[:-1]


def ngram_features(buffer: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order (positions, hashed features) of the n-grams of a word buffer.

    N-grams lie in one word with the separators at its ends; an n-gram stands at its first byte.
    """
    b = buffer.astype(np.uint32)
    gap = buffer == 0x20
    out = []
    for order in _ORDERS:
        n = max(0, len(b) - order + 1)
        h = np.full(n, np.uint32(order * 97))
        for k in range(order):
            h = (h ^ b[k : k + n]) * _MUL[k]
        whole = ~gap[:n] if order == 1 else np.ones(n, bool)
        for k in range(1, order - 1):
            whole &= ~gap[k : k + n]
        at = np.flatnonzero(whole)
        out.append((at, ((h ^ (h >> np.uint32(15))) & np.uint32(FEATURES - 1)).astype(np.int64)[at]))
    return out


_CLASS = LOWER.copy()
_CLASS[[c for c in range(128) if not chr(c).isalpha()]] = 0x20
_GAP = np.arange(256) == 0x20


@dataclass
class Model:
    """Languages in order, their codewords, feature weights (FEATURES x bits), biases and bit weights."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bit margins of every document from the n-grams of all its words.

        A word's n-grams are summed once for the slice, however often the word occurs.
        """
        n_docs, bits = len(offsets) - 1, len(self.bias)
        b = _CLASS[data]
        starts, ends, doc = word_spans(b, offsets, _GAP)
        total, count = np.zeros((n_docs, bits)), np.zeros(n_docs)
        if len(starts):
            _, first, each = np.unique(span_hashes(b, starts, ends), return_index=True, return_inverse=True)
            buffer, at = word_buffer(b, starts[first], ends[first])
            value, number = np.zeros((len(buffer), bits), np.float32), np.zeros(len(buffer), np.float32)
            for pos, feats in ngram_features(buffer):
                value[pos] += self.weights[feats]
                number[pos] += 1
            value, number = np.add.reduceat(value, at), np.add.reduceat(number, at)
            full = np.flatnonzero(np.bincount(doc, minlength=n_docs))
            cut = np.searchsorted(doc, full)
            total[full] = np.add.reduceat(value[each], cut, dtype=np.float64)
            count[full] = np.add.reduceat(number[each], cut, dtype=np.float64)
        return total / np.sqrt(np.maximum(count, 1))[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index, score) by loss-weighted decoding."""
        signs = np.where(self.code, 1.0, -1.0)
        loss = np.logaddexp(0, -margins[:, None, :] * signs[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        return best, p[np.arange(len(p)), best]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sampled documents: the distinct features and how often each occurs."""
    for batch in batches:
        data, offs = utf8(batch.column(0))
        ids, values = [], []
        for i in range(batch.num_rows):
            own = _CLASS[data[offs[i] : offs[i + 1]]]
            starts, ends, _ = word_spans(own, np.array([0, len(own)]), _GAP)
            feats = np.concatenate([f for _, f in ngram_features(word_buffer(own, starts, ends)[0])]) if len(starts) else np.zeros(0, np.int64)
            u, c = np.unique(feats, return_counts=True)
            ids.append(u.astype(np.int32))
            values.append((c / np.sqrt(max(len(feats), 1))).astype(np.float32))
        yield pa.RecordBatch.from_pydict(
            {"label": batch.column(1), "ids": [x.tobytes() for x in ids], "vals": [x.tobytes() for x in values]},
            pa.schema([("label", pa.string()), ("ids", pa.binary()), ("vals", pa.binary())]),
        )


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE, epochs: int = 6) -> Model | None:
    """Fit on at most ``sample`` documents of each language among rows where ``learn`` holds.

    Languages are the distinct non-null values there. None if there are none. An id counts
    once for each language, with the least of its texts. Beyond ``SAMPLE_IN_ALL // sample``
    languages each has a smaller sample, so that what the driver gathers has a bound.
    """
    number = docs.where(learn).agg(F.approx_count_distinct("lang").alias("n")).first().n
    known = docs.where(learn).where("text is not null")
    picked = bounded_sample(known, "lang", "doc_id", max(1, min(sample, SAMPLE_IN_ALL // max(1, number))))
    rows = sampled_texts(known.select("doc_id", "text", "lang"), picked, with_label=True).mapInArrow(_counts, "label string, ids binary, vals binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, bytes(r.ids), bytes(r.vals)))
    languages = sorted({r.label for r in rows})
    code = codewords(len(languages))
    y = np.array([languages.index(r.label) for r in rows])
    ids = [np.frombuffer(r.ids, np.int32) for r in rows]
    vals = [np.frombuffer(r.vals, np.float32) for r in rows]
    bits = code.shape[1]
    w, bias, seen = np.zeros((FEATURES, bits), np.float32), np.zeros(bits), np.full((FEATURES, 1), 1e-3, np.float32)
    seen_bias = 1e-3
    weight = len(rows) / (len(languages) * np.bincount(y, minlength=len(languages)))
    rng = np.random.Generator(np.random.PCG64(5))
    goal = code.astype(np.float64)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, v = ids[i], vals[i]
            m = v @ w[f] + bias
            g = (1 / (1 + np.exp(-m)) - goal[y[i]]) * weight[y[i]]
            step = v[:, None] * g[None]
            seen[f, 0] += (v**2).astype(np.float32)
            w[f] -= (0.1 * step / np.sqrt(seen[f])).astype(np.float32)
            seen_bias += 1
            bias -= 0.1 * g / np.sqrt(seen_bias)
    right = np.zeros(bits)
    for i in range(len(rows)):
        right += ((vals[i] @ w[ids[i]] + bias > 0) == code[y[i]]) * weight[y[i]]
    err = np.clip(1 - right / len(rows), 1e-3, 0.5)
    trust = np.log((1 - err) / err)
    trust = trust / trust.sum() if trust.sum() > 0 else np.full(bits, 1 / bits)
    # losses are summed over as many bits as tell two languages apart
    return Model(languages, code, w, bias, trust * bits)


def _predict(model: Model | None):
    def judge(texts: pa.Array) -> list[pa.Array]:
        data, offs = utf8(texts)
        langs, scores = [], []
        for i, j in slices(offs, SLICE):
            part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            lettered = _has_letter(part, at, texts.slice(i, j - i))
            if model is None:
                langs += [UNKNOWN] * (j - i)
                scores += [0.0] * (j - i)
                continue
            best, score = model.decode(model.margins(part, at))
            langs += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            scores += [float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)]
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return lambda: judge


_ASCII_LETTER = np.zeros(256, np.int64)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1


def _has_letter(data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter: an ASCII one, else any of Unicode's."""
    run = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = run[offsets[1:]] > run[offsets[:-1]]
    for k in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[k] = any(map(str.isalpha, texts[int(k)].as_py()))
    return out


def predict_language(docs: DataFrame, model: Model | None, keep: list[str], ambiguous: float = AMBIGUOUS) -> DataFrame:
    """The columns ``keep`` of every row, lang_pred, score (0 to 1) and ambiguous.

    A null text and one without a letter get ``und``, score 0 and the flag. Without a model
    (nothing to learn from) every text does. A kept column called like a result gives way.
    """
    out = map_texts(docs, [c for c in keep if c != "ambiguous"], _predict(model), "lang_pred string, score double")
    return out.withColumn("ambiguous", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < ambiguous))


def identify_languages(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document.

    Learns where ``learn`` holds (by default: crc32 of the id as text, modulo 4, is not 2)
    from text and non-null lang alone. Repeated rows, null ids and an empty table are fine;
    a row with a null id is not learnt from and counts as not held out. Other columns are
    ignored; the whole of a very long text is read.
    """
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = train(docs, ~held if learn is None else learn, sample)
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return predict_language(rows, model, ["doc_id", "held_out"])
