"""Quality rules: fixed base rules on words, then line labelling by a conditional random field.

Lines are labelled content or boilerplate by Viterbi decoding of a linear-chain conditional
random field over features of each line (case, symbols, repetition, length, duplicates).
A document stays if its base rules hold and enough of its word characters lie in lines
labelled content.

The field is trained here, on line sequences of at most ``SAMPLE`` labelled documents of
each quality. Labels are of documents, not lines, so training alternates: lines of good
documents are content; in bad documents the line labels start from a simple repetition and
symbol rule and are then re-decoded by the field so far, kept only where at least one line
is boilerplate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, map_texts, sampled_texts, slices, utf8

#: Labelled documents of each quality that are learnt from; least share of content to stay.
SAMPLE, LEAST_CONTENT = 1024, 0.5
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
N_FEATURES = 18


def split_words(text: str) -> tuple[list[str], list[list[str]]]:
    """The lines of a text and the words of each; a line feed separates words, so none crosses lines."""
    lines = text.split("\n")
    return lines, [WORD.findall(line) for line in lines]


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 5-word window which the sequence has twice or more, first ones included."""
    if len(words) < 6:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words], np.int64)
    if len(number) <= 4096:  # five ids fit in a long
        keys = ids[:-4]
        for k in range(1, 5):
            keys = keys << 12 | ids[k : len(ids) - 4 + k]
        distinct, each, often = np.unique(keys, return_inverse=True, return_counts=True)
    else:
        distinct, each, often = np.unique(np.stack([ids[k : len(ids) - 4 + k] for k in range(5)], 1), axis=0, return_inverse=True, return_counts=True)
    if len(distinct) == len(each):
        return 0
    begins = np.flatnonzero(often[each.ravel()] > 1)
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + 5, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    return _base(text, *split_words(text))


def _base(text: str, lines: list[str], by_line: list[list[str]]) -> tuple[int, int, int, int, int]:
    seen: set[str] = set()
    dup = 0
    for line, words in zip(lines, by_line, strict=True):
        if words:
            dup += line in seen
            seen.add(line)
    words = [w for part in by_line for w in part]
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeated_words(words)


#: By code point: 1 for a letter, 2 for an upper-case one, 4 for a digit. What lies beyond counts as a letter.
_KIND = np.array([(chr(c).isalpha()) + 2 * chr(c).isupper() + 4 * chr(c).isdigit() for c in range(0x3000)] + [1], np.uint8)
_MARK = re.compile("[^\\w.,;:'\")]|_")


def line_features(lines: list[str], by_line: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word x N_FEATURES of 0 to 1, word characters of each); other lines are left out."""
    rows, weight = [], []
    counts = Counter(lines)
    everything = Counter(w for words in by_line for w in words)
    total = max(1, sum(everything.values()))
    commonest = max(everything.values()) / total if everything else 0.0
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND[np.minimum(codes, 0x3000)]
    ends = np.cumsum([len(line) + 1 for line in lines]) - 1
    per_line = [np.diff(np.concatenate([[0], np.cumsum((kind & bit) > 0)])[np.concatenate([[0], ends])]).tolist() for bit in (1, 2, 4)]
    seen: set[str] = set()
    for line, words, letters, upper, digits in zip(lines, by_line, *per_line, strict=True):
        if not words:
            continue
        chars = sum(map(len, words))
        n = len(words)
        symbols = len(SYMBOL.findall(line))
        distinct = len(set(words)) / n
        marked = len(_MARK.findall("".join([w[-1] for w in words]))) / n
        rows.append(
            (
                1.0,
                symbols / chars,
                min(1.0, 4 * symbols / chars),
                upper / max(1, letters),
                float(letters > 0 and upper > 0.6 * letters),
                min(1.0, 8 * line.count("!") / chars),
                marked,
                1 - distinct if n >= 5 else 0.0,
                float(n >= 20 and distinct < 0.3),
                float(counts[line] > 1),
                float(line in seen),
                digits / chars,
                1 - letters / max(1, chars),
                min(1.0, n / 40),
                float(n < 4),
                float(words[-1][-1] in ".!?"),
                min(1.0, 4 * words.count("|") / n),
                commonest,
            )
        )
        weight.append(chars)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, N_FEATURES), np.array(weight, np.float64)


@dataclass
class ChainField:
    """A linear-chain conditional random field with labels 0 content and 1 boilerplate."""

    emit: np.ndarray  # N_FEATURES x 2
    move: np.ndarray  # 2 x 2, from x to

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels of a sequence of feature rows."""
        scores = x @ self.emit
        n = len(scores)
        back = np.zeros((n, 2), np.int8)
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0].tolist() if n else (0.0, 0.0)
        for i, (s0, s1) in enumerate(scores[1:].tolist(), 1):
            stay, come = a + m00, b + m10
            go, keep = a + m01, b + m11
            back[i] = (come > stay, keep > go)
            a, b = max(stay, come) + s0, max(go, keep) + s1
        out = np.zeros(n, np.int64)
        if n:
            out[-1] = int(b > a)
            for i in range(n - 1, 0, -1):
                out[i - 1] = back[i, out[i]]
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log-likelihood of labels ``y``: by emit, by move, and its value."""
        s = x @ self.emit
        n = len(s)
        fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
        fwd[0] = s[0]
        for i in range(1, n):
            fwd[i] = np.logaddexp(fwd[i - 1, 0] + self.move[0], fwd[i - 1, 1] + self.move[1]) + s[i]
        for i in range(n - 2, -1, -1):
            t = self.move + s[i + 1] + bwd[i + 1]
            bwd[i] = np.logaddexp(t[:, 0], t[:, 1])
        z = np.logaddexp(*fwd[-1])
        node = np.exp(fwd + bwd - z)
        want = np.zeros((n, 2))
        want[np.arange(n), y] = 1
        d_move = np.zeros((2, 2))
        value = s[np.arange(n), y].sum() - z
        if n > 1:
            np.add.at(d_move, (y[:-1], y[1:]), 1)
            value += self.move[y[:-1], y[1:]].sum()
            pair = np.exp(fwd[:-1, :, None] + self.move[None] + (s[1:] + bwd[1:])[:, None, :] - z)
            d_move -= pair.sum(0)
        return x.T @ (want - node), d_move, float(value)


def _fit(seqs: list[np.ndarray], labels: list[np.ndarray], field: ChainField, rounds: int, rng: np.random.Generator) -> None:
    """Stochastic ascent with per-coordinate rates and a little ridge."""
    g_emit, g_move = np.full(field.emit.shape, 1e-2), np.full(field.move.shape, 1e-2)
    for _ in range(rounds):
        for i in rng.permutation(len(seqs)):
            d_emit, d_move, _ = field.gradient(seqs[i], labels[i])
            scale = 1 / np.sqrt(len(labels[i]))  # long documents shall not outweigh the others
            d_emit, d_move = d_emit * scale - 1e-3 * field.emit, d_move * scale - 1e-3 * field.move
            g_emit += d_emit**2
            g_move += d_move**2
            field.emit += 0.3 * d_emit / np.sqrt(g_emit)
            field.move += 0.3 * d_move / np.sqrt(g_move)


def _plain_rule(x: np.ndarray) -> np.ndarray:
    """A first guess for lines of bad documents: symbols, capitals, repetition, tables."""
    return ((x[:, 2] > 0.2) | (x[:, 4] > 0) | (x[:, 5] > 0.3) | (x[:, 8] > 0) | (x[:, 9] > 0) | (x[:, 16] > 0.2)).astype(np.int64)


def fit_field(seqs: list[np.ndarray], good: list[bool], rounds: int = 3) -> ChainField:
    """The field from line sequences of documents known to be good or bad."""
    rng = np.random.Generator(np.random.PCG64(3))
    field = ChainField(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    labels = [np.zeros(len(x), np.int64) if g else _plain_rule(x) for x, g in zip(seqs, good, strict=True)]
    for _ in range(2):
        use = [i for i, (y, g) in enumerate(zip(labels, good, strict=True)) if g or y.any()]
        if not use:
            break
        _fit([seqs[i] for i in use], [labels[i] for i in use], field, rounds, rng)
        labels = [y if g else np.maximum(field.viterbi(x), 0) for x, y, g in zip(seqs, labels, good, strict=True)]
    return field


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [line_features(*split_words(t))[0].astype(np.float32) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"label": batch.column(1), "rows": [r.tobytes() for r in rows]}, pa.schema([("label", pa.int32()), ("rows", pa.binary())]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ChainField:
    """Fit on at most ``sample`` documents of each labelled quality (doc_id, quality 0 or 1).

    An id counts once for each quality, with the least of its texts where rows repeat it. Without a labelled document the plain rule's weights are not learnt and nothing is
    boilerplate.
    """
    picked = bounded_sample(labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)"), "quality", "doc_id", sample)
    got = sampled_texts(docs.select("doc_id", "text"), picked).mapInArrow(_sequences, "label int, rows binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.rows)))
    seqs = [np.frombuffer(r.rows, np.float32).reshape(-1, N_FEATURES).astype(np.float64) for r in got]
    use = [i for i, x in enumerate(seqs) if len(x)]
    return fit_field([seqs[i] for i in use], [got[i].label == 1 for i in use])


def _judge(field: ChainField, least: float):
    def judge(texts: pa.Array) -> list[pa.Array]:
        out: list[tuple] = []
        _, offs = utf8(texts)
        for i, j in slices(offs):
            for text in texts.slice(i, j - i).to_pylist():
                lines, by_line = split_words(text or "")
                n, chars, symbols, dup, repeat = _base(text or "", lines, by_line)
                failed = n < 10 or 100 * repeat > 20 * n
                share = 0.0
                if n:
                    x, w = line_features(lines, by_line)
                    share = float(w[field.viterbi(x) == 0].sum() / w.sum())
                out.append((n, chars, symbols, dup, repeat, failed, not failed and share >= least, share))
        cols = list(zip(*out, strict=True)) or [()] * 8
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        return [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]

    return lambda: judge


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def apply_quality_rules(docs: DataFrame, field: ChainField, keep: list[str], least_content: float = LEAST_CONTENT) -> DataFrame:
    """The columns ``keep`` of every row and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, kept, content_share.

    A null text counts as empty: no words, base_failed, content share 0. Repeated rows are
    judged alike; an empty table gives no rows. A kept column called like a result gives way.
    """
    kinds = ["bigint"] * 5 + ["boolean"] * 2 + ["double"]
    return map_texts(docs, keep, _judge(field, least_content), ", ".join(f"{n} {k}" for n, k in zip(RESULTS, kinds, strict=True)))
