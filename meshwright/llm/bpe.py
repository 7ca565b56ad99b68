"""Byte-pair encoding and decoding by a pair occurrence index, without a tokenizer library's model.

All distinct pieces of a part of the input lie end to end in one symbol array. An index maps
the rank of every mergeable pair to all positions where the pair stands. Active ranks are
taken in ascending order; a rank is applied to all its positions at once, and only the lists
of the pairs to the left and right of a merge are updated. Pieces are independent, so each
one sees its own merges in exactly the order that merging it alone would give.

Pieces come from the tokenizer file's own rules: canonical composition, lower case, a split
into contractions, letter runs, single digits and runs of other characters, white space
dropped, bytes written as printable characters, an end mark on each piece's last symbol.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release, slices, utf8
from .tokens import PIECE, PLAIN, byte_characters, look_up, take_runs, vocabulary

#: Text and distinct pieces taken up at a time by a task.
PART_BYTES, PART_PIECES = 6 << 20, 300_000


class PairIndexEncoder:
    """Encodes pieces with the merges of a tokenizer file; one for each file in a worker."""

    _made: dict[str, PairIndexEncoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = vocab | self.special
        self.names: list[bytes] = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name.encode()
        self.flat_names = np.frombuffer(b"".join([x + b" " for x in self.names]), np.uint8)
        self.name_sizes = np.array([len(x) + 1 for x in self.names], np.int64)
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.end] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64)
        self.width = len(self.names) + 1
        key = left * self.width + right
        self.by_key = np.argsort(key, kind="stable")
        self.keys = key[self.by_key]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.equal = left == right
        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> PairIndexEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 without one (also where a symbol is -1)."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.by_key[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of non-empty pieces of raw bytes."""
        out: list[np.ndarray] = []
        for i in range(0, len(pieces), PART_PIECES):
            out += self._encode_part(pieces[i : i + PART_PIECES])
        return out

    def _encode_part(self, pieces: list[bytes]) -> list[np.ndarray]:
        size = np.array([len(p) for p in pieces], np.int64)
        end = np.cumsum(size)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        sym = self.inner[raw]
        sym[end - 1] = self.last[raw[end - 1]]
        # links inside pieces; position n stands for "none" and has symbol -1
        sym = np.append(sym, -1)
        nxt = np.arange(1, n + 2)
        nxt[end - 1] = n
        nxt[n] = n
        prv = np.arange(-1, n)
        prv[np.concatenate([[0], end[:-1]])] = n
        prv = np.append(prv, n)
        alive = np.ones(n + 1, bool)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(positions: np.ndarray) -> None:
            """Enter the pairs that begin at ``positions`` in the lists of their ranks."""
            rank = self._ranks(sym[positions], sym[nxt[positions]])
            have = rank >= 0
            rank, positions = rank[have], positions[have]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, positions = rank[order], positions[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(positions, cut), strict=True):
                if r in lists:
                    lists[r].append(part)
                else:
                    lists[r] = [part]
                    heapq.heappush(active, r)

        index(np.arange(n))
        while active:
            r = heapq.heappop(active)
            at = lists.pop(r)
            pos = at[0] if len(at) == 1 else np.concatenate(at)
            second = nxt[pos]
            pos = pos[alive[pos] & (self._ranks(sym[pos], sym[second]) == r)]
            if not len(pos):
                continue
            pos = np.unique(pos)
            if self.equal[r] and len(pos) > 1:
                # in a run of overlapping places every other one merges, from the left
                follows = np.concatenate([[False], nxt[pos[:-1]] == pos[1:]])
                begin = np.maximum.accumulate(np.where(~follows, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - begin) % 2 == 0]
            gone = nxt[pos]
            after = nxt[gone]
            alive[gone] = False
            sym[pos] = self.made[r]
            nxt[pos] = after
            prv[after] = pos
            prv[n] = n
            before = prv[pos]
            index(np.unique(np.concatenate([before[before < n], pos[after < n]])))
        ids = sym[:n][alive[:n]].astype("<u4")
        return np.split(ids, np.cumsum(np.add.reduceat(alive[:n], end - size))[:-1])

    def pieces(self, chunk: str) -> list[bytes | int]:
        """The pieces of a chunk without spaces, as raw bytes; a special token's id stands for itself."""
        if self.special_split is not None and "<" in chunk:
            out: list[bytes | int] = []
            for part in self.special_split.split(chunk):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += self._plain_pieces(part)
            return out
        return self._plain_pieces(chunk)

    def _plain_pieces(self, chunk: str) -> list[bytes | int]:
        if PLAIN.fullmatch(chunk):
            return [p.encode() for p in PIECE.findall(chunk.lower())]
        # other characters: the library's rules for composition, case and character classes
        low = self.library.normalizer.normalize_str(chunk)
        back = _unprintable()
        return [bytes(map(back.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(low)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts one after the other and where each text's begin; null counts as empty."""
        return look_up(texts, self.known, self._encode_chunks)

    def _encode_chunks(self, missing: list[str]) -> list[bytes]:
        cut = [self.pieces(c) for c in missing]
        distinct = list({p for parts in cut for p in parts if isinstance(p, bytes)})
        ids = {p: x.tobytes() for p, x in zip(distinct, self.encode_pieces(distinct), strict=True)}
        return [b"".join([ids[p] if isinstance(p, bytes) else np.array([p], "<u4").tobytes() for p in parts]) for parts in cut]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts (UTF-8) of ids, one after the other with a space behind each, and where each begins.

        The file has no decoder, so token names stand with spaces between.
        """
        text, ends = take_runs(self.flat_names, self.name_sizes, ids)
        return text, ends[at]


_back: dict[str, int] = {}


def _unprintable() -> dict[str, int]:
    if not _back:
        _back.update({c: b for b, c in enumerate(byte_characters())})
    return _back


def _round_trip(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder.of(path)
        for batch in batches:
            _, offs = utf8(batch.column(1))
            for i, j in slices(offs, PART_BYTES):
                part = batch.slice(i, j - i)
                ids, at = encoder.encode(part.column(1))
                text, begin = encoder.decode(ids, at)
                raw, decoded = memoryview(ids.tobytes()), memoryview(text.tobytes())
                each = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                # the space behind the last token is no part of a text
                named = [decoded[a : max(a, b - 1)] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                cols = [
                    part.column(0),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in named], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array(list(map(bytes, each)), pa.binary()), pa.array([str(x, "utf-8") for x in named], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
            release()

    return run


def encode_and_decode(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row (and ids, decoded).

    The hashes are of the ids as little-endian uint32 and of the decoded text in UTF-8. A
    null text counts as empty: no ids, empty decoded text. Repeated rows are encoded alike;
    an empty table gives no rows; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids binary, decoded string"
    return docs.select("doc_id", "text").mapInArrow(_round_trip(tokenizer or vocabulary(), with_ids), schema)
