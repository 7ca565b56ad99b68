"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once.

The tokenizers of this kind (normalise, drop white space, split, byte-pair merge inside a
piece) never let a token cross white space, so a text's ids are the ids of its
space-separated chunks, one after the other. Only characters that every definition of
white space has (space, tab, line feed, carriage return) cut chunks here; what else is in
a chunk, special tokens included, is left to the library. Chunks met before are looked up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices, utf8
from .wordhash import word_spans

#: Chunks kept by one Python worker: the first so many that are short. Frequent ones come early.
CACHE_ENTRIES, CACHE_CHUNK = 400_000, 64
#: Pieces that the library's model is given at a time.
RUN = 256
#: Chunks whose characters need no composition and have plain classes: ASCII and precomposed Latin letters.
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
#: Fixed value: the split pattern of the file, for plain characters in lower case.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer file installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character of each byte: itself if it is visible Latin-1, else the next from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


#: The bytes that cut chunks.
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x09, 0x0A, 0x0D]] = True


def chunk_column(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct non-empty parts of texts between spaces, tabs and line ends, which of them each part is, and where each text's parts begin."""
    starts, ends, doc = word_spans(data, offsets, _CUT)
    size = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    kept = np.ascontiguousarray(data[~_CUT[data]])
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(size), pa.py_buffer(kept))
    coded = parts.dictionary_encode()
    whole = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
    distinct = pc.binary_join(whole, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n") if len(coded.dictionary) else []
    return distinct, coded.indices.to_numpy(), np.searchsorted(doc, np.arange(len(offsets)))


def take_runs(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` (of ``sizes``, one after the other) in the order ``which``, and the ends of each, from 0 on."""
    n = sizes[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    shift = (np.cumsum(sizes) - sizes)[which] - ends[:-1]
    return flat[np.arange(ends[-1]) + np.repeat(shift, n)], ends


def look_up(texts: pa.Array, known: dict[str, bytes], encode: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and where each text's begin (and the last ends).

    Distinct chunks are looked up once; unknown ones are encoded once and kept while there is room.
    """
    data, offsets = utf8(texts)
    all_ids, at, before = [], [np.zeros(1, np.int64)], 0
    for i, j in slices(offsets):
        distinct, which, first = chunk_column(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        found = list(map(known.get, distinct))
        open_ = [k for k, x in enumerate(found) if x is None]
        if open_:
            missing = [distinct[k] for k in open_]
            new = encode(missing)
            for k, x in zip(open_, new, strict=True):
                found[k] = x
            room = max(0, CACHE_ENTRIES - len(known))
            known.update([(c, x) for c, x in zip(missing, new, strict=True) if len(c) <= CACHE_CHUNK][:room])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, ends = take_runs(np.frombuffer(b"".join(found), "<u4"), sizes, which)
        all_ids.append(ids)
        at.append(ends[first[1:]] + before)
        before += len(ids)
    return np.concatenate([*all_ids, np.zeros(0, np.uint32)]).astype("<u4", copy=False), np.concatenate(at)


class ChunkEncoder:
    """Encodes texts to little-endian uint32 ids, ``add_special_tokens=False``."""

    _made: dict[str, ChunkEncoder] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        # the merges alone, for pieces that are cut and normalised here
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix, names = self.library.model.end_of_word_suffix, self.library.get_vocab()
        self.is_last = np.zeros(max(names.values()) + 1, bool)
        self.is_last[[i for name, i in names.items() if suffix and name.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.printable = dict(enumerate(byte_characters()))

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """The worker's encoder for this file; workers are reused between tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts one after the other and where each text's begin; null counts as empty."""
        return look_up(texts, self.known, self._encode_chunks)

    def encode_documents(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, with the id ``end`` after each text."""
        ids, at = self.encode(texts)
        return np.insert(ids, at[1:], np.uint32(end)), at + np.arange(len(at))

    def _encode_chunks(self, missing: list[str]) -> list[bytes]:
        """Ids of chunks: plain ones piece by piece by the library's model, others by the whole library."""
        cut: list[list[str] | None] = []
        for c in missing:
            if not PLAIN.fullmatch(c) or "<|" in c:  # a special token may stand there
                cut.append(None)
            else:
                cut.append([c.lower()] if c.isalpha() else PIECE.findall(c.lower()))
        pieces = self.pieces
        if len(pieces) > CACHE_ENTRIES:
            pieces.clear()
        new = list({p for parts in cut if parts is not None for p in parts if p not in pieces})
        pieces.update(zip(new, self._merge(new), strict=True))
        other = [c for c, parts in zip(missing, cut, strict=True) if parts is None]
        rest = iter(self.library.encode_batch_fast(other, add_special_tokens=False) if other else ())
        return [np.array(next(rest).ids, "<u4").tobytes() if parts is None else pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts]) for parts in cut]

    def _merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of plain pieces: the model alone on runs of pieces, which end where a token with the end mark stands."""
        seen = [p if p.isascii() else p.encode().decode("latin-1").translate(self.printable) for p in pieces]
        runs = self.model.encode_batch_fast([" ".join(seen[i : i + RUN]) for i in range(0, len(seen), RUN)], add_special_tokens=False)
        ids = np.array([x for r in runs for x in r.ids], "<u4")
        ends = (4 * (np.flatnonzero(self.is_last[ids]) + 1)).tolist()
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer file has no end mark on each piece")
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
