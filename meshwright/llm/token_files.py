"""Token files: fixed-size blocks of ids, shuffled into byte planes, zstandard by plane, with an index.

Layout of one file (all integers little-endian):

    magic "MWTK", version u32, block length u32 (ids in a block), number of ids u64
    blocks: for each block its four byte planes, least significant first, each one
            zstandard frame; a plane of zeros is stored with length 0
    index:  for each block, offset u64 of its first plane and four plane lengths u32
    documents: number u64, then zstandard frames of their ids' ends (u64, cumulative)
            and keys (i64), and one byte of validity for each key
    footer: offsets u64 of index and documents, magic

A reader can decode any block alone. Files are rows (name, base, content) of a Parquet
table in the shared folder, so Spark's commit protocol covers them and they lie in any
store that Spark can reach; :func:`export_files` gives plain files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.storage import materialize
from .common import release
from .ordering import order_buckets
from .tokens import ChunkEncoder, vocabulary

MAGIC, VERSION, BLOCK, END, LEVEL = b"MWTK", 1, 1 << 16, 2, 1


def write_file(ids: np.ndarray, ends: np.ndarray, keys: list[int | None], block: int = BLOCK, level: int = LEVEL) -> bytes:
    """The file of a run of documents: ``ids`` uint32, ``ends`` cumulative, one key each."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level).compress
    out = [struct.pack("<4sIIQ", MAGIC, VERSION, block, len(ids))]
    at, index = len(out[0]), []
    for i in range(0, len(ids), block):
        planes = np.ascontiguousarray(ids[i : i + block].astype("<u4").view(np.uint8).reshape(-1, 4).T)
        parts = [press(p.tobytes()) if p.any() else b"" for p in planes]
        index.append(struct.pack("<Q4I", at, *map(len, parts)))
        out += parts
        at += sum(map(len, parts))
    index_at = at
    out += index
    at += sum(map(len, index))
    key = np.array([0 if k is None else k for k in keys], "<i8")
    valid = np.array([k is not None for k in keys], np.uint8)
    frames = [press(ends.astype("<u8").tobytes()), press(key.tobytes()), press(valid.tobytes())]
    out += [struct.pack("<Q3I", len(keys), *map(len, frames)), *frames, struct.pack("<QQ4s", index_at, at, MAGIC)]
    return b"".join(out)


class TokenFile:
    """Random access to the blocks and documents of one file."""

    def __init__(self, content: bytes) -> None:
        import zstandard

        self._get = zstandard.ZstdDecompressor().decompress
        self.raw = memoryview(content)
        magic, version, self.block, self.n_ids = struct.unpack_from("<4sIIQ", self.raw)
        index_at, docs_at, end = struct.unpack_from("<QQ4s", self.raw, len(content) - 20)
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        self.index = [struct.unpack_from("<Q4I", self.raw, index_at + 24 * i) for i in range(-(-self.n_ids // self.block))]
        n, *sizes = struct.unpack_from("<Q3I", self.raw, docs_at)
        at, frames = docs_at + 20, []
        for s in sizes:
            frames.append(self._get(self.raw[at : at + s]) if n else b"")
            at += s
        self.ends = np.frombuffer(frames[0], "<u8").astype(np.int64)
        valid = np.frombuffer(frames[2], np.uint8)
        self.keys = [int(k) if v else None for k, v in zip(np.frombuffer(frames[1], "<i8"), valid, strict=True)]

    def read_block(self, i: int) -> np.ndarray:
        at, *sizes = self.index[i]
        n = min(self.block, self.n_ids - i * self.block)
        planes = np.zeros((4, n), np.uint8)
        for p, s in enumerate(sizes):
            if s:
                planes[p] = np.frombuffer(self._get(self.raw[at : at + s]), np.uint8)
            at += s
        return np.ascontiguousarray(planes.T).view("<u4").ravel()

    def document(self, i: int) -> np.ndarray:
        """The ids of document i: only the blocks that hold them are decoded."""
        a, b = (int(self.ends[i - 1]) if i else 0), int(self.ends[i])
        blocks = range(a // self.block, max(a // self.block, -(-b // self.block)))
        got = [self.read_block(k) for k in blocks]
        first = blocks.start * self.block
        return np.concatenate(got)[a - first : b - first] if got else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, first id in the file, ids) of all documents, decoding each block once."""
        k, tail, start = 0, np.zeros(0, np.uint32), 0
        for key, end in zip(self.keys, self.ends.tolist(), strict=True):
            got = [tail]
            have = len(tail)
            while have < end - start:
                got.append(self.read_block(k))
                have += len(got[-1])
                k += 1
            run = np.concatenate(got) if len(got) > 1 else tail
            yield key, start, run[: end - start]
            tail, start = run[end - start :], end


def _files(path: str, block: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("crc", "ascending"), ("size", "ascending")], null_placement="at_start")
        rows = rows.take(order)
        ids, at = ChunkEncoder.of(path).encode_documents(rows["text"].combine_chunks(), END)
        content = write_file(ids, at[1:], rows["doc_id"].to_pylist(), block)
        out = pa.table({"file": pa.array([key[0].as_py()], pa.int64()), "n_ids": pa.array([len(ids)]), "n_docs": pa.array([rows.num_rows]), "content": pa.array([content], pa.binary())})
        release()
        return out

    return run


def write_token_files(docs: DataFrame, tokenizer: str | None = None, file_bytes: int = 8 << 20, block: int = BLOCK) -> DataFrame:
    """Encode ``docs`` into token files in ascending doc_id order; (file, n_ids, n_docs, content).

    One file holds one range of ids, about ``file_bytes`` of text. The table is written
    before it is returned. Null ids come first; equal ids lie in the order of their text's
    crc32 and size. Null and empty texts have the end id alone. An empty table gives none.
    """
    buckets = order_buckets(docs, "doc_id", file_bytes)
    rows = docs.select("doc_id", "text", buckets.column("doc_id").alias("file"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = rows.withColumn("crc", F.crc32(text)).withColumn("size", F.octet_length("text"))
    files = rows.groupBy("file").applyInArrow(_files(tokenizer or vocabulary(), block), "file bigint, n_ids bigint, n_docs bigint, content binary")
    return materialize(files, "token-files")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            base, reader = batch.column(0)[r].as_py(), TokenFile(batch.column(1)[r].as_py())
            rows = [(k, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, s, ids in reader.documents()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, ["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def with_bases(files: DataFrame) -> DataFrame:
    """Adds ``base``: ids in all files before. One short row for each file meets in a window."""
    from pyspark.sql import Window

    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", "n_ids").select(F.col("file").alias("_f"), F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("base"))
    return files.join(base, F.col("file") == F.col("_f")).drop("_f")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    return with_bases(files).select("base", "content").mapInArrow(_digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def export_files(files: DataFrame, folder: str) -> list[str]:
    """Write each file to a local folder, one at a time (for a driver's own disk)."""
    import os

    os.makedirs(folder, exist_ok=True)
    paths = []
    for row in files.select("file", "content").toLocalIterator():
        paths.append(os.path.join(folder, f"{row.file:08d}.mwtk"))
        with open(paths[-1], "wb") as f:
            f.write(bytes(row.content))
    return sorted(paths)
