"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Text handled at once by the vectorised code, in bytes; a longer document is handled alone.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(rows: DataFrame, kept: list[str], results: str) -> StructType:
    """The columns ``kept`` of ``rows`` as they are, nested nullability included, then ``results`` (DDL)."""
    return StructType([rows.schema[c] for c in kept] + StructType.fromDDL(results).fields)


def map_texts(docs: DataFrame, keep: list[str], work: Callable[[], Callable[[pa.Array], list[pa.Array]]], results: str) -> DataFrame:
    """The columns ``keep`` of every row and ``results`` (DDL), made from the texts by a worker function.

    ``work`` is called once in a task; what it returns turns a column of texts into result
    columns. Kept columns travel as one struct, so their names cannot clash, and a kept text
    travels once. A kept column that is called like a result gives way to it.
    """
    made = StructType.fromDDL(results).names
    cols = [c for c in dict.fromkeys(keep) if c not in made]
    inside = "text" in cols
    rows = docs.select(F.struct(*cols or [F.lit(0).alias("_none")]).alias("row"), *([] if inside else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = work()
        for batch in batches:
            texts = batch.column(0).field("text") if inside else batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *act(texts)], ["row", *made])
            del batch, texts
            release()

    out = rows.mapInArrow(run, schema_of(rows, ["row"], results))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in cols), *made)


def release() -> None:
    """Give memory that this process has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library keeps no such pools
    _libc = None


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: what decides on held-out rows."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def bounded_sample(rows: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """At most ``buckets`` keys of each label, spread by hash; the same at any partitioning.

    One key with the smallest hash is taken from each (label, hash bucket), by an
    aggregate that combines map-side, so neither a frequent label nor a large
    table gathers in a task.
    """
    h = F.xxhash64(F.col(key), F.lit("sample"))
    return (
        rows.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(label).alias("label"), F.pmod(h, F.lit(buckets)).alias("bucket"))
        .agg(F.min_by(F.col(key), h).alias("key"))
        .select("key", "label")
    )


def sampled_texts(docs: DataFrame, picked: DataFrame, with_label: bool = False) -> DataFrame:
    """(text, label): one text for each picked key (:func:`bounded_sample`), the least where rows repeat the id.

    Bounded by the sample whatever the rows: repeated rows are combined before they move. If
    ``with_label``, a row counts only where its own ``lang`` is the label.
    """
    small = F.broadcast(picked.select(F.col("key").alias("_key"), F.col("label").alias("_label")))  # bounded by the sample
    on = F.col("doc_id") == F.col("_key")
    if with_label:
        on = on & (F.col("lang") == F.col("_label"))
    rows = docs.where("text is not null").join(small, on)
    return rows.groupBy("_key", "_label").agg(F.min("text").alias("text")).select("text", F.col("_label").alias("label"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column without copying; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges (i, j) of documents of about ``most`` bytes each; all documents are covered."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
