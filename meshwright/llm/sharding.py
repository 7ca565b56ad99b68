"""Shuffling a corpus into shards in two passes over external storage.

Pass 1 scatters records uniformly into buckets that fit in memory, by a seeded hash. Pass 2
loads one bucket at a time, shuffles it by Fisher and Yates' method with a generator seeded
by the bucket, and writes it. Buckets one after the other are then a uniform permutation of
the corpus, which is cut into shards of equal row counts (law ``rows``: counts differ by
one at most). Every step is a function of seed and row, so a task that runs again writes the same rows.

Rows that repeat in id and text would share a bucket. Where such a group outgrows one, its
equal rows are counted before they move, the copies numbered, and the number goes into the
hash, so that a group of any size spreads over all buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.storage import materialize
from .common import schema_of

#: Seed; text of a bucket; what a row takes beside its text; buckets' worth of text from which a group of repeated rows
#: is dealt copy by copy.
SEED, BUCKET_BYTES, ROW_BYTES, HEAVY = 7, 24 << 20, 64, 4


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of range(n); the same for the same seed and bucket."""
    order = list(range(n))
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffle_bucket(seed: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        # a fixed order first: rows arrive in any order
        order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("key", "crc", "size", "rest", "copy")])
        order = order.take(pa.array(fisher_yates(rows.num_rows, seed, bucket)))
        at = pa.array(np.arange(rows.num_rows, dtype=np.int64) + rows["base"][0].as_py())
        return rows.select(["row", "size", "crc"]).take(order).append_column("at", at)

    return run


def _numbered_copies(rows: DataFrame, groups: DataFrame, cols: list[str], bucket_bytes: int) -> DataFrame:
    """The rows of heavy groups with ``copy``: 0, 1, ... among equal rows.

    Equal rows are counted map-side, then made again a block of about a bucket at a time.
    """
    block = F.greatest(F.floor(F.lit(bucket_bytes) / (F.col("size") + ROW_BYTES)), F.lit(1)).cast("bigint")
    counted = rows.join(groups, _same_group(rows, groups)).groupBy(*(rows[c] for c in cols)).agg(F.count("*").alias("n"))
    starts = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, block)))
    dealt = starts.repartition(F.col("key"), F.col("crc"), F.col("rest"), F.col("first"))
    return dealt.select(*cols, F.explode(F.sequence("first", F.least(F.col("first") + block, F.col("n")) - 1)).alias("copy"))


def _same_group(rows: DataFrame, groups: DataFrame):
    return rows["key"].eqNullSafe(groups["g_key"]) & (rows["crc"] == groups["g_crc"]) & (rows["size"] == groups["g_size"])


def deal(docs: DataFrame, cols: list[str], buckets: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Pass 1: row (``cols`` as a struct), key, size, crc, rest, copy and bucket of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # the columns beside the text, so that rows that differ anywhere are told apart
    others = F.to_json(F.struct(*(c for c in cols if c != "text"), F.col("text").isNull().alias("_no_text")))
    rows = docs.select(
        F.struct(*cols).alias("row"), F.col("doc_id").cast("bigint").alias("key"), (F.octet_length(text) + F.lit(1).cast("bigint")).alias("size"), F.crc32(text).alias("crc"), F.xxhash64(others).alias("rest")
    )

    def bucket(*what: str):
        return F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(buckets))

    rows, most = rows.withColumn("weight", F.col("size") + ROW_BYTES), HEAVY * bucket_bytes
    first = bucket("key", "crc", "size").alias("bucket")
    full = rows.groupBy(first).agg(F.sum("weight").alias("bytes")).where(F.col("bytes") > most).select("bucket")
    alone = F.lit(0).cast("bigint").alias("copy")
    cols = ["row", "key", "size", "crc", "rest"]
    if full.isEmpty():
        return rows.select(*cols, alone, first)
    # at most one bucket, and one group, for each HEAVY * BUCKET_BYTES of the corpus: 40 MB for 100 TB
    near = rows.select("key", "crc", "size", "weight", first).join(F.broadcast(full), "bucket")
    groups = near.groupBy(F.col("key").alias("g_key"), F.col("crc").alias("g_crc"), F.col("size").alias("g_size")).agg(F.count("*").alias("n"), F.sum("weight").alias("bytes"))
    groups = F.broadcast(groups.where((F.col("n") > 1) & (F.col("bytes") > most)).select("g_key", "g_crc", "g_size"))
    copies = _numbered_copies(rows, groups, cols, bucket_bytes)
    return rows.join(groups, _same_group(rows, groups), "left_anti").select(*cols, alone, first).unionByName(copies.withColumn("bucket", bucket(*cols[1:], "copy")))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` and shard int, slot long, size long, text_crc32 long; written, then read.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1, ``text_crc32`` that of its
    bytes (null: of none), ``slot`` the place in the shard, gapless from 0. A null doc_id and
    repeated rows, however many, are rows like others. Columns of ``docs`` that have these
    names are replaced. An empty table gives no rows.
    """
    taken = {"shard", "slot", "size", "text_crc32"}
    cols = [c for c in docs.columns if c not in taken]
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES).alias("bytes"), F.count("*").alias("rows")).first()
    n = total.rows
    buckets = max(1, -(-int(total.bytes or 0) // bucket_bytes))
    rows = deal(docs, cols, buckets, seed, bucket_bytes)
    # the place of a bucket: one short row for each bucket meets in a window
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    bases = counts.select("bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("bigint").alias("base"))
    placed = rows.join(bases, "bucket").select("row", "key", "size", "crc", "rest", "copy", "bucket", "base")
    schema = schema_of(rows, ["row"], "size bigint, crc bigint, at bigint")
    mixed = placed.groupBy("bucket").applyInArrow(_shuffle_bucket(seed), schema)
    # shard i holds the places floor(i n / shards) up to floor((i + 1) n / shards)
    shard = F.expr(f"cast(((at + 1) * {shards} - 1) div {max(n, 1)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {n}) div {shards}")
    written = mixed.withColumn("shard", shard).withColumn("slot", F.col("at") - first)
    out = written.select(*(F.col(f"row.`{c}`").alias(c) for c in cols), "shard", "slot", "size", F.col("crc").alias("text_crc32"))
    return materialize(out, "shards")
