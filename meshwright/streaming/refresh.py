"""Keeping derived tables current from a stream of changed files, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..extract.scan import scan_files
from ..operators.cache import cache_key, missing

CHANGES = "rel_path string, text string"


def refresh(spark: SparkSession, landing: str, cache: str, progress: str, extractor: str = "scan@1") -> StreamingQuery:
    """Extract changed files that land as Parquet (rel_path, text) into the cache at ``cache``.

    Everything there is now is taken up, in batches, then the query ends. A batch only works
    on contents that the cache has not seen, so a batch that runs again adds nothing. Deleted
    files do not show in a stream; a snapshot diff finds them.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.dropDuplicates(["rel_path", "text"]).withColumn("key", cache_key(extractor, F.col("rel_path"), F.col("text")))
        try:
            known = batch.sparkSession.read.parquet(cache).select("key")
        except Exception as e:  # noqa: BLE001 - there is no cache before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = keyed.limit(0).select("key")
        todo = missing(keyed, known, "key")
        evidence, _, _ = scan_files(todo)
        counts = evidence.groupBy("file").agg(F.collect_list("identity").alias("identities"))
        done = todo.join(counts, F.col("rel_path") == F.col("file"), "left").select("key", "rel_path", F.coalesce("identities", F.array().cast("array<string>")).alias("identities"))
        done.write.mode("append").parquet(cache)

    stream = spark.readStream.schema(CHANGES).parquet(landing)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", progress).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; rows later than the watermark are left out of a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    got = timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_lengths(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) of sessions that a gap ends."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    got = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
