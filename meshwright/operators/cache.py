"""The extraction cache as a relation: keys by extractor, place and content; snapshots and their differences."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The file that names the version of a cache that readers see.
POINTER = "CURRENT"


def cache_key(extractor: str, place: Column, content: Column) -> Column:
    """``extractor@version:place:sha256``."""
    return F.concat_ws(":", F.lit(extractor), place, F.sha2(content.cast("binary"), 256))


def missing(work: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Rows of ``work`` whose key is not cached."""
    return work.join(cached.select(key).distinct(), key, "left_anti")


def used_only(cached: DataFrame, work: DataFrame, key: str) -> DataFrame:
    """Cached rows that this scan used; what a flush keeps."""
    return cached.join(work.select(key).distinct(), key, "left_semi")


def flush(cached: DataFrame, path: str) -> None:
    """Replace the cache at ``path``: a new version is written beside the others, then a pointer moves to it.

    The pointer is renamed over the old one in one step, so a reader sees the old version or
    the new one, and a crash in between loses nothing. Versions before the last are deleted.
    """
    spark: SparkSession = cached.sparkSession
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    version = f"v-{uuid.uuid4().hex}"
    cached.write.parquet(f"{path}/{version}")
    before = current(spark, path)
    new, pointer = jvm.Path(f"{path}/{version}.pointer"), jvm.Path(f"{path}/{POINTER}")
    out = pointer.getFileSystem(conf).create(new, True)
    out.write(version.encode())
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    over[0] = getattr(jvm, "Options$Rename").OVERWRITE
    jvm.FileContext.getFileContext(pointer.toUri(), conf).rename(new, pointer, over)
    if before is not None:
        pointer.getFileSystem(conf).delete(jvm.Path(f"{path}/{before}"), True)


def current(spark: SparkSession, path: str) -> str | None:
    """The version of the cache at ``path`` that its pointer names; None without one."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    pointer = jvm.Path(f"{path}/{POINTER}")
    fs = pointer.getFileSystem(conf)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def cached_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the cache at ``path``; None where there is none."""
    version = current(spark, path)
    return spark.read.parquet(f"{path}/{version}") if version else None


def diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status): added, removed, changed or same, by content hash."""
    h = lambda df, name: df.select(F.col(key).alias(f"_{name}"), F.sha2(F.col(content).cast("binary"), 256).alias(f"_h{name}"))
    both = h(old, "o").join(h(new, "n"), F.col("_o") == F.col("_n"), "full")
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_ho") != F.col("_hn"), "changed").otherwise("same")
    return both.select(F.coalesce("_o", "_n").alias(key), status.alias("status"))
