"""Evaluation analytics: medians of medians, votes, recall and precision, rankings, run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def median_of_medians(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """(outer, median): the median over ``inner`` of each one's median; inners count alike."""
    each = rows.groupBy(outer, inner).agg(F.median(value).alias("_m"))
    return each.groupBy(outer).agg(F.median("_m").alias("median"), F.count("*").alias("n"))


def majority(*votes: Column) -> Column:
    """Whether more than half of the votes are true; null counts as no."""
    total = sum((F.coalesce(v.cast("int"), F.lit(0)) for v in votes[1:]), F.coalesce(votes[0].cast("int"), F.lit(0)))
    return total * 2 > len(votes)


def recall_precision(rows: DataFrame, group: list[str], truth: Column, found: Column) -> DataFrame:
    """Counts, recall and precision; null where nothing was there to find, or found."""
    return (
        rows.withColumn("_t", truth).withColumn("_f", found).groupBy(*group)
        .agg(F.count_if(F.col("_t") & F.col("_f")).alias("tp"), F.count_if(~F.col("_t") & F.col("_f")).alias("fp"), F.count_if(F.col("_t") & ~F.col("_f")).alias("fn"))
        .withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))
        .withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")))
    )


def site_differences(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Both sets' sites with ``verdict``: hit, extra or miss."""
    cols = found.columns
    hit = found.distinct().intersect(truth.distinct()).withColumn("verdict", F.lit("hit"))
    extra = found.distinct().subtract(truth.distinct()).withColumn("verdict", F.lit("extra"))
    miss = truth.distinct().subtract(found.distinct()).withColumn("verdict", F.lit("miss"))
    return hit.unionByName(extra).unionByName(miss).select(*cols, "verdict")


def top_of_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group, with rank from 1."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= n)


def latest_before(events: DataFrame, marks: DataFrame, key: str, at: str) -> DataFrame:
    """Each event with the latest mark of its key at or before it, null without one.

    Events and marks are merged and one running maximum is taken for each key: no range join.
    """
    cols = events.columns
    merged = events.withColumn("_mark", F.lit(None).cast(marks.schema[at].dataType)).unionByName(
        marks.select(F.col(key), F.col(at), F.col(at).alias("_mark")), allowMissingColumns=True
    ).withColumn("_is", F.col("_mark").isNotNull())
    w = Window.partitionBy(key).orderBy(at, F.col("_is").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("latest", F.max("_mark").over(w)).where("not _is").select(*cols, "latest")


def pair_calls(rows: DataFrame, run: str, order: str, is_call: Column, is_result: Column) -> DataFrame:
    """(run, call, result): each call with the next result of its run, null if there is none."""
    nxt = F.min(F.when(is_result, F.col(order))).over(Window.partitionBy(run).orderBy(order).rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("_next", nxt).where(is_call).select(run, F.col(order).alias("call"), F.col("_next").alias("result"))
