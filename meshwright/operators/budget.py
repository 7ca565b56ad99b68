"""Budgets: running cuts, greedy packing with skips, and ladders of ever smaller views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_cut(rows: DataFrame, group: list[str], order: list, cost: Column, room: Column | int) -> DataFrame:
    """Rows until the running cost of a group first exceeds ``room``."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(cost).over(w)
    return rows.withColumn("running", total.cast("bigint")).where(F.col("running") <= room)


def greedy_pack(rows: DataFrame, group: list[str], order: list[str], item: str, cost: str, budget: int, skip_cost: int = 0) -> DataFrame:
    """Items taken in order as long as they fit; one that does not is skipped and costs ``skip_cost``.

    A group's items must fit in a task's memory: they are a candidate list, cut before.
    """
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(item).alias("item"), F.col(cost).cast("bigint").alias("cost"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{rows.schema[item].dataType.simpleString()}>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= budget
        return F.when(fits, F.struct((acc["used"] + x["cost"]).alias("used"), F.array_append(acc["taken"], x["item"]).alias("taken"))).otherwise(
            F.struct((acc["used"] + skip_cost).alias("used"), acc["taken"].alias("taken"))
        )

    got = rows.groupBy(*group).agg(items.alias("items")) if group else rows.agg(items.alias("items"))
    return got.withColumn("pack", F.aggregate("items", start, step)).select(*group, F.col("pack.used").alias("used"), F.col("pack.taken").alias("taken"))


def ladder(rows: DataFrame, group: str, order: list, cost: Column, steps: list[tuple[int, int]], budget: int) -> DataFrame:
    """(step, per_group, most_groups, cost): the first step whose view fits the budget.

    A step shows the first ``per_group`` rows of the first ``most_groups`` groups. All steps
    are priced in one pass; no row if none fits.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = rows.select(group, rank.alias("r"), cost.cast("bigint").alias("c"))
    best = max(p for p, _ in steps)
    # a group's place: by its number of rows; only groups that some step could show are ranked
    sizes = ranked.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(max(m for _, m in steps))
    place = sizes.withColumn("g", F.row_number().over(Window.orderBy(F.desc("n"), group))).drop("n")
    shown = ranked.where(F.col("r") <= best).join(place, group)
    prices = shown.agg(*(F.coalesce(F.sum(F.when((F.col("r") <= p) & (F.col("g") <= m), F.col("c"))), F.lit(0)).cast("bigint").alias(f"s{i}") for i, (p, m) in enumerate(steps)))
    each = F.array(*(F.struct(F.lit(i).cast("bigint").alias("step"), F.lit(p).cast("bigint").alias("per_group"), F.lit(m).cast("bigint").alias("most_groups"), F.col(f"s{i}").alias("cost")) for i, (p, m) in enumerate(steps)))
    return prices.select(F.explode(each).alias("x")).select("x.*").where(F.col("cost") <= budget).orderBy("step").limit(1)
