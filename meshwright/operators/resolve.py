"""Resolution: unique names, candidates by priority, scopes, members along a chain of fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_by_priority(candidates: DataFrame, key: list[str], order: list[str], value: list[str]) -> DataFrame:
    """For each key the candidate of least ``order``; combines map-side, no window."""
    best = F.min(F.struct(*order, *value)).alias("_best")
    return candidates.groupBy(*key).agg(best).select(*key, *(F.col(f"_best.{c}").alias(c) for c in (*order, *value)))


def unique_only(refs: DataFrame, targets: DataFrame, name: str, target: str) -> DataFrame:
    """References resolved where exactly one distinct target has the name."""
    sole = targets.groupBy(name).agg(F.min(target).alias("resolved"), F.count_distinct(target).alias("_n")).where("_n = 1").drop("_n")
    return refs.join(sole, name)


def suffixes(path: Column, separator: str = "/") -> Column:
    """All suffixes of a path at component boundaries, longest first."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator))


def ancestors(path: Column, separator: str = "/") -> Column:
    """All proper prefixes of a path at component boundaries, shortest first."""
    parts = F.split(path, separator)
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), separator))).otherwise(F.array().cast("array<string>"))


def member_lookup(asked: DataFrame, bases: DataFrame, members: DataFrame, depth: int) -> DataFrame:
    """(cls, member, owner, depth): the nearest owner of a member along ``bases`` (cls, base, pos).

    ``asked`` has cls and member; classes are searched depth-first in order of bases, to
    ``depth`` levels. Each round is one join of what has not been found yet.
    """
    front = asked.select("cls", "member", F.col("cls").alias("at"), F.array().cast("array<bigint>").alias("trail"))
    found = None
    own = members.select(F.col("cls").alias("at"), "member").distinct()
    for k in range(depth + 1):
        hit = front.join(own, ["at", "member"]).select("cls", "member", F.col("at").alias("owner"), F.lit(k).cast("bigint").alias("depth"), "trail")
        found = hit if found is None else found.unionByName(hit)
        if k < depth:
            step = bases.select(F.col("cls").alias("at"), "base", F.col("pos").cast("bigint").alias("pos"))
            front = front.join(step, "at").select("cls", "member", F.col("base").alias("at"), F.concat("trail", F.array("pos")).alias("trail"))
    best = F.min(F.struct("trail", "owner", "depth")).alias("b")
    return found.groupBy("cls", "member").agg(best).select("cls", "member", F.col("b.owner").alias("owner"), F.col("b.depth").alias("depth"))
