"""Plain tables as an entity graph: nodes (id, tier) and edges (src, dst, relation, line).

Regions and nations are infrastructure (tier 0), customers and suppliers tier 1, parts and
orders tier 2. Ids are ``kind:key``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NODE_TABLES = (("region", "r_regionkey", 0), ("nation", "n_nationkey", 0), ("customer", "c_custkey", 1), ("supplier", "s_suppkey", 1), ("part", "p_partkey", 2), ("orders", "o_orderkey", 2))
EDGE_TABLES = (
    ("nation", "nation", "n_nationkey", "region", "n_regionkey", "depends_on", None),
    ("customer", "customer", "c_custkey", "nation", "c_nationkey", "in_nation", None),
    ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "in_nation", None),
    ("orders", "orders", "o_orderkey", "customer", "o_custkey", "placed_by", None),
    ("lineitem", "orders", "l_orderkey", "part", "l_partkey", "contains", "l_linenumber"),
    ("lineitem", "orders", "l_orderkey", "supplier", "l_suppkey", "supplied_by", "l_linenumber"),
)


def entity_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, only: dict[str, str] | None = None) -> DataFrame:
    """(id, kind, tier); ``only`` filters a kind's table by a SQL condition."""
    parts = []
    for name, key, tier in NODE_TABLES:
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if only and name in only:
            t = t.where(only[name])
        parts.append(t.select(entity_id(name, key).alias("id"), F.lit(name).alias("kind"), F.lit(tier).cast("bigint").alias("tier")))
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, relation, line); line is null where an edge has none."""
    parts = []
    for name, a, ka, b, kb, relation, line in EDGE_TABLES:
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        n = F.col(line).cast("bigint") if line else F.lit(None).cast("bigint")
        parts.append(t.select(entity_id(a, ka).alias("src"), entity_id(b, kb).alias("dst"), F.lit(relation).alias("relation"), n.alias("line")))
    return reduce(DataFrame.unionByName, parts)


#: The same two relations for DuckDB, as common table expressions.
NODES_SQL = "nodes AS (" + " UNION ALL ".join(f"SELECT '{n}:' || {k} AS id, '{n}' AS kind, CAST({t} AS BIGINT) AS tier FROM {n}" for n, k, t in NODE_TABLES) + ")"
EDGES_SQL = (
    "edges AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}:' || {ka} AS src, '{b}:' || {kb} AS dst, '{r}' AS relation, CAST({line or 'NULL'} AS BIGINT) AS line FROM {t}" for t, a, ka, b, kb, r, line in EDGE_TABLES
    )
    + ")"
)
