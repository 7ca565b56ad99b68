"""Operators on property graphs held as two relations, nodes (id, ...) and edges (src, dst, relation, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import discard, materialize

#: Relations that bind closely, and their hop cost; all others cost 1.
STRONG, STRONG_COST, BUDGET = ("routes_to", "depends_on", "build_context_contains"), 0.5, 3.0


def assemble(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): edges with both ends among the nodes, and the others."""
    ids = nodes.select("id").distinct()
    has = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(
        ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left"
    )
    ok = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    return has.where(ok).select(*edges.columns), has.where(~ok).select(*edges.columns)


def kept_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes, by two semi joins."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_semi")


def merge_evidence(records: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """identity and its ordered list of evidence; the first decides what the node is."""
    item = F.struct(*order, *fields)
    got = records.groupBy("identity").agg(F.sort_array(F.collect_list(item)).alias("evidence"))
    return got.select("identity", F.col("evidence")[0].alias("first"), "evidence")


def relation_name(explicit: Column, kind: Column) -> Column:
    """The explicit relation, else ``imports`` for an import, else ``calls``."""
    return F.when(explicit.isNotNull(), explicit).when(kind == "import", F.lit("imports")).otherwise(F.lit("calls"))


def index_relation(relation: Column, via: Column) -> Column:
    """The index's vocabulary: reference, inherits, built_by, jsx, else call."""
    return (
        F.when(relation == "references", F.lit("reference"))
        .when(relation.isin("inherits", "built_by"), relation)
        .when(via == "jsx", F.lit("jsx"))
        .otherwise(F.lit("call"))
    )


def collapse_links(edges: DataFrame) -> DataFrame:
    """(src, dst, relation, n, line): how often and the least line that is not 0."""
    return edges.groupBy("src", "dst", "relation").agg(F.count("*").alias("n"), F.min(F.nullif(F.col("line"), F.lit(0))).alias("line"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): distinct links out plus distinct links in, by relation."""
    links = edges.select("src", "dst", "relation").distinct()
    ends = links.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, relation): every edge in both directions, once."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation")
    return out.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "relation")).distinct()


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, budget: float = BUDGET, max_rounds: int = 200) -> DataFrame:
    """(id, cost): nodes within ``budget`` of the seeds, in both directions.

    Nodes of tier 0 are always admitted, at a cost of ``budget`` at most. Weights are
    positive, so rounds of least costs end in the same fixpoint as a shortest-path heap.
    Each round joins only what improved.
    """
    weight = F.when(F.col("relation").isin(*STRONG), F.lit(STRONG_COST)).otherwise(F.lit(1.0))
    links = both_ways(edges).select("a", "b", weight.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))
    infra = nodes.where("tier = 0").select(F.col("id").alias("_infra")).distinct()
    links = materialize(
        links.join(infra, F.col("b") == F.col("_infra"), "left").select("a", "b", "w", F.col("_infra").isNotNull().alias("always")), "links"
    )
    best = materialize(seeds.select("id").distinct().withColumn("cost", F.lit(0.0)), "best")
    front = best
    for _ in range(max_rounds):
        step = F.col("cost") + F.col("w")
        reach = front.join(links, F.col("id") == F.col("a")).where(F.col("always") | (step <= budget))
        reach = reach.groupBy("b").agg(F.min(F.when(F.col("always"), F.least(step, F.lit(budget))).otherwise(step)).alias("new"))
        better = materialize(
            reach.join(best, F.col("b") == F.col("id"), "left").where("cost is null or new < cost").select(F.col("b").alias("id"), F.col("new").alias("cost")), "front"
        )
        if better.isEmpty():
            return best
        merged = materialize(best.unionByName(better).groupBy("id").agg(F.min("cost").alias("cost")), "best")
        discard(best)
        best, front = merged, better
    raise RuntimeError("expand did not reach a fixpoint")


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hops) of nodes at most ``depth`` undirected hops from a seed."""
    links = materialize(both_ways(edges).select("a", "b").distinct(), "links")
    seen = materialize(seeds.select("id").distinct().withColumn("hops", F.lit(0).cast("bigint")), "hops")
    front = seen
    for k in range(1, depth + 1):
        nxt = front.join(links, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        front = materialize(nxt.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(k).cast("bigint")), "front")
        if front.isEmpty():
            break
        seen = materialize(seen.unionByName(front), "hops")
    return seen


def cap(reached: DataFrame, nodes: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """The first n of (seed first, tier 0 next, cost, id), with their rank from 1.

    The n best are found by a top-n in every partition; only those are ranked.
    """
    rows = (
        reached.join(seeds.select(F.col("id").alias("_seed")).distinct(), F.col("id") == F.col("_seed"), "left")
        .join(nodes.select(F.col("id").alias("_id"), "tier").distinct(), F.col("id") == F.col("_id"))
        .select("id", "cost", F.col("_seed").isNull().alias("not_seed"), (F.col("tier") != 0).alias("not_infra"))
    )
    top = rows.orderBy("not_seed", "not_infra", "cost", "id").limit(n)
    rank = F.row_number().over(Window.orderBy("not_seed", "not_infra", "cost", "id"))
    return top.select("id", "cost", rank.cast("bigint").alias("rank"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (id)."""
    return kept_edges(ids, edges)


def paths(edges: DataFrame, start: DataFrame, goal: Column, depth: int, most: int) -> DataFrame:
    """The ``most`` shortest simple directed paths from ``start`` (id): (hops, path), ties by path text.

    Every front is written, so a level costs one join; the search ends with the level that
    brings the number of paths to ``most``, as later ones are longer.
    """
    links = materialize(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "links")
    front = start.select(F.col("id").alias("node"), F.array("id").alias("path"))
    found = None
    for _ in range(depth):
        front = (
            front.join(links, F.col("node") == F.col("a")).where(~F.array_contains("path", F.col("b")))
            .select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        )
        front = materialize(front, "front")
        done = front.where(goal)
        found = done if found is None else found.unionByName(done)
        if front.isEmpty() or found.limit(most).count() >= most:
            break
        front = front.where(~goal)
    out = found.select((F.size("path") - 1).cast("bigint").alias("hops"), F.array_join("path", ">").alias("path"))
    return out.orderBy("hops", "path").limit(most)


def levels_down(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(level, id): nodes first reached at each level of a directed tree walk."""
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    seen = start.select("id", F.lit(0).cast("bigint").alias("level"))
    front = seen
    for k in range(1, depth + 1):
        nxt = front.join(links, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        front = nxt.join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(k).cast("bigint"))
        seen = materialize(seen.unionByName(front), "levels")
        front = seen.where(F.col("level") == k)
    return seen


def closure(pairs: DataFrame, depth: int) -> DataFrame:
    """(node, ancestor, depth): all ancestors up to ``depth`` steps, at their least depth."""
    base = materialize(pairs.select(F.col("src").alias("node"), F.col("dst").alias("ancestor")).distinct(), "pairs")
    found = base.withColumn("depth", F.lit(1).cast("bigint"))
    front = found
    for k in range(2, depth + 1):
        front = (
            front.select("node", F.col("ancestor").alias("_mid")).join(base.select(F.col("node").alias("_mid"), "ancestor"), "_mid")
            .select("node", "ancestor").distinct().withColumn("depth", F.lit(k).cast("bigint"))
        )
        front = materialize(front, "front")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def longest_layers(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, layer): the longest path that ends in each node of an acyclic graph."""
    links = materialize(edges.select("src", "dst").distinct(), "links")
    at = materialize(nodes.select("id").distinct().withColumn("layer", F.lit(0).cast("bigint")), "layers")
    front = at
    for k in range(1, max_rounds + 1):
        front = materialize(front.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().withColumn("layer", F.lit(k).cast("bigint")), "front")
        if front.isEmpty():
            return at
        at = materialize(at.unionByName(front).groupBy("id").agg(F.max("layer").alias("layer")), "layers")
    raise ValueError("the graph has a cycle")
