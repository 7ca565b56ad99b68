"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round
is one partial aggregate and one join, so a hub's neighbours are never gathered
in one task: the minimum is combined map-side and AQE can split the join. Before the first
round every partition replaces its edges by a spanning forest of them, twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import discard, materialize

#: Edges of a partition that are held at a time when they are thinned.
FOREST_EDGES = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for each component of the edges of every ``FOREST_EDGES``: what hangs together still does."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars(kind: pa.DataType) -> pa.RecordBatch:
        nodes = list(root)
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["a", "b"])

    kind, seen = None, 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            if a != b:
                root[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= FOREST_EDGES:
            yield stars(kind)
            root.clear()
            seen = 0
    if root:
        yield stars(kind)


def _stars(pairs: DataFrame) -> DataFrame:
    """For pairs (a, b), connect every b to the smallest of a and its b's."""
    low = pairs.groupBy("a").agg(F.min("b").alias("low"))
    return (
        pairs.join(low.select(F.col("a").alias("_a"), F.least("a", "low").alias("low")), F.col("a") == F.col("_a"))
        .select("a", "b", "low")
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest node.

    Edges are undirected; self-loops, repeats and nulls are ignored, though the
    node of a self-loop is returned. No edges give no rows. Converges in
    O(log^2 n) rounds; a fixpoint is found by comparing the edges' number and two sums of
    their 64-bit hashes.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    kind = ends.schema["a"].dataType.simpleString()

    def thinned(rows: DataFrame) -> DataFrame:
        # in a fixed order, so that a task that runs again thins alike
        return rows.sortWithinPartitions("a", "b").mapInArrow(_forest, f"a {kind}, b {kind}")

    def state_of(rows: DataFrame):
        hashed = F.xxhash64("a", "b")
        return rows.agg(F.count("*"), F.sum(hashed.cast("decimal(20,0)")), F.bit_xor(hashed)).first()

    ends = thinned(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct()
    # once more after the shuffle: what is small lies in few partitions then
    ends = materialize(thinned(ends), "cc")
    loops = ends.where("a = b").select("a").distinct()
    cur = ends.where("a <> b")
    last, state = None, state_of(cur)
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a's smaller neighbours and a itself move to the smallest of them
        moved = _stars(large)
        small = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            moved.select("a", F.col("low").alias("b"))
        )
        nxt = materialize(small.where("a <> b").distinct(), "cc")
        now = state_of(nxt)
        discard(last)
        cur = last = nxt
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected_components did not converge")
    labels = cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = cur.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    known = labels.unionByName(roots)
    alone = loops.join(known, F.col("a") == F.col("node"), "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return known.unionByName(alone)
