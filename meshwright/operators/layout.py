"""Layered drawings: an integer box for every node and the way of every edge.

Each weakly connected component is laid out in one task of ``applyInPandas``; drawings are
of capped slices, so a component is small. Back edges are reversed, layers come from longest
paths, long edges get dummy places, and the order in layers from alternating barycenters.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .components import connected_components

SWEEPS, BOX_HEIGHT, GAP_X, GAP_Y, LEAST_WIDTH, MOST_WIDTH, CHAR_WIDTH = 8, 60, 40, 80, 120, 320, 7


def box_width(label: str) -> int:
    return max(LEAST_WIDTH, min(MOST_WIDTH, len(label) * CHAR_WIDTH + 20))


def without_cycles(nodes: list[str], edges: list[tuple[str, str]]) -> list[tuple[str, str, bool]]:
    """Edges (from, to, reversed): those that close a cycle of a depth-first walk are turned round."""
    out_of = defaultdict(list)
    for a, b in sorted(set(edges)):
        if a != b:
            out_of[a].append(b)
    state: dict[str, int] = {}
    result = []
    for start in nodes:
        if start in state:
            continue
        stack = [(start, iter(out_of[start]))]
        state[start] = 1
        while stack:
            node, rest = stack[-1]
            for b in rest:
                if state.get(b) == 1:
                    result.append((b, node, True))
                    continue
                result.append((node, b, False))
                if b not in state:
                    state[b] = 1
                    stack.append((b, iter(out_of[b])))
                    break
            else:
                state[node] = 2
                stack.pop()
    return result


def layers_of(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """The longest path that ends in each node of an acyclic graph."""
    into, out_of = dict.fromkeys(nodes, 0), defaultdict(list)
    for a, b in edges:
        into[b] += 1
        out_of[a].append(b)
    layer = dict.fromkeys(nodes, 0)
    ready = [n for n in nodes if not into[n]]
    while ready:
        a = ready.pop()
        for b in out_of[a]:
            layer[b] = max(layer[b], layer[a] + 1)
            into[b] -= 1
            if not into[b]:
                ready.append(b)
    return layer


def place(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, tuple[int, int, int, int]]:
    """(layer, x, y, width) of each node of one component."""
    nodes = sorted(nodes)
    acyclic = sorted({(a, b) for a, b, _ in without_cycles(nodes, edges)})
    layer = layers_of(nodes, acyclic)
    near, rows = defaultdict(list), defaultdict(list)
    for n in nodes:
        rows[layer[n]].append(n)
    for a, b in acyclic:
        chain = [a, *(f"\0{a}\0{b}\0{k}" for k in range(layer[a] + 1, layer[b])), b]
        for k, d in enumerate(chain[1:-1], 1):
            rows[layer[a] + k].append(d)
        for p, q in zip(chain, chain[1:], strict=False):
            near[p].append(q)
            near[q].append(p)
    depth = max(rows) + 1
    for sweep in range(SWEEPS):
        down = sweep % 2 == 0
        for k in range(1, depth) if down else range(depth - 2, -1, -1):
            at = {n: i for i, n in enumerate(rows[k - 1 if down else k + 1])}
            old = {n: i for i, n in enumerate(rows[k])}
            center = {n: (lambda ps, n=n: sum(ps) / len(ps) if ps else old[n])([at[m] for m in near[n] if m in at]) for n in rows[k]}
            rows[k].sort(key=lambda n: (center[n], old[n]))
    width = {n: 0 if n.startswith("\0") else box_width(n) for k in rows for n in rows[k]}
    total = {k: sum(width[n] + GAP_X for n in rows[k]) for k in rows}
    widest, out = max(total.values()), {}
    for k in range(depth):
        x = (widest - total[k]) // 2
        for n in rows[k]:
            if not n.startswith("\0"):
                out[n] = (k, x, k * (BOX_HEIGHT + GAP_Y), width[n])
            x += width[n] + GAP_X
    return out


def _component(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes = sorted({*pdf["src"], *pdf["dst"]})
    at = place(nodes, list(zip(pdf["src"], pdf["dst"], strict=True)))
    return pd.DataFrame([(n, pdf["component"].iat[0], *at[n]) for n in nodes], columns=["id", "component", "layer", "x", "y", "width"])


def layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, layer, x, y, width): components beside each other, lone nodes in a grid below."""
    plain = edges.where("src <> dst").select("src", "dst").distinct()
    comp = connected_components(plain)
    placed = plain.join(comp, F.col("src") == F.col("node")).select("src", "dst", "component").groupBy("component").applyInPandas(
        _component, "id string, component string, layer bigint, x bigint, y bigint, width bigint"
    )
    # components stand side by side in order of their names: one row each in this window
    sizes = placed.groupBy("component").agg(F.max(F.col("x") + F.col("width")).alias("w"), F.max("y").alias("h"))
    shift = F.coalesce(F.sum(F.col("w") + 2 * GAP_X).over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = placed.join(sizes.select("component", shift.alias("_dx")), "component").withColumn("x", F.col("x") + F.col("_dx")).drop("_dx")
    alone = nodes.join(comp.select(F.col("node").alias("id")), "id", "left_anti").select("id")
    facts = alone.agg(F.count("*").alias("n")).first().n
    per_row = max(1, math.isqrt(max(facts - 1, 0)) + 1)
    below = (moved.agg(F.max("y").alias("y")).first().y or 0) + BOX_HEIGHT + GAP_Y
    rank = F.row_number().over(Window.orderBy("id")) - 1
    grid = alone.withColumn("_r", rank).select(
        "id", F.col("id").alias("component"), F.lit(0).cast("bigint").alias("layer"), (F.col("_r") % per_row * (MOST_WIDTH + GAP_X)).cast("bigint").alias("x"),
        (F.lit(below) + F.floor(F.col("_r") / per_row) * (BOX_HEIGHT + GAP_Y)).cast("bigint").alias("y"), F.lit(LEAST_WIDTH).cast("bigint").alias("width"),
    )
    return moved.select("id", "component", "layer", "x", "y", "width").unionByName(grid)
