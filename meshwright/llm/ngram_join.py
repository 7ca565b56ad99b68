"""Exact Jaccard self-join of documents on word shingles, by count-vector R-trees.

A document's shingles are hashed into ``GROUPS`` groups; its group counts are a point.
The overlap of two sets cannot exceed the summed coordinate minima of their points, nor
can the overlap with any member of an R-tree node exceed the minima against the node's
upper corner, so subtrees and pairs whose bound is too low are skipped and only the
surviving pairs are compared shingle by shingle.

An R-tree fits in one task, so points are first dealt to trees without losing a link:

1. documents with equal sets become one class (a class of any size is one point);
2. every class emits a prefix of its set: with the shingles in one global order, the
   first ``n - ceil(0.8 n) + 1`` of two linked sets always share one. The order puts
   frequent shingles last, by a count sketch over all documents, so a passage in a third
   of all documents is hardly ever in a prefix;
3. the classes that have a prefix shingle are a block; of blocks with the same members one
   is kept. A block's points are joined by bound in an R-tree (up to FANOUT points are one
   leaf): what is left is a spanning forest of the pairs that could link;
4. components of these forests are groups of sets that must be compared. Small groups share
   bins of about ``BIN`` points; a larger group (or block) is cut into tiles, and each pair
   of tiles is one bin. A bin builds its R-tree again, verifies pairs shingle by shingle,
   and returns a spanning forest and link counts, never the pairs.

Components of the last forests are the result. Work in a group of m near copies (not exact
ones) grows with m * m / BIN rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.components import connected_components
from ..operators.storage import discard, materialize
from .common import release, slices, utf8
from .wordhash import join_hashes, shingle_sets

#: Coordinates of the tree's points; members of a bin; children of a node.
GROUPS, BIN, FANOUT = 64, 2048, 16
#: Bits that number the cells of the count sketch (uint32 each); rows in which it travels. Every partition ships
#: one, so more cells cost the shuffle more than they save in prefixes.
SKETCH_BITS, PIECES = 18, 64
#: A shingle in a cell of at most so many occurrences is cold: no more rows can have it, whatever the input.
COLD = 1 << 16


def set_key(s: np.ndarray) -> int:
    """The class key of a set: a signed 64-bit hash of all its shingles and their number."""
    h = join_hashes(np.array([s.sum(dtype=np.uint64)]), np.array([np.bitwise_xor.reduce(s)]), np.array([len(s)], np.uint64))
    return int(h.view(np.int64)[0])


class RTree:
    """A packed R-tree over count points: leaves of FANOUT points in order of size, then of counts.

    ``search`` returns every point whose summed coordinate minima with the query reach the
    overlap that the threshold needs; nodes are skipped by the same bound on their upper
    corner and their smallest size.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, threshold: int) -> None:
        self.points, self.sizes, self.t = points, sizes, threshold
        # sort-tile: by size in runs of FANOUT leaves, inside a run by the heaviest coordinates
        order = np.argsort(sizes, kind="stable")
        run = np.arange(len(order)) // (FANOUT * FANOUT)
        self.order = order[np.lexsort((points[order, 1 % points.shape[1]], points[order, 0], run))] if len(order) else order
        self.levels = []
        top, low = points[self.order], sizes[self.order]
        while len(top) > 1:
            cut = np.arange(0, len(top), FANOUT)
            top, low = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut)
            self.levels.append((top, low))

    def need(self, a, b):
        """The least overlap of sets of sizes a and b that link: 100 o >= t (a + b - o)."""
        return -(-(self.t * (a + b)) // (100 + self.t))

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        where = np.arange(1 if self.levels else len(self.order))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low = self.levels[depth]
            where = where[np.minimum(top[where], q).sum(1) >= self.need(low[where], n)]
            where = (where[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            where = where[where < (len(self.levels[depth - 1][0]) if depth else len(self.order))]
            if not len(where):
                return where
        ids = self.order[where]
        fits = (100 * np.minimum(self.sizes[ids], n) >= self.t * np.maximum(self.sizes[ids], n)) & (
            np.minimum(self.points[ids], q).sum(1) >= self.need(self.sizes[ids], n)
        )
        return ids[fits]


def fine_groups(n: int) -> int:
    """Coordinates of the stored point of a set of n: a power of two that tells unlike sets of its size apart."""
    return max(GROUPS, 1 << max(0, -(-n // 6) - 1).bit_length())


def count_point(s: np.ndarray, groups: int) -> np.ndarray:
    """How many shingles of a set hash into each group."""
    return np.bincount((s >> np.uint64(30)).astype(np.int64) % groups, minlength=groups)


def fold(point: np.ndarray, groups: int) -> np.ndarray:
    """The point in fewer coordinates (both powers of two): groups are added up."""
    return point.reshape(-1, groups).sum(0)


#: Stored counts are uint16; the largest stands for any larger one and is read as this.
_FULL, _MANY = 65535, 1 << 40


def load_point(raw: bytes) -> np.ndarray:
    p = np.frombuffer(raw, "<u2").astype(np.int64)
    p[p == _FULL] = _MANY
    return p


def bound_forest(points: list[np.ndarray], sizes: np.ndarray, blocks: np.ndarray, tiles: np.ndarray, threshold: int, two: bool) -> list[tuple[int, int]]:
    """A spanning forest of the pairs in one block (if ``two``, of two tiles) that could link.

    ``blocks`` is ascending. Pairs whose ends hang together already are not looked at again.
    """
    coarse = np.array([fold(p, GROUPS) for p in points]).reshape(-1, GROUPS)
    root = np.arange(len(points))
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def fine(i: int, j: int) -> bool:
        g = min(len(points[i]), len(points[j]))
        return int(np.minimum(fold(points[i], g), fold(points[j], g)).sum()) >= -(-(threshold * int(sizes[i] + sizes[j])) // (100 + threshold))

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b and fine(i, j):
            root[max(a, b)] = min(a, b)
            out.append((i, j))

    cut = np.flatnonzero(np.diff(blocks)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(blocks)]])
    left, right = [], []
    for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
        b = hi - lo
        if b <= FANOUT:  # a single leaf: its entries are compared directly
            i, j = np.triu_indices(b, 1)
            if two:
                other = tiles[lo + i] != tiles[lo + j]
                i, j = i[other], j[other]
            left.append(lo + i)
            right.append(lo + j)
            continue
        tree = RTree(coarse[lo:hi], sizes[lo:hi], threshold)
        for i in range(b):
            for j in tree.search(coarse[lo + i], sizes[lo + i]).tolist():
                if j > i and not (two and tiles[lo + i] == tiles[lo + j]):
                    join(lo + i, lo + j)
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        near = 100 * np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j])
        i, j = i[near], j[near]
        for at in range(0, len(i), 1 << 15):
            a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            ok = (100 + threshold) * np.minimum(coarse[a], coarse[b]).sum(1) >= threshold * (sizes[a] + sizes[b])
            for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                join(x, y)
    return out


def _then_release(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``work``, after which what it has freed goes back to the system: bins differ much in size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = work(pdf)
        release()
        return out

    return run


def _bound_bin(threshold: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "tile", "node"], kind="stable")
        node = pdf["node"].to_numpy()
        got = bound_forest([load_point(p) for p in pdf["point"]], pdf["n_shingles"].to_numpy(), pdf["block"].to_numpy(), pdf["tile"].to_numpy(), threshold, pdf["cell_a"].iat[0] != pdf["cell_b"].iat[0])
        return pd.DataFrame([(node[i], node[j]) for i, j in got], columns=["node", "root"]).astype("int64")

    return _then_release(run)


def link_sets(sets: list[np.ndarray], tiles: np.ndarray, threshold: int, both: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(i, linked js) with j > i in the tree's numbering; if ``both``, only pairs across two tiles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tree = RTree(np.array([count_point(s, GROUPS) for s in sets]), sizes, threshold)
    values, dense = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(values), bool)
    for i in range(len(sets)):
        found = tree.search(tree.points[i], sizes[i])
        found = found[found > i]
        if both:
            found = found[tiles[found] != tiles[i]]
        if not len(found):
            continue
        own = dense[begin[i] : begin[i + 1]]
        mark[own] = True
        n = sizes[found]
        at = np.repeat(begin[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        inter = np.add.reduceat(mark[dense[at]].astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
        mark[own] = False
        found = found[100 * inter >= threshold * (sizes[i] + n - inter)]
        if len(found):
            yield i, found


def _link_bin(width: int, threshold: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        data, offs = utf8(pa.array(pdf["text"], pa.large_string()))
        sets: list[np.ndarray] = []
        for i, j in slices(offs):
            sets += shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
        node, tile, weight = pdf["node"].to_numpy(), pdf["tile"].to_numpy(), pdf["class_size"].to_numpy()
        right = np.array([len(s) > 0 and set_key(s) == k for s, k in zip(sets, node, strict=True)], bool)
        sets, node, tile, weight = [s for s, r in zip(sets, right, strict=True) if r], node[right], tile[right], weight[right]
        if len(sets) < 2:
            return pd.DataFrame({"src": [], "dst": [], "links": []}).astype("int64")
        root = np.arange(len(sets))
        degree = np.zeros(len(sets), np.int64)
        edges = []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, js in link_sets(sets, tile, threshold, pdf["cell_a"].iat[0] != pdf["cell_b"].iat[0]):
            degree[i] += weight[js].sum()
            degree[js] += weight[i]
            for j in js.tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((node[i], node[j], 0))
        linked = np.flatnonzero(degree)
        rows = edges + list(zip(node[linked], node[linked], degree[linked], strict=True))
        return pd.DataFrame(rows, columns=["src", "dst", "links"]).astype("int64")

    return _then_release(run)


def _cells(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.int64)
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for i, j in slices(offs):
                sets = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                if sets:
                    cells += np.bincount(_cells(np.concatenate(sets), bits), minlength=1 << bits)
            release()
        part = np.minimum(cells, 2**32 - 1).astype(np.uint32).reshape(PIECES, -1)
        yield pa.RecordBatch.from_pydict({"piece": list(range(PIECES)), "cells": [x.tobytes() for x in part]}, pa.schema([("piece", pa.int32()), ("cells", pa.binary())]))

    return run


def _add_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(pdf["cells"].iat[0]) // 4, np.uint64)
    for x in pdf["cells"]:
        total += np.frombuffer(x, np.uint32)
    return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "cells": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def shingle_counts(docs: DataFrame, width: int = 5) -> np.ndarray:
    """Occurrences of shingles over all documents in cells by hash: 1 MB whatever the input.

    Partial sketches meet in two rounds, so no task adds up more than about the square root
    of the number of partitions.
    """
    parts = docs.select("text").mapInArrow(_sketch(width, SKETCH_BITS), "piece int, cells binary")
    fan = max(1, math.isqrt(docs.sparkSession.sparkContext.defaultParallelism) * 4)
    once = parts.groupBy("piece", (F.spark_partition_id() % fan).alias("lane")).applyInPandas(_add_cells, "piece int, cells binary")
    rows = once.groupBy("piece").applyInPandas(_add_cells, "piece int, cells binary").collect()
    out = np.zeros((PIECES, (1 << SKETCH_BITS) // PIECES), np.uint32)
    for r in rows:
        out[r.piece] = np.frombuffer(r.cells, np.uint32)
    return out.ravel()


def prefix_length(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def _prefixes(width: int, threshold: int, counts: np.ndarray):
    bits = len(counts).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            for i, j in slices(offs):
                sets = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                keys = [set_key(s) if len(s) else None for s in sets]
                cold, hot = [], []
                for s in sets:
                    p = prefix_length(len(s), threshold) if len(s) else 0
                    often = counts[_cells(s, bits)]
                    order = np.lexsort((s, often))[:p]
                    rare = np.count_nonzero(often[order] <= COLD)
                    cold.append(s[order[:rare]].view(np.int64))
                    hot.append(s[order[rare:]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array(np.array([len(s) for s in sets], np.int64)),
                        pa.array(keys, pa.int64()),
                        pa.array([np.minimum(count_point(s, fine_groups(len(s))), _FULL).astype("<u2").tobytes() for s in sets], pa.binary()),
                        *(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in ps])]).astype(np.int32), pa.array(np.concatenate([*ps, np.zeros(0, np.int64)]))) for ps in (cold, hot)),
                    ],
                    ["doc_id", "row_key", "n_shingles", "node", "point", "prefix", "hot"],
                )
            release()

    return run


def _blocks(first: DataFrame) -> DataFrame:
    """(node, block, members): the classes that share a prefix shingle; equal blocks are one.

    The sketch bounds how many rows can have a cold shingle, so those meet in a window, with
    one shuffle. Hot ones are combined map-side and joined back, which AQE can split.
    """

    def facts(over=None) -> dict:
        found = {"low": F.min("node"), "high": F.max("node"), "members": F.count("*"), "sum": F.sum(F.xxhash64("node") % 1000003)}
        return {k: v.over(over) for k, v in found.items()} if over is not None else found

    cold = first.select("node", F.explode("prefix").alias("shingle")).withColumns(facts(Window.partitionBy("shingle")))
    hot = first.where(F.size("hot") > 0).select("node", F.explode("hot").alias("shingle"))
    known = hot.groupBy("shingle").agg(*(v.alias(k) for k, v in facts().items())).where("low <> high")
    both = cold.where("low <> high").unionByName(hot.join(known, "shingle").select(*cold.columns))
    return both.select("node", F.xxhash64("low", "high", "members", "sum").alias("block"), "members").distinct()


def _dealt(rows: DataFrame, group: str, bins: int) -> DataFrame:
    """``rows`` (node, ``group``, members) with tile and cell: where each is compared.

    A group of at most BIN members is dealt whole to one of ``bins``; a larger one is cut
    into tiles, and a member goes to the cell of its tile with every tile.
    """
    tiles = F.ceil(F.col("members") / BIN).cast("bigint")
    big = F.col("members") > BIN
    tile = F.when(big, F.pmod(F.xxhash64("node", F.lit(3)), tiles)).otherwise(F.lit(0)).cast("bigint")
    nowhere = F.lit(-1).cast("bigint")
    small = F.array(F.struct(F.pmod(F.xxhash64(group, F.lit(5)), F.lit(bins)).alias("place"), nowhere.alias("cell_a"), nowhere.alias("cell_b")))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), tiles - 1),
        lambda k: F.struct(F.col(group).alias("place"), F.least(k, F.col("tile")).alias("cell_a"), F.greatest(k, F.col("tile")).alias("cell_b")),
    )
    return rows.withColumn("tile", tile).withColumn("cells", F.when(big, pairs).otherwise(small))


def _row_key() -> Column:
    """A hash of id and text: rows that share it are repeated rows, whose sets are equal."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def ngram_jaccard_join(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id, class_size, n_links.

    Words are maximal runs without space and \\x09 to \\x0D, A-Z lower-cased. Two documents
    link when 100 * intersection >= threshold * union of their shingle sets.
    ``component_id`` is the smallest doc_id reachable by links, ``class_id`` the smallest
    with an equal set, ``n_links`` the number of other documents it links with.

    Null and wordless texts have the empty set, link with nothing and are their own class.
    Repeated rows and ids are rows of their own with one set each. A row whose doc_id is
    null takes part; its component_id is the smallest id of its component, null without
    one. Other columns are ignored; an empty table gives no rows.
    """
    return _joined(docs, width, threshold).drop("row_key", "group", "single")


def _joined(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """The join's rows with row_key, and with group and single, which tell components apart even where ids repeat."""
    rows = docs.select("doc_id", "text", _row_key().alias("row_key"))
    counts = shingle_counts(rows, width)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    table = materialize(
        rows.mapInArrow(_prefixes(width, threshold, counts), f"doc_id {id_type}, row_key bigint, n_shingles bigint, node bigint, point binary, prefix array<bigint>, hot array<bigint>"),
        "prefixes",
    )
    classes = materialize(
        table.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min("row_key").alias("first_key")), "classes"
    )
    # one row of each class emits its prefix; a repeated row emits twice, which changes nothing
    first = table.join(classes.select("node", "first_key"), "node").where("row_key = first_key")
    blocks = materialize(_blocks(first), "blocks")
    places = max(1, 2 * blocks.count() // BIN)
    met = _dealt(blocks, "block", places).join(first.select("node", "n_shingles", "point"), "node")
    met = met.select("node", "block", "tile", "n_shingles", "point", F.explode("cells").alias("cell")).select("node", "block", "tile", "n_shingles", "point", "cell.*")
    # written first: components begin in Python too, and a task with both would hold two workers
    near = materialize(met.groupBy("place", "cell_a", "cell_b").applyInPandas(_bound_bin(threshold), "node bigint, root bigint"), "near")
    groups = materialize(connected_components(near, "node", "root"), "groups")
    discard(near)
    discard(blocks)
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    dealt = _dealt(groups.join(sizes, "component"), "component", max(1, 2 * groups.count() // BIN))
    placed = dealt.join(classes, "node").select("node", "first_key", "class_size", "tile", "cells")
    texts = (
        rows.join(placed, F.col("row_key") == F.col("first_key"))
        .dropDuplicates(["row_key", "node"])
        .select("node", "text", "tile", "class_size", F.explode("cells").alias("cell"))
        .select("node", "text", "tile", "class_size", "cell.*")
    )
    found = materialize(
        texts.groupBy("place", "cell_a", "cell_b").applyInPandas(_link_bin(width, threshold), "src bigint, dst bigint, links bigint"), "links"
    )
    discard(groups)
    linked = connected_components(found, "src", "dst")
    degree = found.where("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("outside"))
    # the smallest id of each component, on linked classes alone: an unlinked one is its own component
    members = linked.join(classes.select("node", "class_id"), "node")
    lowest = members.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = members.select("node", "component").join(lowest, "component")
    per_class = classes.join(named, "node", "left").join(degree, "node", "left").select(
        "node", F.coalesce("component", "node").alias("group"), "class_id", "class_size", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("outside", F.lit(0)).alias("outside")
    )
    out = table.select("doc_id", "row_key", "n_shingles", "node").join(per_class, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
        F.when(alone, F.lit(0)).otherwise(F.col("class_size") - 1 + F.col("outside")).cast("bigint").alias("n_links"),
        "row_key",
        "group",
        F.when(alone, F.col("row_key")).alias("single"),
    )


def keep_one_of_each(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each component, of the smallest id there; columns unchanged.

    Components are told apart by their sets, so unlike texts that share an id all stay; of
    repeated rows one does. Rows without an id stay (nothing can be said to stand for them).
    """
    found = _joined(docs, width, threshold).where(F.col("doc_id") == F.col("component_id"))
    lead = found.groupBy("group", "single").agg(F.min("row_key").alias("_lead")).select("_lead")
    rows = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), _row_key().alias("row_key"))
    known = rows.join(lead, F.col("row_key") == F.col("_lead"), "left_semi").dropDuplicates(["row_key"])
    return known.select("row.*").unionByName(docs.where("doc_id is null"))
