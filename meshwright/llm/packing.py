"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are dealt by a hash into packing groups of about ``WINDOWS`` windows, which is
what a task holds. In a group every document is cut into pieces of at most ``PIECE``
tokens. Full-window pieces stand alone; the rest are partitioned into k windows by the
largest differencing method: every piece starts as a partial partition with one non-zero
sum, and the two partial partitions of largest spread are merged again and again, the
largest sums of one meeting the smallest of the other. k starts at the least count that
could hold the tokens and rises by one whenever a window would exceed its capacity.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import release
from .tokens import ChunkEncoder, vocabulary

CAPACITY, END, WINDOWS, PIECE = 4096, 2, 512, 512


def multiway_difference(sizes: np.ndarray, k: int, capacity: int | None = None) -> np.ndarray | None:
    """A window in [0, k) for every size, with near-equal window sums; None if one exceeds ``capacity``.

    Karmarkar and Karp's method for k-way partitions. Merges are kept as a tree of
    column permutations and unwound from the root, so no item lists are copied. Sums are
    kept as differences to the least; the total tells the largest sum at the root, so a
    partition that does not fit is never unwound.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    leaf_of = np.argsort(-sizes, kind="stable")
    sums: list[np.ndarray | None] = []
    tree: list[tuple[int, int, np.ndarray, np.ndarray] | None] = [None] * n
    heap: list[tuple[int, int]] = []
    for i, size in enumerate(sizes[leaf_of].tolist()):
        row = np.zeros(k, np.int64)
        row[0] = size  # rows are kept in descending order
        heap.append((-size, i))
        sums.append(row)
    # ascending already, thus a heap
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = sums[a] + sums[b][::-1]
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        merged -= merged[-1]  # only differences matter from here on
        heapq.heappush(heap, (-int(merged[0]), len(sums)))
        sums[a] = sums[b] = None
        tree.append((a, b, order, k - 1 - order))
        sums.append(merged)
    root = sums[-1]
    if capacity is not None and (int(sizes.sum()) - int(root.sum())) // k + int(root[0]) > capacity:
        return None
    out = np.zeros(n, np.int64)
    todo = [(len(sums) - 1, np.arange(k))]
    while todo:
        node, window = todo.pop()
        if tree[node] is None:
            out[leaf_of[node]] = window[0]
            continue
        a, b, at_a, at_b = tree[node]
        left, right = np.empty(k, np.int64), np.empty(k, np.int64)
        left[at_a], right[at_b] = window, window
        todo += [(a, left), (b, right)]
    return out


def pack(lengths: np.ndarray, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, window, offset) of every piece; windows are gapless from 0.

    Items of length 0 give no piece. Pieces of one window lie in the order of their items.
    """
    cut_item, cut_start, cut_len = [], [], []
    whole: list[tuple[int, int]] = []
    for i, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= capacity:
            whole.append((i, start))
            start += capacity
        while start < n:
            cut_item.append(i)
            cut_start.append(start)
            cut_len.append(min(piece, n - start))
            start += cut_len[-1]
    out = [(i, s, capacity, w, 0) for w, (i, s) in enumerate(whole)]
    sizes = np.array(cut_len, np.int64)
    if len(sizes):
        k = max(1, -(-int(sizes.sum()) // capacity))
        while (where := multiway_difference(sizes, k, capacity)) is None:
            k += 1
        fill = np.zeros(k, np.int64)
        last: dict[int, int] = {}
        for j in range(len(sizes)):
            w = int(where[j])
            # a piece that directly follows its document's previous piece in a window joins it
            p = last.get(w)
            if p is not None and out[p][0] == cut_item[j] and out[p][1] + out[p][2] == cut_start[j]:
                out[p] = (out[p][0], out[p][1], out[p][2] + cut_len[j], out[p][3], out[p][4])
            else:
                last[w] = len(out)
                out.append((cut_item[j], cut_start[j], cut_len[j], len(whole) + w, int(fill[w])))
            fill[w] += cut_len[j]
    return out


_SCHEMA = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _pack_group(path: str, capacity: int, piece: int, with_ids: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        # a fixed order, so that a recomputed task gives the same windows
        rows = rows.sort_by([("doc_id", "ascending"), ("crc", "ascending")])
        ids, at = ChunkEncoder.of(path).encode_documents(rows["text"].combine_chunks(), END)
        n = np.diff(at)
        got = pack(n, capacity, piece)
        item, start, length, window, offset = (np.array(c, np.int64) for c in zip(*got, strict=True))
        begin = at[item] + start
        raw = memoryview(ids.tobytes())
        part = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
        out = {
            "doc_id": rows["doc_id"].take(pa.array(item)),
            "start": start,
            "length": length,
            "ids_crc32": pa.array([zlib.crc32(x) for x in part], pa.int64()),
            "doc_tokens": n[item],
            "sequence_id": window + (key[0].as_py() << 24),
            "offset": offset,
        }
        if with_ids:
            out["ids"] = pa.array([bytes(x) for x in part], pa.binary())
        release()
        return pa.table(out)

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, windows: int = WINDOWS, piece: int = PIECE, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``ids`` are little-endian uint32; a document's ids are those of its whole text and the
    end id 2. Null and empty texts have the end id alone. Equal ids and repeated rows are
    packed as documents of their own; a null doc_id is kept. An empty table gives no rows;
    other columns are ignored. A sequence is padded to ``capacity`` by its reader.
    """
    path = tokenizer or vocabulary()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # the number of groups follows the corpus: one pass over lengths only; a token has two bytes or more on average
    size = docs.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    groups = max(1, round(size / 2.5 / (capacity * windows)))
    rows = docs.select("doc_id", "text")
    rows = rows.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    # rows without an id may be many and alike: those are spread by their place in the scan
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "crc", place), F.lit(groups)))
    schema = _SCHEMA.format(id=id_type) + (", ids binary" if with_ids else "")
    return rows.groupBy("group").applyInArrow(_pack_group(path, capacity, piece, with_ids), schema)
