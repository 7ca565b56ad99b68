import random
import re

import numpy as np
import pytest

from meshwright.llm import ngram_join as J
from meshwright.llm.wordhash import shingle_sets, word_spans


def brute(rows):
    """{row number: (set size, component, links)} by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return [(len(sets[i]), least(groups[find(i)]), links[i]) for i in range(len(rows))]


def near_copies(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        rows.append((i * 3, (passage + "\n" + text if rng.random() < 0.3 else text).replace("w1", "W1") if rng.random() < 0.5 else text))
    return rows


@pytest.mark.parametrize(("seed", "bin_size"), [(1, 2048), (2, 4)])
def test_same_as_all_pairs(spark, monkeypatch, seed, bin_size):
    monkeypatch.setattr(J, "BIN", bin_size)  # small bins cut groups into tiles
    rows = near_copies(seed)
    got = {r.doc_id: r for r in J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), (n, component, links) in zip(rows, brute(rows), strict=True):
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (n, component, links)


def test_odd_rows(spark):
    long = " ".join(f"t{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (4, "A B"), (9, "a  b"), (None, "a b"), (5, long), (6, long + " x"), (None, None)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, node string, component_id int")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in J.ngram_jaccard_join(df).collect()]
    want = [(i, n, c, k) for (i, _), (n, c, k) in zip(rows, brute(rows), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = J.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, None, None]))


def test_repeated_and_null_ids_with_near_copies(spark):
    text = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    near = lambda k: text(k, 42)
    # every id but the last two belongs to several unlike texts, and each text has a near copy
    rows = [(7, text("a")), (7, text("b")), (7, text("c")), (8, near("a")), (8, near("b")), (8, text("z")), (8, text("z"))]
    rows += [(None, text(k)) for k in "defgh"] + [(None, near(k)) for k in "defg"] + [(5, near("h")), (9, near("c"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in J.ngram_jaccard_join(df).collect()]
    assert sorted(got, key=str) == sorted([(i, *b) for (i, _), b in zip(rows, brute(rows), strict=True)], key=str)
    kept = sorted(map(tuple, J.keep_one_of_each(df).collect()), key=str)
    want = [(7, text("a")), (7, text("b")), (7, text("c")), (8, text("z")), (5, near("h"))] + [r for r in rows if r[0] is None]
    assert kept == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.ngram_jaccard_join(df).collect() == []
    assert J.keep_one_of_each(df).collect() == []


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 300, 500)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in sizes]
    for i in range(0, 500, 5):
        sets[i] = np.unique(np.concatenate([sets[i - 1][: max(1, len(sets[i - 1]) - 2)], sets[i][:1]]))
    sizes = np.array([len(s) for s in sets])
    points = np.array([J.count_point(s, J.GROUPS) for s in sets])
    tree = J.RTree(points, sizes, 80)
    for i in range(0, 500, 7):
        bound = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero((bound >= tree.need(sizes, sizes[i])) & (100 * np.minimum(sizes, sizes[i]) >= 80 * np.maximum(sizes, sizes[i])))
        assert sorted(tree.search(points[i], sizes[i]).tolist()) == want.tolist()


def test_words_do_not_cross_documents():
    data = np.frombuffer("ab cdef g".encode(), np.uint8)
    starts, ends, doc = word_spans(data, np.array([0, 1, 1, 5, len(data)]))
    assert list(zip(starts.tolist(), ends.tolist(), doc.tolist(), strict=True)) == [(0, 1, 0), (1, 2, 2), (3, 5, 2), (5, 10, 3)]
    assert [len(s) for s in shingle_sets(data, np.array([0, 1, 1, 5, len(data)]))] == [1, 0, 1, 1]
