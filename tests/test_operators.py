"""Operators by themselves, on small relations."""

import random

import pytest
from pyspark.sql import functions as F

from meshwright.functions import text as T
from meshwright.operators import analytics, budget, cache, components, graph, layout, search


@pytest.mark.parametrize("held", [1, 200_000])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(components, "FOREST_EDGES", held)
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(k, k + 1) for k in range(300, 340)] + [(500, 500), (None, 3), (7, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_expand_admits_infrastructure_and_stops(spark):
    nodes = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", 2), ("e", 2), ("i", 0), ("j", 0)], "id string, tier long")
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "depends_on"), ("c", "d", "x"), ("d", "e", "x"), ("e", "i", "x"), ("d", "i", "x"), ("i", "j", "x")], "src string, dst string, relation string")
    got = graph.expand(nodes, edges, spark.createDataFrame([("a",)], "id string"))
    assert {r.id: r.cost for r in got.collect()} == {"a": 0.0, "b": 1.0, "c": 1.5, "d": 2.5, "i": 3.0, "j": 3.0}
    capped = graph.cap(got, nodes, spark.createDataFrame([("a",)], "id string"), 3)
    assert [r.id for r in capped.orderBy("rank").collect()] == ["a", "i", "j"]


def test_cycle_is_refused(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    with pytest.raises(ValueError):
        graph.longest_layers(nodes, spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"), max_rounds=5)


def test_layout_places_without_overlap(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("x", "y")]
    nodes = spark.createDataFrame([(c,) for c in "abcdxyzw"], "id string")
    rows = layout.layout(nodes, spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {r.id for r in rows} == set("abcdxyzw")
    boxes = [(r.x, r.y, r.x + r.width, r.y + layout.BOX_HEIGHT) for r in rows]
    for i, p in enumerate(boxes):
        for q in boxes[:i]:
            assert p[2] <= q[0] or q[2] <= p[0] or p[3] <= q[1] or q[3] <= p[1]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, "bird fish"), (4, "")], "id long, t string")
    got = {r.id: r.score for r in search.bm25(docs, "id", "t", ["cat", "dog"]).collect()}
    import math

    avg = 6 / 4
    idf = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in (("cat", 1), ("dog", 2), ("bird", 1), ("fish", 1))}
    part = lambda w, tf, dl: idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({1: part("cat", 2, 3) + part("dog", 1, 3), 2: part("dog", 1, 1)})


def test_greedy_pack_skips(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 9), (3, "c", 4)], "r int, item string, cost long")
    got = budget.greedy_pack(rows, [], ["r"], "item", "cost", 10, 1).first()
    assert (got.used, got.taken) == (10, ["a", "c"])


def test_latest_before(spark):
    e = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 9)], "id int, k string, t int")
    m = spark.createDataFrame([("u", 2), ("u", 5), ("v", 10)], "k string, t int")
    assert {r.id: r.latest for r in analytics.latest_before(e, m, "k", "t").collect()} == {1: 5, 2: None, 3: None}


def test_text_functions(spark):
    df = spark.createDataFrame([("HTTPServerError_codeX", "a/b/c", "a/b", "def f(self, x)")], "n string, p string, d string, s string")
    r = df.select(
        T.identifier_words(F.col("n")).alias("w"), T.path_contains(F.col("p"), F.col("d")).alias("c"), T.short_signature(F.col("s"), F.lit("A")).alias("s"),
        T.blank_comments(F.lit("x # y")).alias("b"), T.slug(F.lit("--A b!")).alias("g"),
    ).first()
    assert (r.w, r.c, r.s, r.b, r.g) == (["http", "server", "error", "code", "x"], True, "A.f(x)", "x    ", "a-b")


def test_cache_keeps_what_was_used(spark, tmp_path):
    work = spark.createDataFrame([("a",), ("b",)], "key string")
    old = spark.createDataFrame([("b",), ("c",)], "key string")
    assert [r.key for r in cache.missing(work, old, "key").collect()] == ["a"]
    path = str(tmp_path / "cache")
    cache.flush(cache.used_only(old, work, "key"), path)
    cache.flush(cache.used_only(old, work, "key"), path)
    assert [r.key for r in cache.cached_rows(spark, path).collect()] == ["b"] and cache.cached_rows(spark, path + "-none") is None
    assert len([p for p in (tmp_path / "cache").iterdir() if p.name.startswith("v-") and p.is_dir()]) == 1
