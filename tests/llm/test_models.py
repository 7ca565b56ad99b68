"""Classifiers, queries and the pipeline against plain versions, word by word and pair by pair."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from meshwright.llm import language_id, ngram_join, quality_rules, queries, tokens, toxicity, wordhash
from meshwright.llm.common import fold
from meshwright.operators import components

MASK = (1 << 64) - 1
_cache: dict = {}


@pytest.fixture(scope="module")
def documents(spark, small):
    return {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def language_model(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return language_id.train(docs, fold("doc_id", 4) != 2)


def ids_of(text):
    from tokenizers import Tokenizer

    if "library" not in _cache:
        _cache["library"] = Tokenizer.from_file(tokens.vocabulary())
    return _cache["library"].encode(text or "", add_special_tokens=False).ids


def plain_language(model, text):
    """(language, score, ambiguous) of one text, n-gram by n-gram and bit by bit."""
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    data = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in text.encode())
    total, count = np.zeros(len(model.bias)), 0
    for word in re.findall(rb"[a-z\x80-\xff]+", data):
        for order in (1, 2, 3):
            padded = b" " + word + b" "
            for at in range(len(padded) - order + 1):
                gram = padded[at : at + order]
                if (order == 1 and gram == b" ") or (order == 3 and gram[1:2] == b" "):
                    continue
                h = order * 97
                for k, b in enumerate(gram):
                    h = (h ^ b) * (2654435761, 2246822519, 3266489917)[k] & 0xFFFFFFFF
                total += model.weights[(h ^ h >> 15) & (language_id.FEATURES - 1)]
                count += 1
    margins = total / math.sqrt(max(count, 1)) + model.bias
    losses = [sum(t * math.log1p(math.exp(-m if bit else m)) for m, bit, t in zip(margins, row, model.trust, strict=True)) for row in model.code]
    p = [math.exp(min(losses) - x) for x in losses]
    best = losses.index(min(losses))
    score = p[best] / sum(p)
    return model.languages[best], score, score < language_id.AMBIGUOUS


def test_language_query_by_plain_decoding(spark, small, documents, language_model):
    rows = queries.op2_language_id(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        lang, score, _ = plain_language(language_model, documents[r.doc_id].text)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_languages_of_long_repeated_and_clashing_rows(spark, language_model):
    long = "the house of the king and the road to the river " * 40_000
    docs = spark.createDataFrame([(1, long, "a"), (2, "the house", "b"), (2, "the house", "b"), (3, None, "c"), (4, "\n\t ", "d")], "doc_id long, text string, score string")
    got = language_id.predict_language(docs, language_model, docs.columns).collect()
    assert len(got) == 5 and {type(r.score) for r in got} == {float}
    assert [r.lang_pred for r in got if r.doc_id in (3, 4)] == ["und", "und"]
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 2}) == 1
    assert abs(next(r.score for r in got if r.doc_id == 1) - plain_language(language_model, long)[1]) < 1e-3


def plain_mix(h):
    for shift, mul in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
        h = (h ^ h >> shift) * mul & MASK
    return h ^ h >> 33


def plain_features(text):
    """The distinct feature ids of a text: words, pairs, and pairs with a word between."""
    hashes = []
    for word in re.findall(rb"[a-z\x80-\xff]+", bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in (text or "").encode())):
        raw = sum(int(wordhash._BYTE[b]) * pow(wordhash._BASE, k, 1 << 64) for k, b in enumerate(word)) & MASK
        hashes.append(plain_mix(raw ^ len(word) * int(wordhash._STEP) & MASK))
    found = {h >> 44 for h in hashes}
    for gap, seed in ((1, int(toxicity._PAIR)), (2, int(toxicity._SKIP))):
        found |= {plain_mix(a * seed + b & MASK) >> 44 for a, b in zip(hashes, hashes[gap:], strict=False)}
    return sorted(found)


def test_toxicity_query_by_plain_scores(spark, small, documents):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{small}/documents.parquet"), labels)
    weight = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    rows = queries.op9_toxicity(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        z = model.bias + sum(weight.get(f, 0.0) for f in plain_features(documents[r.doc_id].text))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == (r.score >= toxicity.TOXIC)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_ftrl_by_a_scalar_loop():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(60)]
    y = np.array([int(3 in r or 7 in r) for r in rows])
    got = toxicity.fit_ftrl(rows, y, l1=0.5, epochs=3, seed=1)
    alpha, beta, l1 = 2.0, 1.0, 0.5
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if f != "bias" and abs(z[f]) <= l1:
            return 0.0
        cut = 0.0 if f == "bias" else math.copysign(l1, z[f])
        return -(z[f] - cut) / ((beta + math.sqrt(n[f])) / alpha)

    order = np.random.Generator(np.random.PCG64(1))
    for _ in range(3):
        for i in order.permutation(len(rows)):
            active = {f: weight(f) for f in [*rows[i].tolist(), "bias"]}
            g = 1 / (1 + math.exp(-sum(active.values()))) - y[i]
            for f, w in active.items():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w
                n[f] += g * g
    want = {f: weight(f) for f in range(30) if weight(f) != 0.0}
    assert dict(zip(got.index.tolist(), got.weight.tolist(), strict=True)) == pytest.approx(want) and got.bias == pytest.approx(weight("bias"))


def test_toxicity_of_long_repeated_and_clashing_rows(spark):
    model = toxicity.Model(np.array(plain_features("frobnitz")), np.array([9.0]), -4.0)
    long = "a day on the road " * 60_000 + "Frobnitz"
    docs = spark.createDataFrame([(1, long, "x"), (2, "day", "y"), (2, "day", "y"), (3, None, "z")], "doc_id long, text string, predicted string")
    got = toxicity.score_toxicity(docs, model, docs.columns).collect()
    assert sorted((r.doc_id, r.predicted) for r in got) == [(1, 1), (2, 0), (2, 0), (3, 0)]


def test_quality_without_labels(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    field = quality_rules.train(docs, spark.read.parquet(f"{small}/labels.parquet").limit(0))
    got = quality_rules.apply_quality_rules(docs, field, ["doc_id"]).collect()
    assert len(got) == docs.count() and all(r.kept == (not r.base_failed) for r in got)


def test_token_queries_by_the_library(spark, small, documents):
    want = {i: ids_of(r.text) for i, r in documents.items()}
    raw = lambda ids: np.array(ids, "<u4").tobytes()
    for r in queries.op6_bpe(spark, small).collect():
        ids = want[r.doc_id]
        text = _cache["library"].decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    at, got = 0, {r.doc_id: r for r in queries.op7_token_files(spark, small).collect()}
    for i in sorted(want):
        ids = [*want[i], 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(raw(ids)))
        at += len(ids)
    pieces = defaultdict(list)
    for r in queries.op5_packing(spark, small).collect():
        assert r.ids_crc32 == zlib.crc32(raw([*want[r.doc_id], 2][r.start : r.start + r.length]))
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for i, parts in pieces.items():
        assert [s for s, _, _ in sorted(parts)] == np.cumsum([0, *(n for _, n, _ in sorted(parts))])[:-1].tolist()
        assert sum(n for _, n, _ in parts) == parts[0][2] == len(want[i]) + 1
    assert sorted(pieces) == sorted(want)


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_by_plain_stages(spark, small, documents, language_model):
    """What survives each stage, decided document by document, and the ids that reach the windows."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    field = quality_rules.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    judged = quality_rules._judge(field, quality_rules.LEAST_CONTENT)()(pa.array([r.text for r in documents.values()]))
    left = {i for i, k in zip(documents, judged[6].to_pylist(), strict=True) if k}
    kept = docs.where(docs.doc_id.isin(sorted(left)))
    model = language_id.train(kept, fold("doc_id", 4) != 2)
    left = {i for i in left if not plain_language(model, documents[i].text)[2]}
    sets = {i: plain_shingles(documents[i].text) for i in left}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in left:
        for b in left:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                root[max(find(a), find(b))] = min(find(a), find(b))
    left = {i for i in left if find(i) == i}
    stage = docs
    for _, step in corpus_pipeline.STAGES[:4]:
        stage = corpus_pipeline.materialize(step(spark, stage, small), "test")
    texts = {r.doc_id: r.text for r in stage.collect()}
    assert set(texts) == left
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, small).collect():
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == {i: np.array([*ids_of(t), 2], "<u4").tobytes() for i, t in texts.items()}


def test_stages_on_odd_and_empty_tables(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = "The house of the king stands on the hill, and the road to it runs along the river.\n"
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (3, good, "en", "x", 80), (3, good, "en", "x", 80), (None, good, None, "x", 80), (4, good * 3000, "en", "x", 0), (5, "12 34", "fr", None, 5)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, small)
            assert name == "packing" or out.columns == table.columns
            n = out.count()
            assert (n == 0) == table.isEmpty() or name in ("quality rules", "language ID")


def python_nodes_of_tasks(df):
    """For each place where tasks of a DataFrame's plan end: the Python nodes that one of them runs at once."""
    found = []

    def walk(node, names):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.initialPlan(), names)
        if "Exchange" in name:
            names = []
            found.append(names)
        if re.search("MapIn|FlatMapGroups|FlatMapCoGroups|EvalPython", name):
            names.append(name)
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), names)

    found.append([])
    walk(df._jdf.queryExecution().executedPlan(), found[0])
    return found


def test_a_task_of_the_pipeline_holds_one_python_worker(spark, small, monkeypatch):
    """Two Python nodes in a task take two workers a core, and those stay for the stages to come."""
    seen = []

    def watch(owner, name):
        do = getattr(owner, name)

        def watched(df, *args, **kwargs):
            seen.extend(python_nodes_of_tasks(df))
            return do(df, *args, **kwargs)

        monkeypatch.setattr(owner, name, watched)

    for module in (corpus_pipeline, ngram_join, components):
        watch(module, "materialize")
    watch(type(spark.range(1)), "collect")
    assert corpus_pipeline.run(spark, small).count()
    assert sum(map(len, seen)) >= 8
    assert [names for names in seen if len(names) > 1] == []


def test_bins_give_freed_memory_back(spark, monkeypatch):
    given_back = []
    monkeypatch.setattr(ngram_join, "release", lambda: given_back.append(1))
    texts = [" ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}" for k in range(41))]
    sets = [wordhash.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
    node = [ngram_join.set_key(s) for s in sets]
    place = {"node": node, "tile": [0, 0], "cell_a": [-1, -1], "cell_b": [-1, -1]}
    linked = ngram_join._link_bin(5, 80)(pd.DataFrame(place | {"text": texts, "class_size": [1, 1]}))
    points = [ngram_join.count_point(s, 64).astype("<u2").tobytes() for s in sets]
    near = ngram_join._bound_bin(80)(pd.DataFrame(place | {"block": [7, 7], "n_shingles": [len(s) for s in sets], "point": points}))
    assert sorted(linked[linked.src == linked.dst].links) == [1, 1] and len(near) == 1
    assert len(given_back) == 2
