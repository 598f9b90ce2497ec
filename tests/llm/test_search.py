"""Vector searches and the toxicity index against brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeworks.llm import hnsw, mtree, toxicity

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    chance = np.random.default_rng(3)
    rows = [(i, chance.normal(size=8).round(3).tolist()) for i in range(400)]
    rows += [(i, [0.25] * 8) for i in range(400, 460)]  # a common vector
    rows += [(500, None), (520, [None] * 8), (540, [float("nan")] * 8), (560, [0.0] * 8), (580, [0.5] * 3), (600, [])]
    return rows + [(None, [0.1] * 8), (7, rows[7][1])]  # no id; a repeated row


def usable(rows, zero):
    return [
        (i, np.array(v, np.float32).astype(float))
        for i, v in rows
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and (zero or np.any(v))
    ]


def test_exact_search_is_brute_force(spark, vectors):
    known = usable(vectors, zero=True)
    expected = set()
    for q, a in known:
        if q % 20:
            continue
        scores = [
            (-int(np.floor(64 * a) @ np.floor(64 * b)), i) for i, b in known if i != q and len(a) == len(b)
        ]
        expected |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:20], 1)}
    found = mtree.top_k(frame(spark, vectors)).collect()
    assert {tuple(r) for r in found} == expected


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**24 + i), 1.0 + i]) for i in range(40)]
    found = {(r.query_id, r["rank"]): r.score for r in mtree.top_k(frame(spark, rows), k=1).collect()}
    value = lambda i: (int(np.float32(2**24 + i)) * 64, 64 * (1 + i))
    best = max(value(0)[0] * value(i)[0] + value(0)[1] * value(i)[1] for i in range(1, 40))
    assert found[0, 1] == best


def test_neighbours_are_found(spark, vectors):
    known = usable(vectors, zero=False)
    found = {}
    for r in hnsw.nearest(frame(spark, vectors), every=20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, a in known:
        if q % 20:
            continue
        near = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in known if i != q and len(a) == len(b))[:10]
        mine = sorted(found.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert all(s == pytest.approx(dict((i, d) for d, i in near).get(i, s), abs=1e-12) for _, i, s in mine)
        hits += len({i for _, i in near} & {i for _, i, _ in mine})
        total += len(near)
    assert hits >= 0.9 * total


@pytest.mark.parametrize("clusters", [0, 40, 60, 80])
def test_clusters_are_reached(clusters):
    """Recall of one full shard, its graph written and read again, by queries it does not hold."""
    chance = np.random.default_rng(clusters)
    shape = (hnsw.SHARD_ROWS + 200, 64)
    points = chance.normal(size=shape)
    if clusters:
        points = chance.normal(size=(clusters, 64))[chance.integers(0, clusters, shape[0])] + 0.05 * points
    points, queries = points[:-200], points[-200:]
    graph = hnsw.Graph.load(hnsw.Graph(np.arange(len(points)), points).dump())
    hits = 0
    for query in queries:
        (_, rows, _), *_ = graph.search(np.array([-1]), query[None], 10)
        near = np.argsort(((points - query) ** 2).sum(1), kind="stable")[:10]
        hits += len(set(near.tolist()) & set(rows[:10].tolist()))
    assert hits >= (0.95 if clusters else 0.9) * 10 * len(queries)


def test_every_node_is_reached():
    chance = np.random.default_rng(2)
    points = np.repeat(chance.normal(size=(30, 4)), 40, axis=0) + 1e-6 * chance.normal(size=(1200, 4))
    graph = hnsw.Graph(np.arange(1200), points)
    seen, waiting = {0}, [0]
    while waiting:
        new = set(graph._around(0, waiting.pop()).tolist()) - seen
        seen |= new
        waiting += new
    assert len(seen) == 1200


@pytest.fixture
def small_shards(monkeypatch):
    for module in (mtree, hnsw):
        monkeypatch.setattr(module, "SHARD_ROWS", 60)
        monkeypatch.setattr(module, "BLOCK_ROWS", 10)


def test_several_shards_ties_and_a_hot_id(spark, small_shards):
    """Equal scores come from several shards, one id holds a third of the rows, half of these alike."""
    chance = np.random.default_rng(4)
    rows = [(i, chance.integers(0, 2, 3).astype(float).tolist()) for i in range(1, 301)]
    rows += [(77, [1.0, 1.0, 1.0])] * 75 + [(77, chance.normal(size=3).round(3).tolist()) for _ in range(75)]
    rows += [(20, rows[19][1])] * 2  # a query's own row, repeated
    known = usable(rows, zero=True)
    expected = []
    for q in {i for i, _ in known if i % 20 == 0}:
        pairs = [(-int(np.floor(64 * a) @ np.floor(64 * b)), i) for p, a in known if p == q for i, b in known if i != q]
        expected += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(pairs)[:20], 1)]
    assert sorted(tuple(r) for r in mtree.top_k(frame(spark, rows)).collect()) == sorted(expected)
    known = usable(rows, zero=False)
    found = {(r.query_id, r["rank"]): r.score for r in hnsw.nearest(frame(spark, rows), every=50).collect()}
    hits = 0
    for q in (q for q in {i for i, _ in known if i % 50 == 0}):
        pairs = sorted(float(np.sqrt(((a - b) ** 2).sum())) for p, a in known if p == q for i, b in known if i != q)
        hits += sum(found[q, r] == pytest.approx(d) for r, d in enumerate(pairs[:10], 1))
    assert hits >= 0.9 * len(found)


def test_empty_tables(spark):
    assert mtree.top_k(frame(spark, [])).count() == 0
    assert hnsw.nearest(frame(spark, [])).count() == 0


def test_block_bounds_lose_no_neighbour():
    chance = np.random.default_rng(1)
    model = toxicity.Examples(np.arange(50, dtype=np.uint64), np.ones(50))
    vectors = []
    for _ in range(300):
        word = np.sort(chance.choice(50, chance.integers(1, 6), replace=False))
        weight = chance.random(len(word))
        vectors.append((word, weight / np.sqrt((weight**2).sum())))
    model.index(np.arange(300), chance.integers(0, 2, 300), vectors)
    dense = np.zeros((300, 50))
    for row, (word, weight) in zip(dense, vectors):
        row[word] = weight
    for i in range(0, 300, 7):
        scores = np.round(dense @ dense[i], 12)
        scores[i] = 0
        order = np.lexsort((np.arange(300), -scores))[:16]
        found, score = model.nearest(*vectors[i], 16, but=i)
        order = order[scores[order] > 0]
        assert found.tolist() == order.tolist()
        assert score == pytest.approx(scores[order])


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, f"plain words number{i % 17} here" + (" nasty slur" if bad else ""), "en"))
        labels.append((i, int(bad), int(bad)))
    rows += [(900, None, "en"), (901, "", "en"), (902, "zz " * 50000 + "nasty", "en"), (902, "nasty", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, score int")


def test_toxic_words_are_learned(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 0)
    found = {(r.doc_id, i): r for i, r in enumerate(toxicity.scored(docs, model).collect())}
    assert len(found) == docs.count()
    for (doc_id, _), row in found.items():
        expected = doc_id == 902 or (doc_id < 300 and doc_id % 5 == 0)
        assert (row.score >= 0.5) == expected and 0 <= row.score <= 1
    assert all(not r.evidence for (i, _), r in found.items() if i in (900, 901))
    assert all(e % 5 == 0 and e % 3 for (i, _), r in found.items() if i == 902 for e in r.evidence)


def test_without_labels_or_documents(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels.where("false"), F.lit(True))
    assert {r.score for r in toxicity.scored(docs, model).collect()} == {0.5}
    assert toxicity.scored(docs.where("false"), model).count() == 0


def test_all_words_make_the_vectors(spark):
    """Words that speak for a clean text, rare ones, and norms over every word of all documents."""
    texts = {i: f"calm{i % 2} words" for i in range(8)} | {8: "vile rant", 9: "calm0 unheard unheard", 10: "vile else"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 8)) for i in range(9)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    found = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    frequency = Counter(w for t in texts.values() for w in set(t.split()))

    def vector(text):
        own = {w: (1 + math.log(n)) * (1 + math.log(12 / (1 + frequency[w]))) for w, n in Counter(text.split()).items()}
        length = math.sqrt(sum(x * x for x in own.values()))
        return {w: x / length for w, x in own.items()}

    vectors = {i: vector(t) for i, t in texts.items()}
    for i, row in found.items():
        near = [(-round(sum(x * vectors[e].get(w, 0) for w, x in vectors[i].items()), 12), e) for e in range(9)]
        near = sorted(n for n in near if n[0])
        assert row.evidence == [e for _, e in near]
        places = [model.ids.tolist().index(e) for _, e in near]
        assert row.score == pytest.approx(model.score(np.array(places), np.array([-s for s, _ in near])))
    assert found[10].score > found[9].score


def test_own_copies_hide_no_neighbour():
    ids = np.array([5] * 30 + [7, 8] + [9] * 30)
    found = list(hnsw.Graph(ids, np.ones((62, 4))).search(np.array([5]), np.ones((1, 4)), 10))
    assert [i for _, rows, _ in found for i in rows.tolist()] == [7, 8] + [9] * 8
