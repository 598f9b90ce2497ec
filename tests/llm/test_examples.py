from __future__ import annotations

import pickle
import weakref

import numpy as np

from lakeworks.llm import toxicity


def test_indexing_keeps_no_vector_and_equal_ids_are_ordered_by_label_and_vector():
    ids, labels = np.array([2, 1, 1, 1]), np.array([0, 1, 0, 0])
    vectors = [(np.array([w]), np.array([1.0])) for w in (0, 1, 3, 2)]
    assert toxicity._by_id(ids, labels, vectors) == [3, 2, 1, 0]
    alive = [weakref.ref(word) for word, _ in vectors]
    model, seen = toxicity.Examples(np.arange(4, dtype=np.uint64), np.ones(4)), []
    # The weights are sorted last, when the collected vectors must be gone.
    order = np.argsort
    toxicity.np.argsort = lambda *a, **k: (seen.append(sum(r() is not None for r in alive)), order(*a, **k))[1]
    try:
        model.index(ids, labels, (vectors.pop(0) for _ in range(4)))
    finally:
        toxicity.np.argsort = order
    assert seen[-1] == 0
    assert [len(v[0]) for v in model.indexed()] == [1, 1, 1, 1]


def _counted(examples=400, words=3000):
    """Words of falling frequency, texts of two kinds that share none, and copies."""
    chance = np.random.default_rng(5)
    share = 1 / np.arange(1, words // 2 + 1)
    vectors = []
    for i in range(examples):
        drawn = chance.choice(words // 2, 60, p=share / share.sum()) + i % 2 * (words // 2)
        vectors.append(np.unique(drawn, return_counts=True))
    vectors[100:110] = [vectors[7]] * 10
    return vectors, 1 + chance.random(words)


def test_occurrences_take_few_bytes_and_give_the_same_vectors():
    vectors, idf = _counted()
    weights = [(1 + np.log(times)) * idf[word] for word, times in vectors]
    lengths = np.array([np.sqrt((w**2).sum()) for w in weights])
    ids, labels = np.arange(len(vectors)), np.arange(len(vectors)) % 2
    full, small = (toxicity.Examples(np.arange(len(idf), dtype=np.uint64), idf) for _ in range(2))
    full.index(ids, labels, [(v[0], w / n) for v, w, n in zip(vectors, weights, lengths)])
    small.index(ids, labels, [(word, times.astype(np.uint8)) for word, times in vectors], lengths)
    # The model that tasks get: vocabulary, example and occurrences, no weights.
    postings = sum(len(v[0]) for v in vectors)
    assert len(pickle.dumps(small)) < 4 * postings + 20 * len(idf) + 50 * len(vectors)
    for (a, x), (b, y), (c, z) in zip(full.indexed(), small.indexed(), pickle.loads(pickle.dumps(small)).indexed()):
        assert a.tolist() == b.tolist() == c.tolist() and x.tolist() == y.tolist() == z.tolist()


def test_rare_and_frequent_words_together_lose_no_neighbour(monkeypatch):
    monkeypatch.setattr(toxicity, "FREQUENT", 20)
    vectors, idf = _counted()
    weights = [(1 + np.log(times)) * idf[word] for word, times in vectors]
    vectors = [(v[0], w / np.sqrt((w**2).sum())) for v, w in zip(vectors, weights)]
    model = toxicity.Examples(np.arange(len(idf), dtype=np.uint64), idf)
    model.index(np.arange(len(vectors)), np.arange(len(vectors)) % 2, vectors)
    dense = np.zeros((len(vectors), len(idf)))
    for row, (word, weight) in zip(dense, vectors):
        row[word] = weight
    found = model.neighbours(vectors + [(np.empty(0, np.int64), np.empty(0))])
    assert len(model.often) == 20 and not len(found.pop()[0])
    for i, (numbers, score) in enumerate(found):
        scores = np.round(dense @ dense[i], 9)
        order = np.lexsort((np.arange(len(scores)), -scores))[: toxicity.NEIGHBOURS]
        assert np.abs(score - scores[order]).max() < 1e-8
        # Equal ones, here the copies, come by their number.
        assert all(a < b for a, b, x, y in zip(numbers, numbers[1:], score, score[1:]) if x == y)
    assert found[7][0][:11].tolist() == found[105][0][:11].tolist() == [7, *range(100, 110)]
