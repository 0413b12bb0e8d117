"""Word vectors: the Huffman tree of runs, training against plain loops, fits without the vocabulary on the driver,
means against plain loops."""

import heapq
import math
import random
from collections import Counter

import numpy as np
import pytest

from kestrel.functions import skipgram as S
from kestrel.operators import text as D


def test_tree_of_runs_is_a_huffman_tree():
    rng = random.Random(3)
    for _ in range(100):
        weights = sorted(rng.choice([1, 1, 1, 2, 2, 3, 5, 8, rng.randint(1, 200)]) for _ in range(rng.randint(1, 60)))
        root = 2 * len(weights) - 2
        nodes, codes = S.paths(np.arange(len(weights)), S.huffman(sorted(Counter(weights).items())), root)
        heap, cost = weights[:], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            cost += (both := heapq.heappop(heap) + heapq.heappop(heap))
            heapq.heappush(heap, both)
        assert sum(w * n for w, n in zip(weights, (nodes >= 0).sum(1))) == cost
        assert set(nodes[nodes >= 0].tolist()) <= set(range(len(weights), root + 1))
        assert len({tuple((n, c) for n, c in zip(*x) if n >= 0) for x in zip(nodes.tolist(), codes.tolist())}) == len(weights)


def _plain(sentences, leaves, tree, root, dim, total, parts, part, seed, batch, chunk):
    """The same pairs one by one; gradients of a batch are taken before its vectors move."""
    nodes, codes = S.paths(leaves, tree, root)
    length = (nodes >= 0).sum(1)
    syn0 = S.first_vectors(leaves, dim, seed).astype(float)
    syn1 = {int(n): np.zeros(dim) for n in np.unique(nodes) if n >= 0}
    rng, moved = np.random.default_rng([seed, part]), np.zeros(len(leaves), int)
    places = [(s, i) for s in sentences for i in range(len(s))]
    for lo in range(0, len(places), chunk):
        here = places[lo:lo + chunk]
        rate = max(S.RATE * (1 - parts * lo / (total + 1)), S.RATE * 0.0001)
        reach = S.WINDOW - rng.integers(0, S.WINDOW, len(here))
        deep = np.array([length[s[i]] for s, i in here])
        kind = 2 * reach + (deep > np.median(deep))
        order = np.lexsort((rng.random(len(here)), kind))
        batches = []
        for at, k in enumerate(order):
            if not at or kind[k] != kind[order[at - 1]] or len(batches[-1]) == batch:
                batches.append([])
            batches[-1].append(k)
        for b in rng.permutation(len(batches)):
            d0, d1 = np.zeros_like(syn0), {n: np.zeros(dim) for n in syn1}
            for k in batches[b]:
                s, i = here[k]
                for c in range(max(0, i - reach[k]), min(len(s), i + reach[k] + 1)):
                    if c == i:
                        continue
                    moved[s[c]] += 1
                    for n, code in zip(nodes[s[i]].tolist(), codes[s[i]]):
                        if n >= 0 and abs(f := syn0[s[c]] @ syn1[n]) < S.MAX_EXP:
                            g = rate * (1 - code - 1 / (1 + math.exp(-f)))
                            d0[s[c]] += g * syn1[n]
                            d1[n] += g * syn0[s[c]]
            syn0 += d0
            for n in syn1:
                syn1[n] += d1[n]
    return syn0, moved


@pytest.mark.parametrize("dim, batch, chunk", [(4, 1, 50), (5, 3, 64), (6, 64, 200)])
def test_training_moves_vectors_as_plain_loops_do(monkeypatch, dim, batch, chunk):
    monkeypatch.setattr(S, "RATE", 0.3)
    monkeypatch.setattr(S, "MAX_EXP", 0.3)  # some exponents pass the bound
    rng = random.Random(dim)
    sentences = [[min(rng.randrange(12), rng.randrange(12)) for _ in range(rng.choice([1, 2, 5, 20]))] for _ in range(40)]
    n = Counter(w for s in sentences for w in s)
    ordered = sorted(n, key=lambda w: (n[w], w))
    number = {w: i for i, w in enumerate(ordered)}
    sentences = [[number[w] for w in s] for s in sentences]
    flat, ends = np.array([w for s in sentences for w in s]), np.cumsum([len(s) for s in sentences])
    args = (np.arange(len(ordered)), S.huffman(sorted(Counter(n.values()).items())), 2 * len(ordered) - 2, dim, len(flat), 2, 1, 7)
    got, moved = S.train(flat, ends, *args, batch=batch, chunk=chunk)
    want, times = _plain(sentences, *args, batch, chunk)
    assert moved.tolist() == times.tolist()
    assert got.shape == want.shape and np.abs(want - S.first_vectors(args[0], dim, 7)).max() > 0.2
    assert np.allclose(got, want, atol=1e-4)


def test_a_large_vocabulary_stays_off_the_driver(spark, monkeypatch):
    """More words than VOCABULARY are fitted without Spark ML's Word2Vec: every word in every part, the same in
    each run, words of one topic close to each other, rare ones left out on request."""
    import pyspark.ml.feature as ml
    monkeypatch.setattr(ml.Word2Vec, "fit", lambda *a, **b: pytest.fail("the vocabulary went to the driver"))
    monkeypatch.setattr(D, "VOCABULARY", 50, raising=False)
    monkeypatch.setattr(D, "PART_WORDS", 20_000)
    rng = random.Random(1)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(30)}" for _ in range(20))) for i in range(3000)]
    rows += [(9000 + i, f"alone{i}") for i in range(20)] + [(9100, None), (9101, ""), (9102, " \n ")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    got = {r.word: np.array(r.vec) for r in D.fit_word_vectors(df, ["t"], 8, min_count=1).collect()}
    assert set(got) == {w for _, t in rows for w in (t or "").split()} and len(got) == 80
    assert all(len(v) == 8 and v.any() and np.isfinite(v).all() for v in got.values())
    unit = {w: v / np.linalg.norm(v) for w, v in got.items()}
    near = [unit[f"a{i}"] @ unit[f"a{j}"] for i in range(30) for j in range(i)]
    far = [unit[f"a{i}"] @ unit[f"b{j}"] for i in range(30) for j in range(30)]
    assert min(near) > max(far)
    frequent = {r.word for r in D.fit_word_vectors(df, ["t"], 8, min_count=2).collect()}
    assert frequent == {w for w in got if not w.startswith("alone")}


def test_fit_is_the_same_in_each_run(spark, monkeypatch):
    monkeypatch.setattr(D, "VOCABULARY", 10, raising=False)
    monkeypatch.setattr(D, "PART_WORDS", 2000)
    df = spark.range(400).selectExpr("concat_ws(' ', transform(sequence(1, 15), i -> concat('w', pmod(hash(id, i), 90)))) as t")
    first, second = (sorted((r.word, r.vec) for r in D.fit_word_vectors(df, ["t"], 3, min_count=1).collect()) for _ in range(2))
    assert len(first) == 90
    assert np.allclose([v for _, v in first], [v for _, v in second], rtol=0, atol=1e-12)


def test_means_are_those_of_plain_loops(spark, monkeypatch):
    """Rows that share an id, rows without one, words with several vectors or none, long texts cut into pieces."""
    monkeypatch.setattr(D, "PART_NUMBERS", 16 * 700, raising=False)
    monkeypatch.setattr(D, "SENTENCE", 40, raising=False)
    rng = random.Random(2)
    vectors = [(f"w{i}", [float(i), i / 7, -1.0]) for i in range(60)] + [("w3", [5.0, 5.0, 5.0]), (None, [9.0, 9.0, 9.0])]
    rows = [(i % 150 if i % 11 else None, " ".join(f"w{rng.randrange(80)}" for _ in range(rng.choice([0, 1, 9, 41, 130]))), "W1 w1")
            for i in range(200)] + [(500, None, None), (501, " \t\n", "w99"), (502, "w3  w3\nw4", None)]
    df = spark.createDataFrame(rows, "id long, t string, u string")
    got = sorted((r.row_id if r.row_id is not None else -1, list(r.vec)) for r in D.mean_word_vectors(
        df, "id", ["t", "u"], spark.createDataFrame(vectors, "word string, vec array<double>"), 3).collect())
    of = {}
    for word, vec in vectors:
        of.setdefault(word, []).append(vec)
    want = []
    for key, _, _ in rows:
        words = [w for k, t, u in rows if k == key and key is not None for w in f"{t or ''} {u or ''}".split()]
        known = [v for w in words for v in of.get(w, [])]
        want.append((-1 if key is None else key, np.mean(known, axis=0).tolist() if known else [0.0] * 3))
    want.sort()
    assert [k for k, _ in got] == [k for k, _ in want]
    assert np.allclose([v for _, v in got], [v for _, v in want])
    assert not any(dict(got)[501]) and not any(dict(got)[-1])


def test_both_queries_fit_a_large_vocabulary_off_the_driver(spark, monkeypatch, tmp_path):
    """d04 and c12 hold the same mean vectors; every row with a word has one, a word seen once included."""
    import pyspark.ml.feature as ml
    from kestrel.plans import catalog
    monkeypatch.setattr(ml.Word2Vec, "fit", lambda *a, **b: pytest.fail("the vocabulary went to the driver"))
    monkeypatch.setattr(D, "VOCABULARY", 10, raising=False)
    monkeypatch.setattr(D, "PART_WORDS", 100)
    rows = [(1, i, ["user", "bot"][i % 2], f"once{i} again here w{i % 7}" if i % 9 else [None, "", f"only{i}"][i // 9 % 3])
            for i in range(90)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string") \
        .write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.row_id: list(r.vec) for r in catalog.QUERIES["d04_mean_word_vectors"](spark, str(tmp_path)).collect()}
    assert set(got) == {1000 + i for i in range(90)}
    assert all(len(v) == 16 and any(v) == bool(rows[k - 1000][3]) for k, v in got.items())
    features = {r.row_id: list(r.features) for r in
                catalog.QUERIES["c12_feature_matrix_vectors"](spark, str(tmp_path)).collect()}
    assert set(features) == set(got) and {len(f) for f in features.values()} == {17}
    assert all(np.allclose(features[k][1:], v) for k, v in got.items())
