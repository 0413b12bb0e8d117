"""Targets by water filling, rates, copies; the Feistel shuffle and its inverse."""
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, share=1.5, weights=(5, 2, 1)):
    """The contract, literally: share by weight, stop at twice the size, share the rest again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        add = {s: left * weight[s] / whole for s in open_}
        left = 0.0
        for s, x in add.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 9, 40):
        sizes = {f"s{i}é" if i % 2 else f"S{i}": int(rng.integers(0, 5000)) for i in range(n)} | {None: 70}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(fill(sizes), rel=1e-9, abs=1e-6)


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(5)
    docs = [(i, "w " * int(rng.integers(0, 60) if i % 3 else 25), f"s{min(i % 9, 4)}") for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    report = mixing.mixed_documents_report(df)
    got = report.collect()
    assert len(got) == len(docs)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.size == len(WORD.findall(docs[r.doc_id][1])) and 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert target == pytest.approx(fill(sizes))
    assert all(abs(taken[s] - target[s]) <= 2 for s in sizes)
    again = mixing.mixed_documents_report(df.repartition(7)).collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in got}
    mixed = Counter(r.doc_id for r in mixing.mix_documents(df).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_rates_tilt_by_size(spark):
    """Within a source the rate is 2 / (1 + exp(-lambda size)): monotone in size, exact in sum."""
    cells = spark.createDataFrame([(0, s, 50) for s in range(0, 40)], "sid int, size long, n long")
    for share in (0.02, 0.5, 1.3, 1.97):
        total = sum(50 * s for s in range(40))
        row = mixing.solve(cells, spark.createDataFrame([(0, share * total)], "sid int, target double")).first()
        s = np.arange(40)
        rate = 2 / (1 + np.exp(-row.lam * s / row.scale))
        assert (50 * s * rate).sum() == pytest.approx(share * total, rel=1e-6)
    for share, limit in ((0.0, 0.0), (2.0, 2.0)):
        row = mixing.solve(cells, spark.createDataFrame([(0, share * total)], "sid int, target double")).first()
        assert row.limit == limit


def test_odd_mix(spark, odd_documents, no_documents):
    assert mixing.mixed_documents_report(no_documents).count() == 0
    assert mixing.mix_documents(no_documents).count() == 0
    got = mixing.mixed_documents_report(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    same = [r.copies for r in got if r.doc_id == 103]
    assert len(same) == 2 and same[0] == same[1]
    mixed = mixing.mix_documents(odd_documents.withColumnRenamed("lang", "__hash").withColumnRenamed("n_chars", "copies"))
    assert mixed.count() == sum(r.copies for r in got)


def test_permutation():
    for n in (1, 2, 3, 7, 40, 1000, 4097):
        rows = np.arange(n)
        p = sharding.permute(rows, n, seed=3)
        assert sorted(p.tolist()) == rows.tolist()
        assert (sharding.permute(p, n, seed=3, inverse=True) == rows).all()
        shard, slot = sharding.place(rows, n, 5, seed=3)
        assert all(sharding.row_at(int(a), int(b), n, 5, seed=3) == i for i, (a, b) in enumerate(zip(shard, slot)))
    assert (sharding.permute(np.arange(1000), 1000, 1) != sharding.permute(np.arange(1000), 1000, 2)).any()
    with pytest.raises(ValueError):
        sharding.row_at(4, 1, 7, 5)


def test_shards(spark, odd_documents, no_documents):
    assert sharding.shard_documents(no_documents).count() == 0
    for df in (odd_documents, spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))):
        got = sharding.shard_documents(df, shards=7).collect()
        n = df.count()
        assert sorted(r.row_number for r in got) == list(range(n))
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert sharding.place([r.row_number], n, 7, 8) == ([r.shard], [r.slot])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(len(slots.get(k, [])) for k in range(7)) <= 1
        ids = [r.doc_id for r in sorted(got, key=lambda r: r.row_number)]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        again = sharding.shard_documents(df.repartition(5), shards=7).collect()
        assert Counter(again) == Counter(got)
    texts = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = sharding.shard_documents(odd_documents).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError):
        sharding.shard_rows(spark.createDataFrame([(1, 2)], "doc_id long, slot long"), "doc_id", [], 3)


def test_mix_keeps_columns_of_its_own_names(spark):
    from kestrel.llm import mixing
    rows = [(i, f"one two three {i}", "s", "c", 1, "h") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __copies string, __id int, __hash string")
    out = mixing.mix_documents(df)
    assert out.columns == df.columns and out.count() > 0
    assert {tuple(r) for r in out.collect()} <= set(rows)
