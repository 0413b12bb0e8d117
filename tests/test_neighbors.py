"""L2 against full distance tables."""
import numpy as np
import pytest

from kestrel.operators.neighbors import knn_score


def brute(train, test, k, own):
    d = np.sqrt(((test[:, None, :] - train[None, :, :]) ** 2).sum(-1))
    if own:
        np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(test), np.nan)


def frame(spark, x, extra=()):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id long, x array<double>").repartition(4)


@pytest.mark.parametrize("cell", [16, 100, 5000])
def test_fitted_rows(spark, cell):
    """A third of the rows crowd one region, another part are equal points."""
    rng = np.random.default_rng(cell)
    x = np.concatenate([rng.normal(0, 1, (400, 6)), rng.normal(5, 1e-3, (300, 6)), np.tile(rng.normal(9, 1, (1, 6)), (60, 1)),
                        np.round(rng.normal(0, 1, (140, 6)))])
    df = frame(spark, x, [(9000, None), (9001, [float("nan")] * 6), (9002, [None] * 6)])
    got = {r["id"]: r["score"] for r in knn_score(df, "x", 5, cell_points=cell).collect()}
    assert len(got) == len(x) + 3 and got[9000] is got[9001] is got[9002] is None
    assert np.allclose([got[i] for i in range(len(x))], brute(x, x, 5, True), atol=1e-9)


def test_new_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 3))
    y = np.concatenate([rng.normal(0, 3, (300, 3)), x[:50], np.tile(x[:1], (700, 1))])
    got = {r["id"]: r["score"] for r in knn_score(frame(spark, x), "x", 3, frame(spark, y), cell_points=40).collect()}
    assert np.allclose([got[i] for i in range(len(y))], brute(x, y, 3, False), atol=1e-9)


def test_few_rows(spark):
    df = frame(spark, np.array([[0.0, 0.0], [3.0, 4.0]]))
    assert [r["score"] for r in knn_score(df, "x", 1).orderBy("id").collect()] == [5.0, 5.0]
    assert [r["score"] for r in knn_score(df, "x", 2).collect()] == [None, None]
    none = spark.createDataFrame([], "id long, x array<double>")
    assert knn_score(none, "x", 2).count() == 0
    assert [r["score"] for r in knn_score(none, "x", 2, df).collect()] == [None, None]


def test_only_reachable_cells(spark):
    """Far groups: a point is sent to cells of its own group only."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(1000 * g, 1, (200, 4)) for g in range(8)])
    import kestrel.operators.neighbors as nb
    sent = []
    search = nb._search
    nb._search = lambda pairs, cells, k: sent.append(pairs.count()) or search(pairs, cells, k)
    try:
        knn_score(frame(spark, x), "x", 5, cell_points=100).count()
    finally:
        nb._search = search
    assert sent[0] == len(x) and sent[1] < 4 * len(x)


def test_a_query_goes_once_to_a_group_of_cells(spark):
    """In many dimensions nearly every cell is within reach; the copies of a point stay few."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (1500, 24))
    import kestrel.operators.neighbors as nb
    sent = []
    search = nb._search
    nb._search = lambda pairs, cells, k: sent.append(pairs.count()) or search(pairs, cells, k)
    try:
        got = {r["id"]: r["score"] for r in knn_score(frame(spark, x), "x", 5, cell_points=20).collect()}
    finally:
        nb._search = search
    assert sent[1] <= (nb.GROUPS + 1) * len(x)
    assert np.allclose([got[i] for i in range(len(x))], brute(x, x, 5, True), atol=1e-9)
