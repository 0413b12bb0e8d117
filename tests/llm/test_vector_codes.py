"""Product codes: Orchard search and refinement against full distance tables."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import vector_codes as vc


def brute(points, entries):
    d = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(-1)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("k, width, spread", [(256, 16, 900), (256, 2, 3), (7, 1, 2), (1, 4, 50), (40, 16, 1)])
def test_search_is_exact(k, width, spread):
    """Ties (small spreads give many equal entries and distances) go to the lowest index."""
    rng = np.random.default_rng(k + width)
    entries = rng.integers(-spread, spread + 1, (k, width))
    points = rng.integers(-2 * spread, 2 * spread + 1, (5000, width))
    index, dist = vc.Orchard(entries).nearest(points)
    want, least = brute(points, entries)
    assert (index == want).all() and (dist == least).all()


def reference(rows):
    x = np.array([[int(np.floor(1024 * c)) for c in v] for _, v, _ in rows])
    width = x.shape[1] // 4
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].tolist()))[:256]
    books = [x[order][:, p * width:(p + 1) * width] for p in range(4)]
    for step in range(5):
        found = [brute(x[:, p * width:(p + 1) * width], books[p]) for p in range(4)]
        if step < 4:
            for p in range(4):
                books[p] = np.array([
                    [int(s) // int((found[p][0] == e).sum()) for s in x[found[p][0] == e, p * width:(p + 1) * width].sum(0)]
                    if (found[p][0] == e).any() else books[p][e] for e in range(len(books[p]))])
    code = ["".join(f"{found[p][0][i]:02x}" for p in range(4)) for i in range(len(rows))]
    return code, sum(f[1] for f in found), vc.books_digest(np.stack(books))


def test_report_against_full_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist(), int(i % 5) if i % 7 else None) for i in range(600)]
    rows += [(3, rows[3][1], 1), (None, rows[9][1], None), (None, rows[10][1], 4)] + [(700, rows[0][1], 2)] * 300
    bad = [(800, None, 1), (801, [0.0] * 7 + [float("nan")], 1), (802, [float("inf")] + [0.0] * 7, 1), (803, [], 2),
           (804, [None] + [0.0] * 7, 3), (805, [0.5] * 4, 3)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int") \
        .withColumn("code", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)
    code, error, digest = reference(rows)
    by_label = {}
    for (_, _, label), e in zip(rows, error):
        by_label[label] = by_label.get(label, 0) + int(e)
    got = vc.code_report(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    want = [(r[0], c, int(e), by_label[r[2]], digest) for r, c, e in zip(rows, code, error)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_small_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    empty = vc.code_report(spark.createDataFrame([], kind))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    assert vc.code_report(spark.createDataFrame([(1, None, 2)], kind)).count() == 0
    one = vc.code_report(spark.createDataFrame([(1, [0.5, -0.5, 0.25, 1.0], 2)], kind)).collect()
    assert one[0]["code"] == "00000000" and one[0]["error"] == 0
    hollow = vc.code_report(spark.createDataFrame([(1, [], 2), (None, [], None)], kind)).collect()
    assert [(r["code"], r["error"]) for r in hollow] == [("00000000", 0)] * 2
    with pytest.raises(ValueError, match="4 equal parts"):
        vc.code_report(spark.createDataFrame([(1, [0.5, 1.0, 2.0], 2)], kind))
    with pytest.raises(ValueError, match="too large"):
        vc.code_report(spark.createDataFrame([(1, [1e30, 1.0, 2.0, 1.0], 2)], kind))
