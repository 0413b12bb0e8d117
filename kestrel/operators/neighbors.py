"""L2 — exact distance to the k-th nearest neighbour by pivot cells.

The distinct points of the fitted rows are dealt to cells around pivots; a cell with too many
points is dealt again to pivots of its own, so that no cell is large however crowded a region is,
and equal points are one point with a count.  A first pass searches every query point's own cell, which
bounds its k-th distance.  A second pass sends it only to cells whose ring (least and greatest
distance of their points from the pivot) it can reach within that bound: by the triangle
inequality no other cell holds a nearer point.  In many dimensions rings rule out few cells, so
cells travel in groups: a query point goes once to a group, with the list of its cells to search.
Both passes compare blocks of a bounded number of points, and a group returns at most k distances
of a point.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.exprs import quote_ident
from kestrel.session import cut_lineage

#: Points of a cell aimed at (twice as many are left whole), most cells (pivots go to all tasks),
#: and query points compared with a cell at a time.
CELL_POINTS, MAX_CELLS, BLOCK = 2048, 8192, 2048
#: Groups of cells aimed at, and most points of a group (but for its last cell): so many points and
#: as many query points are in a task.
GROUPS, GROUP_POINTS = 16, 131_072
#: Part of a bound that rounding may take.
SLACK = 1e-9


def _points(df: DataFrame, vector: str) -> DataFrame:
    """(pid, v, n): distinct whole vectors, as packed doubles, with their counts; checkpointed."""
    x = F.col(quote_ident(vector)).cast("array<double>")
    whole = df.select(x.alias("x")).where(F.col("x").isNotNull() & F.forall(
        "x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))))
    distinct = whole.groupBy("x").agg(F.count(F.lit(1)).alias("n"))

    def pack(batches):
        for b in batches:
            v = [x.values.to_numpy().tobytes() for x in b.column("x")]
            yield pa.record_batch([b.column("pid"), pa.array(v, pa.binary()), b.column("n"), b.column("x")],
                                  names=["pid", "v", "n", "x"])

    return cut_lineage(distinct.withColumn("pid", F.monotonically_increasing_id()).mapInArrow(
        pack, "pid long, v binary, n long, x array<double>"))


def _matrix(packed) -> np.ndarray:
    """Rows of packed doubles as a matrix."""
    return np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one product, good to about 1e-15 of the squared lengths."""
    out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(out, 0.0, out=out)


def _dealt(points: DataFrame, pivots_of: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Points with the nearest of the pivots that ``pivots_of(cell)`` names (ids, matrix), and
    the distance from it (exact)."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                cell = part.column("cell").to_numpy(zero_copy_only=False).copy()
                x = _matrix(part.column("v").to_pylist())
                radius = part.column("radius").to_numpy(zero_copy_only=False).copy()
                for c in np.unique(cell):
                    ids, pivots = pivots_of(int(c))
                    if not len(ids):
                        continue
                    rows = np.flatnonzero(cell == c)
                    best = _squared(x[rows], pivots).argmin(axis=1)
                    cell[rows] = ids[best]
                    radius[rows] = np.sqrt(((x[rows] - pivots[best]) ** 2).sum(axis=1))
                yield pa.record_batch([part.column("pid"), part.column("v"), part.column("n"),
                                       pa.array(cell), pa.array(radius)], names=["pid", "v", "n", "cell", "radius"])

    return points.select("pid", "v", "n", "cell", "radius").mapInArrow(
        run, "pid long, v binary, n long, cell int, radius double")


def _cells(points: DataFrame, cell_points: int, max_cells: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(points with cell and radius, pivots by cell, (points, least, greatest radius) by cell)."""
    cells = points.select("pid", "v", "n", F.lit(0).alias("cell"), F.lit(0.0).alias("radius"))
    total = cells.count()
    aim = max(cell_points, -(-total // max_cells))
    sizes = {0: total}
    pivots: list[np.ndarray | None] = [None]
    while True:
        large = {c: -(-n // aim) for c, n in sizes.items() if n > 2 * aim or pivots[c] is None}
        if not large:
            break
        # pivots: the points of least hash; a hash bound keeps the ordered rows few
        share = F.create_map(*[F.lit(v) for c, m in large.items() for v in (c, min(1.0, 8.0 * m / sizes[c]))])
        wanted = F.create_map(*[F.lit(v) for c, m in large.items() for v in (c, m)])
        hashed = cells.where(F.col("cell").isin(list(large))).withColumn("h", F.xxhash64("v", F.lit(len(pivots))))
        few = hashed.where(F.pmod("h", F.lit(1 << 20)) <= F.lit(1 << 20) * share[F.col("cell")])
        nth = F.row_number().over(Window.partitionBy("cell").orderBy("h", "pid"))
        rows = few.withColumn("nth", nth).where(F.col("nth") <= F.greatest(wanted[F.col("cell")], F.lit(1))) \
            .select("cell", "v").collect()
        chosen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for c in large:
            own = [r["v"] for r in rows if r["cell"] == c]
            if own:
                ids = np.arange(len(pivots), len(pivots) + len(own), dtype=np.int32)
                chosen[c] = (ids, _matrix(own))
                pivots.extend(chosen[c][1])
        if not chosen:
            break
        none = (np.zeros(0, dtype=np.int32), np.zeros((0, 0)))
        cells = cut_lineage(_dealt(cells, lambda c, chosen=chosen: chosen.get(c, none)))
        stats = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"),
                                          F.max("radius").alias("hi")).collect()  # one row per cell
        before, sizes = sizes, {r["cell"]: r["n"] for r in stats}
        if sizes == before:
            break
    # cells that were split hold nothing any more
    names = sorted(sizes)
    number = np.full(len(pivots), -1, dtype=np.int32)
    number[names] = np.arange(len(names))
    ring = {r["cell"]: (r["n"], r["lo"], r["hi"]) for r in stats}
    packed = F.create_map(*[F.lit(v) for c in names for v in (c, int(number[c]))]) if len(names) < 500 else None
    if packed is not None:
        cells = cells.withColumn("cell", packed[F.col("cell")])
    else:
        spark = cells.sparkSession
        table = spark.createDataFrame([(c, int(number[c])) for c in names], "cell int, number int")
        cells = cells.join(F.broadcast(table), "cell").drop("cell").withColumnRenamed("number", "cell")
    return cells, np.stack([pivots[c] for c in names]), np.array([ring[c] for c in names])


def _search(pairs: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(qid, near): for pairs (qid, q, grp, reach, bound) the k nearest points (by count) within the
    bound of the cells ``reach`` of the group, as (squared distance, count); nothing where there is none.

    Pairs of a group are cut into blocks of about as many query points as it has points, and the
    group's points (grp, cell, v, n) go to each of its blocks."""
    points = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("points"))
    blocks = cut_lineage(pairs.groupBy("grp").agg(F.count(F.lit(1)).alias("pairs")).join(points, "grp").select(
        "grp", F.ceil(F.col("pairs") / F.greatest("points", F.lit(BLOCK))).cast("int").alias("blocks")))  # one row per group
    left = pairs.join(F.broadcast(blocks), "grp").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
    right = cells.join(F.broadcast(blocks), "grp").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", "block", "cell", "v", "n")

    def compare(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        ids, near = [], []
        if len(queries) and len(members):
            x, limit = _matrix(queries["q"]), queries["bound"].to_numpy() * (1 + SLACK)
            best, times = np.full((len(x), k), np.inf), np.zeros((len(x), k), dtype=np.int64)
            to = np.concatenate([np.asarray(r) for r in queries["reach"]])
            row = np.repeat(np.arange(len(x)), [len(r) for r in queries["reach"]])
            for cell, part in members.groupby("cell"):
                y, n = _matrix(part["v"]), part["n"].to_numpy()
                m = min(len(y), k)
                step = max(1, 4_000_000 // max(len(y), m * y.shape[1]))
                rows = row[to == cell]
                for at in range(0, len(rows), step):
                    own = rows[at:at + step]
                    q = x[own]
                    d = _squared(q, y)
                    pick = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(y) else np.tile(np.arange(m), (len(q), 1))
                    exact = ((y[pick] - q[:, None, :]) ** 2).sum(axis=2)
                    both, n_both = np.hstack([best[own], exact]), np.hstack([times[own], n[pick]])
                    order = np.argsort(both, axis=1, kind="stable")[:, :k]
                    best[own] = np.take_along_axis(both, order, axis=1)
                    times[own] = np.take_along_axis(n_both, order, axis=1)
            within = (times > 0) & (best <= limit[:, None])
            qid = queries["qid"].to_numpy()
            for i in np.flatnonzero(within.any(axis=1)):
                ids.append(qid[i])
                near.append([{"d": d, "n": n} for d, n in zip(best[i][within[i]].tolist(), times[i][within[i]].tolist())])
        return pd.DataFrame({"qid": pd.Series(ids, dtype="int64"), "near": near})

    return left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInPandas(
        compare, "qid long, near array<struct<d: double, n: long>>")


def _kth(near, k: int):
    """Squared distance at which the counts of ascending (d, n) reach k; null if they don't."""
    return F.aggregate(F.sort_array(near), F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d")),
                       lambda s, e: F.struct((s["n"] + e["n"]).alias("n"),
                                             F.when((s["n"] < k) & (s["n"] + e["n"] >= k), e["d"]).otherwise(s["d"]).alias("d")))["d"]


def knn_score(train: DataFrame, vector: str, k: int = 5, test: DataFrame | None = None, out: str = "score",
              cell_points: int = CELL_POINTS, max_cells: int = MAX_CELLS) -> DataFrame:
    """L2 — the rows of ``test`` with the Euclidean distance to the k-th nearest row of ``train``;
    without ``test`` the rows of ``train``, each without itself.

    Vectors must have one length.  A vector that is null or holds null or non-finite components
    has a null score and is nobody's neighbour; with fewer than k rows to compare, the score is
    null.  Ties and repeated rows count one by one.
    """
    points = _points(train, vector)
    own = test is None
    scored = train if own else test
    if not points.take(1):
        return scored.withColumn(out, F.lit(None).cast("double"))
    k_found = k + 1 if own else k  # a fitted row finds itself first
    cells, pivots, rings = _cells(points, cell_points, max_cells)
    queries = points if own else _points(test, vector)
    started = cells if own else _dealt(
        queries.select("pid", "v", "n", F.lit(0).alias("cell"), F.lit(0.0).alias("radius")),
        lambda c, ids=np.arange(len(pivots), dtype=np.int32): (ids, pivots))
    first = cut_lineage(started.select(F.col("pid").alias("qid"), F.col("v").alias("q"), "cell"))
    home = cut_lineage(_search(
        first.select("qid", "q", F.col("cell").alias("grp"), F.array("cell").alias("reach"),
                     F.lit(float("inf")).alias("bound")), cells.withColumn("grp", F.col("cell")), k_found))
    bounded = first.join(home, "qid", "left").withColumn(
        "bound", F.coalesce(_kth("near", k_found), F.lit(float("inf"))))
    count, low, high = rings.T
    group_points = max(cell_points, min(GROUP_POINTS, -(-int(count.sum()) // GROUPS)))
    group_of = ((np.cumsum(count) - count) // group_points).astype(np.int32)  # ascending by cell
    table = cells.sparkSession.createDataFrame(list(enumerate(group_of.tolist())), "cell int, grp int")
    grouped = cells.join(F.broadcast(table), "cell")  # one row per cell

    def reach(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _matrix(part.column("q").to_pylist())
                d = np.sqrt(_squared(x, pivots))
                bound = part.column("bound").to_numpy(zero_copy_only=False)
                away = np.maximum(np.maximum(d - high, low - d), 0.0)
                # the product's rounding counts as nearness
                away = np.maximum(away - 1e-7 * (1.0 + d), 0.0)
                can = away ** 2 <= bound[:, None] * (1 + SLACK)
                can[np.arange(len(x)), part.column("cell").to_numpy(zero_copy_only=False)] = False
                row, cell = np.nonzero(can)
                grp = group_of[cell]
                at_first = np.ones(len(row), dtype=bool)
                at_first[1:] = (row[1:] != row[:-1]) | (grp[1:] != grp[:-1])
                start = np.flatnonzero(at_first)
                rows = pa.array(row[start])
                cells_of = pa.ListArray.from_arrays(
                    pa.array(np.append(start, len(row)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                yield pa.record_batch([part.column("qid").take(rows), part.column("q").take(rows),
                                       pa.array(grp[start]), cells_of, pa.array(bound[row[start]])],
                                      names=["qid", "q", "grp", "reach", "bound"])

    further = bounded.select("qid", "q", "cell", "bound").mapInArrow(
        reach, "qid long, q binary, grp int, reach array<int>, bound double")
    near = home.unionByName(_search(further, grouped, k_found)).groupBy("qid").agg(
        _kth(F.flatten(F.collect_list("near")), k_found).alias("d2"))
    scores = queries.select(F.col("pid").alias("qid"), F.col("x").alias("__x")).join(near, "qid").select(
        "__x", F.sqrt("d2").alias(out))
    return scored.withColumn("__v", F.col(quote_ident(vector)).cast("array<double>")).join(
        scores, F.col("__v") == F.col("__x"), "left").drop("__v", "__x")
