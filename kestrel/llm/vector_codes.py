"""Vector code compression: product codes with codebooks refined by Orchard search.

A vector is turned into integers and cut into equal parts; each part is replaced by the index of
the nearest entry of that part's codebook.  The nearest entry is found by Orchard's search: every
entry keeps the list of all entries sorted by distance from it; a search walks the list of its
best entry so far, jumps to the list of an entry that is nearer as soon as one turns up, marks
entries it has measured, and ends where the list goes beyond twice the best distance (the
triangle inequality excludes the rest).  All arithmetic is in integers, so results are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import missing, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Points that search together, list places looked at in one step, entries that seed a search.
POINTS, STEP, SEEDS = 4096, 8, 8


class Orchard:
    """Distance-sorted neighbour lists of a codebook (rows of int64)."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, dtype=np.int64)
        k = len(self.entries)
        gaps = np.empty((k, k), dtype=np.int64)
        for i in range(k):
            gaps[i] = ((self.entries - self.entries[i]) ** 2).sum(axis=1)
        self.lists = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.lists, axis=1)
        self.seeds = np.unique(np.linspace(0, k - 1, min(k, SEEDS)).astype(np.int64))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lowest) and squared distance of every point."""
        found = [self._search(points[at:at + POINTS]) for at in range(0, len(points), POINTS)]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([i for i, _ in found]), np.concatenate([d for _, d in found])

    def _search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(points), len(self.entries)
        seen = np.zeros((n, k), dtype=bool)
        first = np.stack([((points - self.entries[s]) ** 2).sum(axis=1) for s in self.seeds], axis=1)
        at = first.argmin(axis=1)  # the first of equal ones, that is the lowest index
        best, dist = self.seeds[at], first[np.arange(n), at]
        seen[:, self.seeds] = True
        place = np.zeros(n, dtype=np.int64)
        active = np.arange(n)
        beyond = np.iinfo(np.int64).max
        while len(active):
            here, d = best[active], dist[active]
            places = place[active][:, None] + np.arange(STEP)
            inside = places < k
            places = np.minimum(places, k - 1)
            entry = self.lists[here[:, None], places]
            # an entry farther than twice the distance is farther from the point than the best one
            inside &= self.gaps[here[:, None], places] <= 4 * d[:, None]
            row, col = np.nonzero(inside & ~seen[active[:, None], entry])
            tried = entry[row, col]
            seen[active[row], tried] = True
            measured = np.full(entry.shape, beyond)
            measured[row, col] = ((points[active[row]] - self.entries[tried]) ** 2).sum(axis=1)
            least = measured.min(axis=1)
            index = np.where(measured == least[:, None], entry, k).min(axis=1)
            better = (least < d) | ((least == d) & (index < here))
            jumped = active[better]
            best[jumped], dist[jumped], place[jumped] = index[better], least[better], 0
            stays = active[~better]
            place[stays] += STEP
            active = np.sort(np.concatenate([jumped, stays[inside[~better, -1]]]))
        return best, dist


def integer_vectors(df: DataFrame, vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """(vec_id, label, x) of the rows whose vector is whole: not null, without null or non-finite
    components, and of length ``dim`` (None: the most frequent length, the longer of equally
    frequent ones).  x holds floor(SCALE * component).  Written to the shared folder.

    Components must be so small that squared distances fit into 63 bits, else ValueError.
    """
    missing(df, "vec_id", "label", vector)
    v = F.col(vector)
    whole = df.select("vec_id", "label", v.cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(
            ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
    sizes = whole.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top"))
    if dim is None:
        most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
        dim = most["d"] if most else 0
    if dim % PARTS:
        raise ValueError(f"a vector of {dim} components can't be cut into {PARTS} equal parts")
    top = sizes.where(F.col("d") == dim).agg(F.max("top")).first()[0] or 0.0
    if dim * (2 * (SCALE * top + 1)) ** 2 >= 2.0 ** 62:
        raise ValueError(f"components up to {top:g} are too large for exact squared distances")
    return written(whole.where(F.size("v") == dim).select(
        "vec_id", "label", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")).alias("x")), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths as an int64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _cut(x: np.ndarray, part: int) -> np.ndarray:
    width = x.shape[1] // PARTS
    return np.ascontiguousarray(x[:, part * width:(part + 1) * width])


def first_codebooks(vectors: DataFrame) -> np.ndarray:
    """(part, entry, component): the parts of the ENTRIES smallest vec_ids (null last; ties by
    the vector), ascending."""
    rows = vectors.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    x = np.array([r["x"] for r in rows], dtype=np.int64).reshape(len(rows), len(rows[0]["x"]) if rows else 0)
    return np.stack([_cut(x, p) for p in range(PARTS)])


def refine(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part goes to its nearest entry, every used entry becomes the floor of the
    mean of its parts.  Tasks send one sum per used entry; only those of a codebook reach the driver."""
    parts, entries, width = books.shape

    def run(batches):
        searches = [Orchard(b) for b in books]
        sums = np.zeros((parts, entries, width), dtype=np.int64)
        counts = np.zeros((parts, entries), dtype=np.int64)
        for b in batches:
            x = _matrix(b.column("x"))
            for p, search in enumerate(searches):
                points = _cut(x, p)
                index, _ = search.nearest(points)
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                if len(used):
                    sums[p, used] += np.add.reduceat(points[order], starts, axis=0)
                    counts[p] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(counts)
        columns = [part, entry, counts[part, entry], *sums[part, entry].T]
        yield pa.record_batch([pa.array(c) for c in columns], names=names)

    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]
    partial = vectors.select("x").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    total = partial.groupBy("part", "entry").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[2:]])
    out = books.copy()
    for r in total.collect():
        out[r["part"], r["entry"]] = [int(s) // int(r["n"]) for s in r[3:]]
    return out


def assign(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector: entry indexes as two hex digits each, and
    the squared distances summed over the parts."""
    def run(batches):
        searches = [Orchard(b) for b in books]
        for b in batches:
            x = _matrix(b.column("x"))
            codes, error = np.zeros((len(x), PARTS), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
            for p, search in enumerate(searches):
                codes[:, p], d = search.nearest(_cut(x, p))
                error += d
            yield pa.record_batch([b.column("vec_id"), b.column("label"),
                                   pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                                  names=["vec_id", "label", "code", "error"])

    kind = dict(vectors.dtypes)
    return vectors.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    """sha256 of the decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks) of the whole vectors of ``df``.

    Rows with a null vector, with null or non-finite components, or of another length than the
    table's are left out.  Repeated rows and ids get equal codes, null ids and labels stay; an
    empty table gives no rows and empty codebooks; other columns are ignored.
    """
    vectors = integer_vectors(df, vector)
    books = first_codebooks(vectors)
    if books.shape[1]:
        for _ in range(rounds):
            books = refine(vectors, books)
    return assign(vectors, books) if books.shape[1] else vectors.select(
        "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books


def code_report(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error (error over equal labels, nulls together) and
    codebooks_sha256 of every whole vector; odd rows as in ``compress``."""
    coded, books = compress(df, vector)
    coded = written(coded, "vector-codes")
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
