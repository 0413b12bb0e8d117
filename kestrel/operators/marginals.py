"""Marginal counts of discrete columns, each summed from the smallest table that holds it.

The rows are counted once into a cube (one row per observed combination).  A request for many
column sets first packs them into covers: unions of sets whose tables stay small against the
cube.  All covers of a request are counted in one job over the cube, are kept, and serve later
requests too; every set is then summed from its smallest cover.  So the cube is read once per
cover, not once per set, and the plan of a job does not grow with the number of sets: which
columns a set takes is a small table joined to the counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.exprs import quote_ident
from kestrel.session import cut_lineage

#: A cover may have this part of the cube's rows, or this many rows if that is more.
SHARE, LEAST_ROWS = 1 / 8, 4096

Columns = tuple[int, ...]


def count_cube(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per observed combination of ``cols`` with its count ``__n``, checkpointed:
    every test of every depth reads it instead of the data."""
    cols = list(dict.fromkeys(cols))
    return cut_lineage(df.groupBy(*[F.col(quote_ident(c)) for c in cols])
                       .agg(F.count(F.lit(1)).alias("__n")))


class Marginals:
    """Counts of ``cols`` of ``df`` and the covers made from them so far."""

    def __init__(self, df: DataFrame, cols: Sequence[str]):
        self.cols = list(dict.fromkeys(cols))
        cube = count_cube(df, self.cols)
        values = [F.col(quote_ident(c)) for c in self.cols]
        self.cube = cube.select(F.lit(0).alias("set_id"), F.array(*[v.cast("string") for v in values]).alias("key"),
                                F.col("__n").alias("n"))
        row = cube.agg(F.count(F.lit(1)), *[F.count_distinct(v) for v in values]).first()
        self.rows, self.cards = row[0], [c + 1 for c in row[1:]]  # a null is a value of its own
        #: tables of covers, with the columns, number and rows of each cover
        self.levels: list[tuple[DataFrame, dict[Columns, tuple[int, int]]]] = []

    def columns(self, names) -> Columns:
        return tuple(sorted({self.cols.index(c) for c in names}))

    def _bound(self, columns: Columns) -> int:
        return min(self.rows, math.prod(self.cards[c] for c in columns))

    def _smallest(self, columns: Columns) -> tuple[int, Columns] | None:
        """(level, cover) of the fewest rows that holds the columns."""
        found = [(rows, level, cover) for level, (_, covers) in enumerate(self.levels)
                 for cover, (_, rows) in covers.items() if set(columns) <= set(cover)]
        return min(found)[1:] if found else None

    def _summed(self, source: DataFrame, wanted: list[tuple[int, Columns, int, Columns]]) -> DataFrame:
        """(set_id, key, n): sums of ``source`` for (number there, columns there, set_id, columns)."""
        takes: dict[int, list[tuple[int, list[int]]]] = {}
        for number, have, set_id, take in wanted:
            takes.setdefault(number, []).append((set_id, [have.index(c) for c in take]))
        table = source.sparkSession.createDataFrame(
            list(takes.items()), "set_id int, takes array<struct<target: int, places: array<int>>>")
        # one row per source set, bounded by the request: broadcast
        each = source.join(F.broadcast(table), "set_id").select("key", "n", F.explode("takes").alias("t"))
        return each.select(F.col("t.target").alias("set_id"), F.transform(
            "t.places", lambda p: F.get("key", p)).alias("key"), "n").groupBy("set_id", "key").agg(F.sum("n").alias("n"))

    def _cover(self, sets: list[Columns]) -> None:
        """Count covers for sets that no cover holds: each set joins the first union that stays
        within the limit, else it begins one."""
        limit = max(LEAST_ROWS, int(self.rows * SHARE))
        unions: list[set[int]] = []
        for s in sorted(sets, key=lambda s: (-len(s), s)):
            for u in unions:
                if u >= set(s) or math.prod(self.cards[c] for c in u | set(s)) <= limit:
                    u |= set(s)
                    break
            else:
                unions.append(set(s))
        covers = list(dict.fromkeys(tuple(sorted(u)) for u in unions))
        every = tuple(range(len(self.cols)))
        table = cut_lineage(self._summed(self.cube, [(0, every, i, c) for i, c in enumerate(covers)]))
        sizes = {r["set_id"]: r["m"] for r in table.groupBy("set_id").agg(F.count(F.lit(1)).alias("m")).collect()}
        self.levels.append((table, {c: (i, sizes.get(i, 0)) for i, c in enumerate(covers)}))

    def counts(self, sets: Sequence[Columns]) -> DataFrame:
        """(set_id, key, n) of every column set: set_id is its place in ``sets``, key the values
        of its columns in ascending order as strings."""
        small = [s for s in sets if self._smallest(s) is None]
        if small:
            self._cover(small)
        out = None
        by_level: dict[int, list] = {}
        for i, s in enumerate(sets):
            level, cover = self._smallest(s)
            by_level.setdefault(level, []).append((self.levels[level][1][cover][0], cover, i, s))
        for level, wanted in by_level.items():
            part = self._summed(self.levels[level][0], wanted)
            out = part if out is None else out.unionByName(part)
        return out

    def contingency(self, tests: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
        """Counts ``(test_id, s_key, x, y, n)`` of (x, y | S) tests; rows with a null in x, y or
        S are left out of that test."""
        sets = list(dict.fromkeys(self.columns((x, y, *s)) for x, y, s in tests))
        number = {s: i for i, s in enumerate(sets)}
        roles: dict[int, list] = {}
        for test_id, (x, y, s) in enumerate(tests):
            have = self.columns((x, y, *s))
            at = [have.index(self.cols.index(c)) for c in (x, y, *s)]
            roles.setdefault(number[have], []).append((test_id, at[0], at[1], at[2:]))
        table = self.cube.sparkSession.createDataFrame(
            list(roles.items()), "set_id int, tests array<struct<test_id: int, x: int, y: int, s: array<int>>>")
        whole = self.counts(sets).where(F.forall("key", lambda v: v.isNotNull()))
        each = whole.join(F.broadcast(table), "set_id").select("key", "n", F.explode("tests").alias("t"))
        return each.select(F.col("t.test_id").alias("test_id"), F.transform("t.s", lambda p: F.get("key", p)).alias("s_key"),
                           F.get("key", F.col("t.x")).alias("x"), F.get("key", F.col("t.y")).alias("y"), "n")
