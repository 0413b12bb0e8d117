"""Helpers shared by the training-data operators: word pattern, range buckets, scratch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir

#: A word: a run of characters that are neither the space nor U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

LOWEST = -(1 << 63)

FILE_ROWS = 10_000


def missing(df: DataFrame, *cols: str) -> None:
    """Raise a clear error when an input lacks a required column."""
    gone = [c for c in cols if c not in df.columns]
    if gone:
        raise ValueError(f"input has no column {', '.join(gone)}; it has {', '.join(df.columns)}")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (case-insensitively), derived from ``base``."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` increasing cut points of the integer column ``key``.

    One aggregation over the key column alone; the result has one value per target
    partition.  Cuts only balance the work, no result depends on them.
    """
    if parts < 2:
        return []
    probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    row = df.agg(F.percentile_approx(F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)), probs,
                                     F.lit(max(10_000, 20 * parts))).alias("b")).first()
    return sorted(set(row["b"] or []))


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` that are <= ``value``: a binary search over a literal array,
    so each row costs log2(number of bounds)."""
    if not bounds:
        return F.lit(0)
    cuts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        F.get(cuts, at + s - 1) <= value, at + s).otherwise(at))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors, and gives the optimizer true sizes.

    ``rows``: about how many rows to expect.  A small table made by a shuffle then becomes a few
    files of about FILE_ROWS rows instead of one for every shuffle partition.
    """
    path = scratch_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, min(shuffle_partitions(df.sparkSession), -(-rows // FILE_ROWS))))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Memory(dict):
    """Remembered values of at most about two times ``limit`` keys: when the young generation is
    full it becomes the old one, and keys still in use move up again."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def learn(self, keys: set, make) -> None:
        """Make every key readable; ``make(list of new keys)`` gives their values in order."""
        old = self.old
        new = [k for k in keys if k not in self and k not in old]
        found = {k: old[k] for k in keys if k not in self and k in old}
        found.update(zip(new, make(new)))
        if len(self) + len(found) > self.limit:
            kept = {k: self[k] for k in keys if k in self}
            self.old = dict(self)
            self.clear()
            self.update(kept)
        self.update(found)


class Remembered(dict):
    """``make(key)``, remembered for at most about two times ``limit`` keys: when the young
    generation is full it becomes the old one, and keys still in use move up again."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
