"""K — joins and set operations that need a chosen plan shape.

K1 range lookup: the direct form ``lower < x AND upper > x`` has no equi-key, so Spark can only
plan a (broadcast) nested-loop join, O(rows x ranges).  Here the range ends are numbered, which
turns every end and every gap between neighbouring ends into one position.  A range covers a
run of positions and is posted on the at most 2 log R dyadic nodes that make up the run; each
node keeps its first range only.  A position that holds a probe value looks at the log R nodes
above it; probe values with the same position share the answer.  So R ranges post at most
2 R log R rows and at most min(N, 4 R) positions of N distinct probe values join with log R nodes
each, however the ranges overlap.  All of these tables grow with the data: none is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.exprs import quote_ident
from kestrel.functions.prefix import prefix_sums
from kestrel.session import cut_lineage, unbounded


def _nodes(first: Column, last: Column, levels: int) -> Column:
    """Dyadic nodes (level, index) whose positions together are ``first``..``last``."""
    zero = F.struct(first.cast("long").alias("a"), last.cast("long").alias("z"),
                    F.array().cast("array<struct<level:int,idx:bigint>>").alias("n"))

    def node(level, idx):
        return F.array(F.struct(level.cast("int").alias("level"), idx.alias("idx")))

    def step(s, level):
        open_ = s["a"] <= s["z"]
        odd = open_ & (s["a"] % 2 == 1)
        a = s["a"] + F.when(odd, F.lit(1)).otherwise(0)
        even = (a <= s["z"]) & (s["z"] % 2 == 0)
        z = s["z"] - F.when(even, F.lit(1)).otherwise(0)
        none = F.array().cast("array<struct<level:int,idx:bigint>>")
        return F.struct(  # an empty run stays empty at all coarser levels
            F.when(a > z, F.lit(1 << 62)).otherwise(F.shiftright(a, 1)).alias("a"),
            F.when(a > z, F.lit(-1).cast("long")).otherwise(F.shiftright(z, 1)).alias("z"),
            F.concat(s["n"], F.when(odd, node(level, s["a"])).otherwise(none),
                     F.when(even, node(level, s["z"])).otherwise(none)).alias("n"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), zero, step)["n"]


def range_lookup(df: DataFrame, x: str, ranges: DataFrame, lo: str, hi: str, value: str,
                 out: str, order: str | None = None, default: str = "Unknown") -> DataFrame:
    """K1 — first range (by ``order``, default ``lo``, then value) with ``lo < x < hi``; no match,
    or a null or NaN ``x``, gives ``default``.  Ranges with a null or crossed bound match nothing.
    Exact for overlapping, nested and equal ranges; see the module text for the plan."""
    order = order or lo
    r = cut_lineage(ranges.select(
        F.col(quote_ident(lo)).cast("double").alias("__lo"), F.col(quote_ident(hi)).cast("double").alias("__hi"),
        F.struct(F.col(quote_ident(order)).alias("o"), F.col(quote_ident(value)).cast("string").alias("v"))
        .alias("__hit")).where("__lo < __hi"))
    ends = r.select(F.explode(F.array("__lo", "__hi")).alias("__x"), F.lit(1).alias("__end"))
    probes = df.select(F.col(quote_ident(x)).cast("double").alias("__x"), F.lit(0).alias("__end")).where(
        "__x IS NOT NULL AND NOT isnan(__x)")
    values = ends.unionByName(probes).groupBy("__x").agg(F.max("__end").alias("__end"))
    # end number i is position 2 i, the gap behind it 2 i + 1; before the first end is nothing
    before = F.col("__end_before")
    placed = cut_lineage(prefix_sums(values, [], "__x", ["__end"]).select(
        "__x", F.when(F.col("__end") == 1, 2 * before).otherwise(2 * before - 1).cast("long").alias("__pos")))
    top = placed.agg(F.max("__pos")).first()[0]
    levels = max(int(top or 0), 1).bit_length()
    low = unbounded(placed.select(F.col("__x").alias("__lo"), (F.col("__pos") + 1).alias("__a")))
    high = unbounded(placed.select(F.col("__x").alias("__hi"), (F.col("__pos") - 1).alias("__z")))
    runs = r.join(low, "__lo").join(high, "__hi")
    tree = (runs.select("__hit", F.explode(_nodes(F.col("__a"), F.col("__z"), levels)).alias("__n"))
            .groupBy("__n.level", "__n.idx").agg(F.min("__hit").alias("__hit")))
    above = placed.where("__pos >= 0").select("__pos").distinct().select("__pos", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(
            k.alias("level"), F.floor(F.col("__pos") / F.pow(F.lit(2.0), k)).cast("long").alias("idx")))).alias("__n"))
    first = (above.select("__pos", "__n.level", "__n.idx").join(unbounded(tree), ["level", "idx"])
             .groupBy("__pos").agg(F.min("__hit")["v"].alias("__hit")))
    hits = placed.join(unbounded(first), "__pos").select("__x", "__hit")
    return (df.withColumn("__x", F.col(quote_ident(x)).cast("double")).join(unbounded(hits), "__x", "left")
            .withColumn(out, F.coalesce(F.col("__hit"), F.lit(default))).drop("__x", "__hit"))


def range_lookup_naive(df: DataFrame, x: str, ranges: DataFrame, lo: str, hi: str,
                       value: str, out: str, row_id: str, order: str | None = None,
                       default: str = "Unknown") -> DataFrame:
    """K1 as written, a nested-loop join: for checks on small tables only."""
    order = order or lo
    r = ranges.select(F.col(lo).alias("__lo"), F.col(hi).alias("__hi"),
                      F.col(value).alias("__val"), F.col(order).alias("__ord"))
    j = df.join(r, (F.col("__lo") < F.col(x)) & (F.col("__hi") > F.col(x)), "left")
    first = j.groupBy(row_id).agg(F.min_by("__val", F.col("__ord")).alias("__hit"))
    return (df.join(first, row_id, "left")
            .withColumn(out, F.coalesce(F.col("__hit").cast("string"), F.lit(default)))
            .drop("__hit"))


def hconcat(a: DataFrame, b: DataFrame, key: str = "row_id", how: str = "inner") -> DataFrame:
    """K3 — key-aligned horizontal concatenation (never positional)."""
    return a.join(b, key, how)
