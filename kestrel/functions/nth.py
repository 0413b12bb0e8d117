"""The first n rows of an order, per group, without sorting or moving the table.

Radix selection: a histogram of the leading bits of the order value tells in which bin the n-th
row lies; the next pass looks at the following bits of that bin's rows only.  As soon as the bin
holds few rows (or equal values), every other row is decided by comparing its value with the
bin, in a filter, and only the rows of the bin are ordered.  The table itself is scanned, never
shuffled or written; what travels are histograms and the rows of one bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.prefix import prefix_sums
from kestrel.session import cut_lineage

#: Bits of a pass, rows of a bin that are ordered directly, and groups whose cuts (one row each)
#: are broadcast.
BITS, SMALL, GROUPS = 16, 20_000, 100_000


def hash_code(md5: Column) -> Column:
    """The leading 60 bits of an md5 in hex, in the order of the hex string."""
    return F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")


def mark_first(df: DataFrame, code: Column, ties: Sequence[Column], limits: DataFrame, by: Sequence[str] = (),
               out: str = "first", small: int = SMALL) -> DataFrame:
    """``df`` with a boolean ``out``: whether a row is among the first ``__limit`` rows of its
    group in the order of ``code`` (an integer; nulls first), then ``ties``.

    ``limits`` has one row per group (``by`` columns and ``__limit``); rows of other groups, and of
    groups with a null in ``by``, are left out.
    """
    by, columns = list(by), df.columns
    coded = df.withColumn("__code", code)
    low, high = coded.agg(F.min("__code"), F.max("__code")).first()
    low, high = low or 0, high or 0
    # a span of more than 63 bits loses its last bit, which the ties' order then decides
    half = 1 if high - low >= 1 << 63 else 0
    base = F.shiftright("__code", half) - F.lit(low >> half) if half else F.col("__code") - F.lit(low)
    width = ((high >> half) - (low >> half)).bit_length()

    def joined(rows: DataFrame, cut: DataFrame, few: bool) -> DataFrame:
        side = F.broadcast(cut) if few else cut
        return rows.join(side, by) if by else rows.crossJoin(F.broadcast(cut))

    few = limits.count() <= GROUPS if by else True
    cut = limits.select(*by, F.col("__limit").cast("long").alias("__left"))
    shift, rows, before = width, coded, None
    while True:
        shift = max(0, shift - BITS)
        prefix = F.coalesce(F.shiftright(base, shift), F.lit(-1))
        inside = joined(rows, cut, few)
        if before is not None:
            inside = inside.where(before == F.col("__bin"))
        bins = inside.groupBy(*by, prefix.alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.max("__left").alias("__left"))
        w = Window.partitionBy(*by).orderBy("__p")  # at most 2^BITS + 1 bins a group
        end = F.sum("__n").over(w)
        last = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__p"))) == 1
        reached = bins.withColumns({"__end": end, "__last": last}).where((F.col("__end") >= F.col("__left")) | F.col("__last"))
        first = F.row_number().over(Window.partitionBy(*by).orderBy("__p"))
        cut = cut_lineage(reached.withColumn("__k", first).where("__k = 1").select(
            *by, F.col("__p").alias("__bin"),
            F.least(F.col("__left") - F.col("__end") + F.col("__n"), F.col("__n")).alias("__left"), F.col("__n").alias("__size")))
        before = prefix
        largest = cut.agg(F.max("__size")).first()[0] or 0
        if shift == 0 or largest <= small:
            break
    placed = joined(coded, cut, few).withColumn("__p", prefix)
    sure = placed.where(F.col("__p") != F.col("__bin")).withColumn(out, F.col("__p") < F.col("__bin"))
    edge = placed.where(F.col("__p") == F.col("__bin"))
    if largest <= small:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("__code").asc_nulls_first(), *ties))
        edge = edge.withColumn(out, rank <= F.col("__left"))
    else:  # that many equal values: their order is cumulated in ranges
        edge = edge.withColumns({f"__tie{i}": t for i, t in enumerate(ties)} | {"__one": F.lit(1)})
        edge = prefix_sums(edge, by, "__code", ["__one"], tiebreak=[f"__tie{i}" for i in range(len(ties))]) \
            .withColumn(out, F.col("__one_before") < F.col("__left"))
    return sure.select(*columns, out).unionByName(edge.select(*columns, out))
