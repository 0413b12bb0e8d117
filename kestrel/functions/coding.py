"""Looking up values of many columns at once.

One table holds what belongs to every (column, value).  Its frequent values, as many as fit into
a byte bound, are broadcast and looked up in place.  Values that are not among them, of all
columns, go through one shuffle as (row, column, value) and come back as one map per row: however
many columns there are, the wide table is exchanged once, and not at all while the table is small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.exprs import quote_ident
from kestrel.session import cut_lineage

#: Bytes of frequent values (with their codes) that are broadcast for all columns together.
HEAD_BYTES = 16 << 20


def as_string(c: str) -> Column:
    return F.col(quote_ident(c)).cast("string")


def value_counts(df: DataFrame, cols: Sequence[str], value: Callable[[str], Column] = as_string,
                 first: str | None = None) -> DataFrame:
    """(ci, v, n): the distinct values of column number ci with their counts, of all columns in
    one pass; nulls are no values.  With ``first``, the least value of that column of the rows
    that hold a value is appended as first_pos."""
    position = [F.col(quote_ident(first)).alias("__first")] if first else []
    each = df.select(*position, F.explode(F.array(*[
        F.struct(F.lit(i).alias("ci"), value(c).alias("v")) for i, c in enumerate(cols)])).alias("e"))
    least = [F.min("__first").alias("first_pos")] if first else []
    return each.select(*["__first"] * bool(first), "e.*").where(F.col("v").isNotNull()).groupBy("ci", "v").agg(
        F.count(F.lit(1)).alias("n"), *least)


def look_up(df: DataFrame, cols: Sequence[str], table: DataFrame, payload: str,
            value: Callable[[str], Column] = as_string, head_bytes: int = HEAD_BYTES) -> tuple[DataFrame, list[Column]]:
    """(``df`` with helper columns, the payload of each column's value): ``table`` has ci, v, n
    and ``payload``, which is never null; a value without entry has none.

    ``table`` is read several times: write it first.  Drop the columns that ``df`` did not have.
    """
    width = F.lit(24) + F.octet_length(F.col("v").cast("string"))
    sizes = {r["k"]: r["b"] for r in table.groupBy(F.length(F.bin("n")).alias("k")).agg(F.sum(width).alias("b")).collect()}
    least, total = 1 << max(sizes, default=0), 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > head_bytes:
            break
        least = 1 << (k - 1)
    whole = least <= 1
    out, found = df, []
    for i, c in enumerate(cols):
        part = table.where((F.col("ci") == i) & (F.col("n") >= least)).select(
            F.col("v").alias(f"__v{i}"), F.col(payload).alias(f"__p{i}"))
        out = out.withColumn(f"__v{i}", value(c)).join(F.broadcast(part), f"__v{i}", "left")
        found.append(F.col(f"__p{i}"))
    if whole or not sizes:
        return out, found
    out = cut_lineage(out.withColumn("__rid", F.monotonically_increasing_id()))
    missed = out.select("__rid", F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"__v{i}").isNotNull() & F.col(f"__p{i}").isNull(), F.struct(F.lit(i).alias("ci"), F.col(f"__v{i}").alias("v")))
        for i in range(len(cols))]))).alias("e")).select("__rid", "e.*")
    rest = missed.join(table.where(F.col("n") < least).select("ci", "v", payload), ["ci", "v"]).groupBy("__rid").agg(
        F.map_from_entries(F.collect_list(F.struct("ci", payload))).alias("__rest"))  # at most one entry a column
    out = out.join(rest, "__rid", "left")
    return out, [F.coalesce(p, F.try_element_at("__rest", F.lit(i))) for i, p in enumerate(found)]
