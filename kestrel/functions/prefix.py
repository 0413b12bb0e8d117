"""Distributed prefix sums — the replacement for a global ``Window.orderBy``.

A window ordered over all rows without a partition key runs in one task.  Here the rows are
range-partitioned by (keys, value, tiebreak) in their own types, each partition is summed, the
sums of the partitions before it (one row per partition and key group it holds) become offsets,
and rows are cumulated inside their partition only.  Any orderable type works, strings with a
long common prefix and 64-bit integers included, and a value with many rows is cut by its
``tiebreak`` columns.

Callers feed *distinct* ordering values with their weights (pre-aggregated) or pass
``tiebreak`` columns that make the order total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.session import cut_lineage


def prefix_sums(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str],
                descending: bool = False, tiebreak: Sequence[str] = (),
                buckets: int | None = None, suffix: str = "_before") -> DataFrame:
    """Add ``<s><suffix>`` = sum of ``s`` over rows of the same ``keys`` group that
    come strictly before the row in ``value`` order (then ``tiebreak``); nulls come first
    (last when ``descending``)."""
    keys = list(keys)
    parts = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_value = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    order = [by_value, *[F.col(t) for t in tiebreak]]
    # checkpointed: the partition number must mean the same rows in both uses
    ranged = cut_lineage(df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
                         .withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "__part").agg(*[F.sum(s).alias(f"__tot_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__part").alias("__at"),
        *[F.coalesce(F.sum(f"__tot_{s}").over(before), F.lit(0)).alias(f"__off_{s}") for s in sums])
    same = F.col("__part") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    # without keys the offsets are one row per partition
    out = ranged.join(offsets if keys else F.broadcast(offsets), same)
    return out.select(*df.columns, *[
        (F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"__off_{s}")).alias(f"{s}{suffix}")
        for s in sums])
