"""Connected components of an undirected edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import written


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """(node, m): the smallest of a node and its neighbours ``other``."""
    return edges.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("m")).select(
        "node", F.least("node", "m").alias("m"))


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node reachable.

    Large star: every node ties its larger neighbours to its smallest one.  Small star: every
    node ties itself and its smaller neighbours to the smallest of them.  Both keep the components; in turns
    they leave stars around the smallest nodes after a number of rounds that is logarithmic in
    practice.  A round is one written table of at most as many edges as before; their number and
    the sum of their hashes tell when a round changed nothing.  ``rows``: about how many edges
    there are.
    """
    # from here on a > b
    edges = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges", rows)
    last, rows = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.where("b > a").withColumnRenamed("a", "node").join(_least(both, "a", "b"), "node").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.withColumnRenamed("a", "node").join(_least(large, "a", "b"), "node").select(
            "node", F.col("b").alias("low"), "m")
        edges = written(small.select(F.explode(F.array("node", "low")).alias("a"), F.col("m").alias("b"))
                        .where("a <> b").distinct(), "cc-edges", rows)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == last or state[0] == 0:
            break
        last, rows = tuple(state), state[0]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
