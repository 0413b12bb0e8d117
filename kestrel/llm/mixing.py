"""Mixing sources to target token weights by entropy balancing.

Every document has the prior of two fair draws (one expected copy, two at most).  Among all
reweightings that give a source its target number of words, entropy balancing takes the one
closest to the prior: an exponential tilt in the document's size, with expected copies

    rate(size) = 2 / (1 + exp(-lambda_source * size / scale_source))

The multipliers solve a convex dual; Newton steps (kept inside a bracket) are distributed
aggregations over the distinct sizes of each source.  Rates are rounded into whole copies with
error diffusion from long to short documents, so a source misses its target by about its
shortest document only.  All sums that decide something are exact decimals, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import WORD, fresh, missing, written
from kestrel.session import cut_lineage

#: A cell of equal size in a source is split into pieces of about this many units for ranking.
PIECE = 1000
MAX_STEPS = 200


def source_targets(sizes: DataFrame, share: float = 1.5, weights: Sequence[float] = (5, 2, 1),
                   cap: float = 2.0) -> DataFrame:
    """source, sid, source_size, target from (source, size) rows.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` times
    all sizes; a target stops at ``cap`` times its source's size and the excess is shared again
    by weight.  That is water filling: target = least(cap, level * weight), with the level read
    off the sources sorted by cap per weight.  The windows run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    t = by.select("source", "source_size", at.alias("sid"))
    t = t.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]),
                                F.col("sid") % len(weights)))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(
        Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", level)
    return t.select("source", "sid", "source_size", F.least(
        "cap", F.max("level").over(every) * F.col("w")).alias("target"))


def _rate(lam: str, size: str, scale: str) -> Column:
    return F.lit(2.0) / (F.lit(1.0) + F.exp(-F.col(lam) * F.col(size) / F.col(scale)))


def _exact_sum(x: Column) -> Column:
    return F.sum(x.cast("decimal(30,6)")).cast("double")


def solve(cells: DataFrame, targets: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Multipliers of the sources: sid, lam, scale, limit (null, or the rate at a bound).

    ``cells`` has sid, size, n.  A target at twice the source's size (or at zero) has no finite
    multiplier; its rate is the bound itself.  One aggregation per step; the state has one row
    per source and is checkpointed, so a lost executor costs one step.
    """
    weight = F.col("n") * F.col("size")
    stats = cells.groupBy("sid").agg(F.sum(weight).cast("double").alias("size_sum"),
                                     F.sum("n").alias("n_sum"))
    state = targets.join(stats, "sid").select(
        "sid", "target", F.greatest(F.col("size_sum") / F.col("n_sum"), F.lit(1e-9)).alias("scale"),
        F.when(F.col("target") >= 2 * F.col("size_sum") * (1 - 1e-12), F.lit(2.0))
        .when(F.col("target") <= 0, F.lit(0.0)).alias("limit"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"))
    state = cut_lineage(state.withColumn("done", F.col("limit").isNotNull()))
    for _ in range(MAX_STEPS):
        if not state.where(~F.col("done")).take(1):
            return state.select("sid", "lam", "scale", "limit")
        r = _rate("lam", "size", "scale")
        sums = (cells.join(state.where(~F.col("done")), "sid")
                .groupBy("sid").agg(
                    _exact_sum(weight * r).alias("got"),
                    _exact_sum(weight * F.col("size") / F.col("scale") * r * (1 - r / 2)).alias("slope")))
        s = state.join(sums, "sid", "left")
        miss = F.col("got") - F.col("target")
        near = F.abs(miss) <= F.greatest(F.col("target") * tolerance, F.lit(1e-3))
        lo = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        s = s.withColumns({"lo": lo, "hi": hi, "newton": F.col("lam") - F.try_divide(miss, F.col("slope"))})
        inside = ((F.col("lo").isNull() | (F.col("newton") > F.col("lo")))
                  & (F.col("hi").isNull() | (F.col("newton") < F.col("hi")))
                  & (F.abs(F.col("newton") - F.col("lam")) <= 4 * (1 + F.abs("lam"))))
        step = F.when(F.coalesce(inside, F.lit(False)), F.col("newton")) \
            .when(F.col("hi").isNull(), 2 * F.abs("lam") + 1) \
            .when(F.col("lo").isNull(), -2 * F.abs("lam") - 1) \
            .otherwise((F.col("lo") + F.col("hi")) / 2)
        # a bracket that no double can split is as near as it gets
        stuck = F.coalesce((F.col("hi") - F.col("lo")) <= 1e-15 * F.abs("lam"), F.lit(False))
        end = F.col("done") | near | stuck
        state = cut_lineage(s.select(
            "sid", "target", "scale", "limit", F.when(end, F.col("lam")).otherwise(step).alias("lam"),
            "lo", "hi", end.alias("done")))
    raise RuntimeError(f"entropy balancing did not converge in {MAX_STEPS} steps")


def _round_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of the cells of one source: from long to short, each cell takes the copies
    nearest to its expectation plus what the longer cells left over, in words."""
    pdf = pdf.sort_values("size", ascending=False)
    size, n, rate = (pdf[c].to_numpy() for c in ("size", "n", "rate"))
    out, left = np.zeros(len(pdf), dtype=np.int64), 0.0
    for i in range(len(pdf)):
        if size[i] == 0:
            out[i] = n[i]
            continue
        want = n[i] * rate[i]
        out[i] = min(max(np.floor(want + left / size[i] + 0.5), 0), 2 * n[i])
        left += (want - out[i]) * size[i]
    return pd.DataFrame({"sid": pdf["sid"], "size": size, "n": n, "cell_copies": out})


def plan_copies(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Append ``copies`` (0, 1 or 2) to ``units`` (sid, size, hash, ...): tilted rates, rounded
    per cell (source, size) and dealt inside the cell by hash order.  Cells are pre-aggregated;
    a cell of many units is split into pieces of about PIECE units before anything is ranked."""
    cells = written(units.groupBy("sid", "size").agg(F.count("*").alias("n")), "mix-cells")
    rates = cells.join(solve(cells, targets), "sid").select(
        "sid", "size", "n", F.coalesce("limit", _rate("lam", "size", "scale")).alias("rate"))
    rounded = rates.groupBy("sid").applyInPandas(
        _round_source, "sid int, size long, n long, cell_copies long")
    pieces = F.ceil(F.col("n") / PIECE)
    u = units.join(rounded, ["sid", "size"]).withColumn("piece", F.pmod("hash", pieces))
    deal = u.groupBy("sid", "size", "piece").agg(
        F.count("*").alias("piece_n"), F.first("n").alias("n"),
        F.first("cell_copies").alias("cell_copies"))
    upto = F.sum("piece_n").over(Window.partitionBy("sid", "size").orderBy("piece"))
    deal = deal.withColumn("upto", upto)
    share = "cast(cast(cell_copies as decimal(19,0)) * cast({} as decimal(19,0)) div n as long)"
    deal = deal.select("sid", "size", "piece", "piece_n", (
        F.expr(share.format("upto")) - F.expr(share.format("(upto - piece_n)"))).alias("piece_copies"))
    at = F.row_number().over(Window.partitionBy("sid", "size", "piece").orderBy("hash", "doc_id")) - 1
    u = u.drop("n", "cell_copies").join(deal, ["sid", "size", "piece"]).withColumn("at", at)
    copies = F.expr("cast(piece_copies div piece_n as int)") + F.when(
        F.col("at") < F.col("piece_copies") % F.col("piece_n"), 1).otherwise(0)
    return u.withColumn("copies", copies.cast("int")).drop("piece", "piece_n", "piece_copies", "at")


def document_units(docs: DataFrame) -> DataFrame:
    """Small rows that are planned: doc_id, source, hash of the whole row, m (how many rows are
    identical), row_size (words of the text, null 0) and size (m times that, as identical rows
    share one decision)."""
    missing(docs, "doc_id", "text", "source")
    return docs.select(
        "doc_id", "source", F.xxhash64(*docs.columns).alias("hash"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("row_size")
    ).groupBy("doc_id", "source", "hash", "row_size").agg(F.count("*").alias("m")).withColumn(
        "size", F.col("row_size") * F.col("m"))


def plan_mix(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """doc_id, source, hash, m, row_size, source_size, target and copies of every distinct row.

    No text is shuffled.  A null source is a source of its own (the last); a document without
    words has size 0 and keeps one copy; an empty table gives an empty plan.
    """
    units = written(document_units(docs), "mix-units")
    targets = cut_lineage(source_targets(units.select("source", "size"), share, weights))
    keyed = units.join(targets.withColumnRenamed("source", "__source"),
                       F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    planned = plan_copies(keyed.select("doc_id", "source", "hash", "m", "row_size", "size", "sid"),
                          targets.select("sid", "target"))
    return planned.join(targets.select("sid", "source_size", "target"), "sid").drop("sid", "size")


def mix_documents(docs: DataFrame, share: float = 1.5,
                  weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """The mixed table: every row of ``docs`` repeated as often as the plan says (0 to 2).

    Rows equal in all columns share one decision, so a source that consists mostly of one
    repeated row can miss its target by up to half its words.
    """
    i, src, at, copies, h, each = (fresh(docs, n) for n in ("__id", "__src", "__plan", "__copies", "__hash", "__each"))
    plan = plan_mix(docs, share, weights).select(
        F.col("doc_id").alias(i), F.col("source").alias(src), F.col("hash").alias(at), F.col("copies").alias(copies))
    keyed = docs.withColumn(h, F.xxhash64(*docs.columns))
    joined = keyed.join(plan, (F.col(h) == F.col(at)) & F.col("doc_id").eqNullSafe(F.col(i))
                        & F.col("source").eqNullSafe(F.col(src)))
    return joined.withColumn(each, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*docs.columns)


def mixed_documents_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken."""
    plan = plan_mix(docs)
    return plan.withColumn("__each", F.explode(F.array_repeat(F.lit(0), F.col("m").cast("int")))).select(
        "doc_id", F.col("row_size").alias("size"), "source", "source_size", "target", "copies",
        (F.col("copies") * F.col("row_size")).alias("taken"))
