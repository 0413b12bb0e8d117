"""Stream-static scoring with fitted (static) tables.

Fitted artefacts — binning statistics, density counts, column weights — are
static tables.  A streaming DataFrame is binned with the fixed statistics
(literals), expanded to (row, permutation, position) records in one projection,
and joined stream-static to the count tables: all stateless.  Each micro-batch
holds every record of its rows, so the per-row sum runs inside ``foreachBatch``
and is written to an epoch-keyed folder (a retried epoch overwrites its own
output: exactly-once files).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.exprs import quote_ident
from kestrel.operators import scoring as I


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int = 1) -> DataFrame:
    """Parquet file stream: new files matching ``path`` (a folder or a glob)
    become micro-batches.  The path is read as a glob, so a folder, a single file and a
    pattern behave alike in any store."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(f"{path[:-1]}[{path[-1]}]" if path[-1] not in "]}*/" else path))


def fixed_equal_width(stats_df: DataFrame, col: str, n_buckets: int = 10):
    """Fit equal-width bin edges on a static table; returns a function mapping a
    column to its bin with the fitted (literal) minimum and maximum."""
    row = stats_df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    mn, mx = float(row["mn"]), float(row["mx"])
    width = (mx - mn) or 1.0

    def apply(c: Column) -> Column:
        b = F.floor((c.cast("double") - F.lit(mn)) / F.lit(width) * n_buckets)
        return F.least(F.greatest(b, F.lit(0)), F.lit(n_buckets - 1)).cast("int")
    return apply


def score_records(stream: DataFrame, row_id: str, model: I.DensityModel, orders,
                  weights: DataFrame | None = None) -> DataFrame:
    """Per-record weighted NLL of a (streaming) DataFrame: projection + joins
    against the static model tables (stateless)."""
    olist = orders if isinstance(orders, list) else I.orders_list(orders)
    nll = I.score_nll(stream, row_id, model, olist)
    return I.feature_scores(nll, weights)


def run_stream_scores(stream: DataFrame, row_id: str, model: I.DensityModel, orders,
                      out_path: str, checkpoint: str, weights: DataFrame | None = None) -> str:
    """Run the stream to completion (available data) and write per-row scores
    ``(row_id, score)`` — the mean over permutations of the weighted sums."""
    olist = orders if isinstance(orders, list) else I.orders_list(orders)
    n_perms = len(olist)
    rec = score_records(stream, row_id, model, olist, weights)

    def per_batch(batch: DataFrame, epoch: int) -> None:
        scores = batch.groupBy("row_id").agg((F.sum("nll") / F.lit(float(n_perms))).alias("score"))
        scores.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    q = (rec.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


def stream_features(df: DataFrame, ts: str, value: str, binner) -> DataFrame:
    """Event features for scoring: type, weekday name, fixed-edge value bin."""
    return df.select("*", F.date_format(F.col(quote_ident(ts)), "EEEE").alias("weekday"),
                     binner(F.col(quote_ident(value))).cast("string").alias("value_bin"))


EVENT_FEATURES: Sequence[str] = ("event_type", "weekday", "value_bin")
