"""The density-scoring plan: bin -> permute -> fit -> score -> weight -> average -> top-k.

Everything between reading the table and the top-k is one lazy DataFrame plan;
the only driver-side values are plan metadata (column names and the small table
of column orders).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import binning, metrics, orders as ords, scoring
from kestrel.session import cut_lineage


def density_scores(df: DataFrame, row_id: str, label: str, cols: Sequence[str],
                   n_perms: int = 3, seed: int = 0, alpha: float = 1.0,
                   weights: DataFrame | None = None, method: str = "standard",
                   n_buckets: int = 10, train_filter=None, materialize: bool = True) -> DataFrame:
    """Mean weighted NLL per row over ``n_perms`` column permutations.

    The model is fitted on the normal rows (``label = 0``) unless ``train_filter``
    is given; every row is scored.  Returns ``(row_id, score)``.
    """
    spark = df.sparkSession
    numeric = binning.numeric_columns(df, cols)
    binned = binning.normalize(df.select(row_id, label, *cols), method, n_buckets, numeric)
    if materialize:
        # the binned table feeds the statistics, every count of the fit and the
        # scoring: write it once (reliable checkpoint) instead of re-deriving the
        # joins and binning statistics for each consumer
        binned = cut_lineage(binned)
    perms = scoring.orders_list(ords.permutations(spark, cols, n_perms, seed))
    train = binned.where(train_filter if train_filter is not None else F.col(label) == 0)
    model = scoring.fit_density(train, cols, perms, alpha)
    # broadcast the fitted tables only behind a proven bound on their size
    model = scoring.size_bounds(model)
    return scoring.mean_scores(binned, row_id, model, perms, weights)


def top_density_anomalies(df: DataFrame, row_id: str, label: str, cols: Sequence[str],
                          k: int = 20, **kw) -> DataFrame:
    """Flagship: the ``k`` highest-scoring rows with their original values, label,
    score (rounded to 6 decimals) and rank."""
    scores = density_scores(df, row_id, label, cols, **kw).withColumn(
        "score", F.round("score", 6))
    return metrics.top_anomalies(scores.withColumnRenamed("row_id", row_id), df, row_id, k)
