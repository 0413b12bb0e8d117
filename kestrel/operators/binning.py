"""C — binning, scaling and categorical encoding.

Every operator works on whole columns with aggregate statistics joined back as
one small row (min/max/mean/std are a single-row aggregate, so the broadcast is
bounded by the number of columns).  Ranks never use a global window: distinct
values are counted, cumulated with :func:`kestrel.functions.prefix.prefix_sums`
and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.coding import look_up, value_counts
from kestrel.functions.exprs import LANGUAGE_WORDS, ordinal_words, quote_ident
from kestrel.functions.prefix import prefix_sums
from kestrel.session import cut_lineage, unbounded

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    names = cols if cols is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in names if isinstance(types[c], NUMERIC)]


def _stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: min, max, distinct count, mean, population std per column."""
    aggs = []
    for c in cols:
        x = F.col(quote_ident(c)).cast("double")
        aggs += [F.min(x).alias(f"__min_{c}"), F.max(x).alias(f"__max_{c}"),
                 F.avg(x).alias(f"__mean_{c}"), F.stddev_pop(x).alias(f"__std_{c}")]
    st = df.agg(*aggs)
    # "more than one distinct value" is min < max: no distinct aggregation needed
    return st.select("*", *[F.when(F.col(f"__min_{c}") < F.col(f"__max_{c}"), F.lit(2))
                            .otherwise(F.lit(1)).alias(f"__nu_{c}") for c in cols])


def _with_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    # the statistics are one row: broadcasting it is always bounded
    return df.crossJoin(F.broadcast(_stats(df, cols)))


def _drop_stats(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def bin_quantile(df: DataFrame, cols: Sequence[str] | None = None,
                 buckets: int | None = None) -> DataFrame:
    """C1 — ``rank(min) / n * 100`` truncated, as ``'the 42nd percentile'``.

    ``n`` counts every row (nulls included); null values become ``'NaN'``.  Only
    columns with more than one distinct value are rewritten.
    """
    cols = numeric_columns(df, cols)
    if not cols:
        return df
    counts = cut_lineage(df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(quote_ident(c)).cast("double").alias("v"))
        for c in cols])).alias("kv")).select("kv.c", "kv.v")
        .groupBy("c", "v").agg(F.count(F.lit(1)).alias("cnt")))
    ranked = prefix_sums(counts.where("v IS NOT NULL"), ["c"], "v", ["cnt"], buckets=buckets)
    rows = counts.groupBy("c").agg(F.sum("cnt").alias("n"))
    # the percentile is a step function of the value with at most 101 steps per column: their
    # first values are read by the driver and become a comparison tree, so rows need no join
    steps = (ranked.join(rows, "c")
             .withColumn("pct", F.floor((F.col("cnt_before") + 1) / F.col("n") * 100).cast("long"))
             .groupBy("c", "pct").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("d")).collect())
    found: dict[str, list] = {c: sorted((r.v, r.pct, r.d) for r in steps if r.c == c) for c in cols}
    out = df.withColumns({f"__p{i}": _step_tree(F.col(quote_ident(c)).cast("double"), found[c])
                          for i, c in enumerate(cols) if found[c]})
    for i, c in enumerate(cols):
        if sum(d for *_, d in found[c]) <= 1:
            out = out.withColumn(c, F.col(quote_ident(c)).cast("string"))
        else:
            out = out.withColumn(c, F.when(F.col(quote_ident(c)).cast("double").isNull(), F.lit("NaN"))
                                 .otherwise(ordinal_words(F.col(f"__p{i}"))))
    return out.drop(*[f"__p{i}" for i in range(len(cols))])


def _step_tree(v: Column, steps: list) -> Column:
    """The second entry of the last of the ascending ``steps`` whose first entry is <= ``v``."""
    if len(steps) == 1:
        return F.lit(steps[0][1])
    half = len(steps) // 2
    return F.when(v < F.lit(steps[half][0]), _step_tree(v, steps[:half])).otherwise(
        _step_tree(v, steps[half:]))


def bin_equal_width(df: DataFrame, cols: Sequence[str] | None = None,
                    n_buckets: int = 10) -> DataFrame:
    """C4 — min-max scaled times ``n_buckets`` (if more than one distinct value),
    then half-even rounding: ``/10`` to 1 decimal if ``10 % n_buckets == 0`` else
    ``/100`` to 2 decimals.  The rounding also applies to constant columns."""
    cols = numeric_columns(df, cols)
    if not cols:
        return df
    out = _with_stats(df, cols)
    for c in cols:
        x = F.col(quote_ident(c)).cast("double")
        scaled = F.when(F.col(f"__nu_{c}") > 1,
                        (x - F.col(f"__min_{c}")) / (F.col(f"__max_{c}") - F.col(f"__min_{c}"))
                        * F.lit(float(n_buckets))).otherwise(x)
        if 10 % n_buckets == 0:
            val = F.bround(F.bround(scaled, 0) / 10.0, 1)
        else:
            val = F.bround(F.bround(scaled, 0) / 100.0, 2)
        val = val + F.lit(0.0)  # a rounded -0.0 is 0.0 in every engine
        out = out.withColumn(c, val)
    return _drop_stats(out)


def bin_standard(df: DataFrame, cols: Sequence[str] | None = None,
                 decimals: int | None = 1) -> DataFrame:
    """C5 (``decimals=1``) and C8 (``decimals=None``): zero mean, unit population
    variance; a zero std divides by 1."""
    cols = numeric_columns(df, cols)
    if not cols:
        return df
    out = _with_stats(df, cols)
    for c in cols:
        std = F.col(f"__std_{c}")
        denom = F.when((std.isNull()) | (std == 0), F.lit(1.0)).otherwise(std)
        z = (F.col(quote_ident(c)).cast("double") - F.col(f"__mean_{c}")) / denom
        out = out.withColumn(c, F.bround(z, decimals) + F.lit(0.0) if decimals is not None else z)
    return _drop_stats(out)


def standardize(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C8 — standard scaling without rounding (input of the detectors)."""
    return bin_standard(df, cols, decimals=None)


def bin_language(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C6 — min-max times 10 truncated to one of ten words (9 and 10 are both
    the last word); only for columns with more than one distinct value."""
    cols = numeric_columns(df, cols)
    if not cols:
        return df
    words = F.array(*[F.lit(w) for w in LANGUAGE_WORDS])
    out = _with_stats(df, cols)
    for c in cols:
        x = F.col(quote_ident(c)).cast("double")
        idx = F.floor((x - F.col(f"__min_{c}")) / (F.col(f"__max_{c}") - F.col(f"__min_{c}"))
                      * 10.0).cast("int")
        word = F.element_at(words, F.least(idx, F.lit(9)) + 1)
        out = out.withColumn(c, F.when(F.col(f"__nu_{c}") > 1, word)
                             .otherwise(F.col(quote_ident(c)).cast("string")))
    return _drop_stats(out)


def normalize(df: DataFrame, method: str, n_buckets: int = 10,
              cols: Sequence[str] | None = None) -> DataFrame:
    """C7 — dispatcher over the binning methods; ``none`` is the identity."""
    if method == "quantile":
        return bin_quantile(df, cols)
    if method == "equal_width":
        return bin_equal_width(df, cols, n_buckets)
    if method == "standard":
        return bin_standard(df, cols)
    if method == "language":
        return bin_language(df, cols)
    if method == "none":
        return df
    raise ValueError(f"unknown normalization method {method!r}")


def ordinal_encode(df: DataFrame, cols: Sequence[str], suffix: str = "",
                   buckets: int | None = None, fit: DataFrame | None = None) -> DataFrame:
    """C2 — codes ``0..k-1`` in ascending value order (nulls stay null); the
    codes are fitted on ``fit`` (default ``df``), unseen values get null.

    The code of a value is the number of distinct values below it (in byte order).  The values
    of all columns are counted in one pass, numbered with the range-partitioned prefix sum and
    looked up together."""
    counts = cut_lineage(value_counts(fit if fit is not None else df, cols))
    numbered = prefix_sums(counts.withColumn("one", F.lit(1)), ["ci"], "v", ["one"], buckets=buckets)
    codes = cut_lineage(numbered.select("ci", "v", "n", F.col("one_before").cast("int").alias("code")))
    out, found = look_up(df, cols, codes, "code")
    coded = {c + suffix: code for c, code in zip(cols, found)}
    return out.withColumns(coded).select(*df.columns, *[c for c in coded if c not in df.columns])


def factor_encode(df: DataFrame, cols: Sequence[str], order_col: str,
                  buckets: int | None = None) -> DataFrame:
    """C3 — order-of-appearance codes (first value seen gets 0; null gets -1), of all columns
    from one count of values and one look-up."""
    first = cut_lineage(value_counts(df, cols, first=order_col))
    numbered = prefix_sums(first.withColumn("one", F.lit(1)), ["ci"], "first_pos", ["one"], tiebreak=["v"],
                           buckets=buckets)
    codes = cut_lineage(numbered.select("ci", "v", "n", F.col("one_before").cast("int").alias("code")))
    out, found = look_up(df, cols, codes, "code")
    return out.withColumns({c: F.coalesce(code, F.lit(-1)) for c, code in zip(cols, found)}).select(*df.columns)


def group_rare(df: DataFrame, cols: Sequence[str], tol: float = 0.01,
               min_categories: int = 10, replace_with: str = "Rare") -> DataFrame:
    """C9 — categories with frequency ``< tol`` among non-null values become
    ``'Rare'``; a column with at most ``min_categories`` categories is left as is.

    Only the categories that are not rare are looked up, at most ``1 / tol`` of a column: the
    table itself is not shuffled."""
    counts = cut_lineage(value_counts(df, cols))
    total = counts.groupBy("ci").agg(F.sum("n").alias("tot"), F.count(F.lit(1)).alias("k"))
    held = {r["ci"]: r["k"] > min_categories for r in total.collect()}  # one row per column
    often = cut_lineage(counts.join(F.broadcast(total), "ci").where(F.col("n") / F.col("tot") >= tol)
                        .select("ci", "v", "n", F.lit(True).alias("often")))
    out, found = look_up(df, cols, often, "often")
    return out.withColumns({
        c: F.when(F.col(quote_ident(c)).isNotNull() & often_here.isNull(), F.lit(replace_with)).otherwise(F.col(quote_ident(c)))
        for i, (c, often_here) in enumerate(zip(cols, found)) if held.get(i)}).select(*df.columns)


def one_hot(df: DataFrame, cols: Sequence[str], max_categories: int = 1000,
            fit: DataFrame | None = None) -> DataFrame:
    """C10 — one-hot with sorted categories, the first category dropped; the
    categories come from ``fit`` (default ``df``), so values unseen at fit time
    give all zeros.  The category list is schema metadata (it names output
    columns), so its size is checked before it is read."""
    src = fit if fit is not None else df
    out = df
    for c in cols:
        cats_df = src.select(F.col(quote_ident(c)).cast("string").alias("v")).where(
            F.col("v").isNotNull()).distinct()
        cats = [r.v for r in cats_df.orderBy("v").limit(max_categories + 1).collect()]
        if len(cats) > max_categories:
            raise ValueError(f"{c}: more than {max_categories} categories; group rare values first")
        x = F.col(quote_ident(c)).cast("string")
        out = out.select("*", *[F.when(x == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}")
                                for v in cats[1:]]).drop(c)
    return out


def collapse_singletons(df: DataFrame, key: str, replacement: str = "0") -> DataFrame:
    """C11/K2 — keys that occur exactly once become ``replacement``.

    A grouped count (map-side combined) joined back; a hot key stays one row in
    the count table, and AQE splits its partition in the join."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__kc"))
    return (df.join(unbounded(counts), key, "left")
            .withColumn(key, F.when(F.col("__kc") == 1, F.lit(replacement))
                        .otherwise(F.col(key).cast("string")))
            .drop("__kc"))


def bin_floor(col, t_max: float, bins: int):
    """C13 — ``min(max(floor(t*bins/t_max), 0), bins-1)`` as an int column."""
    from kestrel.functions.exprs import as_col
    return F.least(F.greatest(F.floor(as_col(col) * bins / t_max), F.lit(0)),
                   F.lit(bins - 1)).cast("int")
