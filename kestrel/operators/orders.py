"""H10-H18 — column orders and column weights derived from factors and graphs.

Orders are a table ``(order_id, cols ARRAY<STRING>)`` (optionally with ``graph_id``);
weights are ``(col, weight)``.  Random choices are hash-ordered with ``md5(seed|...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _md5(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p))
                                     for p in parts]))


def _rand_pos(seed, salt: Column, item: Column, size: Column) -> Column:
    """Uniform-ish position in ``[0, size]`` from a hash (``randint(0, size)``)."""
    h = F.conv(F.substring(_md5(seed, salt.cast("string"), item), 1, 15), 16, 10).cast("long")
    return F.pmod(h, size + F.lit(1)).cast("int")


def _insert_at(acc: Column, item: Column, pos: Column) -> Column:
    """``acc[:pos] + [item] + acc[pos:]`` with a 0-based ``pos``."""
    head = F.slice(acc, F.lit(1), pos)
    tail = F.slice(acc, pos + F.lit(1), F.greatest(F.size(acc) - pos, F.lit(0)))
    return F.concat(head, F.array(item), tail)


def permutations(spark: SparkSession, columns: Sequence[str], n: int, seed: int = 0,
                 include_default: bool = False) -> DataFrame:
    """H18 — ``n`` column permutations: ``order_id`` i sorts the columns by
    ``md5(seed|i|col)``.  With ``include_default`` order 0 is the given order."""
    cols = F.array(*[F.lit(c) for c in columns])
    keyed = F.transform(cols, lambda c: F.struct(
        _md5(seed, F.col("order_id").cast("string"), c).alias("k"), c.alias("c")))
    perms = (spark.range(n).select(F.col("id").cast("int").alias("order_id"))
             .select("order_id", F.transform(F.array_sort(keyed), lambda s: s["c"]).alias("cols")))
    if include_default:
        perms = (spark.createDataFrame([(0, list(columns))], "order_id int, cols array<string>")
                 .unionByName(perms.select((F.col("order_id") + 1).alias("order_id"), "cols")))
    return perms


def insert_nodes(orders: DataFrame, excluded: Sequence[str] | DataFrame, strategy: str,
                 seed: int = 0) -> DataFrame:
    """H10 — put the excluded nodes (minus those already in the order) at the
    front, the back, or each at a hash-random position after a hash shuffle."""
    if isinstance(excluded, DataFrame):
        ex_arr = excluded.agg(F.array_sort(F.collect_set("node")).alias("__ex"))
        o = orders.crossJoin(F.broadcast(ex_arr))
    else:
        o = orders.withColumn("__ex", F.array(*[F.lit(x) for x in excluded]))
    rem = F.array_except(F.col("__ex"), F.col("cols"))
    if strategy == "front":
        new = F.concat(rem, F.col("cols"))
    elif strategy == "back":
        new = F.concat(F.col("cols"), rem)
    elif strategy == "random":
        shuffled = F.transform(
            F.array_sort(F.transform(rem, lambda x: F.struct(
                _md5(seed, "shuffle", F.col("order_id").cast("string"), x).alias("k"),
                x.alias("n")))), lambda s: s["n"])
        new = F.aggregate(shuffled, F.col("cols"), lambda acc, x: _insert_at(
            acc, x, _rand_pos(seed, F.col("order_id"), x, F.size(acc))))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return o.withColumn("cols", new).drop("__ex")


def _factor_columns(factors: DataFrame) -> DataFrame:
    return factors.select(F.col("name").alias("__node"),
                          F.col("column_based").alias("__fcols"))


def expand_orders(orders: DataFrame, factors: DataFrame, seed: int = 0,
                  keep_unknown: bool = True) -> DataFrame:
    """H11 — factor order to column order: every factor becomes its columns in a
    hash-shuffled order, the first occurrence of a column is kept; a node that is
    not a factor is a column itself (``keep_unknown``) or skipped."""
    keys = [c for c in orders.columns if c != "cols"]
    exploded = orders.select(*keys, F.posexplode("cols").alias("__pos", "__node"))
    joined = exploded.join(_factor_columns(factors), "__node", "left")
    if keep_unknown:
        members = F.coalesce(F.col("__fcols"), F.array(F.col("__node")))
    else:
        members = F.coalesce(F.col("__fcols"), F.array().cast("array<string>"))
    salt = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("__pos").cast("string"))
    shuffled = F.transform(F.array_sort(F.transform(members, lambda c: F.struct(
        _md5(seed, salt, c).alias("k"), c.alias("c")))), lambda s: s["c"])
    parts = joined.select(*keys, "__pos", shuffled.alias("__cols"))
    return (parts.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("__pos", "__cols"))).alias("__parts"))
            .select(*keys, F.array_distinct(F.flatten(
                F.transform("__parts", lambda s: s["__cols"]))).alias("cols")))


def expand_causal_order(orders: DataFrame, factors: DataFrame, all_columns: Sequence[str],
                        seed: int = 0) -> DataFrame:
    """H12 — like H11 with non-factor nodes skipped; every table column still
    missing is then inserted, in table order, at a hash-random position."""
    base = expand_orders(orders, factors, seed, keep_unknown=False)
    allc = F.array(*[F.lit(c) for c in all_columns])
    missing = F.filter(allc, lambda c: ~F.array_contains(F.col("cols"), c))
    new = F.aggregate(missing, F.col("cols"), lambda acc, x: _insert_at(
        acc, x, _rand_pos(seed, F.col("order_id"), x, F.size(acc))))
    return base.withColumn("cols", new)


def pick_order(orders: DataFrame, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """H13 — one order chosen by the smallest ``md5(seed|order_id)``."""
    agg = orders.groupBy(*by) if by else orders.groupBy()
    return agg.agg(F.min_by(F.struct("order_id", "cols"),
                            _md5(seed, F.col("order_id").cast("string"))).alias("o")).select(
        *by, "o.order_id", "o.cols")


def columns_table(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """A9 companion — the column list of a table (schema only) as ``(pos, col)``."""
    return spark.createDataFrame(list(enumerate(columns)), "pos int, col string")


def weights_by_factors(factors: DataFrame, columns: DataFrame,
                       skip: Sequence[str] = ()) -> DataFrame:
    """H14 — weight(col) = number of factors whose ``column_based`` lists it
    (names trimmed, each factor counted once); every table column is present,
    skipped columns are removed."""
    members = (factors.select(F.explode(F.array_distinct(F.transform(
        "column_based", lambda c: F.trim(c)))).alias("col"))
        .groupBy("col").agg(F.count(F.lit(1)).alias("n")))
    cols = columns.where(~F.col("col").isin(list(skip))) if skip else columns
    return (cols.join(members, "col", "left")
            .select("col", F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("weight")))


def weights_by_graph(edges: DataFrame, factors: DataFrame) -> DataFrame:
    """H15 — for each column, the sum of |weight| over edges that connect one of
    its factors with a factor that is not one of its factors (both directions).
    Columns are those named by the factors; a column without such edges gets 0."""
    cf = factors.select(F.col("name").alias("factor"),
                        F.explode("column_based").alias("col")).distinct()
    out_e = cf.join(edges.select(F.col("src").alias("factor"), F.col("dst").alias("other"),
                                 "weight"), "factor")
    in_e = cf.join(edges.select(F.col("dst").alias("factor"), F.col("src").alias("other"),
                                "weight"), "factor")
    mine = cf.select("col", F.col("factor").alias("other"))
    ext = out_e.unionByName(in_e).join(mine, ["col", "other"], "left_anti")
    sums = ext.groupBy("col").agg(F.sum(F.abs("weight")).alias("w"))
    return (cf.select("col").distinct().join(sums, "col", "left")
            .select("col", F.coalesce(F.col("w"), F.lit(0.0)).cast("double").alias("weight")))


def blend_weights(weights: DataFrame, alphas: dict) -> DataFrame:
    """H16 — ``weights(set_id, col, weight)``: check that all sets have the same
    columns, normalize each set by its sum (a zero sum is an error), and return
    ``sum(alpha[set] * normalized)`` per column."""
    n_sets = len(alphas)
    alpha_df = weights.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in alphas.items()], "set_id string, alpha double")
    w = weights.withColumn("set_id", F.col("set_id").cast("string"))
    sums = w.groupBy("set_id").agg(F.sum("weight").alias("tot"))
    per_col = w.groupBy("col").agg(F.count_distinct("set_id").alias("nsets"))
    normed = (w.join(F.broadcast(sums), "set_id").join(F.broadcast(alpha_df), "set_id")
              .withColumn("nw", F.when(F.col("tot") == 0, F.raise_error(
                  F.lit("Cannot normalize weights: sum(weights)=0"))).otherwise(
                  F.col("weight") / F.col("tot"))))
    out = (normed.groupBy("col").agg(F.sum(F.col("alpha") * F.col("nw")).alias("weight"))
           .join(per_col, "col")
           .withColumn("weight", F.when(F.col("nsets") != n_sets, F.raise_error(
               F.concat(F.lit("Column set mismatch for column "), F.col("col"))))
               .otherwise(F.col("weight")))
           .drop("nsets"))
    return out


def resolve_order(orders: DataFrame, columns: Sequence[str]) -> DataFrame:
    """H17 — map order tokens to table columns: case-insensitive substring match
    either way (also against ``' <col> is '``), first unused column wins, empty
    tokens skipped; an unmatched token raises; unused columns follow in table
    order."""
    names = F.array(*[F.lit(c) for c in columns])
    n = len(columns)
    idx = F.sequence(F.lit(0), F.lit(n - 1))

    def step(acc, tok):
        needle = F.lower(F.trim(tok))
        cand = F.filter(idx, lambda i: (~F.array_contains(acc, i)) & (
            F.contains(F.lower(F.element_at(names, i + 1)), needle)
            | F.contains(F.lower(F.concat(F.lit(" "), F.element_at(names, i + 1), F.lit(" is "))),
                         needle)
            | F.contains(needle, F.lower(F.element_at(names, i + 1)))))
        first = F.element_at(cand, 1)
        return F.when(needle == "", acc).when(first.isNull(), F.raise_error(F.concat(
            F.lit("order token cannot be matched to any column: "), tok))).otherwise(
            F.concat(acc, F.array(first)))

    used = F.aggregate("cols", F.array().cast("array<int>"), step)
    full = F.concat(used, F.filter(idx, lambda i: ~F.array_contains(used, i)))
    return orders.withColumn("cols", F.transform(full, lambda i: F.element_at(names, i + 1)))


def order_positions(orders: DataFrame) -> DataFrame:
    """Orders in long form ``(order_id, pos, col)``."""
    keys = [c for c in orders.columns if c != "cols"]
    return orders.select(*keys, F.posexplode("cols").alias("pos", "col"))


def cyclic_orders(orders: DataFrame, n: int) -> DataFrame:
    """Permutation ``i`` uses order ``i mod len(orders)`` (graph-based ranking)."""
    k = orders.count()
    w = Window.partitionBy(F.lit(0)).orderBy("order_id")  # the order table is metadata-sized
    ranked = orders.withColumn("__r", F.row_number().over(w) - 1)
    perms = orders.sparkSession.range(n).select(F.col("id").cast("int").alias("perm_id"),
                                                (F.col("id") % k).alias("__r"))
    return perms.join(ranked, "__r").select(F.col("perm_id").alias("order_id"), "cols")
