"""E — hash-ordered sampling, shuffling and splitting.

"Random" choices order rows by ``md5(seed|key)``.  A choice of the first n rows is a radix
selection (the table is only scanned); positions of all rows are hash ranks computed with the
range-partitioned prefix sum (no global window, one plan for every n).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.exprs import hash_key, quote_ident
from kestrel.functions.nth import hash_code, mark_first
from kestrel.functions.prefix import prefix_sums


def hash_rank(df: DataFrame, key: str, seed, by: Sequence[str] = (), out: str = "pos"
              ) -> DataFrame:
    """0-based position of each row in ``md5(seed|key)`` order (per ``by`` group)."""
    w = (df.withColumn("__hs", hash_key(seed, F.col(quote_ident(key))))
         .withColumn("__one", F.lit(1)))
    r = prefix_sums(w, list(by), "__hs", ["__one"], tiebreak=[key])
    return r.withColumnRenamed("__one_before", out).drop("__hs", "__one")


def _hash_first(df: DataFrame, key: str, seed, limits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The first ``__limit`` rows of each group in ``md5(seed|key)`` order."""
    md5 = hash_key(seed, F.col(quote_ident(key)))
    return mark_first(df, hash_code(md5), [md5, F.col(quote_ident(key))], limits, by, "__first") \
        .where("__first").drop("__first")


def sample_n(df: DataFrame, n: int | Column, seed=0, key: str = "row_id") -> DataFrame:
    """E1 — exactly ``n`` rows (all rows if ``n`` >= count), hash-ordered."""
    if isinstance(n, Column):
        return hash_rank(df, key, seed, out="__pos").where(F.col("__pos") < n).drop("__pos")
    return _hash_first(df, key, seed, df.sparkSession.range(1).select(F.lit(n).alias("__limit")))


def shuffle(df: DataFrame, seed=0, key: str = "row_id", out: str = "position") -> DataFrame:
    """E2 — all rows with an explicit hash-shuffled position column."""
    return hash_rank(df, key, seed, out=out)


def downsample_class(df: DataFrame, col: str, value, n: int, seed=0, key: str = "row_id"
                     ) -> DataFrame:
    """E3 — the rows of one class down-sampled to ``n``, all other rows kept."""
    sub = sample_n(df.where(F.col(col) == F.lit(value)), n, seed, key)
    return df.where(F.col(col) != F.lit(value)).unionByName(sub)


def downsample_ratio(df: DataFrame, col: str, keep_value, seed=0, key: str = "row_id",
                     ratio: tuple[int, int] = (95, 5)) -> DataFrame:
    """E4 — keep every row with ``col == keep_value``; of the other rows keep
    ``int(n_keep * 5 / 95)`` (hash-chosen), bounded by what exists."""
    keep = df.where(F.col(col) == F.lit(keep_value))
    other = df.where(F.col(col) != F.lit(keep_value))
    m = keep.agg(F.floor(F.count(F.lit(1)) * ratio[1] / ratio[0]).alias("__limit"))
    return keep.unionByName(_hash_first(other, key, seed, m))


def subsample_one_vs_rest(df: DataFrame, class_col: str, groups: Sequence[Sequence[str]],
                          target: int, n: int, seed=0, key: str = "row_id",
                          label: str = "label") -> DataFrame:
    """E5 — classes map to groups; the target group is normal (0), every other
    group anomalous (1).  Keep ``int(0.95 n)`` normals and ``int(0.05 n)``
    anomalies, or, when there are too few normals, all normals and
    ``int(0.05 * normals / 0.95)`` anomalies.  Classes outside every group raise."""
    mapping = {c: gi for gi, g in enumerate(groups) for c in g}
    gmap = F.create_map(*[x for c, gi in mapping.items() for x in (F.lit(c), F.lit(gi))])
    g = F.try_element_at(gmap, F.col(class_col))
    lab = (df.withColumn("__g", F.when(g.isNull(), F.raise_error(
        F.concat(F.lit("class outside every group: "), F.col(class_col)))).otherwise(g))
        .withColumn(label, F.when(F.col("__g") == target, 0).otherwise(1)).drop("__g"))
    n_norm = lab.agg(F.count_if(F.col(label) == 0).alias("__nn"))
    enough = F.lit(int(n * 0.95)) <= F.col("__nn")
    limits = n_norm.select(F.explode(F.array(
        F.struct(F.lit(0).alias(label), F.when(enough, F.lit(int(n * 0.95))).otherwise(F.col("__nn")).alias("__limit")),
        F.struct(F.lit(1).alias(label), F.when(enough, F.lit(int(n * 0.05)))
                 .otherwise(F.floor(F.lit(0.05) * F.col("__nn") / 0.95)).alias("__limit")))).alias("q")).select("q.*")
    return _hash_first(lab, key, seed, limits, [label])


def _integral(df: DataFrame, order: str) -> bool:
    return dict(df.dtypes)[order] in ("tinyint", "smallint", "int", "bigint")


def split_half_by_label(df: DataFrame, label: str, order: str) -> DataFrame:
    """E6 — per label value, the first ``floor(count/2)`` rows in ``order`` are
    ``train``, the rest ``test`` (column ``split``)."""
    tie = F.xxhash64(*df.columns)
    cnt = df.groupBy(label).agg(F.floor(F.count(F.lit(1)) / 2).alias("__limit"))
    part = F.when(F.col("__first"), F.lit("train")).otherwise(F.lit("test"))
    if _integral(df, order):
        return mark_first(df, F.col(order).cast("long"), [tie], cnt, [label], "__first") \
            .withColumn("split", part).drop("__first")
    w = df.withColumn("__one", F.lit(1)).withColumn("__tie", tie)
    r = prefix_sums(w, [label], order, ["__one"], tiebreak=["__tie"]).join(cnt, label)
    return r.withColumn("__first", F.col("__one_before") < F.col("__limit")).withColumn("split", part) \
        .drop("__one", "__tie", "__one_before", "__limit", "__first")


def split_semi_supervised(df: DataFrame, label: str, order: str, ratio: float = 0.5
                          ) -> DataFrame:
    """E7 — train = the first ``int(ratio * normals)`` normal rows in ``order``;
    test = the other normals and every anomaly."""
    normal = df.where(F.col(label) == 0)
    tie = F.xxhash64(*df.columns)
    cnt = normal.agg(F.floor(F.count(F.lit(1)) * ratio).alias("__limit"))
    if _integral(df, order):
        marked = mark_first(normal, F.col(order).cast("long"), [tie], cnt, (), "__first")
    else:
        w = normal.withColumn("__one", F.lit(1)).withColumn("__tie", tie)
        r = prefix_sums(w, [], order, ["__one"], tiebreak=["__tie"]).crossJoin(F.broadcast(cnt))
        marked = r.withColumn("__first", F.col("__one_before") < F.col("__limit")) \
            .drop("__one", "__tie", "__one_before", "__limit")
    split = marked.withColumn("split", F.when(F.col("__first"), F.lit("train")).otherwise(F.lit("test"))).drop("__first")
    return split.unionByName(df.where(F.col(label) != 0).withColumn("split", F.lit("test")))


def augment(base: DataFrame, synth: DataFrame, label: str, label_value) -> DataFrame:
    """E8 — align synthetic rows to the base schema by position, force the
    label, and append."""
    feats = [c for c in base.columns if c != label]
    if len(synth.columns) < len(feats):
        raise ValueError("synthetic table has fewer columns than the base features")
    s = synth.select(*[F.col(quote_ident(a)).cast(base.schema[b].dataType).alias(b)
                       for a, b in zip(synth.columns, feats)])
    s = s.withColumn(label, F.lit(label_value).cast(base.schema[label].dataType))
    return base.unionByName(s)


def plan_ratio_batches(df: DataFrame, label: str, batch_size: int, ratio: float,
                       seed=0, key: str = "row_id", replicas: int = 1) -> DataFrame:
    """E9 — ratio batches for data-parallel training.

    Rows of each class are hash-ordered and dealt round-robin to ``replicas``.  On
    every replica a batch holds ``b - a`` normals then ``a = int(b * ratio)``
    anomalies; cycles = max(ceil(normals / (b-a)), ceil(anomalies / a)) and the
    smaller class repeats cyclically.  When a class cannot fill its slots of one
    batch, the replica uses all its rows once (normals, then anomalies).

    Returns ``(replica, batch_id, slot, row_id)``; slots come from distributed
    ``spark.range`` rows, the per-(replica, class) counts are one small aggregate."""
    a = int(batch_size * ratio)
    nb = batch_size - a
    cls = F.when(F.col(label) == 1, F.lit(1)).otherwise(F.lit(0))
    ranked = hash_rank(df.withColumn("__cls", cls), key, seed, by=["__cls"], out="__gpos")
    ranked = ranked.select("__cls", F.col(quote_ident(key)).alias("row_id"),
                           (F.col("__gpos") % replicas).cast("int").alias("replica"),
                           F.floor(F.col("__gpos") / replicas).alias("__pos"))
    counts = {(r["replica"], r["__cls"]): r["n"] for r in ranked.groupBy("replica", "__cls").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    spark = df.sparkSession
    plan = []  # (replica, class, its rows, slots to fill, rows a batch, first slot, fallback): two rows a replica
    for rep in range(replicas):
        n_norm, n_anom = counts.get((rep, 0), 0), counts.get((rep, 1), 0)
        if n_norm < nb or n_anom < a or (nb == 0 and a == 0):
            # fallback: every row once, normals first
            plan += [(rep, 0, n_norm, n_norm, batch_size, 0, True), (rep, 1, n_anom, n_anom, batch_size, n_norm, True)]
            continue
        cycles = max(-(-n_norm // nb) if nb else 0, -(-n_anom // a) if a else 0)
        plan += [(rep, 0, n_norm, cycles * nb, nb, 0, False), (rep, 1, n_anom, cycles * a, a, nb, False)]
    # replicas hold equally many rows but for one, so a class's slots are cut from one range
    longest = {c: max(r[3] for r in plan if r[1] == c) for c in (0, 1)}
    parts = [spark.range(replicas * most).select(F.floor(F.col("id") / F.lit(most)).cast("int").alias("replica"),
                                                 F.lit(c).alias("__cls"), (F.col("id") % most).alias("j"))
             for c, most in longest.items() if most]
    if not parts:
        return spark.createDataFrame([], "replica int, batch_id long, slot int, row_id long")
    plan = spark.createDataFrame(plan, "replica int, __cls int, cnt long, total long, per long, first long, fallback boolean")
    j, per, first = F.col("j"), F.col("per"), F.col("first")
    at = F.when(F.col("fallback"), j + first).otherwise(j)
    slots = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).join(
        F.broadcast(plan), ["replica", "__cls"]).where(j < F.col("total")).select(
        "replica", "__cls", (j % F.col("cnt")).alias("__pos"), F.floor(at / per).alias("batch_id"),
        (at % per + F.when(F.col("fallback"), 0).otherwise(first)).alias("slot"))
    out = slots.join(ranked, ["replica", "__cls", "__pos"])
    return out.select(F.col("replica").cast("int"), F.col("batch_id").cast("long"),
                      F.col("slot").cast("int"), "row_id")
