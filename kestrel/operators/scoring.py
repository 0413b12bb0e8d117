"""I — count-based autoregressive field density and the NLL aggregation algebra.

The density of a row under a column order ``c1..cm`` is
``P(c1=v1) * prod_i P(ci=vi | c(i-1)=v(i-1))`` with additive smoothing ``alpha``
over the number ``K`` of distinct training values of the predicted column:

    P(v | u) = (n(u, v) + alpha) / (n(u) + alpha * K)

Fitting is a grouped count over ``stack``-ed adjacent column pairs taken straight
from the wide table (no self-join on ``row_id``); scoring emits one record per
(row, order, position) in a single projection and looks the counts up with
equi-joins, which AQE broadcasts when the fitted tables are small and shuffles
(with skew splitting) when they are not.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.exprs import quote_ident
from kestrel.session import cut_lineage, unbounded

NULL_TOKEN = "None"
START = ""  # context of the first position of an order


def melt(df: DataFrame, row_id: str, cols: Sequence[str], key: str = "col",
         value: str = "value") -> DataFrame:
    """I1 — ``(row_id, col, value)``; values as strings, null as ``'None'``."""
    return df.select(F.col(quote_ident(row_id)).alias("row_id"), F.explode(F.array(*[
        F.struct(F.lit(c).alias(key), F.coalesce(F.col(quote_ident(c)).cast("string"),
                                                 F.lit(NULL_TOKEN)).alias(value))
        for c in cols])).alias("__kv")).select("row_id", f"__kv.{key}", f"__kv.{value}")


def orders_list(orders: DataFrame, max_orders: int = 100_000) -> list[tuple[int, list[str]]]:
    """Read the (small) order table: it is plan metadata, like a schema.  Its size
    is checked before it is read."""
    rows = orders.select("order_id", "cols").limit(max_orders + 1).collect()
    if len(rows) > max_orders:
        raise ValueError(f"more than {max_orders} column orders")
    return sorted((int(r.order_id), list(r.cols)) for r in rows)


def _adjacent(orders: list[tuple[int, list[str]]]) -> list[tuple[str, str]]:
    pairs = []
    seen = set()
    for _, cols in orders:
        for a, b in zip(cols[:-1], cols[1:]):
            if (a, b) not in seen:
                seen.add((a, b))
                pairs.append((a, b))
    return pairs


def _val(c: str):
    return F.coalesce(F.col(quote_ident(c)).cast("string"), F.lit(NULL_TOKEN))


@dataclass
class DensityModel:
    counts: DataFrame    # (prev_col, prev_value, col, value, n)
    contexts: DataFrame  # (prev_col, prev_value, col, n_ctx)
    cards: DataFrame     # (col, k, n_rows)
    alpha: float
    pairs: list | None = None      # adjacent (prev_col, col) pairs of the orders
    firsts: list | None = None     # first columns of the orders
    n_counts: int | None = None    # proven upper bounds of the table sizes in bytes
    n_contexts: int | None = None


# broadcast a fitted table only below this many bytes (a proven bound); larger
# tables are shuffle-joined (AQE splits skewed partitions)
BROADCAST_BYTES = 64_000_000
# frequent contexts and frequent bigrams of a text model that are broadcast take this many each
FREQUENT_BYTES = 24_000_000


def size_bounds(model: DensityModel) -> DensityModel:
    """Upper bounds in bytes of the fitted tables from the cardinality and the widest value of
    each column (one row per column): ``counts`` has at most ``sum k_a * k_b`` rows over adjacent
    pairs plus the first columns' ``k``, ``contexts`` at most ``sum k_a`` plus one row per first
    column; a row holds two names, two values and two numbers."""
    c = {r["col"]: (int(r["k"]), int(r["w"] or 0)) for r in model.cards.select("col", "k", "w").collect()}
    pairs, firsts = model.pairs or [], model.firsts or []

    def k(col):
        return c.get(col, (0, 0))[0]

    def row(*cols):
        return 64 + sum(len(x.encode()) + c.get(x, (0, 0))[1] for x in cols)

    n_counts = sum(k(a) * k(b) * row(a, b) for a, b in pairs) + sum(k(x) * row(x) for x in firsts)
    n_ctx = sum(k(a) * row(a, b) for a, b in pairs) + sum(row(x) for x in firsts)
    return DensityModel(model.counts, model.contexts, model.cards, model.alpha, pairs, firsts,
                        n_counts, n_ctx)


def _sized(df: DataFrame, size: int | None) -> DataFrame:
    return F.broadcast(df) if size is not None and size <= BROADCAST_BYTES else df


def fit_density(train: DataFrame, cols: Sequence[str], orders: DataFrame | list,
                alpha: float = 1.0) -> DensityModel:
    """I2 — fit value counts and adjacent-pair counts for every order."""
    olist = orders if isinstance(orders, list) else orders_list(orders)
    pairs = _adjacent(olist)
    firsts = sorted({o[0] for _, o in olist if o})
    # unigram counts: one stacked projection, map-side combined count
    uni = (train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), _val(c).alias("value")) for c in cols])).alias("kv"))
        .groupBy("kv.col", "kv.value").agg(F.count(F.lit(1)).alias("n")))
    n_rows = train.agg(F.count(F.lit(1)).alias("n_rows"))
    cards = (uni.groupBy("col").agg(F.count(F.lit(1)).alias("k"), F.max(F.octet_length("value")).alias("w"))
             .crossJoin(F.broadcast(n_rows)))
    if pairs:
        pair_counts = (train.select(F.explode(F.array(*[
            F.struct(F.lit(a).alias("prev_col"), _val(a).alias("prev_value"),
                     F.lit(b).alias("col"), _val(b).alias("value")) for a, b in pairs]))
            .alias("kv")).groupBy("kv.prev_col", "kv.prev_value", "kv.col", "kv.value")
            .agg(F.count(F.lit(1)).alias("n")))
    else:
        pair_counts = None
    first_counts = (uni.where(F.col("col").isin(firsts))
                    .select(F.lit(START).alias("prev_col"), F.lit(START).alias("prev_value"),
                            "col", "value", "n"))
    counts = first_counts if pair_counts is None else first_counts.unionByName(pair_counts)
    # contexts: n(prev value) for every adjacent pair, and the row count at the start
    spark = train.sparkSession
    if pairs:
        adj = spark.createDataFrame(pairs, "prev_col string, col string")
        ctx_pairs = (uni.withColumnRenamed("col", "prev_col")
                     .withColumnRenamed("value", "prev_value")
                     .join(F.broadcast(adj), "prev_col")
                     .select("prev_col", "prev_value", "col", F.col("n").alias("n_ctx")))
    else:
        ctx_pairs = None
    ctx_first = (cards.where(F.col("col").isin(firsts))
                 .select(F.lit(START).alias("prev_col"), F.lit(START).alias("prev_value"),
                         "col", F.col("n_rows").alias("n_ctx")))
    contexts = ctx_first if ctx_pairs is None else ctx_first.unionByName(ctx_pairs)
    return DensityModel(counts, contexts, cards, float(alpha), pairs, firsts)


def order_records(df: DataFrame, row_id: str, orders: list[tuple[int, list[str]]],
                  extra: Sequence[str] = ()) -> DataFrame:
    """K9 — rows x orders x positions as ``(row_id, perm_id, pos, col, value,
    prev_col, prev_value)``, produced by one projection (no join)."""
    items = []
    for oid, cols in orders:
        for pos, c in enumerate(cols):
            prev = cols[pos - 1] if pos > 0 else None
            items.append(F.struct(
                F.lit(oid).alias("perm_id"), F.lit(pos).alias("pos"), F.lit(c).alias("col"),
                _val(c).alias("value"),
                F.lit(prev if prev is not None else START).alias("prev_col"),
                (_val(prev) if prev is not None else F.lit(START)).alias("prev_value")))
    return df.select(F.col(quote_ident(row_id)).alias("row_id"),
                     *[F.col(quote_ident(e)) for e in extra],
                     F.inline(F.array(*items)))


def score_nll(test: DataFrame, row_id: str, model: DensityModel,
              orders: DataFrame | list) -> DataFrame:
    """I3 — ``(row_id, perm_id, pos, col, nll)`` with
    ``nll = -ln((n(prev,val)+a)/(n(prev)+a*K))``; unseen values and contexts count 0."""
    olist = orders if isinstance(orders, list) else orders_list(orders)
    scored = _with_nll(order_records(test, row_id, olist), model)
    return scored.select("row_id", "perm_id", "pos", "col", "nll")


def _with_nll(rec: DataFrame, model: DensityModel) -> DataFrame:
    """Append nll to records (prev_col, prev_value, col, value, ...).  Records outnumber the rows:
    they are shuffled only for fitted tables that are not proven small."""
    if model.n_counts is None and model.pairs is not None and "w" in model.cards.columns:
        model = size_bounds(model)
    a = F.lit(model.alpha)
    scored = (rec.join(_sized(model.counts, model.n_counts),
                       ["prev_col", "prev_value", "col", "value"], "left")
              .join(_sized(model.contexts, model.n_contexts), ["prev_col", "prev_value", "col"],
                    "left")
              # one row per column: bounded by the schema width
              .join(F.broadcast(model.cards.select("col", "k")), "col", "left"))
    num = F.coalesce(F.col("n"), F.lit(0)).cast("double") + a
    den = F.coalesce(F.col("n_ctx"), F.lit(0)).cast("double") + a * F.coalesce(
        F.col("k"), F.lit(0)).cast("double")
    return scored.select(*rec.columns, (-F.ln(num / den)).alias("nll"))


def mean_scores(test: DataFrame, row_id: str, model: DensityModel, orders: DataFrame | list,
                weights: DataFrame | None = None) -> DataFrame:
    """I3 + I6 + I10 factored over the orders: ``(row_id, score)``, the mean over the orders of
    the weighted NLL sums.

    The NLL of a column depends only on the column before it, so each distinct adjacent pair is
    scored once per row and counts as often as it occurs in the orders: 21 orders of 7 columns
    have at most 49 pairs instead of 147 positions, and no row is repeated per order."""
    olist = orders if isinstance(orders, list) else orders_list(orders)
    times = Counter((cols[i - 1] if i else None, c) for _, cols in olist for i, c in enumerate(cols))
    rec = test.select(F.col(quote_ident(row_id)).alias("row_id"), F.inline(F.array(*[F.struct(
        F.lit(c).alias("col"), _val(c).alias("value"), F.lit(START if prev is None else prev).alias("prev_col"),
        (F.lit(START) if prev is None else _val(prev)).alias("prev_value"), F.lit(float(n)).alias("times"))
        for (prev, c), n in times.items()])))
    s = _multiplier(_with_nll(rec, model), weights)
    return s.groupBy("row_id").agg((F.sum(F.col("nll") * F.col("times") * F.col("__mult"))
                                    / F.lit(float(len(olist)))).alias("score"))


def score_contrast(test: DataFrame, row_id: str, model_normal: DensityModel | None,
                   model_anomaly: DensityModel | None, orders) -> DataFrame:
    """I4 — NLL under the normal model minus NLL under the anomaly model; with
    only one model the plain NLL (normal) or its negation (anomaly)."""
    olist = orders if isinstance(orders, list) else orders_list(orders)
    keys = ["row_id", "perm_id", "pos", "col"]
    if model_normal is None and model_anomaly is None:
        raise ValueError("need at least one model")
    if model_anomaly is None:
        return score_nll(test, row_id, model_normal, olist)
    if model_normal is None:
        return score_nll(test, row_id, model_anomaly, olist).withColumn("nll", -F.col("nll"))
    n = score_nll(test, row_id, model_normal, olist)
    an = score_nll(test, row_id, model_anomaly, olist).withColumnRenamed("nll", "nll_a")
    return n.join(an, keys).select(*keys, (F.col("nll") - F.col("nll_a")).alias("nll"))


def _multiplier(scores: DataFrame, weights: DataFrame | None) -> DataFrame:
    if weights is None:
        return scores.withColumn("__mult", F.lit(1.0))
    # the weight table has one row per column: bounded by the schema width
    w = F.broadcast(weights.select("col", F.col("weight").alias("__w")))
    return (scores.join(w, "col", "left")
            .withColumn("__mult", F.coalesce(F.col("__w").cast("double"), F.lit(0.0)) + 1.0)
            .drop("__w"))


def feature_scores(scores: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """I7 — per (row, perm, col) weighted NLL, no length normalization."""
    return (_multiplier(scores, weights)
            .select("row_id", "perm_id", "col", (F.col("nll") * F.col("__mult")).alias("nll")))


def aggregate_nll(scores: DataFrame, weights: DataFrame | None = None,
                  text_cols: Sequence[str] = (), token_counts: DataFrame | None = None
                  ) -> DataFrame:
    """I6 — row score per permutation: sum over columns of ``nll * (w + 1)``
    (missing weight: multiplier 1); a text column's NLL is first divided by its
    token count ``token_counts(row_id, perm_id, col, n_tokens)``."""
    s = _multiplier(scores, weights)
    contrib = F.col("nll")
    if text_cols:
        if token_counts is None:
            raise ValueError("text columns need token counts")
        s = s.join(token_counts, ["row_id", "perm_id", "col"], "left")
        contrib = F.when(F.col("col").isin(list(text_cols)),
                         F.col("nll") / F.col("n_tokens")).otherwise(F.col("nll"))
    return (s.groupBy("row_id", "perm_id")
            .agg(F.sum(contrib * F.col("__mult")).alias("score")))


def total_nll(token_nll: DataFrame) -> DataFrame:
    """I8 — unweighted sum over all tokens per (row, perm)."""
    return token_nll.groupBy("row_id", "perm_id").agg(F.sum("nll").alias("score"))


def mean_permutations(row_scores: DataFrame, expected: int | None = None) -> DataFrame:
    """I10 — mean score over permutations per row, with the number of permutations
    seen; when ``expected`` is given, an incomplete row raises."""
    out = row_scores.groupBy("row_id").agg(F.avg("score").alias("score"),
                                           F.count_distinct("perm_id").alias("n_perms"))
    if expected is not None:
        out = out.withColumn("score", F.when(F.col("n_perms") != expected, F.raise_error(
            F.concat(F.lit("incomplete permutations for row "), F.col("row_id").cast("string"))))
            .otherwise(F.col("score")))
    return out


def row_scores(scores: DataFrame, weights: DataFrame | None, n_perms: int) -> DataFrame:
    """I6 + I10 fused: one grouped aggregation by ``row_id`` (map-side combined)
    giving ``sum(nll * (w+1)) / n_perms`` — the mean over permutations of the
    weighted per-permutation sums."""
    s = _multiplier(scores, weights)
    return (s.groupBy("row_id")
            .agg((F.sum(F.col("nll") * F.col("__mult")) / F.lit(float(n_perms))).alias("score")))


# ----------------------------------------------------------------- token level
def token_table(df: DataFrame, row_id: str, text_col: str, pattern: str | None = None,
                lower: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """Tokens of a whole text with positions: ``(row_id, pos, token, prev)``.
    ``prev`` is the preceding token ('' at position 0), taken inside the same
    array (no window, no shuffle)."""
    from kestrel.operators.text import TOKEN_PATTERN
    txt = F.col(quote_ident(text_col))
    toks = F.regexp_extract_all(F.lower(txt) if lower else txt, F.lit(pattern or TOKEN_PATTERN), 0)
    t = df.select(F.col(quote_ident(row_id)).alias("row_id"), *extra, toks.alias("__t"))
    # outer, then the empty texts left out: else Spark tokenizes again to leave them out before
    return t.select("row_id", *extra, F.posexplode_outer("__t").alias("pos", "token"), "__t").where(
        "pos IS NOT NULL").select("row_id", *extra, "pos", "token",
        F.when(F.col("pos") == 0, F.lit(START)).otherwise(
            F.element_at("__t", F.col("pos"))).alias("prev"))


def fit_text_model(train_tokens: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I5 (fit) — bigram counts ``(prev, token, n)``, context counts
    ``(prev, n_ctx)`` and the vocabulary size (one row).  The counts are kept once; contexts and
    vocabulary are read off the bigrams, not off the tokens."""
    big = cut_lineage(train_tokens.groupBy("prev", "token").agg(F.count(F.lit(1)).alias("n")))
    ctx = cut_lineage(big.groupBy("prev").agg(F.sum("n").alias("n_ctx")))
    vocab = big.agg(F.count_distinct("token").alias("V"))
    return big, ctx, vocab


def _frequent(counts: DataFrame, keys: Sequence[str], n: str, limit: int) -> tuple[DataFrame, bool]:
    """The most frequent rows of a count table that take at most ``limit`` bytes together, and
    whether these are all.  The least count is read off a histogram of four steps per doubling."""
    size = sum((F.coalesce(F.octet_length(k), F.lit(0)) for k in keys), F.lit(64)).cast("long")
    steps = sorted(counts.groupBy(F.floor(F.log2(n) * 4).alias("step")).agg(
        F.min(n).alias("least"), F.sum(size).alias("bytes")).collect(), reverse=True)
    least, taken = None, 0
    for r in steps:
        taken += r["bytes"]
        if taken > limit:
            return counts.where(F.lit(False) if least is None else F.col(n) >= least), False
        least = r["least"]
    return counts, True


def _looked_up(tokens: DataFrame, model, limit: int | None = None) -> DataFrame:
    """Tokens with ``n`` (of prev and token), ``n_ctx`` (of prev), null where unseen, and ``V``.

    Words are as uneven as language: a join on them would gather a frequent word's tokens in one
    task.  Frequent contexts and bigrams (a bounded table each) are broadcast, which leaves most
    tokens where they are; only tokens of rare contexts or bigrams are shuffled."""
    big, ctx, vocab = model
    limit = FREQUENT_BYTES if limit is None else limit
    many_ctx, all_ctx = _frequent(ctx, ["prev"], "n_ctx", limit)
    many, all_big = _frequent(big, ["prev", "token"], "n", limit)
    rows = (tokens.join(F.broadcast(many_ctx), "prev", "left")
            .join(F.broadcast(many), ["prev", "token"], "left"))
    if not all_big:
        known = F.lit(True) if all_ctx else F.col("n_ctx").isNotNull()
        rest = rows.where(known & F.col("n").isNull()).drop("n")
        if not all_ctx:
            rare = rows.where(~known).drop("n", "n_ctx").join(unbounded(ctx), "prev", "left")
            rest = rest.unionByName(rare)
        # sorted by a hash first: words that begin alike are slow to compare
        h = F.xxhash64("prev", "token").alias("__h")
        rows = rows.where(known & F.col("n").isNotNull()).unionByName(
            rest.select("*", h).join(unbounded(big.select("*", h)), ["__h", "prev", "token"], "left").drop("__h"))
    return rows.crossJoin(F.broadcast(vocab))  # one row


def _bigram_nll(alpha: float):
    return -F.ln((F.coalesce("n", F.lit(0)) + alpha) / (F.coalesce("n_ctx", F.lit(0)) + alpha * F.col("V")))


def score_text_nll(tokens: DataFrame, model, alpha: float = 1.0) -> DataFrame:
    """I5 — per-token ``-ln((n(prev,tok)+a)/(n(prev)+a V))`` and the
    length-normalized row score ``(row_id, score, n_tokens)``."""
    return _looked_up(tokens, model).groupBy("row_id").agg(
        F.avg(_bigram_nll(alpha)).alias("score"), F.count(F.lit(1)).alias("n_tokens"))


def token_nll(tokens: DataFrame, model, alpha: float = 1.0, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Per-token NLL ``(*keys, pos, nll)`` under the bigram model."""
    return _looked_up(tokens, model).select(*keys, "pos", _bigram_nll(alpha).alias("nll"))


def value_spans(df: DataFrame, row_id: str, orders, cols) -> DataFrame:
    """I9 helper — token spans of each column in a serialized row
    (``" col is value "`` joined by ``,``; whitespace tokens): a column occupies
    its name tokens (``col``, ``is``), its value tokens and one separator.  The
    attributed span is ``[start + len(name) - 1, start + len(name) + len(value))``
    — the value tokens plus the token before them, in shifted positions."""
    olist = orders if isinstance(orders, list) else orders_list(orders)
    items = []
    for oid, ocols in olist:
        off = F.lit(0)
        for c in ocols:
            name_len = len(c.split()) + 1
            v = F.coalesce(F.nullif(F.trim(F.col(quote_ident(c)).cast("string")), F.lit("")), F.lit(NULL_TOKEN))
            vlen = F.size(F.regexp_extract_all(v, F.lit(r"\S+"), 0))
            items.append(F.struct(F.lit(oid).alias("perm_id"), F.lit(c).alias("col"),
                                  (off + name_len - 1).alias("start"),
                                  (off + name_len + vlen).alias("end")))
            off = off + name_len + vlen + 1
    return df.select(F.col(quote_ident(row_id)).alias("row_id"), F.inline(F.array(*items)))


def attribute_tokens(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """I9 — sum the token NLLs ``(row_id, perm_id, pos, nll)`` falling into each
    column span ``[start, end)``: an equi-join on (row, permutation) — a row's
    own tokens and spans — then the interval filter."""
    j = tokens.join(spans, ["row_id", "perm_id"]).where(
        (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    return j.groupBy("row_id", "perm_id", "col").agg(F.sum("nll").alias("nll"))


def eval_summary(scores: DataFrame, labels: DataFrame, score: str = "score") -> DataFrame:
    """I11 — mean score overall, on normal and on anomalous rows, and AUC-ROC."""
    from kestrel.operators.metrics import auc_roc
    j = scores.join(labels, "row_id")
    means = j.agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_all"),
                  F.avg(F.when(F.col("label") == 0, F.col(score))).alias("mean_normal"),
                  F.avg(F.when(F.col("label") == 1, F.col(score))).alias("mean_anomaly"))
    return means.crossJoin(auc_roc(j, score, "label"))


def score_with(df: DataFrame, fn, schema: str = "row_id long, perm_id int, pos int, nll double"
               ) -> DataFrame:
    """I12 — apply a user batch scorer (pandas DataFrame -> token NLL rows) with
    ``mapInPandas``; Arrow batches, one Python worker per task."""
    def run(it):
        for pdf in it:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def pairwise_cosine(df: DataFrame, vec: str, by: str) -> DataFrame:
    """I13 — mean pairwise cosine within each group without a self-join: with unit
    vectors u, ``sum_{i<j} cos = (||sum u||^2 - n) / 2``."""
    unit = df.select(by, F.transform(vec, lambda x: x.cast("double")).alias("__v"))
    unit = unit.select(by, "__v", F.sqrt(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x)).alias("__n"))
    unit = unit.select(by, F.transform("__v", lambda x: x / F.col("__n")).alias("__u"))
    per = (unit.select(by, F.posexplode("__u").alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("s")))
    sq = per.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    n = unit.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return sq.join(n, by).select(by, "n", F.when(F.col("n") > 1, (F.col("ss") - F.col("n"))
                                                 / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def centroid_distance(df: DataFrame, vec: str, is_anomaly) -> DataFrame:
    """I13 — mean squared distance of anomalous vectors to the normal centroid (one array, so
    rows are neither exploded nor shuffled)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = df.select(F.transform(vec, lambda x: x.cast("double")).alias("__v"), is_anomaly.alias("__a"))
    cen = v.where(~F.col("__a")).groupBy().agg(
        vector_to_array(Summarizer.mean(array_to_vector("__v"))).alias("__c"))
    d2 = F.aggregate(F.zip_with("__v", "__c", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x)
    d = v.where(F.col("__a")).crossJoin(F.broadcast(cen)).select(d2.alias("d2"))  # cen is one row
    return d.agg(F.avg("d2").alias("mean_sq_distance"), F.count(F.lit(1)).alias("n_anomalies"))
