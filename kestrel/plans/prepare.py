"""Composite preparation chains (B18-B20) and feature-matrix assembly (C12).

Each chain is a lazy composition of the library's operators; per-dataset
dictionaries (renames, replacements) are arguments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.exprs import quote_ident
from kestrel.operators import binning as C
from kestrel.operators import joins as K
from kestrel.operators import metrics as J
from kestrel.operators import recode as R
from kestrel.operators import sampling as E
from kestrel.operators import text as D
from kestrel.session import unbounded


def prepare_ecommerce(tx: DataFrame, ranges: DataFrame, lo: str = "lower_bound_ip_address",
                      hi: str = "upper_bound_ip_address", country: str = "country",
                      range_order: str | None = None, label: str = "class") -> DataFrame:
    """B18 — devices seen once collapsed to ``'0'`` (C11) then ordinal codes (C2), IP country
    by strict range lookup (K1), purchase month and weekday names (B11), ids and raw times
    dropped (B9), names verbalized, label ``No``/``Yes`` moved last.  Devices come first: their
    codes are counted on the given rows, so that the range lookup is planned once."""
    x = C.collapse_singletons(tx, "device_id")
    x = C.ordinal_encode(x, ["device_id"])
    x = K.range_lookup(x, "ip_address", ranges, lo, hi, country, "IP_country", order=range_order)
    x = x.withColumn("purchase_time", F.to_timestamp("purchase_time", "yyyy-MM-dd HH:mm:ss"))
    x = R.calendar_features(x, "purchase_time")
    x = R.drop_cols(x, ["user_id", "signup_time", "purchase_time", "ip_address"])
    x = x.withColumn(label, F.when(F.col(label) == 1, "Yes").otherwise("No"))
    x = R.move_last(x, label)
    return R.verbalize_columns(x, style="underscore")


def prepare_claims(df: DataFrame, replacements: Mapping[str, Mapping], drop: Sequence[str],
                   renames: Mapping[str, str], label: str = "FraudFound",
                   order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """B19 — value replacements (B5), dropped columns (B9), phrase names (B7),
    accident and claim dates (B12, claim weekday ``'0'`` -> ``unknown``), split in
    halves per label (E6) and test rows overlapping train removed (J11).
    Returns (train, test)."""
    x = df
    for col, mapping in replacements.items():
        x = R.replace_values(x, col, mapping)
    x = R.drop_cols(x, drop)
    x = R.combine_date_parts(x, "Month", "WeekOfMonth", "DayOfWeek", "the date when the accident happened")
    x = R.combine_date_parts(x, "MonthClaimed", "WeekOfMonthClaimed", "DayOfWeekClaimed",
                             "the date when the insurance claim was filed", unknown_on_zero=True)
    dates = ["the date when the accident happened", "the date when the insurance claim was filed"]
    x = x.select(*dates, *[c for c in x.columns if c not in dates])
    x = R.verbalize_columns(x, renames, style="camel", keep=dates)
    lab = renames.get(label, R.camel_to_words(label))
    x = R.move_last(x, lab)
    if order is None:  # no row order in a table: order rows by a hash of their content
        from kestrel.functions.exprs import hash_num
        x = x.withColumn("__ord", hash_num(0, *[F.col(quote_ident(c)) for c in x.columns]))
        order = "__ord"
    split = E.split_half_by_label(x, lab, order)
    train = split.where(F.col("split") == "train").drop("split", "__ord")
    test = split.where(F.col("split") == "test").drop("split", "__ord")
    feats = [c for c in train.columns]
    return train, J.remove_overlap(train, test, feats)


def prepare_postings(train: DataFrame, test: DataFrame, defaults: Mapping[str, str],
                     id_col: str, label: str = "fraudulent", seed=0) -> tuple[DataFrame, DataFrame]:
    """B20 — per-column null defaults (B2), id dropped, rows hash-shuffled (E2,
    explicit position), label encoded (B6); the test features lose the label
    (returned as a separate ``label`` column keyed by position)."""
    out = []
    for part in (train, test):
        x = R.fill_defaults(part, defaults)
        x = E.shuffle(x, seed, id_col, out="position").drop(id_col)
        x = R.encode_label(x, label)
        out.append(x)
    tr, te = out
    return tr, te.withColumnRenamed(label, "label")


def encode_features(df: DataFrame, row_id: str, method: str = "ordinal", normalize: bool = True,
                    rare_tol: float = 0.01) -> DataFrame:
    """``row_id`` and numeric columns: rare categories grouped (C9), constant columns dropped (B16),
    categoricals ordinal- (C2) or one-hot-encoded (C10), numeric nulls mean-imputed (B3) and
    standardized (C8)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    feats = [c for c in df.columns if c != row_id]
    cats = [c for c in feats if isinstance(types[c], T.StringType)]
    nums = [c for c in feats if c not in cats]
    x = df.select(row_id, *feats)
    if cats:
        x = C.group_rare(x, cats, tol=rare_tol)
    x = R.drop_constant(x)
    cats = [c for c in cats if c in x.columns]
    nums = [c for c in nums if c in x.columns]
    if nums:
        x = R.impute_mean(x, nums)
        if normalize:
            x = C.standardize(x, nums)
    if cats:
        if method == "ordinal":
            x = C.ordinal_encode(x, cats)
        elif method == "one_hot":
            x = C.one_hot(x, cats)
        else:
            raise ValueError(f"unknown categorical encoding {method!r}")
    return x


def to_feature_matrix(df: DataFrame, row_id: str, method: str = "ordinal",
                      normalize: bool = True, text_encoding: str = "none",
                      text_cols: Sequence[str] = (), max_features: int = 300,
                      rare_tol: float = 0.01, vector_size: int = 100, min_count: int = 5) -> DataFrame:
    """C12 — detector input ``(row_id, features ARRAY<DOUBLE>)``: text columns
    encoded (``word2vec``: mean of vectors of words seen ``min_count`` times, fitted on them; ``bag_of_words`` /
    ``tfidf``: 300 terms; dropped for ``none``),
    rare categories grouped (C9), constant columns dropped (B16), categoricals
    ordinal- (C2) or one-hot-encoded (C10), numeric nulls mean-imputed (B3) and
    standardized (C8)."""
    text_cols = list(text_cols)
    x = encode_features(df.drop(*text_cols), row_id, method, normalize, rare_tol)
    cols = [c for c in x.columns if c != row_id]
    vec = F.array(*[F.col(quote_ident(c)).cast("double") for c in cols]) if cols else \
        F.array().cast("array<double>")
    out = x.select(F.col(quote_ident(row_id)).alias("row_id"), vec.alias("features"))
    if text_cols and text_encoding == "word2vec":
        vectors = D.fit_word_vectors(df, text_cols, vector_size, min_count)
        means = D.mean_word_vectors(df, row_id, text_cols, vectors, vector_size)
        return out.join(unbounded(means), "row_id").select("row_id", F.concat("features", "vec").alias("features"))
    if text_cols and text_encoding != "none":
        if text_encoding not in ("tfidf", "bag_of_words"):
            raise ValueError(f"unknown text encoding {text_encoding!r}")
        terms = D.top_terms(df, row_id, text_cols, max_features)
        if text_encoding == "tfidf":
            long = D.tfidf(df, row_id, text_cols, max_features, terms)
            value = "tfidf"
        else:
            long = D.bag_of_words(df, row_id, text_cols, max_features, terms)
            value = "tf"
        vocab = sorted(r.term for r in terms.select("term").collect())  # bounded: max_features terms
        dense = D.to_dense(long, vocab, value)
        out = (out.join(unbounded(dense), "row_id", "left")
               .select("row_id", F.concat("features", F.coalesce(
                   "vec", F.array_repeat(F.lit(0.0), len(vocab)))).alias("features")))
    return out
