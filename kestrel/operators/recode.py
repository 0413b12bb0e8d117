"""B — projections, recodes, fills and filters.

All of these are column expressions inside one projection (whole-stage codegen);
statistics such as a column mean are one-row aggregates joined back.
"""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence
from itertools import chain

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.exprs import quote_ident


def _c(name: str) -> Column:
    return F.col(quote_ident(name))


def _map_lit(mapping: Mapping) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def fill_unknown(df: DataFrame, token: str = "unknown",
                 cast_numeric_with_nulls: bool = True) -> DataFrame:
    """B1 — blank / whitespace-only strings and nulls become ``token``.  A
    non-string column that holds a null is cast to string first (its nulls become
    the token); the null check is a single one-row aggregate."""
    string_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    other = [f.name for f in df.schema.fields if f.name not in string_cols]
    with_nulls: set[str] = set()
    if other and cast_numeric_with_nulls:
        row = df.agg(*[F.max(_c(c).isNull().cast("int")).alias(c) for c in other]).first()
        with_nulls = {c for c in other if row[c] == 1}
    out = []
    for f in df.schema.fields:
        x = _c(f.name)
        if f.name in string_cols:
            out.append(F.when(x.isNull() | x.rlike(r"^\s*$"), F.lit(token)).otherwise(x)
                       .alias(f.name))
        elif f.name in with_nulls:
            out.append(F.coalesce(x.cast("string"), F.lit(token)).alias(f.name))
        else:
            out.append(x)
    return df.select(*out)


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """B2 — per-column null defaults (``Unknown``, ``Not Specified``, ``NaN``...)."""
    return df.select(*[
        F.coalesce(_c(c), F.lit(defaults[c]).cast(df.schema[c].dataType)).alias(c)
        if c in defaults else _c(c) for c in df.columns])


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B3 — nulls (and NaN) of numeric columns replaced by the column mean."""
    means = df.agg(*[F.avg(F.when(~F.isnan(_c(c).cast("double")), _c(c).cast("double")))
                     .alias(f"__m_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(means))  # one row
    for c in cols:
        x = _c(c).cast("double")
        j = j.withColumn(c, F.when(x.isNull() | F.isnan(x), F.col(f"__m_{c}")).otherwise(x))
    return j.drop(*[f"__m_{c}" for c in cols])


def recode(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """B4 — dictionary recode; unmapped values become null."""
    return df.withColumn(out or col, F.try_element_at(_map_lit(mapping), _c(col)))


def replace_values(df: DataFrame, col: str, mapping: Mapping, out: str | None = None
                   ) -> DataFrame:
    """B5 — dictionary replace; unmapped values are kept."""
    x = _c(col)
    return df.withColumn(out or col, F.coalesce(F.try_element_at(_map_lit(mapping), x), x))


def encode_label(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """B6 — binary label: yes/no, true/false, 1/0 (any case, trimmed) to 1/0,
    anything else a numeric cast (null when not numeric)."""
    v = F.lower(F.trim(_c(col).cast("string")))
    enc = (F.when(v.isin("yes", "true", "1"), F.lit(1))
           .when(v.isin("no", "false", "0"), F.lit(0))
           .otherwise(F.expr(f"try_cast(try_cast({quote_ident(col)} AS STRING) AS DOUBLE)")
                      .cast("int")))
    return df.withColumn(out or col, enc)


def camel_to_words(name: str) -> str:
    """``AgeOfPolicyHolder`` -> ``age of policy holder``: a word starts at every capital."""
    return regex.sub(r"(?=\p{Lu})", " ", name).strip().lower()


def verbalize_columns(df: DataFrame, mapping: Mapping[str, str] | None = None,
                      style: str | None = "underscore", keep: Sequence[str] = ()) -> DataFrame:
    """B7 — rename columns by a dictionary, then ``_`` -> space (``underscore``) or
    split on uppercase (``camel``); columns in ``keep`` keep their names."""
    names = {}
    for c in df.columns:
        n = (mapping or {}).get(c, c)
        if c not in keep and c not in (mapping or {}):
            if style == "underscore":
                n = n.replace("_", " ")
            elif style == "camel":
                n = camel_to_words(n)
        names[c] = n
    return df.withColumnsRenamed(names)


def positional_names(n: int) -> list[str]:
    """Names of the first ``n`` columns as spreadsheets count them: A..Z, AA, AB, ..."""
    def name(i: int) -> str:
        head, last = divmod(i, 26)
        return (name(head - 1) if head else "") + chr(ord("A") + last)
    return [name(i) for i in range(n)]


def anonymize(df: DataFrame, keep: Sequence[str] = (), fit: DataFrame | None = None) -> DataFrame:
    """B8 — rename feature columns positionally (A..Z, AA..ZZ) and ordinal-encode
    the categorical ones (codes in sorted value order, fitted on ``fit`` — the
    training table — when given, and applied to ``df``)."""
    from kestrel.operators.binning import ordinal_encode
    feats = [c for c in df.columns if c not in keep]
    names = positional_names(len(feats))
    ren = dict(zip(feats, names))
    renamed = df.withColumnsRenamed(ren)
    cats = [n for c, n in zip(feats, names) if isinstance(df.schema[c].dataType, T.StringType)]
    fitted = fit.withColumnsRenamed(ren) if fit is not None else None
    return ordinal_encode(renamed, cats, fit=fitted)


def drop_cols(df: DataFrame, cols: Sequence[str] = (), contains: Sequence[str] = ()
              ) -> DataFrame:
    """B9 — drop named columns and columns whose name contains a substring."""
    gone = set(cols) | {c for c in df.columns for s in contains if s in c}
    return df.select(*[_c(c) for c in df.columns if c not in gone])


def move_last(df: DataFrame, col: str) -> DataFrame:
    """B9 — move a column (the label) to the end."""
    return df.select(*[_c(c) for c in df.columns if c != col], _c(col))


def filter_normal(df: DataFrame, label: str = "label", normal=0) -> DataFrame:
    """B10 — keep the normal rows only (pushed down to the scan when possible)."""
    return df.where(_c(label) == F.lit(normal))


def calendar_features(df: DataFrame, ts: str, month: str = "month_purchase",
                      weekday: str = "weekday_purchase") -> DataFrame:
    """B11 — month name and weekday name of a timestamp."""
    return df.withColumn(month, F.date_format(_c(ts), "MMMM")).withColumn(
        weekday, F.date_format(_c(ts), "EEEE"))


# Month abbreviations and weekday names with their numbers; '0'
# stands for an unknown weekday (8) and, for the claim month, an unknown month (13).
MONTH_NUMBERS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7,
                 "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
WEEKDAY_NUMBERS = {"monday": 1, "tuesday": 2, "wednesday": 3, "thursday": 4, "friday": 5,
                   "saturday": 6, "sunday": 7, "0": 8}


def combine_date_parts(df: DataFrame, month: str, week: str, dow: str, out: str,
                       unknown_on_zero: bool = False, drop: bool = True) -> DataFrame:
    """B12 — ``"M-D"`` from month text, week-of-month and weekday text with
    ``D = 7*(week-1) + weekday``; weekday ``'0'`` counts 8.  The claim variant
    (``unknown_on_zero``) maps month ``'0'`` to 13 and gives ``'unknown'`` when the
    weekday is ``'0'``.  An unknown month or weekday text raises."""
    months = dict(MONTH_NUMBERS)
    if unknown_on_zero:
        months["0"] = 13
    m = F.try_element_at(_map_lit(months), F.lower(_c(month).cast("string")))
    d = F.try_element_at(_map_lit(WEEKDAY_NUMBERS), F.lower(_c(dow).cast("string")))
    m = F.when(m.isNull(), F.raise_error(F.concat(F.lit("unknown month: "),
                                                  _c(month).cast("string")))).otherwise(m)
    d = F.when(d.isNull(), F.raise_error(F.concat(F.lit("unknown weekday: "),
                                                  _c(dow).cast("string")))).otherwise(d)
    day = 7 * (_c(week).cast("string").cast("int") - 1) + d
    val = F.concat(m.cast("string"), F.lit("-"), day.cast("string"))
    if unknown_on_zero:
        val = F.when(d == 8, F.lit("unknown")).otherwise(val)
    res = df.withColumn(out, val)
    return res.drop(month, week, dow) if drop else res


def coerce_int(df: DataFrame, col: str) -> Column:
    """B13 — annotation value to int or null: booleans to 0/1, floats truncated,
    NaN null, strings by ``try_cast(trim(s) AS INT)`` (so ``'2.0'`` and words are
    null, as are ``''``, ``unknown``, ``None``, ``null``, ``na``)."""
    dt = df.schema[col].dataType
    x = _c(col)
    if isinstance(dt, T.BooleanType):
        return x.cast("int")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(x), F.lit(None).cast("int")).otherwise(F.expr(
            f"try_cast({quote_ident(col)} AS INT)"))
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.expr(f"try_cast({quote_ident(col)} AS INT)")
    return F.expr(f"try_cast(trim({quote_ident(col)}) AS INT)")


def fill_missing_codes(df: DataFrame, factors: Sequence[tuple[str, Sequence[int]]]
                       ) -> DataFrame:
    """B14 — every factor column present and coerced to int; missing values get
    -1 when -1 is a possible value of the factor, else 0."""
    out = df
    for name, possible in factors:
        code = -1 if -1 in list(possible or []) else 0
        if name in out.columns:
            out = out.withColumn(name, F.coalesce(coerce_int(out, name), F.lit(code)))
        else:
            out = out.withColumn(name, F.lit(code))
    return out


def all_missing(df: DataFrame, factors: Sequence[tuple[str, Sequence[int]]],
                out: str = "all_missing") -> DataFrame:
    """B15 — flag rows whose every factor equals its missing code."""
    conds = [F.col(quote_ident(n)) == F.lit(-1 if -1 in list(p or []) else 0)
             for n, p in factors]
    flag = conds[0]
    for c in conds[1:]:
        flag = flag & c
    return df.withColumn(out, flag)


def drop_constant(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """B16 — drop columns whose values are all equal (nulls count as a value; an empty table
    drops all).  One aggregate of min, max and null count per column, combined before the
    shuffle; the single row is read by the driver, as it changes the schema."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[e for i, c in enumerate(cols) for e in (
        (F.min(_c(c)) == F.max(_c(c))).alias(f"same{i}"), F.count(_c(c)).alias(f"n{i}"))]).first()
    const = {c for i, c in enumerate(cols)
             if row[f"n{i}"] == 0 or (row[f"same{i}"] and row[f"n{i}"] == row["n"])}
    return df.select(*[_c(c) for c in df.columns if c not in const])


def clean_text(c) -> Column:
    """B17 — remove ``<br />`` and trim."""
    x = c if isinstance(c, Column) else F.col(c)
    return F.trim(F.replace(x, F.lit("<br />"), F.lit("")))
