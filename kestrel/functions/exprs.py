"""Column-expression helpers shared by the operators.

Random choices are hash-ordered: ``md5(concat_ws('|', seed, key...))`` gives the same
hex string in Spark and in DuckDB, so every "random" operator is deterministic and
can be checked against SQL.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def hash_key(seed, *parts) -> Column:
    """md5 hex of ``seed|part1|part2...`` (parts cast to string)."""
    items = [F.lit(str(seed))] + [as_col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *items))


def hash_num(seed, *parts) -> Column:
    """Non-negative 60-bit integer from the first 15 hex digits of :func:`hash_key`.

    Its numeric order equals the lexicographic order of the md5 prefix, so it can be
    used where a numeric sort/bucket key is needed while SQL orders by the hex text.
    """
    return F.conv(F.substring(hash_key(seed, *parts), 1, 15), 16, 10).cast("long")


def quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ordinal_words(n: Column) -> Column:
    """``the 42nd percentile`` for an integer column; 11-13 (and 10-20) take ``th``."""
    m100 = F.pmod(n, F.lit(100))
    m10 = F.pmod(n, F.lit(10))
    suffix = (F.when((m100 >= 10) & (m100 <= 20), F.lit("th"))
              .when(m10 == 1, F.lit("st"))
              .when(m10 == 2, F.lit("nd"))
              .when(m10 == 3, F.lit("rd"))
              .otherwise(F.lit("th")))
    return F.concat(F.lit("the "), n.cast("string"), suffix, F.lit(" percentile"))


# The ten magnitude words of language binning, lowest to highest.
LANGUAGE_WORDS = ["Minimal", "Slight", "Moderate", "Noticeable", "Considerable",
                  "Significant", "Substantial", "Major", "Extensive", "Maximum"]


def gamma_q(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x) for a > 0.

    Below a + 1 the power series of the lower function, above it the continued fraction
    (evaluated from the front, Lentz); the common factor is taken in logs, so nothing
    underflows before the result itself does.
    """
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return min(1.0, max(0.0, 1.0 - total * scale))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h, i = d, 0
    while True:
        i += 1
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15 or i > 1_000_000:
            return min(1.0, max(0.0, h * scale))


def chi2_sf(x: float, k: int) -> float:
    """Upper tail P(X >= x) of a chi-square with ``k`` degrees of freedom: Q(k/2, x/2)."""
    if k <= 0 or x is None or math.isnan(x):
        return float("nan")
    return gamma_q(k / 2.0, x / 2.0)


def chi2_isf(p: float, k: int) -> float:
    """Critical value c with chi2_sf(c, k) = p, by bisection (monotone)."""
    lo, hi = 0.0, max(1.0, float(k))
    while chi2_sf(hi, k) > p:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if chi2_sf(mid, k) > p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def stack_expr(pairs: Iterable[tuple[str, Column]], key_name: str, value_name: str):
    """Build a ``stack`` select list turning (name, column) pairs into long rows."""
    pairs = list(pairs)
    args = []
    for name, colexpr in pairs:
        args.append(F.lit(name))
        args.append(colexpr)
    return F.stack(F.lit(len(pairs)), *args).alias(key_name, value_name)
