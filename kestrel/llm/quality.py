"""Quality rules: a threshold table compiled into one projection, in DataFrame functions only.

``measures`` turns a text into counts; ``RATIOS`` names ratios of those counts, and a threshold
table of (ratio, low, high) rows is compiled into one boolean column.  There is no user
function, no shuffle and no join: each row is judged on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import WORD, fresh, missing

SYMBOLS = r"[#*$%&|<>]"
ELLIPSIS_LINE = r"(\.\.\.|…)[\x20\x09-\x0D]*\z"
BULLET_LINE = r"^[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]"
WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was by this are "
    "le la les de des et un une du en est que pour dans il au ou "
    "der die das und zu den von mit ist ein eine des im nicht auf "
    "el los las y del una por con para se es un no lo").split()

#: (ratio, lowest allowed, highest allowed); None leaves a side open.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("mean_word_chars", 2.0, 12.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_share", 0.02, None),
    ("dup_line_share", None, 0.50),
    ("ellipsis_line_share", None, 0.50),
    ("bullet_line_share", None, 0.90),
    ("repeat_word_share", None, 0.30),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur at least twice in the text, the first included.

    Windows are compared by a 64-bit hash.  Only texts with a repeated window sort their
    windows; in start order, each repeated window adds the words the one before left free.
    """
    n = F.size(words) - (WINDOW - 1)

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(
            h.alias("h"), i.alias("i"))))

        def same(r: Column, j: Column, other: Column) -> Column:
            return F.coalesce(F.get(r, other)["h"] == F.get(r, j)["h"], F.lit(False))

        starts = _let(ranked, lambda r: F.sort_array(F.filter(F.transform(
            r, lambda x, j: F.when(same(r, j, j - 1) | same(r, j, j + 1), x["i"])),
            lambda i: i.isNotNull())))
        return _let(starts, lambda s: F.aggregate(
            F.transform(s, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(
                F.get(s, j + 1) - i, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    def over(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)) \
            .otherwise(F.lit(0).cast("long"))

    def windows(ids: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(
            *[F.get(ids, i + k) for k in range(WINDOW)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n >= 2, _let(hashed, lambda ids: _let(windows(ids), over))) \
        .otherwise(F.lit(0).cast("long"))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Append the counts that the rules use: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines (lines with a word), n_stop_words, n_ellipsis_lines and
    n_bullet_lines, all long.  A null text has no words; every whole text is counted."""
    t, words, lines = fresh(df, "__text"), fresh(df, "__words"), fresh(df, "__lines")
    out = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({
        words: F.regexp_extract_all(F.col(t), F.lit(f"({WORD})"), 1),
        lines: F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(WORD))})
    w, ls = F.col(words), F.col(lines)
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(F.col(t), F.lit(SYMBOLS)),
        "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
        "n_repeat_words": _repeat_words(w),
        "n_lines": F.size(ls),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(sorted(set(STOP_WORDS))))),
        "n_ellipsis_lines": F.size(F.filter(ls, lambda x: x.rlike(ELLIPSIS_LINE))),
        "n_bullet_lines": F.size(F.filter(ls, lambda x: x.rlike(BULLET_LINE))),
    }
    return out.withColumns({k: v.cast("long") for k, v in counts.items()}).drop(t, words, lines)


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


RATIOS = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "mean_word_chars": lambda: _share("word_chars", "n_words"),
    "symbols_per_word": lambda: _share("n_symbols", "n_words"),
    "stop_word_share": lambda: _share("n_stop_words", "n_words"),
    "dup_line_share": lambda: _share("n_dup_lines", "n_lines"),
    "ellipsis_line_share": lambda: _share("n_ellipsis_lines", "n_lines"),
    "bullet_line_share": lambda: _share("n_bullet_lines", "n_lines"),
    "repeat_word_share": lambda: _share("n_repeat_words", "n_words"),
}


def compile_rules(thresholds: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """The array of names of the rules that a row breaks."""
    broken = []
    for name, low, high in thresholds:
        if name not in RATIOS:
            raise ValueError(f"unknown ratio {name}; known: {', '.join(RATIOS)}")
        bad = F.lit(False)
        if low is not None:
            bad = bad | (RATIOS[name]() < F.lit(float(low)))
        if high is not None:
            bad = bad | (RATIOS[name]() > F.lit(float(high)))
        broken.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_stop_words", "n_ellipsis_lines", "n_bullet_lines")


def judge(df: DataFrame, text: str = "text",
          thresholds: Sequence[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """Append the measures, ``base_failed`` (n_words < 20, or 100 * n_repeat_words >
    30 * n_words), ``broken`` (names of the broken rules) and ``kept`` (neither).

    A null or empty text has no words and fails.  Repeated rows are judged alike, an empty
    table stays empty; input columns with the names of appended ones are replaced.
    """
    missing(df, text)
    clash = {*MEASURES, "base_failed", "broken", "kept"}
    df = df.select(*[c for c in df.columns if c == text or c.lower() not in clash])
    out = measures(df, text)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumns({"base_failed": base, "broken": compile_rules(thresholds)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
