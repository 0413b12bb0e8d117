"""G — factor annotation: pluggable annotators, retries, merges, factor-set rounds.

The annotator is a user callable ``(sample_text, factors_json, attempt,
temperature) -> response text`` (a model client, or the built-in keyword
annotator).  It runs inside ``mapInArrow`` over Arrow batches: the rows are dealt
to tasks evenly, the row text is built by Spark (``format_sample``) before the
Python boundary, every task annotates its own rows, and retries happen inside the task.  Rule annotation
(G2) needs no Python at all: factor values are column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.exprs import quote_ident
from kestrel.operators.recode import all_missing, fill_missing_codes
from kestrel.operators.text import format_sample
from kestrel.session import unbounded

Factor = tuple[str, Sequence[int]]  # (name, possible_values)


def missing_code(possible: Sequence[int] | None) -> int:
    """-1 when -1 is a possible value of the factor, else 0."""
    return -1 if -1 in list(possible or []) else 0


#: The JSON part of a response: what a code fence (with or without the json tag) holds.
_FENCED = re.compile(r"```(?:json)?(.*?)(?:```|\Z)", re.DOTALL)


_WHOLE = re.compile(r"[+-]?\d{1,18}")


def whole_number(value: object) -> int | None:
    """B13 for one parsed JSON value: booleans as 0/1, numbers cut towards zero, texts that spell a
    whole number; everything else, and what does not fit 32 bits, is missing."""
    if isinstance(value, str):
        spelled = value.strip()
        number = int(spelled) if _WHOLE.fullmatch(spelled) else None
    elif isinstance(value, (bool, int, float)):
        number = int(value) if abs(value) < 2.0 ** 31 else None  # neither NaN nor infinite
    else:
        number = None
    return number if number is not None and abs(number) < 2 ** 31 else None


def whole_numbers(values: pd.Series) -> pd.Series:
    """:func:`whole_number` of a column of parsed JSON values."""
    return pd.Series([whole_number(v) for v in values], index=values.index, dtype="Int64")


def read_response(response: str | None, names: Sequence[str]) -> list[int | None]:
    """One nullable whole number per factor; a response that is null, broken or not an object is
    missing throughout."""
    response = response or ""
    fenced = _FENCED.search(response) if "```" in response else None
    try:
        parsed = json.loads(fenced[1] if fenced else response)
    except ValueError:
        parsed = None
    if not isinstance(parsed, dict):
        return [None] * len(names)
    return [whole_number(parsed.get(name)) for name in names]


def retry_temperatures(start: float = 0.7, tries: int = 3, floor: float = 0.3,
                       step: float = 0.2) -> list[float]:
    """G7 — temperatures of successive tries: each a step lower, never under the floor."""
    return [start if i == 0 else max(floor, start - i * step) for i in range(tries)]


def answers_of(texts: Sequence[str], factors: Sequence[Factor], annotator: Callable,
               factors_json: str, max_attempts: int = 5, temperature: float = 0.7) -> list[list[int]]:
    """G1 for a batch: every try calls the annotator for the texts still open, at the try's
    temperature (G7).  A text is done when any factor has a value other than its missing code;
    after the last try missing codes remain."""
    names = [name for name, _ in factors]
    codes = [missing_code(possible) for _, possible in factors]
    answers = [codes] * len(texts)
    pending = list(range(len(texts)))
    for attempt, degree in enumerate(retry_temperatures(temperature, max_attempts), 1):
        still = []
        for i in pending:
            try:
                response = annotator(texts[i], factors_json, attempt, degree)
                if not isinstance(response, str):
                    response = None
            except Exception:  # noqa: BLE001 - a failed call of the user's annotator is retried
                response = None
            got = [code if v is None else v for v, code in zip(read_response(response, names), codes)]
            if got != codes:
                answers[i] = got
            else:
                still.append(i)
        pending = still
        if not pending:
            break
    return answers


def annotate_texts(texts: Sequence[str], factors: Sequence[Factor], annotator: Callable,
                   factors_json: str, max_attempts: int = 5, temperature: float = 0.7) -> pd.DataFrame:
    """:func:`answers_of` a batch as a table, one integer column per factor."""
    answers = answers_of(texts, factors, annotator, factors_json, max_attempts, temperature)
    return pd.DataFrame(answers, columns=[name for name, _ in factors], index=range(len(texts)), dtype="int32")


def annotate(df: DataFrame, row_id: str, factors: Sequence[Factor], annotator: Callable,
             cols: Sequence[str] | None = None, batch_size: int = 500, max_attempts: int = 5,
             factor_docs: Mapping[str, object] | None = None, temperature: float = 0.7) -> DataFrame:
    """G1 — ``(row_id, <factor> INT ...)`` for every row.  ``batch_size`` bounds
    the rows handed to the annotator per call group inside a task; tries start at
    ``temperature`` and cool down (G7)."""
    cols = list(cols or [c for c in df.columns if c != row_id])
    # Python-side work: the rows are dealt evenly, however few files or tasks they come from
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.select(row_id, *[c for c in dict.fromkeys(cols) if c != row_id]).repartition(tasks)
    texts = format_sample(dealt, cols, out="__text").select(
        F.col(quote_ident(row_id)).alias("row_id"), "__text")
    fjson = json.dumps(dict(factor_docs) if factor_docs else
                       {n: {"possible_values": list(p)} for n, p in factors}, indent=2)
    names = [n for n, _ in factors]
    rid_type = dict(texts.dtypes)["row_id"]
    schema = f"row_id {rid_type}, " + ", ".join(f"`{n}` int" for n in names)

    def run(it):
        for b in it:
            rows = b.column("__text").to_pylist()
            answers = []
            for start in range(0, len(rows), batch_size):
                answers += answers_of(rows[start:start + batch_size], factors, annotator, fjson,
                                      max_attempts, temperature)
            values = [pa.array([a[i] for a in answers], pa.int32()) for i in range(len(names))]
            yield pa.record_batch([b.column("row_id"), *values], names=["row_id", *names])
    return texts.mapInArrow(run, schema)


def keyword_annotator(rules: Mapping[str, Sequence[tuple[str, int]]],
                      fail_first: str | None = None) -> Callable:
    """Deterministic annotator: for each factor the value of the first matching
    regex rule over the sample text (no match: key absent).  With
    ``fail_first`` (a regex) the first attempt for matching texts answers with
    broken JSON, exercising the retry path.  Answers alternate between a fenced
    and a plain JSON object."""
    compiled = {f: [(re.compile(p), v) for p, v in rs] for f, rs in rules.items()}

    def call(text: str, factors_json: str, attempt: int, temperature: float) -> str:
        if fail_first and attempt == 1 and re.search(fail_first, text):
            return "{ not json"
        ans = {}
        for f, rs in compiled.items():
            for rx, v in rs:
                if rx.search(text):
                    ans[f] = v
                    break
        body = json.dumps(ans)
        return f"```json\n{body}\n```" if attempt % 2 else body
    return call


def annotate_by_rules(df: DataFrame, rules: Mapping[str, Column], keep: Sequence[str] = ()
                      ) -> DataFrame:
    """G2 — factor values as Spark expressions (stays in Catalyst codegen)."""
    return df.select(*keep, *[expr.cast("int").alias(name) for name, expr in rules.items()])


def merge_annotations(df: DataFrame, ann: DataFrame, factors: Sequence[Factor],
                      row_id: str = "row_id") -> DataFrame:
    """G4 — existing columns named like the annotations are replaced; rows
    without an annotation get the missing codes (B14)."""
    names = [n for n, _ in factors]
    base = df.drop(*[n for n in names if n in df.columns])
    joined = base.join(unbounded(ann.select(row_id, *[n for n in names if n in ann.columns])), row_id, "left")
    return fill_missing_codes(joined, factors)


def annotate_new(df: DataFrame, existing: DataFrame, new_factors: Sequence[Factor],
                 annotator: Callable, row_id: str = "row_id", cols: Sequence[str] | None = None,
                 **kw) -> DataFrame:
    """G3 — annotate only the new factors and append them to the existing
    annotations (key-aligned join)."""
    known = [c for c in existing.columns if c != row_id]
    new = [(n, p) for n, p in new_factors if n not in known]
    if not new:
        return existing
    ann = annotate(df, row_id, new, annotator, cols, **kw)
    return existing.join(unbounded(ann), row_id, "left")


def retry_mask(df: DataFrame, factors: Sequence[Factor]) -> DataFrame:
    """B15 used by G1: rows whose every factor is missing."""
    return all_missing(df, factors)


def diff_factors(reviewed: DataFrame, known: DataFrame, focus: DataFrame,
                 deleted_before: DataFrame | None = None) -> dict[str, DataFrame]:
    """G5 — factor set algebra of a round on ``name`` columns: ``new`` = reviewed -
    known, ``kept`` = reviewed ∩ known, ``deleted`` = known - reviewed (plus the
    deletions of earlier rounds), ``focus`` = focus names present in reviewed."""
    r = reviewed.select("name").distinct()
    k = known.select("name").distinct()
    deleted = k.join(r, "name", "left_anti")
    if deleted_before is not None:
        deleted = deleted.unionByName(deleted_before.select("name")).distinct()
    return {"new": r.join(k, "name", "left_anti"), "kept": r.join(k, "name", "left_semi"),
            "deleted": deleted,
            "focus": focus.select(F.col("factor_name").alias("name")).join(r, "name", "left_semi")}


def run_rounds(df: DataFrame, proposals: DataFrame, annotate_round: Callable, confirm: Callable,
               validate_focus: Callable, learn: Callable, max_rounds: int = 5,
               min_new: int = 2, row_id: str = "row_id") -> DataFrame:
    """G6 — discovery rounds driven by a table of proposals
    ``(round, name, possible_values, focus)``.  Each round: the new factors are
    annotated (only those never annotated before), independent factors are deleted, the focus list is
    validated, the graph is learned.  Stops after a round > 1 with fewer than
    ``min_new`` new factors, when no focus factor is left, or after
    ``max_rounds``.  Returns one summary row per round."""
    spark = df.sparkSession
    annotated = df.select(row_id)
    known: list[Factor] = []
    summary = []
    rounds = sorted(r["round"] for r in proposals.select("round").distinct().collect())
    for rnd in rounds[:max_rounds]:
        prop = proposals.where(F.col("round") == rnd)
        rows = prop.select("name", "possible_values", "focus").collect()  # a round's factors
        reviewed = [(r["name"], list(r["possible_values"])) for r in rows]
        known_names = {n for n, _ in known}
        new = [(n, p) for n, p in reviewed if n not in known_names]
        # a factor that was deleted and comes back keeps its annotation
        unseen = [(n, p) for n, p in new if n not in annotated.columns]
        if unseen:
            annotated = annotated.join(annotate_round(df, unseen), row_id, "left")
        known = [f for f in known if f[0] in {n for n, _ in reviewed}] + new
        kept = confirm(annotated, [n for n, _ in known])
        known = [f for f in known if f[0] in kept]
        focus = validate_focus(annotated, [r["name"] for r in rows if r["focus"] and r["name"] in kept])
        n_edges = learn(annotated, [n for n, _ in known]) if len(known) >= 2 else 0
        stop = None
        if rnd > rounds[0] and len(new) < min_new:
            stop = "few new factors"
        elif not focus:
            stop = "no focus factor left"
        summary.append((int(rnd), len(new), len(known), len(reviewed) - len(known), len(focus),
                        int(n_edges), stop))
        if stop:
            break
    return spark.createDataFrame(summary, "round int, n_new int, n_kept int, n_deleted int, "
                                          "n_focus int, n_edges int, stop_reason string")


def fill_and_flag(df: DataFrame, factors: Sequence[Factor]) -> DataFrame:
    """B14 + B15 over annotated rows (missing codes, all-missing flag)."""
    return all_missing(fill_missing_codes(df, factors), factors)
