"""L6 — restartable sweep of detectors over datasets, splits and input encodings.

A run is one detector on one split of one dataset.  The input is encoded once for each dataset
and encoding (over train and test, as detectors compare them), written by a reliable checkpoint
and shared by all runs that read it.  Every run writes its metrics into a folder of the result
table, so that a sweep that was interrupted goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.metrics import evaluate, run_key
from kestrel.session import cut_lineage, unbounded

RESULT = ("run string, dataset string, split int, method string, encoding string, metric string, value double, "
          "fit_seconds double, score_seconds double, status string")
COLUMNS = [field.split()[0] for field in RESULT.split(", ")]


@dataclass(frozen=True)
class Method:
    """A detector: ``fit(train, columns)`` returns any model, ``score(model, train, test, columns)``
    a DataFrame ``(row_id, score)``.  ``encoding`` names the input it wants."""
    score: Callable[[Any, DataFrame, DataFrame, list[str]], DataFrame]
    fit: Callable[[DataFrame, list[str]], Any] = lambda train, columns: None
    encoding: str = "ordinal"


def _result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).option("recursiveFileLookup", True).parquet(path)


def _write(metrics: DataFrame, path: str, run: dict, seconds: tuple, status: str) -> None:
    """The rows of one run, in a folder of its own; a run that is repeated replaces them."""
    key = run_key(run)
    values = run | {"run": key, "fit_seconds": seconds[0], "score_seconds": seconds[1], "status": status}
    out = metrics.withColumns({name: F.lit(value) for name, value in values.items()})
    types = dict(field.split() for field in RESULT.split(", "))
    out.select(*[F.col(c).cast(types[c]).alias(c) for c in COLUMNS]).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/{hashlib.md5(key.encode()).hexdigest()}")


def _failed(spark: SparkSession, path: str, run: dict, seconds: tuple, error: Exception) -> None:
    nothing = spark.createDataFrame([(None, None)], "metric string, value double")
    _write(nothing, path, run, seconds, f"{type(error).__name__}: {str(error)[:200]}")


def _run(x: DataFrame, columns: list[str], method: Method, path: str, run: dict) -> None:
    """Fit on the train rows, score the test rows (both written before the clock stops), evaluate."""
    train, test = (x.where(F.col("split") == part) for part in ("train", "test"))
    features = ["row_id", *columns]
    at, fit_seconds, score_seconds = time.time(), None, None
    try:
        model = method.fit(train.select(*features), columns)
        if isinstance(model, DataFrame):
            model = cut_lineage(model)
        fit_seconds, at = round(time.time() - at, 3), time.time()
        scores = cut_lineage(method.score(model, train.select(*features), test.select(*features), columns)
                             .select("row_id", "score"))
        score_seconds = round(time.time() - at, 3)
        judged = evaluate(scores.join(unbounded(test.select("row_id", "label")), "row_id"), "score", "label", "row_id")
        _write(judged, path, run, (fit_seconds, score_seconds), "ok")
    except Exception as error:  # noqa: BLE001 - any failure of a user's detector is a result
        _failed(x.sparkSession, path, run, (fit_seconds, score_seconds), error)


def run_sweep(spark: SparkSession, datasets: Mapping[str, DataFrame], splits: Iterable[int],
              methods: Mapping[str, Method], split: Callable[[DataFrame, int], DataFrame],
              encode: Callable[[DataFrame, str], DataFrame], path: str, workers: int = 4) -> DataFrame:
    """L6 — metrics of every method on every split of every dataset.

    ``datasets`` hold a unique ``row_id``, ``label`` (0/1) and features; ``encode(features,
    encoding)`` keeps ``row_id`` and gives numbers otherwise; ``split(rows, s)`` adds ``split``
    (``train`` or ``test``).  ``path`` is a folder that all executors share.  Runs already there
    with status ``ok`` are not repeated, failed ones are; a failure is one row with its error as
    status and null metric.  At most ``workers`` (dataset, encoding) pairs run at the same time;
    seconds compare best with ``workers=1``.  A dataset without rows gives failed or zero rows,
    as its detectors do.  Only names of runs reach the driver.
    """
    spark.createDataFrame([], RESULT).write.mode("ignore").parquet(f"{path}/none")  # the folder exists from here on
    done = {r.run for r in _result(spark, path).where(F.col("status") == "ok").select("run").distinct().collect()}
    todo: dict[tuple[str, str], list[dict]] = {}
    keys = []
    for dataset in datasets:
        for s in splits:
            for name, method in methods.items():
                run = {"dataset": dataset, "split": s, "method": name, "encoding": method.encoding}
                keys.append(run_key(run))
                if keys[-1] not in done:
                    todo.setdefault((dataset, method.encoding), []).append(run)

    def work(item):
        (dataset, encoding), runs = item
        rows = datasets[dataset]
        try:
            x = encode(rows.drop("label"), encoding)
            columns = [c for c in x.columns if c != "row_id"]
            x = cut_lineage(x.join(unbounded(rows.select("row_id", "label")), "row_id"))
            parts = {s: cut_lineage(split(x, s)) for s in sorted({run["split"] for run in runs})}
        except Exception as error:  # noqa: BLE001 - an input that cannot be made fails its runs only
            for run in runs:
                _failed(spark, path, run, (None, None), error)
            return
        for run in runs:
            _run(parts[run["split"]], columns, methods[run["method"]], path, run)

    with ThreadPoolExecutor(max_workers=workers) as pool:
        list(pool.map(work, todo.items()))
    return _result(spark, path).where(F.col("run").isin(keys))
