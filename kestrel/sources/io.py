"""A — readers and writers for tables, factor catalogues, graphs, orders, weights.

JSON documents of the reference's formats are read with Spark's JSON support
(``wholetext`` + ``from_json`` into maps / arrays, then ``explode``), so a file is
parsed by a task, never by the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.exprs import quote_ident
from kestrel.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
               fmt: str | None = None) -> DataFrame:
    """A1 — CSV (header) or Parquet table scan; CSV types come from ``schema``
    (inference only when no schema is given)."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        r = spark.read.option("header", True)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        return r.csv(path)
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(path)


FACTOR_STRUCT = ("STRUCT<description: STRING, possible_values: ARRAY<STRING>, "
                 "annotation_criteria: STRING, column_based: ARRAY<STRING>>")


def read_factors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A2 — ``{"factors": {name: {...}}, "recommended_focus_factors": [...]}`` to
    ``factors(pos, name, description, possible_values, annotation_criteria,
    column_based)`` and ``focus(factor_name, reasoning, expected_value_diversity)``
    (a focus entry may be a plain name).  Non-numeric possible values are null."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json(
        "value", f"STRUCT<factors: MAP<STRING, {FACTOR_STRUCT}>, "
                 "recommended_focus_factors: ARRAY<STRING>>").alias("d"))
    factors = doc.select(F.posexplode(F.map_entries("d.factors")).alias("pos", "e")).select(
        "pos", F.col("e.key").alias("name"), F.col("e.value.description").alias("description"),
        F.transform("e.value.possible_values", lambda v: v.try_cast("int")).alias("possible_values"),
        F.col("e.value.annotation_criteria").alias("annotation_criteria"),
        F.coalesce("e.value.column_based", F.array().cast("array<string>")).alias("column_based"))
    fschema = "STRUCT<factor_name: STRING, reasoning: STRING, expected_value_diversity: STRING>"
    focus = doc.select(F.explode("d.recommended_focus_factors").alias("f")).select(
        F.when(F.col("f").startswith("{"), F.from_json("f", fschema)).otherwise(
            F.struct(F.col("f").alias("factor_name"), F.lit(None).cast("string").alias("reasoning"),
                     F.lit(None).cast("string").alias("expected_value_diversity"))).alias("x")
    ).select("x.*")
    return factors, focus


def _graph_id(doc: DataFrame, graph_id: str) -> Column:
    """The id of a graph document: its ``graph_id=`` folder or field, else the given one."""
    return F.col("graph_id").cast("string") if "graph_id" in doc.columns else F.lit(graph_id)


def read_edges(spark: SparkSession, path: str, graph_id: str = "g") -> DataFrame:
    """A3 — graph JSON to an edges table; ``path`` is one document or a folder with one document
    for each graph (see :func:`write_json_doc`).  Endpoint form ``{from, to, value}`` gives
    ``(graph_id, src, dst, value, edge_pos)``; weighted form ``{from, to, weight}``
    gives ``weight`` instead of ``value``."""
    doc = spark.read.option("multiLine", True).json(path)
    e = doc.select(_graph_id(doc, graph_id).alias("graph_id"), F.posexplode("edges").alias("edge_pos", "e"))
    fields = doc.schema["edges"].dataType.elementType.fieldNames()
    cols = ["graph_id", F.col("e.from").alias("src"), F.col("e.to").alias("dst")]
    if "value" in fields:
        cols.append(F.col("e.value").cast("double").alias("value"))
    if "weight" in fields:
        cols.append(F.col("e.weight").cast("double").alias("weight"))
    return e.select(*cols, "edge_pos")


def read_causal_order(spark: SparkSession, path: str, graph_id: str = "g") -> DataFrame:
    """A3 — the ``causal_order`` list of a weighted graph file."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(_graph_id(doc, graph_id).alias("graph_id"), F.col("causal_order").alias("nodes"))


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """A4 — a JSON 2-D list of column names (a 1-D list is wrapped) to
    ``(order_id, cols)``."""
    txt = spark.read.text(path, wholetext=True)
    two = F.from_json("value", "ARRAY<ARRAY<STRING>>")
    one = F.from_json("value", "ARRAY<STRING>")
    arr = F.when(F.trim("value").rlike(r"^\[\s*\["), two).otherwise(F.array(one))
    return txt.select(F.posexplode(arr).alias("order_id", "cols")).select(
        F.col("order_id").cast("int"), "cols")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """A5 — ``{"weights": {col: number}}`` to ``(col, weight)``."""
    txt = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "STRUCT<weights: MAP<STRING, DOUBLE>>")
    return txt.select(F.explode(m["weights"]).alias("col", "weight"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> str:
    """A6 — write an (annotated) table as Parquet or CSV with a header."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def write_json_doc(spark: SparkSession, doc: Column, source: DataFrame, path: str,
                   by: str | None = None) -> str:
    """A7 — one JSON document built by an aggregate expression over ``source``
    (orders, excluded nodes, weights, metrics), written as a single text file; with ``by``
    one document for each value of that column, in its own ``by=value`` folder."""
    if by is not None:
        source.groupBy(by).agg(doc.alias("value")).write.mode("overwrite").partitionBy(by).text(path)
        return path
    source.agg(doc.alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def orders_json(orders: DataFrame) -> Column:
    """A7 — 2-D list of the orders sorted by ``order_id``."""
    return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("order_id", "cols"))),
                                 lambda s: s["cols"]))


def weights_json(weights: DataFrame) -> Column:
    """A7 — ``{"weights": {col: weight}}``."""
    return F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("col", "weight")))
                              .alias("weights")))


def factors_json(factors: DataFrame, focus: Column | None = None) -> Column:
    """A7 — the factor catalogue document."""
    entry = F.struct(F.col("name"), F.struct(
        "description", F.transform("possible_values", lambda v: v.cast("string")).alias("possible_values"),
        "annotation_criteria", "column_based"))
    m = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))),
                                       lambda s: s["e"]))
    doc = F.struct(m.alias("factors"), (focus if focus is not None else
                                        F.array().cast("array<string>")).alias("recommended_focus_factors"))
    return F.to_json(doc)


def edges_json(edges: DataFrame, value: str = "value", causal_order: Column | None = None) -> Column:
    """A7 — ``{"edges": [{from, to, value}]}`` ordered by ``edge_pos`` when
    present, else by (from, to); a weighted graph file also holds its ``causal_order``."""
    extra = [] if causal_order is None else [causal_order.alias("causal_order")]
    key = F.col("edge_pos") if "edge_pos" in edges.columns else F.lit(0)
    return F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct(
        key.alias("k"), F.col("src").alias("from"), F.col("dst").alias("to"),
        F.col(value).alias(value)))),
        lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), s[value].alias(value)))
        .alias("edges"), *extra))


def write_predicted_anomalies(scores: DataFrame, rows: DataFrame, path: str,
                              row_id: str = "row_id", by: str = "method", seed: int = 0) -> str:
    """A8 — per method, the k rows predicted anomalous (k = its number of true
    anomalies; ties at the cut by ``md5(seed|row_id)``, as J3) with their original
    columns, label, score and rank, written partitioned by method.  The cut and
    the rank are distributed (bucketed prefix sums); no per-method sort of all
    rows."""
    from kestrel.functions.exprs import hash_num
    from kestrel.functions.prefix import prefix_sums
    from kestrel.operators.metrics import predict_top_k
    pred = predict_top_k(scores, "score", "label", row_id, [by], seed).where(F.col("predicted") == 1)
    # rank among the predicted rows: score descending, then the hash order
    keyed = (pred.withColumn("__h", hash_num(seed, F.col(row_id)))
             .withColumn("__hs", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string"))))
             .withColumn("__one", F.lit(1)).withColumn("__neg", -F.col("score")))
    ranked = prefix_sums(keyed, [by], "__neg", ["__one"], tiebreak=["__hs", row_id])
    out = (ranked.withColumn("rank", (F.col("__one_before") + 1).cast("int"))
           .drop("__h", "__hs", "__one", "__neg", "__one_before", "predicted")
           .join(rows, row_id))
    out.write.mode("overwrite").partitionBy(by).parquet(path)
    return path


def columns(df: DataFrame) -> DataFrame:
    """A9 — the column list ``(pos, col)`` from the schema only (no rows read)."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns)), "pos int, col string")


def array_to_columns(df: DataFrame, arr: str, names: Sequence[str] | None = None,
                     n: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """A10 — array elements to named columns (A..Z, AA..ZZ by default); every
    array must have the expected length (a mismatch raises)."""
    from kestrel.operators.recode import positional_names
    if names is None:
        if n is None:
            n = df.select(F.size(arr).alias("s")).where(F.col("s").isNotNull()).first()["s"]
        names = positional_names(n)
    size_ok = F.size(arr) == len(names)
    checked = F.when(size_ok, F.col(quote_ident(arr))).otherwise(F.raise_error(F.concat(
        F.lit("array length differs from the number of names: "), F.size(arr).cast("string"))))
    return df.select(*keep, *[checked[i].alias(nm) for i, nm in enumerate(names)])
