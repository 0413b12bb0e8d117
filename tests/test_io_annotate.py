import json
import os

import pandas as pd
import tempfile

from pyspark.sql import functions as F

from kestrel.operators import annotate as G
from kestrel.sources import io as A


def test_json_readers_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="kestrel-io-")
    p1 = os.path.join(d, "orders1d.json")
    with open(p1, "w") as f:
        json.dump(["a", "b", "c"], f)
    p2 = os.path.join(d, "orders2d.json")
    with open(p2, "w") as f:
        json.dump([["a", "b"], ["b", "a"]], f)
    assert [r.cols for r in A.read_orders(spark, p1).collect()] == [["a", "b", "c"]]
    assert [r.cols for r in A.read_orders(spark, p2).orderBy("order_id").collect()] == [["a", "b"], ["b", "a"]]
    p3 = os.path.join(d, "factors.json")
    with open(p3, "w") as f:
        json.dump({"factors": {"completeness": {"description": "d", "possible_values": [0, 1, "x"],
                                                "annotation_criteria": "c",
                                                "column_based": ["description", "benefits"]}},
                   "recommended_focus_factors": ["completeness",
                                                 {"factor_name": "role", "reasoning": "r"}]}, f)
    fac, focus = A.read_factors(spark, p3)
    r = fac.first()
    assert r.name == "completeness" and r.possible_values == [0, 1, None]
    assert sorted(x.factor_name for x in focus.collect()) == ["completeness", "role"]
    p4 = os.path.join(d, "w.json")
    with open(p4, "w") as f:
        json.dump({"weights": {"a": 1, "b": 0.5}}, f)
    assert {x.col: x.weight for x in A.read_weights(spark, p4).collect()} == {"a": 1.0, "b": 0.5}
    p5 = os.path.join(d, "g.json")
    with open(p5, "w") as f:
        json.dump({"nodes": ["a", "b"], "edges": [{"from": "a", "to": "b", "value": -1},
                                                  {"from": "b", "to": "a", "value": 1}]}, f)
    e = A.read_edges(spark, p5).orderBy("edge_pos").collect()
    assert [(x.src, x.dst, x.value) for x in e] == [("a", "b", -1.0), ("b", "a", 1.0)]
    arr = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id int, v array<double>")
    cols = A.array_to_columns(arr, "v", keep=["id"]).orderBy("id").collect()
    assert [(c.A, c.B) for c in cols] == [(1.0, 2.0), (3.0, 4.0)]


def test_annotation_retries_and_missing_codes(spark):
    df = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "row_id long, t string")
    factors = [("f1", [0, 1]), ("f2", [-1, 0, 1])]
    calls = []

    def annotator(text, fjson, attempt, temp):
        calls.append(attempt)
        if "alpha" in text and attempt < 3:
            return "``` not json ```"
        if "beta" in text:
            return json.dumps({"f1": "unknown", "f2": None})  # all missing: retried 5x
        if "gamma" in text:
            return "```json\n{\"f1\": 1.9, \"f2\": \"1\"}\n```"
        return json.dumps({"f1": True, "f2": 0})
    out = {r.row_id: (r.f1, r.f2) for r in G.annotate(df, "row_id", factors, annotator, ["t"]).collect()}
    assert out == {1: (1, 0), 2: (0, -1), 3: (1, 1)}
    assert [round(t, 6) for t in G.retry_temperatures(0.7, 3)] == [0.7, 0.5, 0.3]
    values = pd.Series(["2.0", 2.7, True, None, float("nan"), " -3 ", [1], "unknown", 2 ** 40], dtype=object)
    assert G.whole_numbers(values).fillna(-99).tolist() == [-99, 2, 1, -99, -99, -3, -99, -99, -99]


def test_annotation_cools_down():
    seen = []

    def annotator(text, fjson, attempt, temperature):
        seen.append(round(temperature, 6))
        if attempt == 2:
            raise TimeoutError
        return "no json" if attempt < 4 else '{"f": 1}'
    out = G.annotate_texts(["x"], [("f", [0, 1])], annotator, "{}", 5, 0.9)
    assert out["f"].tolist() == [1] and seen == [0.9, 0.7, 0.5, 0.3]


def test_merge_annotations_replaces_columns(spark):
    df = spark.createDataFrame([(1, 9), (2, 9)], "row_id long, f1 int")
    ann = spark.createDataFrame([(1, 0)], "row_id long, f1 int")
    out = {r.row_id: (r.f1, r.f2) for r in
           G.merge_annotations(df, ann, [("f1", [0, 1]), ("f2", [-1, 1])]).collect()}
    assert out == {1: (0, -1), 2: (0, -1)}


def test_one_graph_document_for_each_graph(spark):
    e = spark.createDataFrame([("1", "a", "b", 0.5), ("1", "b", "c", 2.0), ("x y", "c", "a", -1.0)],
                              "graph_id string, src string, dst string, weight double")
    path = os.path.join(tempfile.mkdtemp(prefix="kestrel-io-"), "graphs")
    order = F.array_sort(F.collect_set("src"))
    A.write_json_doc(spark, A.edges_json(e, "weight", order), e, path, by="graph_id")
    back = A.read_edges(spark, path)
    assert sorted((r.graph_id, r.src, r.dst, r.weight) for r in back.collect()) == sorted(map(tuple, e.collect()))
    assert {r.graph_id: r.nodes for r in A.read_causal_order(spark, path).collect()} == {"1": ["a", "b"], "x y": ["c"]}


def test_annotation_deals_rows_and_batches(spark):
    """One input file, more tasks: the annotator runs in all of them, in groups of the batch size."""
    from pyspark import TaskContext

    def annotator(text, fjson, attempt, temp):
        return json.dumps({"part": TaskContext.get().partitionId(), "word": int(text.split()[-1]) % 7})

    df = spark.range(0, 400, 1, 1).selectExpr("id AS row_id", "id AS t").unionByName(
        spark.createDataFrame([(None, 3)], "row_id long, t long")).coalesce(1)
    out = G.annotate(df, "row_id", [("part", [-1]), ("word", [0])], annotator, ["t"], batch_size=30).collect()
    assert {r.row_id: r.word for r in out} == {None: 3} | {i: i % 7 for i in range(400)}
    assert len({r.part for r in out}) > 1
