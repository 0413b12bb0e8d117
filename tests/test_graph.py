from itertools import permutations

from pyspark.sql import functions as F

from kestrel.operators import graph as G
from kestrel.operators import orders as H

NODES = ["a", "b", "c", "d"]
EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]


def endpoint(spark, edges, gid="g"):
    rows = []
    for s, d in edges:
        rows += [(gid, s, d, -1.0), (gid, d, s, 1.0)]
    return spark.createDataFrame(rows, "graph_id string, src string, dst string, value double")


def nodes_df(spark, gid="g"):
    return spark.createDataFrame([(gid, n) for n in NODES], "graph_id string, node string")


def valid(order, edges):
    pos = {n: i for i, n in enumerate(order)}
    return all(pos[s] < pos[d] for s, d in edges)


def test_infer_topo_and_all_orders(spark):
    d = G.infer_directed(endpoint(spark, EDGES))
    assert sorted((r.src, r.dst) for r in d.collect()) == sorted(EDGES)
    assert G.topo_sort(nodes_df(spark), d).first().order == ["a", "b", "c", "d"]
    allo = [r.cols for r in G.topo_sorts_all(nodes_df(spark), d, 10).orderBy("order_id").collect()]
    assert allo == [["a", "b", "c", "d"], ["a", "c", "b", "d"]]
    brute = sorted(list(p) for p in permutations(NODES) if valid(p, EDGES))
    assert allo == brute
    fr = spark.createDataFrame([(allo[0], allo[1])], "cols_a array<string>, cols_b array<string>")
    assert G.footrule(fr).first().footrule == 2.0


def test_cycle_detection(spark):
    d = G.infer_directed(endpoint(spark, EDGES + [("d", "a")]))
    assert G.topo_sort(nodes_df(spark), d).first().order == []
    cyc = G.find_cycle(nodes_df(spark), d).first()
    assert cyc.has_cycle
    path = cyc.cycle
    assert path[0] == path[-1] and len(path) >= 3
    es = set(EDGES + [("d", "a")])
    assert all((a, b) in es for a, b in zip(path[:-1], path[1:]))


def test_sampled_orders_respect_edges_and_diverse(spark):
    d = G.infer_directed(endpoint(spark, EDGES))
    s = G.sample_topo_orders(nodes_df(spark), d, 10, 200, seed=1).collect()
    got = sorted(tuple(r.cols) for r in s)
    assert got == [("a", "b", "c", "d"), ("a", "c", "b", "d")]
    sel = G.select_diverse(spark.createDataFrame(
        [("g", i, list(p)) for i, p in enumerate(permutations(NODES))],
        "graph_id string, order_id int, cols array<string>"), 3, seed=0).collect()
    assert len(sel) == 3 and sorted(r.pick for r in sel) == [0, 1, 2]


def test_levels(spark):
    d = G.infer_directed(endpoint(spark, EDGES))
    lv = {r.node: r.level for r in G.topo_levels(nodes_df(spark), d).collect()}
    assert lv == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_insert_and_weights(spark):
    o = spark.createDataFrame([(0, ["b", "c"])], "order_id int, cols array<string>")
    assert H.insert_nodes(o, ["a", "c"], "front").first().cols == ["a", "b", "c"]
    assert H.insert_nodes(o, ["a", "c"], "back").first().cols == ["b", "c", "a"]
    rnd = H.insert_nodes(o, ["a", "x"], "random", seed=2).first().cols
    assert sorted(rnd) == ["a", "b", "c", "x"] and [c for c in rnd if c in "bc"] == ["b", "c"]
    fac = spark.createDataFrame(
        [("completeness", ["description", "requirements", "benefits"]),
         ("role", ["title", "description", "function"])], "name string, column_based array<string>")
    cols = H.columns_table(spark, ["title", "description", "requirements", "benefits", "function",
                                   "salary"])
    w = {r.col: r.weight for r in H.weights_by_factors(fac, cols).collect()}
    assert w == {"title": 1, "description": 2, "requirements": 1, "benefits": 1, "function": 1,
                 "salary": 0}
    ex = H.expand_orders(spark.createDataFrame([(0, ["role", "completeness", "salary"])],
                                               "order_id int, cols array<string>"), fac).first().cols
    assert sorted(ex[:3]) == ["description", "function", "title"]
    assert ex[3:5] in (["requirements", "benefits"], ["benefits", "requirements"])
    assert ex[-1] == "salary" and len(ex) == 6


def test_sampled_orders_run_every_graph(spark, monkeypatch):
    """The order queries hand the cyclic graph to the sampler too; it has no order."""
    from kestrel.plans import q_graph
    from tests.conftest import SF001
    seen, sample = set(), q_graph.G.sample_topo_orders

    def spy(nodes, directed, *args):
        seen.update(r.graph_id for r in nodes.select("graph_id").distinct().collect())
        return sample(nodes, directed, *args)
    monkeypatch.setattr(q_graph.G, "sample_topo_orders", spy)
    rows = q_graph.sampled_orders(spark, SF001, 5, 20).collect()
    assert len(seen) == 2 and {r.graph_id for r in rows} == {"dag"}


def test_levels_and_exclusions_of_several_graphs(spark):
    # graph c: a -> b <-> c -> d, e alone; b, c and d lie on or behind the cycle
    d = spark.createDataFrame([("g", "a", "b"), ("c", "a", "b"), ("c", "b", "c"), ("c", "c", "b"), ("c", "c", "d")],
                              "graph_id string, src string, dst string")
    nodes = spark.createDataFrame([(g, n) for g in "gc" for n in "abcde"], "graph_id string, node string")
    lv = {(r.graph_id, r.node): r.level for r in G.topo_levels(nodes, d).collect()}
    assert [lv["c", n] for n in "abcde"] == [0, None, None, None, 0]
    assert [lv["g", n] for n in "abcde"] == [0, 1, 0, 0, 0]
    weights = spark.createDataFrame([("g", "a", 0.0), ("c", "a", 1.0)], "graph_id string, col string, weight double")
    out = sorted(tuple(r) for r in G.excluded_nodes(nodes, d, weights).collect())
    assert out == [("c", "e"), ("g", "a"), ("g", "c"), ("g", "d"), ("g", "e")]
    both = G.excluded_nodes(nodes, d, weights.where("graph_id = 'g'").drop("graph_id"))
    assert sorted(tuple(r) for r in both.collect()) == [("c", "a")] + out
