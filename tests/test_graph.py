import math

import pytest
from pyspark.sql import functions as F

from loomwork.operators import graph, layers, stats
from loomwork.operators.components import connected_components

EDGES = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "a"), ("x", "y"), ("", "a"), ("a", None)]


@pytest.fixture(scope="module")
def edges(spark):
    return graph.edges_of(spark.createDataFrame(EDGES, "source_domain string, target_domain string"))


def power_iteration(pairs, rounds=None, tolerance=1e-6):
    nodes = sorted({n for p in pairs for n in p})
    pr = {n: 1 / len(nodes) for n in nodes}
    out = {n: [b for a, b in pairs if a == n] for n in nodes}
    for _ in range(rounds or 100):
        stuck = sum(pr[n] for n in nodes if not out[n])
        new = {n: 0.15 / len(nodes) + 0.85 * (stuck / len(nodes) + sum(pr[a] / len(out[a]) for a in nodes if n in out[a])) for n in nodes}
        change = sum(abs(new[n] - pr[n]) for n in nodes)
        pr = new
        if rounds is None and change < len(nodes) * tolerance:
            break
    return pr


@pytest.mark.parametrize("fixed", [1, 5, None])
def test_pagerank(edges, fixed):
    want = power_iteration({("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "a"), ("x", "y")}, fixed)
    got = {r.node: r.pr for r in graph.pagerank(edges, fixed=fixed).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want)
    assert abs(sum(got.values()) - 1) < 1e-9


def test_empty_graph_is_an_error(edges):
    with pytest.raises(graph.EmptyGraphError):
        graph.pagerank(edges.where("src = 'nobody'"))


def test_degrees_and_subgraph(edges, spark):
    assert {tuple(r) for r in graph.degrees(edges).collect()} == {("a", 2, 1), ("b", 1, 1), ("c", 2, 2), ("d", 0, 1), ("x", 0, 1), ("y", 1, 0)}
    top = spark.createDataFrame([("a", 1.0), ("c", 0.5)], "node string, pr double")
    assert {tuple(r) for r in graph.induced_degrees(edges, top).collect()} == {("a", 1.0, 1, 0), ("c", 0.5, 1, 2)}


def test_bfs_and_non_expanding_nodes(edges, spark):
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.bfs(edges, seeds).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    opened = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.bfs(edges, seeds, opened).collect()} == {("a", 0), ("b", 1)}


def test_components_of_a_long_path(spark):
    path = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    extra = spark.createDataFrame([(500, 501), (7, 7), (900, 900), (1000, None)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(path.union(extra)).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500, 900: 900}


def test_betweenness_of_a_diamond(spark):
    pairs = [("s", "a"), ("s", "b"), ("a", "t"), ("b", "t"), ("t", "u")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    got = {r.node: r.betweenness for r in graph.betweenness(e, graph.nodes_of(e)).collect()}
    assert got == {"s": 0.0, "a": 1.0, "b": 1.0, "t": 3.0, "u": 0.0}


GOLDEN = [1, 3, 49, 601, 3276, 14911, 39320, 53104, 37384, 3732]


def test_layers_against_published_figures(spark):
    rows = [(d, "crawled" if d < 8 else "pending") for d, n in enumerate(GOLDEN)]
    counts = spark.createDataFrame([(d, s, n) for (d, s), n in zip(rows, GOLDEN, strict=True)], "depth int, status string, n int")
    queue = counts.select("depth", "status", F.explode(F.sequence(F.lit(1), "n")).alias("k")).withColumn("status", F.when((F.col("depth") == 8) & (F.col("k") <= 7983), "crawled").otherwise(F.col("status")))
    got = layers.layer_stats(queue).orderBy("depth").collect()
    assert [r.l for r in got] == GOLDEN and got[-1].a == 151_381 + 1000
    assert [round(r.r, 3) for r in got[1:]] == [3.0, 16.333, 12.265, 5.451, 4.552, 2.637, 1.351, 0.704, 0.1]
    assert got[0].l1 is None and got[1].l1 == 2 and got[2].l2 == 44 and [r["last"] for r in got] == [False] * 9 + [True]
    assert tuple(layers.peak(queue).first()) == (7, 53104)
    assert tuple(layers.progress(queue).first()) == (8, 7983, 37384)


def test_power_law_and_its_guards(spark):
    rows = [(f"p{k}", 3.0 * k**-0.7) for k in range(1, 60)] + [("zero", 0.0)]
    points = stats.ranked(spark.createDataFrame(rows, "domain string, pagerank double"))
    assert [r.rank for r in points.orderBy("rank").collect()] == list(range(1, 61))
    fit = stats.power_law(points)
    f = fit.first()
    assert f.n == 59 and math.isclose(f.c, 3.0) and math.isclose(f.alpha, 0.7) and math.isclose(f.r_squared, 1.0)
    line = stats.fitted_line(points, fit).orderBy("rank").collect()
    assert len(line) == 251 and line[0]["rank"] == 1 and line[-1]["rank"] == 60
    flat = stats.power_law(spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.5)], "rank long, domain string, pagerank double")).first()
    assert (flat.alpha, flat.r_squared) == (0.0, 0.0)
    assert tuple(stats.power_law(spark.createDataFrame([(1, "a", 0.5)], "rank long, domain string, pagerank double")).first()) == (1, 0.0, 0.0, 0.0)


def test_a_round_of_components_is_one_query(spark, monkeypatch):
    """What has changed is counted while it is written."""
    monkeypatch.setattr(type(spark.range(0)), "isEmpty", lambda df: pytest.fail("a query of its own"))
    edges = spark.range(40).selectExpr("id AS src", "id + 1 AS dst")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(k, 0) for k in range(41)}
    assert connected_components(edges.where("src < 0")).collect() == []
