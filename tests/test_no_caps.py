"""Sizes beyond what was once a limit."""

import json

import pytest

from loomwork.operators import comments, graph
from loomwork.sinks import reports


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Many levels of few rows."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_betweenness_of_a_long_path(spark):
    n = 36
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(n - 1)], "src string, dst string")
    found = {r.node: r.betweenness for r in graph.betweenness(edges, spark.createDataFrame([("n0",)], "node string")).collect()}
    assert found["n1"] == 34 and found["n30"] == 5 and found["n35"] == 0


def test_deep_threads(spark):
    rows = [(f"c{k}", f"c{k - 1}" if k else None) for k in range(106)]
    found = {r.external_comment_id: r.depth for r in comments.thread_depth(spark.createDataFrame(rows, "external_comment_id string, parent_external_comment_id string")).collect()}
    assert found == {f"c{k}": k for k in range(106)}


def test_reports_are_whole(spark):
    assert reports.html_table(spark.range(1500)).count("<tr>") == 1501
    nodes = spark.createDataFrame([("a", "A", 1.0, "u"), ("b", "B", 1.0, "u")], "node string, label string, size double, url string")
    edges = spark.createDataFrame([("a", "b"), ("a", "gone")], "src string, dst string")
    data = reports.graph_html(nodes, edges).split("const data=")[1].split(";</script>")[0]
    assert json.loads(data[: data.index(";const place")] if ";const place" in data else data)["edges"] == [["a", "b"]]
