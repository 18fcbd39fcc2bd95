"""Connected components of an undirected graph (GR-8)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomwork.plans.lineage import discard, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label each endpoint of ``edges`` with the smallest node reachable from it.

    Returns ``(node, component)``, one row for each distinct endpoint.  Direction, parallel edges and
    self-loops do not matter (a node with only a self-loop is its own component); edges with a null
    end are ignored; an empty input gives an empty result.

    Every round takes the minimum label among the neighbours and then jumps to the label's own label,
    so path-like components shrink geometrically instead of one hop a round.  All aggregates combine
    on the map side and the joins are plain equi-joins, which adaptive execution splits when a hub
    holds a large share of the edges.  A round is one query: it counts what it changes while it writes.
    """
    one_way = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = written(one_way.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())
    older = labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(max_rounds):
        own = labels.select("node", "label", F.col("label").alias("was"))
        seen = both.join(labels.select(F.col("node").alias("a"), "label"), "a").select(F.col("b").alias("node"), "label")
        lower = own.unionByName(seen, allowMissingColumns=True).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = lower.join(onward, "label", "left").select("node", "was", F.least("label", "further").alias("label"))
        changes = Observation(f"components-{uuid.uuid4().hex}")
        done = written(jumped.observe(changes, F.count(F.when(F.col("label") < F.col("was"), 1)).alias("rows")))
        discard(older)
        labels, older = done.select("node", "label"), done
        if not changes.get.get("rows"):
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
