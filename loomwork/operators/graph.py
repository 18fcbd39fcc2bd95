"""Graph operators over an edge table ``(source_domain, target_domain)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.text import display_name
from loomwork.operators.components import connected_components
from loomwork.plans.lineage import cut, written

DAMPING = 0.85
#: Limits and default of the size of a top-N subgraph.
LEAST_TOP, MOST_TOP, DEFAULT_TOP = 10, 1000, 300


class EmptyGraphError(ValueError):
    """There is no edge with two ends."""


def edges_of(recommendations: DataFrame) -> DataFrame:
    """Distinct directed edges ``(src, dst)`` with two non-empty ends; self-loops stay (GR-1)."""
    e = recommendations.select(F.col("source_domain").alias("src"), F.col("target_domain").alias("dst"))
    return e.where("src <> '' AND dst <> ''").dropDuplicates(["src", "dst"])


def nodes_of(edges: DataFrame) -> DataFrame:
    """``(node)``: all ends of edges (SET-1)."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, in_degree, out_degree)`` of all nodes, in one aggregation of both ends (GR-3)."""
    ends = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("src", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def pagerank(edges: DataFrame, damping: float = DAMPING, fixed: int | None = None, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """``(node, pr)``: PageRank with uniform teleport and uniform dangling redistribution (GR-2).

    With ``fixed``, that many rounds; else until the L1 change is below nodes * ``tolerance``, at most
    ``most`` rounds, after which it raises.  A round is one plan: a join, an aggregation in which a hub among the targets
    is combined in every task, and the mass of the dangling nodes as one row.
    """
    weights = edges.join(out_degree(edges).withColumnRenamed("node", "src"), "src").select("src", "dst", (1.0 / F.col("out_degree")).alias("w"))
    weights = written(weights, "weights")
    nodes = written(nodes_of(edges).join(edges.select(F.col("src").alias("node"), F.lit(True).alias("sends")).distinct(), "node", "left"))
    n = nodes.count()
    if n == 0:
        raise EmptyGraphError("the graph has no edge")
    ranks = nodes.select("node", "sends", F.lit(1.0 / n).alias("pr"))
    for _ in range(fixed or most):
        sent = ranks.where("sends").select(F.col("node").alias("src"), "pr")
        inflow = weights.join(sent, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("pr") * F.col("w")).alias("inflow"))
        # One row, part of the round's plan.
        stuck = F.broadcast(ranks.agg(F.coalesce(F.sum(F.when(F.col("sends").isNull(), F.col("pr"))), F.lit(0.0)).alias("stuck")))
        rank = (1 - damping) / n + damping * F.col("stuck") / n + damping * F.coalesce("inflow", F.lit(0.0))
        # From files the planner knows the size of the ranks: while they are small they travel to the weights, which stay in place.
        after = written(ranks.join(inflow, "node", "left").join(stuck, F.lit(True)).select("node", "sends", F.col("pr").alias("was"), rank.alias("pr")), "ranks")
        ranks = after.select("node", "sends", "pr")
        if fixed is None and after.agg(F.sum(F.abs(F.col("pr") - F.col("was"))).alias("change")).first().change < n * tolerance:
            return ranks.select("node", "pr")
    if fixed is None:
        raise RuntimeError(f"PageRank did not settle in {most} rounds")
    return ranks.select("node", "pr")


def ranking(ranks: DataFrame, edges: DataFrame, publications: DataFrame, queue: DataFrame, top: int | None = None, digits: int = 10) -> DataFrame:
    """``(rank, domain, name, pagerank, in_degree, depth)`` by rounded rank, then domain (JN-1, JN-2, SRT-1).

    Ranks of equal-standing nodes differ in the last bits from run to run, so they are rounded before sorting.
    """
    rows = ranks.select(F.col("node").alias("domain"), F.round("pr", digits).alias("pagerank"))
    rows = rows.join(in_degree(edges).withColumnRenamed("node", "domain"), "domain", "left")
    if top is not None:
        rows = rows.orderBy(F.desc("pagerank"), "domain").limit(top)
    rows = rows.join(publications.select("domain", "name"), "domain", "left").join(queue.select("domain", "depth"), "domain", "left")
    place = F.row_number().over(Window.orderBy(F.desc("pagerank"), "domain")) if top is not None else F.lit(None).cast("int")
    return rows.select(place.alias("rank"), "domain", display_name("name", "domain").alias("name"), "pagerank", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), "depth")


def top_nodes(ranks: DataFrame, n: int = DEFAULT_TOP, digits: int = 10) -> DataFrame:
    """``(node, pr)`` of the top ``n``, which is held between 10 and 1000 (SRT-2)."""
    n = max(LEAST_TOP, min(MOST_TOP, n))
    return ranks.select("node", F.round("pr", digits).alias("pr")).orderBy(F.desc("pr"), "node").limit(n)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (JN-18, GR-5)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def induced_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ranks of the full graph with degrees inside the induced subgraph (GR-4)."""
    found = degrees(induced(edges, nodes))
    return nodes.join(found, "node", "left").select("node", "pr", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def publication_list(publications: DataFrame, ranks: DataFrame, edges: DataFrame, digits: int = 10) -> DataFrame:
    """Every publication with rank and degrees, zero if it is not in the graph (JN-3)."""
    rows = publications.select("domain", display_name("name", "domain").alias("name"))
    rows = rows.join(ranks.select(F.col("node").alias("domain"), F.round("pr", digits).alias("pr")), "domain", "left").join(degrees(edges).withColumnRenamed("node", "domain"), "domain", "left")
    return rows.select("domain", "name", F.coalesce("pr", F.lit(0.0)).alias("pagerank"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def bfs(edges: DataFrame, seeds: DataFrame, expands: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)``: breadth-first depth from several seeds ``(node)`` (GR-6).

    Nodes outside ``expands`` (if given) are reached but lead no further.  Each level is one join with the
    frontier and one anti join with what was visited; levels are cut off from each other's lineage.
    """
    frontier = cut(seeds.select("node").distinct().select("node", F.lit(0).alias("depth")))
    visited, depth = frontier, 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        open_nodes = frontier if expands is None else frontier.join(expands.select("node"), "node", "left_semi")
        reached = edges.join(open_nodes.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(visited, "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        visited = cut(visited.union(frontier))
    return visited


def crawl_step(queue: DataFrame, attempts: int | None = None) -> DataFrame:
    """The next frontier: all pending rows of the least depth, by domain, at most ``attempts`` (SRT-3)."""
    pending = queue.where("status = 'pending'")
    least = pending.agg(F.min("depth").alias("least"))
    rows = pending.join(F.broadcast(least), F.col("depth") == F.col("least")).select("domain", "status", "depth")
    return rows if attempts is None else rows.orderBy("depth", "domain").limit(attempts)


def reciprocity(edges: DataFrame) -> DataFrame:
    """``(a, b)`` with ``a < b`` and edges both ways (GR-7): both directions of a pair meet in one group."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b")


def out_degree_histogram(edges: DataFrame) -> DataFrame:
    """``(out_degree, nodes)`` (GR-9)."""
    return degrees(edges).groupBy("out_degree").agg(F.count(F.lit(1)).alias("nodes"))


def weak_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` (GR-8)."""
    return connected_components(edges)


def depth_measures(ranks: DataFrame, depths: DataFrame, digits: int = 10) -> DataFrame:
    """Rank against depth: ``pr / (1 + depth)``, and the place by ``pr`` among the nodes at least as deep, equal ones alike (GR-11).

    A node's place is one more than the number of nodes at least as deep that rank higher.  Nodes are counted by depth and rounded
    rank before the counts of each depth are summed up in order.
    """
    rows = ranks.select("node", F.round("pr", digits).alias("pr")).join(depths, "node").where("depth IS NOT NULL")
    rows = cut(rows)
    levels = rows.select(F.col("depth").alias("level")).distinct()
    # One row for each node and depth down to its own: it counts at all depths that it is at least as deep as.
    spread = rows.join(F.broadcast(levels), F.col("level") <= F.col("depth"))
    counts = spread.groupBy("level", "pr").agg(F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("level").orderBy(F.desc("pr")).rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(F.col("level").alias("depth"), "pr", (F.coalesce(F.sum("here").over(before), F.lit(0)) + 1).alias("place"))
    return rows.join(places, ["depth", "pr"]).select("node", "depth", "pr", (F.col("pr") / (1 + F.col("depth"))).alias("pr_by_depth"), "place")


def failure_by_kind(queue: DataFrame) -> DataFrame:
    """Failed and all rows and their ratio, by kind of domain: custom (dotted) or platform (GR-12)."""
    kind = F.when(F.col("domain").contains("."), "custom").otherwise("platform")
    counts = queue.groupBy(kind.alias("kind")).agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("domains"))
    return counts.withColumn("ratio", F.col("failed") / F.col("domains"))


def discovery_by_seed(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """``(seed, depth, nodes)``: how many nodes each seed reaches first at each depth (GR-13)."""
    frontier = cut(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier.select("seed", F.col("node").alias("src")), "src").select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(visited, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(frontier)
    return visited.groupBy("seed", "depth").agg(F.count(F.lit(1)).alias("nodes"))


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(node, betweenness)``: shortest-path dependencies from the given source nodes, unnormalised (GR-10).

    With all nodes as sources it is exact; with a sample of them an estimate to be scaled by nodes / sources.  The
    levels of all sources advance together; the dependencies are then added up from the deepest level back.
    """
    levels = [cut(sources.select(F.col("node").alias("source"), "node").distinct().select("source", "node", F.lit(1.0).alias("paths")))]
    visited = levels[0].select("source", "node")
    while True:
        step = edges.where("src <> dst").join(levels[-1].withColumnRenamed("node", "src"), "src").groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        new = cut(step.join(visited, ["source", "node"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
        visited = cut(visited.union(new.select("source", "node")))
    owed, total = None, None
    for near, far in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        far_owed = far.withColumn("owed", F.lit(0.0)) if owed is None else far.join(owed, ["source", "node"], "left").select("source", "node", "paths", F.coalesce("owed", F.lit(0.0)).alias("owed"))
        share = far_owed.select("source", F.col("node").alias("dst"), ((1 + F.col("owed")) / F.col("paths")).alias("share"))
        owed = cut(near.select("source", F.col("node").alias("src"), "paths").join(edges.where("src <> dst"), "src").join(share, ["source", "dst"]).groupBy("source", F.col("src").alias("node")).agg(F.sum(F.col("paths") * F.col("share")).alias("owed")))
        counted = owed.where("source <> node").groupBy("node").agg(F.sum("owed").alias("owed"))
        total = counted if total is None else cut(total.union(counted).groupBy("node").agg(F.sum("owed").alias("owed")))
    nodes = nodes_of(edges)
    if total is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    return nodes.join(total, "node", "left").select("node", F.coalesce("owed", F.lit(0.0)).alias("betweenness"))


def linked_domains(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(domain, pages)``: how many pages link to each absolute host (GR-14)."""
    found = F.regexp_extract_all(html_col, F.lit(r"""(?i)href\s*=\s*["']?https?://([^/?#"'\s>:]+)"""), F.lit(1))
    links = pages.select(F.explode(F.array_distinct(F.transform(found, lambda x: F.lower(x)))).alias("domain"))
    return links.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"))


def link_paths(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(path, links)``: targets of relative links."""
    found = F.regexp_extract_all(html_col, F.lit('href="(/[^"]*)"'), F.lit(1))
    return pages.select(F.explode(found).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("links"))
