"""The registered queries of the analytics operators and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as fn
from loomwork.operators import audit, backfill, classify, comments, constraints, embeddings, graph, layers, merge, neighbours, repair, stats
from loomwork.plans.lineage import cut, fresh_folder, written
from loomwork.plans.views import ctes, view
from loomwork.sinks import snapshots

Query = Callable[[SparkSession, str], DataFrame]

ROUNDS = 20
LABELS = ["culture wars", "economy", "steel", "tin", "other"]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return put


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges_of(view(spark, sf, "recommendations"))


EDGES = ctes("recommendations") + ",\ne AS (SELECT DISTINCT source_domain AS src, target_domain AS dst FROM recommendations WHERE source_domain <> '' AND target_domain <> '')"
NODES = EDGES + ",\nn AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
DEGREES = NODES + ",\nd AS (SELECT node, count(i)::BIGINT AS in_degree, count(o)::BIGINT AS out_degree FROM (SELECT dst AS node, 1 AS i, NULL AS o FROM e UNION ALL SELECT src, NULL, 1 FROM e) GROUP BY node)"
#: Fixed rounds of PageRank: what each node hands to each other is one table, so a round is a join and a sum.
RANKS = (
    NODES
    + f""",
od AS (SELECT src, count(*) AS c FROM e GROUP BY src),
cnt AS (SELECT count(*)::DOUBLE AS n FROM n),
m AS (
  SELECT e.src, e.dst, 1.0::DOUBLE / c AS w FROM e JOIN od ON e.src = od.src
  UNION ALL SELECT a.node, b.node, 1.0::DOUBLE / cnt.n FROM n a, n b, cnt WHERE a.node NOT IN (SELECT src FROM od)
  UNION ALL SELECT node, node, 0.0 FROM n
),
steps(i, node, p) AS (
  SELECT 0, node, 1.0::DOUBLE / cnt.n FROM n, cnt
  UNION ALL
  SELECT s.i + 1, m.dst, (0.15 / max(cnt.n) + 0.85 * sum(s.p * m.w))::DOUBLE
  FROM steps s JOIN m ON s.node = m.src, cnt WHERE s.i < {ROUNDS} GROUP BY s.i, m.dst
),
ranks AS (SELECT node, p FROM steps WHERE i = {ROUNDS})"""
)


def _ranks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = written(_edges(spark, sf), "edges")
    return e, graph.pagerank(e, fixed=ROUNDS)


NAME = "coalesce(nullif(trim(name), ''), {d})"


@_register("pagerank_all", f"WITH RECURSIVE {RANKS} SELECT node AS domain, round(p, 8) AS pagerank FROM ranks")
def pagerank_all(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(spark, sf)[1].select(F.col("node").alias("domain"), F.round("pr", 8).alias("pagerank"))


@_register("pagerank_converged")
def pagerank_converged(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pagerank(cut(_edges(spark, sf))).select(F.col("node").alias("domain"), F.round("pr", 8).alias("pagerank"))


@_register(
    "top_pagerank",
    f"""WITH RECURSIVE {RANKS}, {ctes("publications", "queue")}, din AS (SELECT dst, count(*) c FROM e GROUP BY dst),
top AS (SELECT node, round(p, 8) AS pagerank FROM ranks ORDER BY 2 DESC, 1 LIMIT 50)
SELECT row_number() OVER (ORDER BY t.pagerank DESC, t.node)::INT AS rank, t.node AS domain, {NAME.format(d="t.node")} AS name,
  t.pagerank, coalesce(din.c, 0)::BIGINT AS in_degree, q.depth
FROM top t LEFT JOIN publications pb ON pb.domain = t.node LEFT JOIN queue q ON q.domain = t.node LEFT JOIN din ON din.dst = t.node""",
)
def top_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    e, ranks = _ranks(spark, sf)
    return graph.ranking(ranks, e, view(spark, sf, "publications"), view(spark, sf, "queue"), top=50, digits=8)


@_register("in_degree", f"WITH {EDGES} SELECT dst AS node, count(*)::BIGINT AS in_degree FROM e GROUP BY dst")
def in_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_degree(_edges(spark, sf))


@_register("out_degree", f"WITH {EDGES} SELECT src AS node, count(*)::BIGINT AS out_degree FROM e GROUP BY src")
def out_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.out_degree(_edges(spark, sf))


@_register("degrees", f"WITH {DEGREES} SELECT node, in_degree, out_degree FROM d")
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf))


@_register("out_degree_hist", f"WITH {DEGREES} SELECT out_degree, count(*)::BIGINT AS nodes FROM d GROUP BY out_degree")
def out_degree_hist(spark: SparkSession, sf: str) -> DataFrame:
    return graph.out_degree_histogram(_edges(spark, sf))


@_register("reciprocity", f"WITH {EDGES} SELECT a.src AS a, a.dst AS b FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def reciprocity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reciprocity(_edges(spark, sf))


TOP = RANKS + ",\ntop AS (SELECT node, round(p, 8) AS pr FROM ranks ORDER BY 2 DESC, 1 LIMIT 300),\nie AS (SELECT src, dst FROM e WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top))"


@_register("induced_top300_edges", f"WITH RECURSIVE {TOP} SELECT src, dst FROM ie")
def induced_top300_edges(spark: SparkSession, sf: str) -> DataFrame:
    e, ranks = _ranks(spark, sf)
    return graph.induced(e, graph.top_nodes(ranks, digits=8))


@_register("induced_degrees", f"WITH RECURSIVE {TOP} SELECT node, pr, (SELECT count(*) FROM ie WHERE dst = node)::BIGINT AS in_degree, (SELECT count(*) FROM ie WHERE src = node)::BIGINT AS out_degree FROM top")
def induced_degrees(spark: SparkSession, sf: str) -> DataFrame:
    e, ranks = _ranks(spark, sf)
    return graph.induced_degrees(e, cut(graph.top_nodes(ranks, digits=8)))


@_register(
    "size_scale",
    f"""WITH RECURSIVE {TOP}, g AS (SELECT min(pr) lo, max(pr) hi FROM top)
SELECT node, round(8 + 27 * (pr - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 4) AS size FROM top, g""",
)
def size_scale(spark: SparkSession, sf: str) -> DataFrame:
    top = cut(graph.top_nodes(_ranks(spark, sf)[1], digits=8))
    return stats.sizes(top).select("node", F.round("size", 4).alias("size"))


LISTED = (
    RANKS
    + f""", {ctes("publications")}, din AS (SELECT dst, count(*) c FROM e GROUP BY dst), dout AS (SELECT src, count(*) c FROM e GROUP BY src),
listed AS (SELECT pb.domain, {NAME.format(d="pb.domain")} AS name, coalesce(round(r.p, 8), 0.0) AS pagerank, coalesce(din.c, 0)::BIGINT AS in_degree, coalesce(dout.c, 0)::BIGINT AS out_degree
  FROM publications pb LEFT JOIN ranks r ON r.node = pb.domain LEFT JOIN din ON din.dst = pb.domain LEFT JOIN dout ON dout.src = pb.domain),
points AS (SELECT row_number() OVER (ORDER BY pagerank DESC, domain)::BIGINT AS rank, domain, pagerank FROM listed)"""
)


def _points(spark: SparkSession, sf: str) -> DataFrame:
    e, ranks = _ranks(spark, sf)
    return stats.ranked(cut(graph.publication_list(view(spark, sf, "publications"), ranks, e, digits=8)))


@_register("db_publications", f"WITH RECURSIVE {LISTED} SELECT * FROM listed")
def db_publications(spark: SparkSession, sf: str) -> DataFrame:
    e, ranks = _ranks(spark, sf)
    return graph.publication_list(view(spark, sf, "publications"), ranks, e, digits=8)


@_register("rank_points", f"WITH RECURSIVE {LISTED} SELECT * FROM points")
def rank_points(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf)


@_register("rank_sampled", f"WITH RECURSIVE {LISTED} SELECT * FROM points WHERE rank <= 1000 OR (rank - 1001) % 100 = 0")
def rank_sampled(spark: SparkSession, sf: str) -> DataFrame:
    return stats.chart_sample(_points(spark, sf))


@_register(
    "power_law",
    f"""WITH RECURSIVE {LISTED}, f AS (SELECT count(*) AS n, regr_slope(ln(pagerank), ln(rank)) s, regr_intercept(ln(pagerank), ln(rank)) c, regr_r2(ln(pagerank), ln(rank)) r2 FROM points WHERE pagerank > 0)
SELECT n::BIGINT AS n, round(exp(c), 4) AS c, round(-s, 4) AS alpha, round(r2, 4) AS r_squared FROM f""",
)
def power_law(spark: SparkSession, sf: str) -> DataFrame:
    return stats.power_law(_points(spark, sf)).select("n", *[F.round(c, 4).alias(c) for c in ("c", "alpha", "r_squared")])


BFS = EDGES + ",\nw(node, d) AS (SELECT 'pub0', 0 UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node WHERE w.d < 12)"


@_register("bfs_depth", f"WITH RECURSIVE {BFS} SELECT node, min(d)::INT AS depth FROM w GROUP BY node")
def bfs_depth(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bfs(cut(_edges(spark, sf)), spark.sql("SELECT 'pub0' AS node"))


@_register(
    "weak_components",
    f"""WITH RECURSIVE {EDGES}, u AS (SELECT src a, dst b FROM e UNION SELECT dst, src FROM e),
w(node, root) AS (SELECT a, a FROM (SELECT DISTINCT a FROM u WHERE a IN (SELECT min(a) FROM u)) UNION SELECT u.b, w.root FROM w JOIN u ON u.a = w.node)
SELECT node, root AS component FROM w""",
)
def weak_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.weak_components(_edges(spark, sf))


@_register(
    "depth_vs_pagerank",
    f"""WITH RECURSIVE {RANKS}, {ctes('queue')}, j AS (SELECT r.node, q.depth, round(r.p, 8) AS pr FROM ranks r JOIN queue q ON q.domain = r.node)
SELECT node, depth, pr, pr / (1 + depth) AS pr_by_depth, (SELECT count(*) FROM j b WHERE b.depth >= j.depth AND b.pr > j.pr)::BIGINT + 1 AS place FROM j""",
)
def depth_vs_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    depths = view(spark, sf, "queue").select(F.col("domain").alias("node"), "depth")
    return graph.depth_measures(_ranks(spark, sf)[1], depths, digits=8)


@_register("failed_by_kind", f"WITH {ctes('queue')}, c AS (SELECT CASE WHEN contains(domain, '.') THEN 'custom' ELSE 'platform' END AS kind, count(*) FILTER (status = 'failed')::BIGINT AS failed, count(*)::BIGINT AS domains FROM (SELECT domain, status FROM queue UNION ALL SELECT domain || '.org', CASE WHEN depth % 3 = 0 THEN 'failed' ELSE status END FROM queue WHERE depth > 1) GROUP BY 1) SELECT kind, failed, domains, failed / domains AS ratio FROM c")
def failed_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    queue = view(spark, sf, "queue")
    custom = queue.where("depth > 1").withColumns({"domain": F.concat("domain", F.lit(".org")), "status": F.when(F.col("depth") % 3 == 0, "failed").otherwise(F.col("status"))})
    return graph.failure_by_kind(queue.unionByName(custom))


@_register("discovery_by_seed")
def discovery_by_seed(spark: SparkSession, sf: str) -> DataFrame:
    return graph.discovery_by_seed(cut(_edges(spark, sf)), spark.sql("SELECT explode(array('pub0', 'pub1', 'pub500')) AS node"))


@_register("betweenness_sampled")
def betweenness_sampled(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.betweenness(cut(_edges(spark, sf)), spark.sql("SELECT explode(array('pub0', 'pub1', 'pub500')) AS node"))
    return found.select("node", F.round("betweenness", 6).alias("betweenness"))


HREF = """regexp_extract_all(html, 'href="(/[^"]*)"', 1)"""


@_register("page_link_paths", f"SELECT path, count(*)::BIGINT AS links FROM (SELECT unnest({HREF}) AS path FROM pages) GROUP BY path")
def page_link_paths(spark: SparkSession, sf: str) -> DataFrame:
    return graph.link_paths(spark.read.parquet(f"{sf}/pages.parquet"))


NORMAL = "lower(split_part(split_part(replace(replace({c}, 'https://', ''), 'http://', ''), '/', 1), ':', 1))"
NORMALIZED = f"CASE WHEN ends_with({NORMAL}, '.substack.com') THEN split_part({NORMAL}, '.', 1) ELSE {NORMAL} END"


@_register("page_host_frequency", f"SELECT {NORMALIZED.format(c='url')} AS domain, count(*)::BIGINT AS pages FROM pages GROUP BY 1")
def page_host_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").groupBy(fn.normalize_domain("url").alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


# Layers ------------------------------------------------------------------------------------------

LAYERS = ctes("queue") + ", s AS (SELECT depth, count(*)::BIGINT AS l FROM queue WHERE depth IS NOT NULL GROUP BY depth)"


@_register(
    "layer_stats",
    f"""WITH {LAYERS}, t AS (SELECT depth, l, (sum(l) OVER (ORDER BY depth))::BIGINT AS a, l - lag(l) OVER (ORDER BY depth) AS l1,
  round(l / nullif(lag(l) OVER (ORDER BY depth), 0), 6) AS r, lead(depth) OVER (ORDER BY depth) IS NULL AS last FROM s)
SELECT depth, l, a, l1, l1 - lag(l1) OVER (ORDER BY depth) AS l2, r, last FROM t""",
)
def layer_stats(spark: SparkSession, sf: str) -> DataFrame:
    return layers.layer_stats(view(spark, sf, "queue"))


@_register("layer_peak", f"WITH {LAYERS} SELECT depth, l FROM s ORDER BY l DESC, depth LIMIT 1")
def layer_peak(spark: SparkSession, sf: str) -> DataFrame:
    return layers.peak(view(spark, sf, "queue"))


@_register(
    "layer_progress",
    f"""WITH {LAYERS}, w AS (SELECT coalesce((SELECT min(depth) FROM queue WHERE status = 'pending'), (SELECT max(depth) FROM s)) AS depth)
SELECT depth, count(*) FILTER (status IN ('crawled', 'failed'))::BIGINT AS processed, count(*)::BIGINT AS l FROM queue JOIN w USING (depth) GROUP BY depth""",
)
def layer_progress(spark: SparkSession, sf: str) -> DataFrame:
    return layers.progress(view(spark, sf, "queue"))


@_register("layer_saturation", f"WITH {LAYERS} SELECT depth, round((sum(l) OVER (ORDER BY depth)) / (SELECT sum(l) FROM s), 6) AS share FROM s")
def layer_saturation(spark: SparkSession, sf: str) -> DataFrame:
    return layers.saturation(view(spark, sf, "queue"))


@_register("queue_status", f"WITH {ctes('queue')} SELECT status, count(*)::BIGINT AS n FROM queue GROUP BY status")
def queue_status(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "queue").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


PUBLICATION_URL = "CASE WHEN contains({d}, '.') AND NOT contains({d}, 'substack.com') THEN 'https://' || {d} ELSE 'https://' || replace({d}, '.substack.com', '') || '.substack.com' END"


@_register("failed_list", f"WITH {ctes('queue')} SELECT domain, depth, {PUBLICATION_URL.format(d='domain')} AS url FROM queue WHERE status = 'failed'")
def failed_list(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "queue").where("status = 'failed'").select("domain", "depth", fn.publication_url("domain").alias("url"))


@_register("crawl_frontier", f"WITH {ctes('queue')} SELECT domain, status, depth FROM queue WHERE status = 'pending' AND depth = (SELECT min(depth) FROM queue WHERE status = 'pending')")
def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return graph.crawl_step(view(spark, sf, "queue"))


@_register("table_counts", f"WITH {ctes('recommendations', 'publications', 'queue', 'posts', 'comments', 'users')} " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS n FROM {t}" for t in ("recommendations", "publications", "queue", "posts", "comments", "users")))
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [view(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("recommendations", "publications", "queue", "posts", "comments", "users")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Functions ---------------------------------------------------------------------------------------


@_register("normalize_domain", f"SELECT page_id, {NORMALIZED.format(c='url')} AS domain FROM pages")
def normalize_domain(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", fn.normalize_domain("url").alias("domain"))


@_register("publication_url", f"SELECT page_id, {PUBLICATION_URL.format(d=f'({NORMALIZED})').format(c='url')} AS url FROM pages")
def publication_url(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", fn.publication_url(fn.normalize_domain("url")).alias("url"))


@_register("display_name", f"WITH {ctes('publications')} SELECT domain, {NAME.format(d='domain')} AS name FROM publications")
def display_name(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "publications").select("domain", fn.display_name("name", "domain").alias("name"))


LABEL = f"ltrim(CASE WHEN starts_with({NORMALIZED}, 'www.') THEN substr({NORMALIZED}, 5) ELSE {NORMALIZED} END, '.')".format(c="url")


@_register("graph_labels", f"SELECT page_id, CASE WHEN length({LABEL}) > 27 THEN substr({LABEL}, 1, 25) || '..' ELSE {LABEL} END AS label FROM pages")
def graph_labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", fn.graph_label(fn.normalize_domain("url")).alias("label"))


CLEAN = "trim(regexp_replace(coalesce(text, ''), '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))"


@_register("embedding_source_text", f"SELECT doc_id, length({CLEAN})::INT AS n, sha256({CLEAN}) AS source_hash FROM documents")
def embedding_source_text(spark: SparkSession, sf: str) -> DataFrame:
    clean = fn.collapsed(F.coalesce("text", F.lit("")))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.length(clean).alias("n"), fn.content_hash(clean).alias("source_hash"))


@_register("html_escaped", """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM pages""")
def html_escaped(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", fn.html_escaped("html").alias("html"))


@_register("topic_snap", "SELECT p_partkey, CASE " + " ".join(f"WHEN contains('{t}', lower(split_part(p_type, ' ', 3))) OR contains(lower(split_part(p_type, ' ', 3)), '{t}') THEN '{t}'" for t in LABELS) + " ELSE split_part(p_type, ' ', 3) END AS topic FROM part WHERE split_part(p_type, ' ', 3) <> '' UNION ALL SELECT p_partkey, 'other' FROM part WHERE split_part(p_type, ' ', 3) = ''")
def topic_snap(spark: SparkSession, sf: str) -> DataFrame:
    word = F.split_part("p_type", F.lit(" "), F.lit(3))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", fn.snapped_topic(word, LABELS).alias("topic"))


@_register("redacted_json", "SELECT event_id, props AS props FROM events")
def redacted_json(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", fn.redacted("props").alias("props"))


# Audit and repair --------------------------------------------------------------------------------

_TABLES = ("recommendations", "publications", "queue", "posts", "comments", "users")


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {t: view(spark, sf, t) for t in _TABLES}


def _b(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


def _count(condition: str, table: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {condition}"


def _dups(table: str, keys: str, condition: str = "true") -> str:
    return f"SELECT count(*) FROM (SELECT 1 FROM {table} WHERE {condition} GROUP BY {keys} HAVING count(*) > 1)"


def _lost(table: str, key: str, parent: str, parent_key: str, condition: str = "true") -> str:
    return f"SELECT count(*) FROM {table} c WHERE {condition} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_key} = c.{key})"


def _undated(c: str, table: str, optional: bool = False) -> str:
    return _count(f"NOT {_b(c)} AND {c} NOT LIKE '____-__-__%'" if optional else f"{_b(c)} OR {c} NOT LIKE '____-__-__%'", table)


AUDIT_SQL = {
    "publications_null_domain": _count(_b("domain"), "publications"),
    "publications_duplicate_domain": _dups("publications", "domain"),
    "recommendations_null_endpoints": _count("source_domain IS NULL OR target_domain IS NULL", "recommendations"),
    "recommendations_duplicate_edges": _dups("recommendations", "source_domain, target_domain"),
    "queue_null_domain": _count(_b("domain"), "queue"),
    "queue_invalid_status": _count("status IS NULL OR status NOT IN ('pending', 'crawled', 'failed')", "queue"),
    "queue_duplicate_domain": _dups("queue", "domain"),
    "recommendations_orphan_source": _lost("recommendations", "source_domain", "publications", "domain"),
    "queue_crawled_without_publication": _lost("queue", "domain", "publications", "domain", "status = 'crawled'"),
    "queue_failed_with_publication": _count("status = 'failed' AND domain IN (SELECT domain FROM publications)", "queue"),
    "users_duplicate_external_user_id": _dups("users", "external_user_id", f"NOT {_b('external_user_id')}"),
    "posts_duplicate_external_post_id": _dups("posts", "external_post_id", f"NOT {_b('external_post_id')}"),
    "comments_duplicate_external_comment_id": _dups("comments", "external_comment_id", f"NOT {_b('external_comment_id')}"),
    "comments_orphan_post_id": _lost("comments", "post_id", "posts", "id", "post_id IS NOT NULL"),
    "comments_orphan_user_id": _lost("comments", "user_id", "users", "id", "user_id IS NOT NULL"),
    "comments_orphan_parent_comment_id": _lost("comments", "parent_comment_id", "comments", "id", "parent_comment_id IS NOT NULL"),
    "comments_broken_parent_external_comment_id": _lost("comments", "parent_external_comment_id", "comments", "external_comment_id", f"NOT {_b('parent_external_comment_id')}"),
    "users_invalid_first_seen": _undated("first_seen", "users"),
    "users_invalid_last_seen": _undated("last_seen", "users"),
    "posts_invalid_first_seen": _undated("first_seen", "posts"),
    "posts_invalid_last_seen": _undated("last_seen", "posts"),
    "posts_invalid_published_at": _undated("published_at", "posts", True),
    "comments_invalid_first_seen": _undated("first_seen", "comments"),
    "comments_invalid_last_seen": _undated("last_seen", "comments"),
    "comments_invalid_commented_at": _undated("commented_at", "comments", True),
}
ALL_TABLES = ctes(*_TABLES)


@_register("audit_all", f"WITH {ALL_TABLES} " + " UNION ALL ".join(f"SELECT {k}::INT AS position, '{n}' AS \"check\", ({q})::BIGINT AS count" for k, (n, q) in enumerate(AUDIT_SQL.items())))
def audit_all(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit(spark, _tables(spark, sf))


#: What is wrong in each table: repeated rows, blank, unknown and undated values, keys of nothing.
DAMAGED = {
    "publications": "SELECT * FROM publications UNION ALL SELECT id, substack_id, name, CASE WHEN id % 2 = 0 THEN domain WHEN id % 4 = 1 THEN ' ' END, description, first_seen FROM publications WHERE id % 9 = 1",
    "recommendations": "SELECT * FROM recommendations UNION ALL SELECT source_domain, target_domain FROM recommendations WHERE target_domain LIKE '%7' UNION ALL SELECT CAST(NULL AS VARCHAR(9)), target_domain FROM recommendations WHERE target_domain LIKE '%91'",
    "queue": "SELECT * FROM queue UNION ALL SELECT CASE WHEN depth % 3 = 0 THEN domain ELSE '' END, CASE WHEN depth % 2 = 0 THEN 'odd' END, depth FROM queue WHERE depth > 2",
    "posts": "SELECT * FROM posts UNION ALL SELECT * FROM posts WHERE id % 6 = 0",
    "comments": "SELECT * FROM comments WHERE id % 700 <> 1 UNION ALL SELECT id, external_comment_id, -post_id - 1, -user_id - 1, -id, parent_external_comment_id, body, role, commented_at, '2026', last_seen FROM comments WHERE id % 8 = 3",
    "users": "SELECT * FROM users UNION ALL SELECT id, external_user_id, name, handle, profile_url, first_seen, '' FROM users WHERE id % 5 = 2",
}


@_register(
    "audit_of_damaged",
    f"WITH {ALL_TABLES}, " + ", ".join(f"{t}_d AS ({sql})" for t, sql in DAMAGED.items()) + " "
    + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", ({re.sub('(?<![.])\\b(' + '|'.join(_TABLES) + ')\\b', lambda m: m[1] + '_d', q)})::BIGINT AS count" for n, q in AUDIT_SQL.items()),
)
def audit_of_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """All checks over tables in which each of them finds something."""
    tables = {t: spark.sql(re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql), **{t: view(spark, sf, t)}) for t, sql in DAMAGED.items()}
    return audit.audit(spark, tables).select("check", "count")


def _one_check(check: audit.Check) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return audit.audit(spark, {t: view(spark, sf, t) for t in check.needs}, (check,)).select("check", "count")

    return run


for _check in audit.CHECKS:
    _register(f"audit_{_check.name}", f"WITH {ALL_TABLES} SELECT '{_check.name}' AS \"check\", ({AUDIT_SQL[_check.name]})::BIGINT AS count")(_one_check(_check))

REPAIRED = (
    ALL_TABLES
    + f""",
p1 AS (SELECT domain FROM publications UNION ALL SELECT DISTINCT source_domain FROM recommendations WHERE NOT {_b("source_domain")} AND source_domain NOT IN (SELECT domain FROM publications)),
p2 AS (SELECT domain FROM p1 UNION ALL SELECT DISTINCT domain FROM queue WHERE status = 'crawled' AND domain NOT IN (SELECT domain FROM p1)),
c1 AS (SELECT c.id, c.external_comment_id, c.parent_comment_id, coalesce(nullif(CASE WHEN trim(c.parent_external_comment_id) = '' THEN NULL ELSE c.parent_external_comment_id END, ''), p.external_comment_id) AS parent_external_comment_id FROM comments c LEFT JOIN comments p ON p.id = c.parent_comment_id),
c2 AS (SELECT c.id, coalesce(p.id, c.parent_comment_id) AS parent_comment_id FROM c1 c LEFT JOIN (SELECT external_comment_id, min(id) AS id FROM c1 GROUP BY 1) p ON p.external_comment_id = c.parent_external_comment_id)"""
)


@_register("repair_publications", f"WITH {REPAIRED} SELECT domain FROM p2")
def repair_publications(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repaired(_tables(spark, sf))["publications"].select("domain")


@_register("repair_queue", f"WITH {REPAIRED} SELECT domain, CASE WHEN status = 'failed' AND domain IN (SELECT domain FROM p2) THEN 'crawled' ELSE status END AS status, depth FROM queue")
def repair_queue(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repaired(_tables(spark, sf))["queue"].select("domain", "status", "depth")


@_register("repair_parent_external", f"WITH {REPAIRED} SELECT id, parent_external_comment_id FROM c1")
def repair_parent_external(spark: SparkSession, sf: str) -> DataFrame:
    return merge.fill_parent_external(view(spark, sf, "comments")).select("id", "parent_external_comment_id")


@_register("repair_parent_links", f"WITH {REPAIRED} SELECT id, parent_comment_id FROM c2")
def repair_parent_links(spark: SparkSession, sf: str) -> DataFrame:
    return repair.linked_parents(merge.fill_parent_external(view(spark, sf, "comments"))).select("id", "parent_comment_id")


# Merges ------------------------------------------------------------------------------------------


@_register("upsert_queue_min_depth", f"WITH {ctes('queue', 'recommendations')}, i AS (SELECT target_domain AS domain, min(2)::INT AS depth FROM recommendations GROUP BY 1) SELECT coalesce(q.domain, i.domain) AS domain, coalesce(q.status, 'pending') AS status, least(coalesce(q.depth, i.depth), coalesce(i.depth, q.depth)) AS depth, CASE WHEN i.domain IS NULL THEN NULL WHEN q.domain IS NULL THEN 'created' WHEN i.depth < q.depth THEN 'updated' ELSE 'unchanged' END AS action FROM queue q FULL JOIN i ON i.domain = q.domain")
def upsert_queue_min_depth(spark: SparkSession, sf: str) -> DataFrame:
    incoming = view(spark, sf, "recommendations").select(F.col("target_domain").alias("domain"), F.lit(2).alias("depth"))
    return merge.upsert_queue(view(spark, sf, "queue"), incoming)


@_register("upsert_publications", f"WITH {ctes('publications')}, i AS (SELECT domain, CASE WHEN id % 4 = 0 THEN '' ELSE 'new ' || domain END AS name FROM publications WHERE id % 2 = 0) SELECT p.domain, coalesce(nullif(i.name, ''), p.name) AS name, CASE WHEN i.domain IS NULL THEN NULL WHEN i.name <> '' AND i.name IS DISTINCT FROM p.name THEN 'updated' ELSE 'unchanged' END AS action FROM publications p LEFT JOIN i ON i.domain = p.domain")
def upsert_publications(spark: SparkSession, sf: str) -> DataFrame:
    current = view(spark, sf, "publications")
    incoming = current.where("id % 2 = 0").select("domain", F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("new "), "domain")).alias("name"))
    return merge.upsert_publications(current, incoming).select("domain", "name", "action")


@_register("upsert_users_actions", f"WITH {ctes('users')} SELECT 'created' AS action, count(*)::BIGINT AS rows FROM users WHERE id % 3 = 0 HAVING count(*) > 0 UNION ALL SELECT CASE WHEN id % 2 = 0 THEN 'updated' ELSE 'unchanged' END, count(*)::BIGINT FROM users WHERE id % 3 <> 0 GROUP BY 1")
def upsert_users_actions(spark: SparkSession, sf: str) -> DataFrame:
    users = view(spark, sf, "users").select("id", "external_user_id", "name", "handle", "profile_url", "first_seen", "last_seen")
    current = users.where("id % 3 <> 0")
    incoming = users.select(F.col("id").alias("arrival"), "external_user_id", F.when(F.col("id") % 2 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), "handle", "profile_url", "first_seen", F.lit("2026-05-05").alias("last_seen"))
    return merge.action_counts(merge.upsert_by_keys(current, incoming, [["external_user_id"]], merge.USER_RULES))


@_register("topic_upsert", f"WITH {ctes('publications')} SELECT domain, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'old' END AS topic_llm, CASE WHEN id % 3 <> 0 THEN 'c' END AS topic_cluster FROM publications WHERE id % 2 = 0 OR id % 3 <> 0")
def topic_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "publications")
    current = rows.where("id % 3 <> 0").select("domain", F.lit("old").alias("topic_llm"), F.lit("c").alias("topic_cluster"))
    return merge.upsert_topics(current, rows.where("id % 2 = 0").select("domain", F.lit("new").alias("topic_llm")))


@_register("publications_to_label", f"WITH {ctes('publications')} SELECT domain, name, description FROM publications ORDER BY domain")
def publications_to_label(spark: SparkSession, sf: str) -> DataFrame:
    return classify.publications_to_label(view(spark, sf, "publications"))


@_register("unfailed_rows", f"WITH {ctes('queue')} SELECT domain, '2026-03-01' AS unfailed_at FROM queue WHERE status = 'failed' AND depth % 2 = 0 ORDER BY domain")
def unfailed_rows(spark: SparkSession, sf: str) -> DataFrame:
    queue = view(spark, sf, "queue")
    return backfill.unfailed_rows(backfill.retried(queue, queue.where("depth % 2 = 0"), "2026-03-01")[1])


# Comments ----------------------------------------------------------------------------------------


@_register("comment_dedupe", f"WITH {ctes('comments')} SELECT id, external_comment_id FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY id) AS k FROM comments) WHERE k = 1")
def comment_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "comments")
    bare = rows.select("id", F.lit("").alias("external_comment_id"), F.lit(None).cast("string").alias("external_user_id"), F.lit(None).cast("string").alias("parent_external_comment_id"), F.lit(None).cast("string").alias("commented_at"), "body", F.col("external_comment_id").alias("kept"))
    return comments.deduped(bare, ["id"]).select("id", F.col("kept").alias("external_comment_id"))


@_register(
    "comment_thread_depth",
    f"""WITH RECURSIVE {ctes("comments")}, t(external_comment_id, depth) AS (
  SELECT c.external_comment_id, 0 FROM comments c WHERE c.parent_external_comment_id IS NULL OR c.parent_external_comment_id NOT IN (SELECT external_comment_id FROM comments)
  UNION ALL SELECT c.external_comment_id, t.depth + 1 FROM t JOIN comments c ON c.parent_external_comment_id = t.external_comment_id)
SELECT external_comment_id, depth::INT AS depth FROM t""",
)
def comment_thread_depth(spark: SparkSession, sf: str) -> DataFrame:
    return comments.thread_depth(view(spark, sf, "comments"))


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as a comment tree: the second turn under the first, the third under the second, the rest at the root."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    node = lambda t, kids: F.struct(t["turn"].alias("id"), t["text"].alias("body"), F.struct(t["role"].alias("id"), t["role"].alias("name")).alias("user"), kids.alias("children"))
    flat = "array<struct<id:bigint,body:string,user:struct<id:string,name:string>>>"
    leaf = lambda k: F.when(F.size("t") > k, F.transform(F.slice("t", k + 1, 1), lambda t: F.struct(t["turn"].alias("id"), t["text"].alias("body"), F.struct(t["role"].alias("id"), t["role"].alias("name")).alias("user")))).otherwise(F.array().cast(flat))
    second = F.when(F.size("t") > 1, F.transform(F.slice("t", 2, 1), lambda t: node(t, leaf(2)))).otherwise(F.array())
    first = F.transform(F.slice("t", 1, 1), lambda t: node(t, second))
    rest = F.transform(F.slice("t", F.lit(4), F.size("t")), lambda t: F.struct(t["turn"].alias("id"), t["text"].alias("body"), F.struct(t["role"].alias("id"), t["role"].alias("name")).alias("user")))
    payload = F.to_json(F.struct(first.alias("comments")))
    more = F.to_json(F.struct(rest.alias("items")))
    return rows.select(F.col("conv_id").alias("payload_id"), payload.alias("payload")).union(rows.select("conv_id", more))


@_register(
    "flatten_tree",
    "SELECT conv_id AS payload_id, CAST(turn AS VARCHAR) AS external_comment_id, CASE WHEN k IN (2, 3) THEN CAST(nullif(prev, 0) AS VARCHAR) END AS parent_external_comment_id, text AS body, role AS external_user_id FROM (SELECT *, row_number() OVER w AS k, lag(turn) OVER w AS prev FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE turn <> 0"
    " UNION ALL SELECT conv_id, NULL, NULL, text, role FROM conversations WHERE turn = 0",
)
def flatten_tree(spark: SparkSession, sf: str) -> DataFrame:
    found = comments.comments_of(_trees(spark, sf))
    return found.select("payload_id", "external_comment_id", "parent_external_comment_id", "body", "external_user_id")


# Classification, embeddings, backfill ------------------------------------------------------------


@_register("ui_guess_counts", "SELECT n_name AS source, 3::BIGINT AS recommendations, 1::BIGINT AS person, 1::BIGINT AS publication, 1::BIGINT AS \"unknown\" FROM nation UNION ALL SELECT NULL, 75::BIGINT, 25::BIGINT, 25::BIGINT, 25::BIGINT")
def ui_guess_counts(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.explode(F.array(F.lit("true"), F.lit("false"), F.lit(None).cast("string"), F.lit("nowhere")))
    rows = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("source"), kinds.alias("kind"))
    inner = F.concat(F.lit('{"recommendedPublication":{'), F.when(F.col("kind") == "nowhere", "").otherwise(F.concat(F.lit('"subdomain":"'), "source", F.lit('"'), F.coalesce(F.concat(F.lit(',"is_personal_mode":'), "kind"), F.lit("")))), F.lit("}}"))
    # In the row of kind null nothing is said about the mode; "nowhere" has no address and is dropped.
    payload = F.coalesce(inner, F.concat(F.lit('{"recommendedPublication":{"subdomain":"'), "source", F.lit('"}}')))
    return classify.guess_counts(classify.recommendations_of(rows.select("source", payload.alias("payload"))))


PROBES = "SELECT page_id, url AS homepage_url, CASE WHEN page_id % 5 = 0 THEN 200 ELSE 404 END AS homepage_status, CASE WHEN page_id % 7 = 0 THEN 200 ELSE 500 END AS archive_status, CASE WHEN page_id % 11 = 0 THEN 200 ELSE 404 END AS publication_status, CASE WHEN page_id % 13 = 0 THEN 'https://elsewhere.example/' ELSE url END AS homepage_final_url, url AS archive_final_url, CAST(NULL AS VARCHAR(9)) AS publication_final_url, CASE WHEN page_id % 3 = 0 THEN 'timeout' ELSE '' END AS homepage_error, '' AS archive_error, CAST(NULL AS VARCHAR(9)) AS publication_error FROM {pages}"


@_register("probe_classify", f"SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'redirected_elsewhere' WHEN publication_status = 200 THEN 'publication_api_ok' WHEN archive_status = 200 THEN 'archive_ok' WHEN homepage_status = 200 THEN 'homepage_up' WHEN homepage_error <> '' THEN 'network_error' ELSE 'crawler_still_failed' END AS class FROM ({PROBES.format(pages='pages')})")
def probe_classify(spark: SparkSession, sf: str) -> DataFrame:
    probes = spark.sql(PROBES, pages=spark.read.parquet(f"{sf}/pages.parquet"))
    return probes.select("page_id", classify.probe_class().alias("class"))


@_register("embedding_candidates", f"SELECT doc_id AS source_id, sha256({CLEAN}) AS source_hash FROM documents WHERE {CLEAN} <> '' AND doc_id % 3 <> 0")
def embedding_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("source_id"), "text")
    clean = rows.where("source_id % 3 = 0").select(F.lit("documents").alias("source_table"), "source_id", fn.content_hash(fn.collapsed("text")).alias("source_hash"), F.lit("m").alias("model"))
    return embeddings.candidates(rows, clean, "documents", "m").select("source_id", "source_hash")


@_register(
    "embedding_topk",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS cosine FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, k::INT AS rank, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS k FROM p) WHERE k <= 5""",
)
def embedding_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours.nearest(v, v.where("vec_id % 50 = 0"))


STATUS = "SELECT domain, CASE WHEN depth % 4 = 0 THEN 'succeeded' WHEN depth % 4 = 1 THEN 'pending' WHEN depth % 4 = 2 THEN 'failed' ELSE 'running' END AS status, depth % 5 AS attempts, CAST(NULL AS VARCHAR(30)) AS last_error, '2026-01-01' AS updated_at FROM queue"


def _status(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(STATUS.replace("FROM queue", "FROM {queue}"), queue=view(spark, sf, "queue"))


TWICE = "pubs AS (SELECT * FROM publications UNION ALL SELECT * FROM publications WHERE id % 3 = 0), odd AS (SELECT domain, CASE WHEN depth = 3 THEN 'odd' WHEN depth <> 4 THEN status END AS status FROM queue)"


@_register(
    "constraint_violations",
    f"WITH {ctes('publications', 'queue')}, {TWICE}, "
    + "v AS ("
    + " UNION ALL ".join(f"SELECT 'publications' AS table_name, 'unique {c}' AS rule, count({c}) - count(DISTINCT {c}) AS n FROM pubs" for c in ("id", "substack_id", "domain"))
    + " UNION ALL SELECT 'queue', 'unique domain', count(domain) - count(DISTINCT domain) FROM odd"
    + " UNION ALL SELECT 'queue', 'required status', count(*) FROM odd WHERE status IS NULL"
    + " UNION ALL SELECT 'queue', 'allowed status', count(*) FROM odd WHERE status NOT IN ('pending', 'crawled', 'failed')"
    + ") SELECT table_name, rule, n::BIGINT AS n FROM v WHERE n > 0",
)
def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    p, q = view(spark, sf, "publications"), view(spark, sf, "queue")
    odd = q.withColumn("status", F.when(F.col("depth") == 3, "odd").when(F.col("depth") != 4, F.col("status")))
    found = constraints.violations({"publications": p.union(p.where("id % 3 = 0")), "queue": odd})
    return found.select(F.col("table").alias("table_name"), "rule", F.col("rows").alias("n"))


@_register(
    "references_cleared",
    f"WITH {ctes('comments', 'posts', 'users')} SELECT id, CASE WHEN post_id IN (SELECT id FROM posts) THEN post_id END AS post_id, "
    "CASE WHEN user_id IN (SELECT id FROM users) THEN user_id END AS user_id, CASE WHEN parent_comment_id IN (SELECT id FROM comments) THEN parent_comment_id END AS parent_comment_id FROM comments",
)
def references_cleared(spark: SparkSession, sf: str) -> DataFrame:
    tables = {n: view(spark, sf, n) for n in ("comments", "posts", "users")}
    return constraints.references_cleared(tables)["comments"].select("id", "post_id", "user_id", "parent_comment_id")


LOOKUPS = "SELECT id AS probe, CASE WHEN id % 3 = 0 THEN external_user_id WHEN id % 3 = 1 THEN '' END AS external_user_id, CASE WHEN id % 3 <> 2 THEN profile_url END AS profile_url, CASE WHEN id % 7 = 0 THEN 'nobody' ELSE handle END AS handle FROM users"


@_register(
    "ordered_lookup",
    f"WITH {ctes('users')}, p AS ({LOOKUPS}) SELECT p.probe, coalesce(a.id, b.id, c.id) AS found_id FROM p "
    + " ".join(f"LEFT JOIN (SELECT {k}, min(id) AS id FROM users GROUP BY {k}) {t} ON {t}.{k} = p.{k}" for t, k in (("a", "external_user_id"), ("b", "profile_url"), ("c", "handle"))),
)
def ordered_lookup(spark: SparkSession, sf: str) -> DataFrame:
    users = view(spark, sf, "users")
    probes = spark.sql(LOOKUPS.replace("FROM users", "FROM {users}"), users=users)
    found = merge.ordered_lookup(probes, users, [["external_user_id"], ["profile_url"], ["handle"]], "probe")
    return found.select("probe", F.col("found.id").alias("found_id"))


@_register("backfill_targets", f"WITH {ctes('publications', 'queue')}, s AS ({STATUS}) SELECT p.domain, p.substack_id, coalesce(s.attempts, 0)::INT AS attempts, coalesce(s.updated_at, p.first_seen, '') AS touched FROM publications p LEFT JOIN s ON s.domain = p.domain WHERE (s.status IS NULL OR s.status IN ('pending', 'failed')) AND coalesce(s.attempts, 0) < 3")
def backfill_targets(spark: SparkSession, sf: str) -> DataFrame:
    return backfill.targets(view(spark, sf, "publications"), _status(spark, sf))


@_register("backfill_summary", f"WITH {ctes('queue')}, s AS ({STATUS}) SELECT status, count(*)::BIGINT AS domains FROM s GROUP BY status")
def backfill_summary(spark: SparkSession, sf: str) -> DataFrame:
    return backfill.summary(_status(spark, sf))


# Versions of tables -------------------------------------------------------------------------------


def _next_queue(queue: DataFrame) -> DataFrame:
    """The queue some time later: rows done, rows gone, rows added."""
    later = queue.where("depth % 7 <> 6").withColumn("status", F.when((F.col("status") == "pending") & (F.col("depth") % 2 == 0), "crawled").otherwise(F.col("status")))
    added = queue.where("depth % 5 = 1").select(F.concat(F.lit("new-"), "domain").alias("domain"), F.lit("pending").alias("status"), (F.col("depth") + 1).alias("depth"))
    return later.unionByName(added)


@_register(
    "snapshot_changes",
    f"""WITH {ctes('queue')}, later AS (
  SELECT domain, CASE WHEN status = 'pending' AND depth % 2 = 0 THEN 'crawled' ELSE status END AS status, depth FROM queue WHERE depth % 7 <> 6
  UNION ALL SELECT 'new-' || domain, 'pending', depth + 1 FROM queue WHERE depth % 5 = 1)
SELECT coalesce(a.domain, b.domain) AS domain, CASE WHEN a.domain IS NULL THEN 'added' WHEN b.domain IS NULL THEN 'removed' ELSE 'changed' END AS change, a.status AS old_status, b.status AS new_status
FROM queue a FULL JOIN later b ON a.domain = b.domain WHERE a.domain IS NULL OR b.domain IS NULL OR a.status IS DISTINCT FROM b.status OR a.depth IS DISTINCT FROM b.depth""",
)
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a store, read while a third is committed over them."""
    queue = view(spark, sf, "queue")
    store = snapshots.SnapshotStore(fresh_folder(spark, "store"), keep=1)
    first = store.commit({"queue": queue})
    with store.reader(spark, first) as before:
        store.commit({"queue": _next_queue(before.table("queue"))}, expected=first)
        with store.reader(spark) as after:
            store.commit({"queue": queue.where("depth < 0")})
            changes = snapshots.changes_between(before.table("queue"), after.table("queue"), ["domain"])
            return written(changes.select("domain", "change", F.col("old.status").alias("old_status"), F.col("new.status").alias("new_status")))


@_register(
    "bucketed_merge",
    f"""WITH {ctes('comments')}, first AS (SELECT * FROM comments WHERE id % 3 <> 0), again AS (SELECT external_comment_id, CASE WHEN id % 2 = 0 THEN body || '!' ELSE body END AS body FROM comments WHERE id % 5 <> 4)
SELECT '1 first' AS run, count(*)::BIGINT AS created, 0::BIGINT AS updated, 0::BIGINT AS unchanged FROM first
UNION ALL SELECT '2 same', 0, 0, count(*) FROM first
UNION ALL SELECT '3 later', count(*) FILTER (f.id IS NULL), count(*) FILTER (f.id IS NOT NULL AND f.body IS DISTINCT FROM coalesce(nullif(a.body, ''), f.body)), count(*) FILTER (f.id IS NOT NULL AND f.body IS NOT DISTINCT FROM coalesce(nullif(a.body, ''), f.body))
FROM again a LEFT JOIN first f ON f.external_comment_id = a.external_comment_id""",
)
def bucketed_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Rows created, updated and unchanged when comments are merged into a bucketed table, the same ones again, and later ones."""
    comments_ = view(spark, sf, "comments").select("id", "external_comment_id", "body")
    store = snapshots.SnapshotStore(fresh_folder(spark, "store"))
    body = F.when(F.col("id") % 2 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    first, later = comments_.where("id % 3 <> 0"), comments_.where("id % 5 <> 4").withColumn("body", body)
    put = lambda rows: store.merge("comments", rows.select("external_comment_id", "body"), ["external_comment_id"], {"body": merge.prefer_new}, "external_comment_id string, body string", buckets=16)
    runs = [(name, *put(rows).values()) for name, rows in (("1 first", first), ("2 same", first), ("3 later", later))]
    return spark.createDataFrame(runs, "run string, created long, updated long, unchanged long")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
