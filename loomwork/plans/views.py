"""The model's tables derived from the star-schema test tables.

No crawled data is at hand, so each model table is a view over whole test tables.  A view is one SQL text in the
dialect that Spark and DuckDB share, with ``{table}`` for the tables it reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Number of network nodes that keys are folded onto.
NODES = 1000

#: Sources skip every node whose number is 3 modulo 7, which leaves dangling nodes; cubing skews the in-degrees.
RECOMMENDATIONS = """
SELECT DISTINCT
  concat('pub', CAST(CASE WHEN s % 7 = 3 THEN s - 1 ELSE s END AS BIGINT)) AS source_domain,
  concat('pub', CAST(floor(x * x * x / {nodes}.0 / {nodes}.0) AS BIGINT)) AS target_domain
FROM (SELECT l_orderkey % {nodes} AS s, l_partkey % {nodes} AS x FROM {{lineitem}}) AS keys
"""
#: Every tenth number is left out, so some network nodes have no publication.
PUBLICATIONS = """
SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR(20)) AS substack_id,
  CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN '  ' ELSE p_name END AS name,
  concat('pub', CAST(floor(p_partkey * 10 / 9) AS BIGINT)) AS domain,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat(p_brand, ' ', p_type) END AS description,
  CAST(NULL AS VARCHAR(30)) AS first_seen
FROM {part}
"""
QUEUE = """
SELECT concat('pub', o_orderkey) AS domain,
  CASE o_orderstatus WHEN 'F' THEN 'crawled' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  CAST(floor(o_totalprice / 50000) AS INT) AS depth
FROM {orders}
"""
POSTS = """
SELECT page_id AS id, CAST(page_id AS VARCHAR(20)) AS external_post_id,
  CASE WHEN page_id % 50 = 7 THEN NULL ELSE CAST(page_id % 97 AS VARCHAR(20)) END AS publication_substack_id,
  regexp_extract(html, '<title>([^<]*)', 1) AS title, url,
  CASE WHEN page_id % 11 = 0 THEN 'yesterday' WHEN page_id % 11 = 1 THEN NULL ELSE '2026-01-02T03:04:05+00:00' END AS published_at,
  CASE WHEN page_id % 13 = 0 THEN '' ELSE '2026-01-02' END AS first_seen,
  CASE WHEN page_id % 17 = 0 THEN '2026/01/02' ELSE '2026-01-02 10:00:00' END AS last_seen
FROM {pages}
"""
COMMENTS = """
SELECT conv_id * 100 + turn AS id, concat(conv_id, '-', turn) AS external_comment_id, conv_id % 300 AS post_id,
  CASE WHEN turn % 6 = 5 THEN NULL ELSE conv_id % 170 END AS user_id,
  CAST(CASE WHEN turn % 4 = 3 THEN conv_id * 100 + turn - 1 WHEN turn % 9 = 8 THEN -1 ELSE NULL END AS BIGINT) AS parent_comment_id,
  CASE WHEN turn = 0 THEN NULL WHEN turn % 5 = 4 THEN concat('missing-', conv_id) WHEN turn % 4 = 3 THEN NULL ELSE concat(conv_id, '-', turn - 1) END AS parent_external_comment_id,
  text AS body, role,
  CASE WHEN turn % 7 = 6 THEN 'noon' ELSE '2026-02-03T04:05:06Z' END AS commented_at,
  '2026-02-03' AS first_seen, CASE WHEN conv_id % 19 = 0 THEN NULL ELSE '2026-02-04' END AS last_seen
FROM {conversations}
"""
USERS = """
SELECT user_id AS id, CAST(user_id AS VARCHAR(20)) AS external_user_id, concat('user ', user_id) AS name,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('h', user_id % 40) END AS handle,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE concat('https://x.example/@h', user_id % 40) END AS profile_url,
  CASE WHEN user_id % 5 = 0 THEN 'soon' ELSE CAST(CAST(min(ts) AS DATE) AS VARCHAR(10)) END AS first_seen,
  CAST(CAST(max(ts) AS DATE) AS VARCHAR(10)) AS last_seen
FROM {events} GROUP BY user_id
"""
VIEWS = {
    "recommendations": RECOMMENDATIONS,
    "publications": PUBLICATIONS,
    "queue": QUEUE,
    "posts": POSTS,
    "comments": COMMENTS,
    "users": USERS,
}


def text(name: str, nodes: int = NODES) -> str:
    body = VIEWS[name]
    return body.format(nodes=nodes) if name == "recommendations" else body


def view(spark: SparkSession, sf_dir: str, name: str, nodes: int = NODES) -> DataFrame:
    """A model table as a DataFrame."""
    body = text(name, nodes)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\{(\w+)\}", body)}
    return spark.sql(body, **tables)


def ctes(*names: str, nodes: int = NODES) -> str:
    """``name AS (...)`` for DuckDB, joined by commas."""
    return ",\n".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', text(n, nodes)).strip()})" for n in names)
