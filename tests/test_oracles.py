"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from loomwork.operators import audit
from loomwork.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Each costs a whole PageRank; what they share is tested by the others.
SLOW = {"induced_top300_edges", "size_scale", "rank_points", "rank_sampled", "depth_vs_pagerank", "pagerank_all", "db_publications"}


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{float(value):.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW - {f"audit_{c.name}" for c in audit.CHECKS}))
def test_same_rows(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect())
    b = sorted(tuple(plain(v) for v in r) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert a == b
