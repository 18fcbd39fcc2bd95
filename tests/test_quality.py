import pytest
from pyspark.sql import functions as F

from loomwork.operators import audit, merge, repair
from loomwork.plans import registry


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "queue": make([("missing-crawled.substack.com", "crawled", 1), ("known.substack.com", "failed", 1)], "domain string, status string, depth int"),
        "publications": make([(1, "1", "Known", "known.substack.com", None, "2026-01-01T00:00:00Z")], "id long, substack_id string, name string, domain string, description string, first_seen string"),
        "recommendations": make([("orphan-source.substack.com", "target.substack.com")], "source_domain string, target_domain string"),
        "comments": make([(1, "parent", None, None), (2, "child-local", 1, None), (3, "child-external", None, "parent")], "id long, external_comment_id string, parent_comment_id long, parent_external_comment_id string"),
    }


def test_audit_repair_audit(spark, tables):
    names = ("recommendations_orphan_source", "queue_crawled_without_publication", "queue_failed_with_publication")
    before = {r.check: r["count"] for r in audit.audit(spark, tables).collect()}
    assert [before[n] for n in names] == [1, 1, 1] and len(before) == 25
    fixed, report = repair.audit_and_repair(spark, tables, "2026-02-02T00:00:00Z")
    after = {r.check: r["count"] for r in report.collect()}
    assert [after[n] for n in names] == [0, 0, 0]
    links = {r.external_comment_id: (r.parent_comment_id, r.parent_external_comment_id) for r in fixed["comments"].collect()}
    assert links == {"parent": (None, None), "child-local": (1, "parent"), "child-external": (1, "parent")}
    assert fixed["publications"].count() == 3


def test_blank_and_null_ends_differ(spark):
    rows = spark.createDataFrame([("", "a"), (None, "a"), ("a", "b"), ("a", "b")], "source_domain string, target_domain string")
    found = {r.check: r["count"] for r in audit.audit(spark, {"recommendations": rows}).collect()}
    assert found["recommendations_null_endpoints"] == 1 and found["recommendations_duplicate_edges"] == 1


USER = "id long, external_user_id string, name string, handle string, profile_url string, publication_substack_id string, publication_role string, is_publication_owner int, first_seen string, last_seen string"


def test_upsert_twice_is_unchanged(spark):
    current = spark.createDataFrame([], USER)
    row = [(0, "u1", "Ann", "ann", None, None, None, 0, "d1", "d1")]
    incoming = spark.createDataFrame(row, "arrival " + USER[3:])
    once = merge.upsert_by_keys(current, incoming, [["external_user_id"], ["profile_url"], ["handle"]], merge.USER_RULES)
    assert [(r.id, r.action) for r in once.collect()] == [(1, "created")]
    again = merge.upsert_by_keys(once.drop("action"), incoming.withColumn("last_seen", F.lit("d2")), [["external_user_id"], ["profile_url"], ["handle"]], merge.USER_RULES)
    assert [(r.id, r.action, r.first_seen, r.last_seen) for r in again.collect()] == [(1, "unchanged", "d1", "d2")]


def test_keys_in_order_flag_and_empty_values(spark):
    current = spark.createDataFrame([(4, None, "Ann", "ann", "url", "9", None, 1, "d0", "d0"), (5, "u5", "Bob", "bob", None, None, None, 0, "d0", "d0")], USER)
    incoming = spark.createDataFrame([(0, "u4", "", "other", "url", None, "admin", 0, "d1", "d1"), (1, None, "Bobby", "bob", None, None, None, 1, "d1", "d1"), (2, "new", "N", None, None, None, None, 0, "d1", "d1"), (3, "new", "N2", None, None, None, None, 0, "d1", "d1")], "arrival " + USER[3:])
    got = {r.id: r for r in merge.upsert_by_keys(current, incoming, [["external_user_id"], ["profile_url"], ["handle"]], merge.USER_RULES).collect()}
    assert sorted(got) == [4, 5, 6] and got[6].name == "N2"
    assert (got[4].external_user_id, got[4].name, got[4].publication_substack_id, got[4].is_publication_owner, got[4].action) == ("u4", "Ann", "9", 1, "updated")
    assert (got[5].external_user_id, got[5].name, got[5].is_publication_owner) == ("u5", "Bobby", 1)


def test_queue_keeps_the_smaller_depth(spark):
    current = spark.createDataFrame([("a", "failed", 3), ("b", "crawled", 0)], "domain string, status string, depth int")
    incoming = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4), ("c", 3)], "domain string, depth int")
    assert {tuple(r) for r in merge.upsert_queue(current, incoming).collect()} == {("a", "failed", 1, "updated"), ("b", "crawled", 0, "unchanged"), ("c", "pending", 3, "created")}


def test_legacy_migration(spark):
    legacy = {
        "queue": spark.createDataFrame([("a", "odd", None), (" ", "pending", 0)], "domain string, status string, depth int"),
        "posts": spark.createDataFrame([(1, 500)], "id long, publication_id long"),
        "comments": spark.createDataFrame([(1, "parent", None), (2, "child", 1)], "id long, external_comment_id string, parent_comment_id long"),
    }
    new = merge.migrate_legacy(legacy)
    assert [tuple(r) for r in new["queue"].collect()] == [("a", "pending", 0)]
    assert new["posts"].first().publication_substack_id == "500"
    assert {r.id: r.parent_external_comment_id for r in new["comments"].collect()} == {1: None, 2: "parent"}


def test_every_query_has_a_name_and_most_have_sql():
    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) - len(sql) <= 5
