"""Backfill batches, constraints, preflight, lookups and the recommendation listing."""

import json

import pytest

from loomwork.operators import backfill, constraints, merge
from loomwork.plans import locks, schema
from loomwork.sinks import reports


def prepared(spark):
    tables, _ = schema.ensured(spark, {}, "t0")
    rows = [(i, str(i), None, d, None, f"2026-01-0{i}") for i, d in enumerate("abcde", 1)]
    return {**tables, "publications": spark.createDataFrame(rows, schema.CORE["publications"])}


def landed(spark):
    archive = json.dumps({"posts": [{"id": 1, "title": "one"}]})
    return spark.createDataFrame([("a", archive, None), ("b", None, "HTTP 500"), ("c", None, "gone"), ("d", archive, None)], "domain string, payload string, error string")


def states(tables):
    return {r.domain: (r.status, r.attempts, r.last_error) for r in tables["comment_publication_status"].collect()}


def test_batches_until_no_attempt_is_left(spark):
    threads = spark.createDataFrame([], "external_post_id string, payload string")
    seen = []
    first = backfill.batch(prepared(spark), landed(spark), threads, "t1", commit=lambda t: seen.append(states(t)))
    assert (first.selected, first.succeeded, first.failed, first.skipped) == (5, 2, 2, 1)
    assert seen[0]["a"] == ("running", 1, None) and seen[1] == states(first.tables)
    assert states(first.tables) == {"a": ("succeeded", 1, None), "b": ("failed", 1, "HTTP 500"), "c": ("failed", 1, "gone"), "d": ("succeeded", 1, None)}
    assert first.tables["posts"].count() == 1 and schema.current(first.tables)
    run = first.tables["comment_ingestion_runs"].first()
    assert (run.id, run.mode, run.status, run.error, run.post_limit) == (1, "pilot", "completed_with_errors", None, 3)
    row = first.tables["comment_publication_status"].where("domain = 'a'").first()
    assert row.last_attempt_at == row.last_success_at == row.updated_at == "t1"
    second = backfill.batch(first.tables, landed(spark), threads, "t2", max_attempts=2)
    assert (second.selected, second.failed) == (3, 2)
    third = backfill.batch(second.tables, landed(spark), threads, "t3", max_attempts=2)
    assert (third.selected, third.succeeded, third.failed, third.skipped) == (1, 0, 0, 1)
    assert states(third.tables)["b"] == ("failed", 2, "HTTP 500")
    assert [r.id for r in third.tables["comment_ingestion_runs"].orderBy("id").collect()] == [1, 2, 3]


def test_stop_on_error_preview_and_seeds(spark):
    tables = prepared(spark)
    threads = spark.createDataFrame([], "external_post_id string, payload string")
    stopped = backfill.batch(tables, landed(spark), threads, "t1", stop_on_error=True, domains=["a", "b", "c"])
    assert (stopped.selected, stopped.succeeded, stopped.failed, stopped.skipped) == (3, 1, 1, 1)
    assert set(states(stopped.tables)) == {"a", "b"}
    run = stopped.tables["comment_ingestion_runs"].first()
    assert (run.mode, run.status, run.error) == ("domain-list", "failed", "HTTP 500")
    chosen = backfill.targets(tables["publications"], tables["comment_publication_status"])
    assert backfill.preview(chosen, 2).splitlines() == ["Dry run: selected 5 publication(s).", "  a attempts=0 publication_substack_id=1", "  b attempts=0 publication_substack_id=2", "  ... and 3 more"]
    seeded = backfill.seeded(stopped.tables["comment_publication_status"], chosen, "t2")
    assert {r.domain: r.status for r in seeded.collect()} == {"a": "succeeded", "b": "failed", "c": "pending", "d": "pending", "e": "pending"}


def test_constraints(spark):
    tables = prepared(spark)
    assert constraints.violations(tables).isEmpty()
    comments = spark.createDataFrame([(1, None, 9, None, None), (2, None, None, None, 1)], "id long, external_comment_id string, post_id long, user_id long, parent_comment_id long")
    fit = constraints.enforced({**tables, "comments": comments})["comments"].orderBy("id").collect()
    assert [(r.post_id, r.parent_comment_id) for r in fit] == [(None, None), (None, 1)]
    queue = spark.createDataFrame([("x", "odd", 0), ("x", None, 0), (None, "failed", 0), (None, "failed", 0)], schema.CORE["queue"])
    with pytest.raises(constraints.ConstraintError, match="allowed status broken by 1 rows; queue: required status broken by 1 rows; queue: unique domain broken by 1 rows"):
        constraints.enforced({"queue": queue})


def test_lookup_takes_the_first_key_with_a_match(spark):
    table = spark.createDataFrame([(1, "k", "u"), (2, "m", "v"), (3, "m", "")], "id long, a string, b string")
    probes = spark.createDataFrame([("p", "m", "u"), ("q", None, "u"), ("r", "none", ""), (None, "k", "u")], "p string, a string, b string")
    found = {r.p: r.found and r.found.id for r in merge.ordered_lookup(probes, table, [["a"], ["b"]], "p").collect()}
    assert found == {"p": 2, "q": 1, "r": None, None: None}
    pairs = {r.p: r.found and r.found.id for r in merge.ordered_lookup(probes, table, [["a", "b"]], "p").collect()}
    assert pairs == {"p": None, "q": None, "r": None, None: None}


def test_preflight(spark, tmp_path):
    tables = prepared(spark)
    schema.require_ready(tables)
    for broken in ({n: t for n, t in tables.items() if n != "users"}, {**tables, "backfill_lock": tables["backfill_lock"].limit(0)}, schema.with_version(spark, tables, 2, "t")):
        with pytest.raises(locks.NotReady):
            schema.require_ready(broken)
    database = tmp_path / "net.db"
    for name in ("other.db.backup", "net.backup", "net.db.bak"):
        (tmp_path / name).write_text("x")
    (tmp_path / "net.db.backup").write_text("")
    with pytest.raises(locks.NotReady):
        locks.backed_up(database)
    names = ["net.db.backup-1", "net.db.backup.2", "net.db.3.backup", "net-4.backup"]
    for name in names:
        (tmp_path / name).write_text("x")
    assert [p.name for p in locks.backups(database)] == names and locks.backed_up(database).name == names[0]


def test_listing_and_failed_list(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u1", "person"), (2, "u2", "publication"), (3, "u3", "unknown")], "n int, url string, guess string")
    whole = list(reports.recommendation_listing(rows, ["n"]))
    assert whole[0] == "\U0001f464\tperson\tbest-effort from recommendedPublication.is_personal_mode=true\tu1" and whole[2].startswith("❓\tunknown\tno reliable")
    assert list(reports.recommendation_listing(rows, ["n"], guess="publication")) == [whole[1]]
    assert list(reports.recommendation_listing(rows, ["n"], separate=True)) == ["=== \U0001f4f0 Best-Effort Publications ===", f"  {whole[1]}", "", "=== \U0001f464 Best-Effort People ===", f"  {whole[0]}"]
    queue = spark.createDataFrame([("x.com", "failed", 2), ("y", "failed", 1), ("z", "crawled", 0)], schema.CORE["queue"])
    folder = f"file://{tmp_path}/failed"
    assert reports.failed_list(spark, folder, None) is None
    want = [("y", 1, "https://y.substack.com"), ("x.com", 2, "https://x.com")]
    assert [tuple(r) for r in reports.failed_list(spark, folder, queue).collect()] == want
    assert [tuple(r) for r in reports.failed_list(spark, folder, None).collect()] == want
