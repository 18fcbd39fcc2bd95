"""The resumable crawl and the schema state."""

import pytest

from loomwork.operators import crawl
from loomwork.plans import schema

RESPONSE = "domain string, found boolean, substack_id string, name string, description string, targets array<string>"


def start(spark, queue):
    empty = lambda n: spark.createDataFrame([], schema.CORE[n])
    return crawl.State(empty("publications"), empty("recommendations"), spark.createDataFrame(queue, schema.CORE["queue"]))


def landed(spark):
    rows = [
        ("a", True, "1", "A", "", ["https://b.substack.com", "https://c.substack.com/x", "https://c.substack.com", "", None]),
        ("b", True, "2", "B", "about", ["https://a.substack.com", "https://d.substack.com"]),
        ("c", False, None, None, None, None),
        ("d", True, "4", "D", None, None),
    ]
    return spark.createDataFrame(rows, RESPONSE)


def by_hand(queue, responses, most_publications=None, most_attempts=None):
    """One domain after the other, the nearest first."""
    queue, edges, names = {d: [s, k] for d, s, k in queue}, set(), []
    found = {r.domain: r for r in responses.collect()}
    ok = tried = 0
    while (most_publications is None or ok < most_publications) and (most_attempts is None or tried < most_attempts):
        pending = sorted((k, d) for d, (s, k) in queue.items() if s == "pending" and d in found)
        if not pending:
            break
        depth, domain = pending[0]
        tried, r = tried + 1, found[domain]
        if r.found:
            names.append(domain)
        for url in (r.targets or []) if r.found else []:
            if url:
                target = url.split("//")[1].split(".")[0]
                edges.add((domain, target))
                queue.setdefault(target, ["pending", depth + 1])[1] = min(queue.get(target, [0, depth + 1])[1], depth + 1)
        good = bool(r.found and r.targets is not None)
        queue[domain][0], ok = ("crawled" if good else "failed"), ok + good
    return {d: tuple(v) for d, v in queue.items()}, edges, sorted(names), (tried, ok)


@pytest.mark.parametrize("limits", [{}, {"most_attempts": 2}, {"most_publications": 1}])
def test_waves_equal_one_by_one(spark, limits):
    queue = [("a", "pending", 0), ("z", "pending", 4), ("b", "pending", 7), ("f", "failed", 1)]
    seen = []
    got = crawl.crawl(start(spark, queue), landed(spark), "now", **limits, commit=lambda s: seen.append(s.attempts))
    states, edges, names, counts = by_hand(queue, landed(spark), **limits)
    assert {r.domain: (r.status, r.depth) for r in got.queue.collect()} == states
    assert {(r.source_domain, r.target_domain) for r in got.recommendations.collect()} == edges
    assert sorted(r.domain for r in got.publications.collect()) == names
    assert sorted(r.id for r in got.publications.collect()) == list(range(1, len(names) + 1))
    assert (got.attempts, got.crawled) == counts and seen[-1] == got.attempts and got.edges_added == len(edges)


def test_resumed_and_fail_open(spark):
    state = start(spark, [("a", "pending", 0)])
    assert crawl.resumed(state.queue, "seed").count() == 1
    with_seeds = crawl.resumed(state.queue, "seed", spark.createDataFrame([("q",), ("a",), ("",), (None,)], "domain string"))
    assert {tuple(r) for r in with_seeds.collect()} == {("a", "pending", 0), ("q", "pending", 0)}
    assert [tuple(r) for r in crawl.resumed(state.queue.limit(0), "seed").collect()] == [("seed", "pending", 0)]

    def broken(domains):
        raise ValueError("no comments")

    got = crawl.crawl(state, landed(spark), "now", most_attempts=1, enrich=broken)
    assert got.enrichment_errors == ("no comments",) and got.queue.where("domain = 'a'").first().status == "crawled"
    again = crawl.crawl(got, landed(spark).where("domain = 'none'"), "later")
    assert again.attempts == 1 and again.queue.count() == got.queue.count()


def test_schema_state(spark):
    tables, done = schema.ensured(spark, {}, "t1")
    assert done and schema.current(tables) and set(tables) == set(schema.EXPECTED)
    assert schema.ensured(spark, tables, "t2")[1] is False
    partial = {n: t for n, t in tables.items() if n != "backfill_lock"}
    assert schema.anomalies(partial) == {"schema_version_missing": 0, "schema_version_mismatch": 0, "schema_drift_tables": 1}
    assert schema.current(schema.ensured(spark, partial, "t3")[0])
    older = schema.with_version(spark, tables, 2, "t0")
    assert schema.anomalies(older)["schema_version_mismatch"] == 1
    risen = schema.ensured(spark, older, "t4")[0]
    assert {r.version for r in risen["schema_migrations"].collect()} == {"2", "3"} and schema.version(risen) == 3
    with pytest.raises(schema.NewerSchema):
        schema.ensured(spark, schema.with_version(spark, tables, 4, "t5"), "t6")
    legacy = {"queue": spark.createDataFrame([("a", "odd", None), (" ", "pending", 1)], "domain string, status string, depth int")}
    moved, done = schema.ensured(spark, legacy, "t7")
    assert done and [tuple(r) for r in moved["queue"].collect()] == [("a", "pending", 0)] and schema.current(moved)
