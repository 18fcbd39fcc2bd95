import os
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomwork.operators import constraints, crawl, merge
from loomwork.sinks import snapshots
from loomwork.sinks.snapshots import Conflict, SnapshotStore

SCHEMA = "k long, v string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(df):
    return sorted(map(tuple, df.collect()))


def folders(store):
    root = f"{store.folder}/data"
    return {f"{t}/{x}" for t in (os.listdir(root) if os.path.isdir(root) else []) for x in os.listdir(f"{root}/{t}")}


def test_a_pinned_reader_outlives_swaps(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"), keep=1)
    store.commit({"a": rows(spark, (1, "x")), "b": rows(spark, (9, "old"))})
    with store.reader(spark) as pinned:
        before = pinned.table("a")
        for n in range(3):
            store.commit({"a": rows(spark, (1, f"new {n}")), "b": rows(spark, (9, f"new {n}"))})
        assert held(before) == held(pinned.table("a")) == [(1, "x")] and held(pinned.table("b")) == [(9, "old")]
        assert 1 in store.numbers(spark) and len(folders(store)) == 4
        with store.reader(spark) as newest:
            assert newest.number == 4 and held(newest.table("a")) == [(1, "new 2")]
    store.clean(spark)
    assert store.numbers(spark) == [4] and len(folders(store)) == 2
    with pytest.raises(KeyError), store.reader(spark, 1):
        pass


def test_a_lease_that_ran_out_pins_nothing(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"), keep=1, lease_seconds=0.1)
    store.commit({"a": rows(spark, (1, "x"))})
    with store.reader(spark) as pinned:
        time.sleep(0.2)
        store.commit({"a": rows(spark, (1, "y"))})
        assert store.numbers(spark) == [2]
        pinned.renew()


def test_a_failure_between_tables_changes_nothing(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"))
    store.commit({"a": rows(spark, (1, "x")), "b": rows(spark, (2, "y"))})
    before = folders(store)
    bad = rows(spark, (3, "z")).withColumn("v", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        store.commit({"a": rows(spark, (1, "half")), "b": bad})
    assert folders(store) == before and store.numbers(spark) == [1]
    with store.reader(spark) as now:
        assert {n: held(t) for n, t in now.tables().items()} == {"a": [(1, "x")], "b": [(2, "y")]}


def test_lost_races_raise(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"))
    first = store.commit({"a": rows(spark, (1, "x"))})
    store.commit({"a": rows(spark, (1, "winner"))}, expected=first)
    with pytest.raises(Conflict):
        store.commit({"a": rows(spark, (1, "late"))}, expected=first)
    meet, ends = threading.Barrier(4), []

    def write(n):
        def at_once(tables):
            meet.wait()
            return tables

        try:
            ends.append(SnapshotStore(store.folder, check=at_once).commit({"a": rows(spark, (1, f"writer {n}"))}))
        except Conflict:
            ends.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [e for e in ends if e]
    assert sorted(won) == list(range(3, 3 + len(won))) and len(ends) == 4
    assert store.latest(spark).number == 2 + len(won) and len(won) >= 1 and not [n for n in os.listdir(f"{store.folder}/manifests") if "draft" in n]


def test_constraints_hold_at_the_write(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"), check=constraints.enforced)
    queue = spark.createDataFrame([("a", "pending", 0)], "domain string, status string, depth int")
    store.commit({"queue": queue})
    with pytest.raises(constraints.ConstraintError, match="unique domain"):
        store.commit({"queue": queue.union(queue)})
    with store.reader(spark) as now:
        assert now.number == 1 and now.table("queue").count() == 1


def test_a_crawl_commits_its_waves_and_goes_on(spark, tmp_path):
    """Each wave's tables are one version; a stopped crawl goes on from the last one, and a report reads one version throughout."""
    store = SnapshotStore(str(tmp_path / "s"), keep=9, check=constraints.enforced)
    make = spark.createDataFrame
    pubs = make([], "id long, substack_id string, name string, domain string, description string, first_seen string")
    edges = make([], "id long, source_domain string, target_domain string")
    queue = make([("a", "pending", 0)], "domain string, status string, depth int")
    answers = make([(d, True, d, d, None, t) for d, t in (("a", ["b", "c"]), ("b", ["d"]), ("c", ["a"]), ("d", []))], "domain string, found boolean, substack_id string, name string, description string, targets array<string>")
    seen = []

    def commit(state):
        with store.reader(spark) as report:
            seen.append(report.table("queue").where("status = 'crawled'").count() if "queue" in report else 0)
            store.commit({"publications": state.publications, "recommendations": state.recommendations, "queue": state.queue})
            assert "queue" not in report or report.table("queue").where("status = 'crawled'").count() == seen[-1]

    crawl.crawl(crawl.State(pubs, edges, queue), answers, "t", most_attempts=1, commit=commit)
    with store.reader(spark) as now:
        state = crawl.crawl(crawl.State(now.table("publications"), now.table("recommendations"), now.table("queue")), answers, "t", commit=commit)
    assert seen == [0, 1, 3] and state.queue.where("status = 'crawled'").count() == 4
    with store.reader(spark) as last:
        assert last.number == 3 and held(last.table("recommendations").select("source_domain", "target_domain")) == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "a")]


def buckets(store, spark):
    """(file, size, time) of each bucket's files in the newest version."""
    out = {}
    for b, folder in store.latest(spark).tables["t"]["buckets"].items():
        out[b] = sorted((n, os.stat(f"{store.folder}/{folder}/{n}").st_mtime_ns) for n in os.listdir(f"{store.folder}/{folder}") if n.endswith(".parquet"))
    return out


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"))
    put = lambda df, **more: store.merge("t", df, ["k"], {"v": merge.prefer_new}, SCHEMA, buckets=8, **more)
    many = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    assert put(many) == {"created": 1000, "updated": 0, "unchanged": 0}
    assert put(many) == {"created": 0, "updated": 0, "unchanged": 1000} and store.latest(spark).number == 1
    before = buckets(store, spark)
    some = rows(spark, (5, "changed"), (2000, "new"), (6, "v6"), (7, None))
    touched = {str(r[0]) for r in some.select(snapshots.bucket_of(["k"], 8)).collect()}
    assert put(some) == {"created": 1, "updated": 1, "unchanged": 2} and 0 < len(touched) < 8
    after = buckets(store, spark)
    assert {b for b in after if after[b] != before[b]} == touched
    with store.reader(spark) as now:
        want = {k: f"v{k}" for k in range(1000)} | {5: "changed", 2000: "new"}
        assert {r.k: r.v for r in now.table("t").collect()} == want and now.table("t").count() == 1001
    with pytest.raises(ValueError, match="bucketed by"):
        store.merge("t", some, ["v"], {}, SCHEMA)
    assert put(some.where("k < 0")) == {"created": 0, "updated": 0, "unchanged": 0}


@pytest.mark.parametrize("few", [True, False])
def test_the_larger_side_is_not_shuffled(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(snapshots, "MOST_INCOMING", 0)
    big = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    big.write.parquet(str(tmp_path / "big"))
    current = spark.read.parquet(str(tmp_path / "big")).withColumn(snapshots.BUCKET, snapshots.bucket_of(["k"], 4))
    incoming = rows(spark, (3, "x"), (9999, "y")).withColumn(snapshots.BUCKET, snapshots.bucket_of(["k"], 4))
    changed = snapshots.changed_rows(current, incoming, ["k"], {"v": merge.prefer_new})
    assert sorted((r.k, r.v, r.action) for r in changed.where("action IS NOT NULL").collect()) == [(3, "x", "updated"), (9999, "y", "created")]
    assert changed.count() == 2001
    if few:
        plan = changed._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange (hashpart|rangepart|Single|RoundRobin)", plan) and "BroadcastHashJoin" in plan


def test_a_write_that_is_repeated_changes_nothing(spark, tmp_path):
    store = SnapshotStore(str(tmp_path / "s"))
    put = lambda n, v: store.merge("t", rows(spark, (1, v)), ["k"], {"v": merge.replace}, SCHEMA, buckets=2, token=("stream", n))
    assert put(0, "a")["created"] == 1 and put(0, "replayed") == {"created": 0, "updated": 0, "unchanged": 0}
    assert put(1, "b")["updated"] == 1
    assert store.commit({"u": rows(spark, (1, "x"))}, token=("stream", 1)) == 2
    with store.reader(spark) as now:
        assert held(now.table("t")) == [(1, "b")] and "u" not in now and held(now.table("u", SCHEMA)) == []


def test_changes_between_versions(spark):
    before, after = rows(spark, (1, "a"), (2, "b"), (3, None)), rows(spark, (2, "b"), (3, "c"), (4, None))
    found = {(r.k, r.change) for r in snapshots.changes_between(before, after, ["k"]).collect()}
    assert found == {(1, "removed"), (3, "changed"), (4, "added")}


def test_a_heavy_batch_is_not_broadcast(spark, tmp_path):
    """Few rows of much text go by their bytes, and meet the table as a light batch does."""
    given = [(1, "old"), (2, "b"), (None, "c")]
    rows(spark, *given).write.parquet(str(tmp_path / "now"))
    current = spark.read.parquet(str(tmp_path / "now")).withColumn(snapshots.BUCKET, snapshots.bucket_of(["k"], 4))
    heavy = rows(spark, (1, "x" * (6 << 20)), (9, "y"), (None, "z")).withColumn(snapshots.BUCKET, snapshots.bucket_of(["k"], 4))
    changed = snapshots.changed_rows(current, heavy, ["k"], {"v": merge.prefer_new})
    assert "FullOuter" in changed._jdf.queryExecution().executedPlan().toString()
    found = {(r.k, len(r.v), r.action, r[snapshots.BUCKET]) for r in changed.collect()}
    bucket = {r.k: r[snapshots.BUCKET] for r in current.union(heavy).collect()}
    assert found == {(1, 6 << 20, "updated", bucket[1]), (2, 1, None, bucket[2]), (None, 1, None, bucket[None]), (9, 1, "created", bucket[9]), (None, 1, "created", bucket[None])}
