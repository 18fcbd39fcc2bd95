import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomwork import cli
from loomwork.functions import text as fn
from loomwork.operators import backfill, classify, comments, embeddings
from loomwork.plans import locks, schema
from loomwork.sinks import reports
from loomwork.sinks.snapshots import SnapshotTable
from loomwork.sources import files, sqlite
from loomwork.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_domains_and_handles(spark):
    domain = lambda u: one(spark, fn.normalize_domain(F.lit(u)))
    assert [domain(u) for u in ("https://A.substack.com/p/x", "http://b.org:80/", "HTTPS://c.org", "a.b.substack.com", "d.org?x#y", "")] == ["a", "b.org", "https", "a", "d.org?x#y", ""]
    assert one(spark, fn.publication_url(F.lit("x"))) == "https://x.substack.com" and one(spark, fn.publication_url(F.lit("x.org"))) == "https://x.org"
    handle = lambda v: one(spark, fn.normalize_handle(F.lit(v)))
    assert [handle(v) for v in ("@Ann", "https://substack.com/@Bob?x=1", "https://carl.substack.com/", "no spaces", "")] == ["ann", "bob", "carl", None, None]
    assert one(spark, fn.graph_label(F.lit("www." + "a" * 30))) == "a" * 25 + ".."
    assert one(spark, fn.collapsed(F.lit("a  b\n"))) == "a b"


def test_redaction_topics_errors(spark):
    secret = json.dumps({"a": [{"Auth": 1, "ok": 2}], "myToken": {"x": 1}})
    row = spark.createDataFrame([(secret,)], "p string").select(fn.redacted("p").alias("v")).first()
    assert json.loads(row.v) == {"a": [{"Auth": "[REDACTED]", "ok": 2}], "myToken": "[REDACTED]"}
    labels = ["culture wars", "culture", "other"]
    snap = lambda t, **k: one(spark, fn.snapped_topic(F.lit(t), labels, **k))
    assert [snap("Culture"), snap("culture", exact_first=True), snap(""), snap("zebra")] == ["culture wars", "culture", "other", "zebra"]
    assert one(spark, fn.joined_errors(F.lit("a"), F.lit(""), F.lit(None), F.lit("b"))) == "a | b" and one(spark, fn.joined_errors(F.lit(""))) == "—"


def test_comment_tree(spark):
    tree = {"comments": [{"id": "p1", "body": "hi", "user": {"id": 7, "name": "Ann"}, "children": [{"id": "c1", "body": "yo", "replies": [{"id": "g1", "deleted": True, "body": None}, {"body": {"text": "deep"}}]}, {"body": "no id", "children": [{"id": "x1", "body": "under"}]}]}]}
    bare = {"items": [{"body": "b", "user_id": 123, "handle": "h"}]}
    rows = comments.comments_of(spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps(bare)), (3, "no json"), (4, None)], "payload_id long, payload string")).orderBy("payload_id", "path").collect()
    assert [(r.external_comment_id, r.parent_external_comment_id, r.body) for r in rows] == [("p1", None, "hi"), ("c1", "p1", "yo"), ("g1", "c1", ""), (None, "c1", "deep"), (None, "p1", "no id"), ("x1", "p1", "under"), (None, None, "b")]
    assert rows[0].external_user_id == "7" and rows[2].deleted and (rows[-1].external_user_id, rows[-1].handle) == ("123", "h")
    posts = comments.posts_of(spark.createDataFrame([(json.dumps({"posts": [{"id": 101, "title": "T", "publication_id": 7}, 5]}),)], "payload string")).collect()
    assert [(p.external_post_id, p.publication_substack_id) for p in posts] == [("101", "7")]


def test_owner_rules(spark):
    def profile(role, posts, user="1"):
        return json.dumps({"id": "1", "hasPosts": posts, "primaryPublication": {"id": "55"}, "publicationUsers": [{"user_id": user, "publication_id": "9", "role": role}]})

    mixed = json.dumps({"id": "1", "hasPosts": True, "publicationUsers": [{"user_id": "1", "publication_id": "8", "role": "contributor"}, {"user_id": "1", "publication_id": "9", "role": "Admin"}]})
    rows = spark.createDataFrame([(0, profile("admin", True)), (1, profile("admin", False)), (2, profile("contributor", True)), (3, profile("admin", True, "2")), (4, mixed), (5, None)], "k int, payload string")
    got = {r.k: (r.is_owner, r.publication_id, r.role) for r in classify.owners(rows).collect()}
    assert got == {0: (1, "9", "admin"), 1: (0, "9", "admin"), 2: (0, "55", "contributor"), 3: (0, "55", None), 4: (1, "9", "contributor"), 5: (0, None, None)}


def test_embeddings_state(spark):
    rows = spark.createDataFrame([(1, "A useful comment"), (2, "")], "source_id long, text string")
    empty = spark.createDataFrame([], "source_table string, source_id long, source_hash string, model string, dimensions int, embedding_json string, embedded_at string")
    embedder = lambda texts, model: [[float(len(t)), 1.0] for t in texts]
    found = embeddings.candidates(rows, empty, "comments", "m")
    assert tuple(embeddings.run_counts(rows, found).first()) == (2, 1, 1)
    stored = embeddings.upsert_embeddings(empty, embeddings.embedded(found, embedder, "comments", "m", "now"))
    assert tuple(embeddings.run_counts(rows, embeddings.candidates(rows, stored, "comments", "m")).first()) == (2, 0, 2)
    assert embeddings.candidates(rows, stored, "comments", "other").count() == 1
    changed = rows.withColumn("text", F.lit("after"))
    again = embeddings.upsert_embeddings(stored, embeddings.embedded(embeddings.candidates(changed.limit(1), stored, "comments", "m"), embedder, "comments", "m", "now"))
    assert again.count() == 1
    with pytest.raises(Exception, match="vectors"):
        embeddings.embedded(found, lambda t, m: [], "comments", "m", "now").collect()


def test_backfill_states(spark):
    pubs = spark.createDataFrame([("alpha", "101", ""), ("beta", "102", "")], "domain string, substack_id string, first_seen string")
    status = spark.createDataFrame([], "domain string, status string, attempts int, last_error string, updated_at string")
    outcome = lambda d, o, e=None: spark.createDataFrame([(d, o, e)], "domain string, outcome string, error string")
    assert [r.domain for r in backfill.targets(pubs, status, limit=1).collect()] == ["alpha"]
    status = backfill.changed(backfill.changed(status, outcome("alpha", "started"), "t1"), outcome("alpha", "failed", "boom"), "t2")
    assert [tuple(r) for r in status.collect()] == [("alpha", "failed", 1, "boom", "t2")]
    assert [r.domain for r in backfill.targets(pubs, status, max_attempts=1).collect()] == ["beta"]
    status = backfill.changed(status, outcome("beta", "seeded"), "t3")
    assert {tuple(r) for r in backfill.summary(status).collect()} == {("failed", 1), ("pending", 1)}


def test_text_sources(spark, tmp_path):
    seeds = tmp_path / "seeds.md"
    seeds.write_text("# no\nA https://a.substack.com/ https://b.org\nW https://en.wikipedia.org/x\nB http://B.org/p\nA2 https://a.substack.com\n\n")
    assert [r.domain for r in files.seed_domains(spark, str(seeds)).orderBy("position").collect()] == ["a", "b.org"]
    log = tmp_path / "log.tsv"
    row = lambda u, s: "\t".join([u, s, *["x"] * 9])
    log.write_text("\n".join(["\t".join(files.PROBE_COLUMNS), row("u1", "404"), "short", row("u2", "200"), row("u1", "200")]))
    assert {(r.homepage_url, r.publication_status) for r in files.probe_log(spark, str(log)).collect()} == {("u1", 200), ("u2", 200)}
    log.write_text("other header\n" + row("u1", "1"))
    assert files.probe_log(spark, str(log)).count() == 0


def test_listed_domains_stay_whole(spark, tmp_path):
    listed = tmp_path / "domains.txt"
    listed.write_text("# no\nhttps://foo.substack.com/p/x\nBar.org:8080 y\n\n  http://A.net/\nfoo.substack.com\n")
    assert [r.domain for r in files.listed_domains(spark, str(listed)).orderBy("position").collect()] == ["foo.substack.com", "bar.org:8080", "a.net"]


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, w REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, None if k % 3 else f"n{k}", k / 2) for k in range(50)])
        db.execute("CREATE TABLE empty_one (id INTEGER)")
    assert sqlite.table_names(path) == ["empty_one", "t"]
    df = sqlite.read_table(spark, path, "t", 4)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("w", "double")] and df.count() == 50 and df.agg(F.sum("w")).first()[0] == 612.5
    assert sqlite.read_table(spark, path, "empty_one").count() == 0


def test_sqlite_affinities_and_filters(spark, tmp_path):
    path = str(tmp_path / "y.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a INT, b BIGINT, c VARCHAR(9), d DOUBLE PRECISION, e)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", [(k, k * 10, f"c{k}", k / 2, k) for k in range(40)] + [("odd", None, b"raw", "x", 1.5)])
        db.execute("CREATE TABLE w (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
        db.executemany("INSERT INTO w VALUES (?, ?)", [(f"k{k}", k) for k in range(9)])
    df = sqlite.read_table(spark, path, "t", 3)
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "string", "double", "string"]
    assert [tuple(r) for r in df.where("c = 'raw'").collect()] == [(None, None, "raw", None, "1.5")] and df.count() == 41
    assert sqlite.read_table(spark, path, "w").agg(F.sum("n")).first()[0] == 36
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = sqlite.read_table(spark, path, "t", 3).where("a >= 35 AND b < 380 AND d > 17.5")
        assert sorted(r.a for r in few.collect()) == [36, 37]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_streaming_is_idempotent(spark, tmp_path):
    landing, table = tmp_path / "landing", SnapshotTable(str(tmp_path / "comments"))
    landing.mkdir()
    (landing / "1.json").write_text(json.dumps({"comments": [{"id": "a", "body": "x", "children": [{"id": "b", "body": "y"}]}]}))
    run = lambda: ingest.ingest(spark, str(landing), table, str(tmp_path / "progress"), "2026-01-01").awaitTermination()
    run()
    run()
    assert len(table.versions(spark)) == 1 and table.read(spark, ingest.SCHEMA).count() == 2
    payload = spark.read.text(str(landing)).select(F.col("value").alias("payload"))
    assert {r.action for r in ingest.merged_comments(table.read(spark, ingest.SCHEMA), payload, "2026-02-02").collect()} == {"unchanged"}
    (landing / "2.json").write_text(json.dumps({"comments": [{"id": "c", "body": "z"}]}))
    run()
    assert table.read(spark, ingest.SCHEMA).count() == 3


def test_locks(tmp_path):
    with locks.exclusive(tmp_path / "lock"):
        with pytest.raises(locks.Locked):
            with locks.exclusive(tmp_path / "lock", break_stale=True):
                pass
    (tmp_path / "lock").write_text("999999999")
    with pytest.raises(locks.Locked), locks.exclusive(tmp_path / "lock"):
        pass
    with locks.exclusive(tmp_path / "lock", break_stale=True):
        pass


def test_reports_and_command_line(spark, tmp_path):
    make = spark.createDataFrame
    make([("a", "A <b>", None), ("b", None, None)], "domain string, name string, description string").write.parquet(str(tmp_path / "publications.parquet"))
    make([("a", "b"), ("b", "a"), ("c", "a")], "source_domain string, target_domain string").write.parquet(str(tmp_path / "recommendations.parquet"))
    make([("a", "crawled", 0), ("b", "failed", 1), ("c", "pending", 1)], "domain string, status string, depth int").write.parquet(str(tmp_path / "queue.parquet"))
    with pytest.raises(cli.Missing, match="no archives.parquet|no posts.parquet, users.parquet, comments.parquet, archives.parquet"):
        cli.run(spark, "comments", str(tmp_path))
    with pytest.raises(cli.Missing, match="comment_publication_status.parquet"):
        cli.run(spark, "backfill", str(tmp_path))
    make([], schema.EXPECTED["comment_publication_status"]).write.parquet(str(tmp_path / "comment_publication_status.parquet"))
    for name in ("posts", "users", "comments"):
        make([], schema.EXPECTED[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    make([], "publication string, payload string").write.parquet(str(tmp_path / "archives.parquet"))
    make([], "external_post_id string, payload string").write.parquet(str(tmp_path / "threads.parquet"))
    spark.read.parquet(str(tmp_path / "publications.parquet")).withColumns({"substack_id": F.lit("1"), "first_seen": F.lit("")}).write.parquet(str(tmp_path / "p2.parquet"))
    spark.read.parquet(str(tmp_path / "p2.parquet")).write.mode("overwrite").parquet(str(tmp_path / "publications.parquet"))
    folder = f"file://{tmp_path}"  # not a path of the driver's own
    out = {c: cli.run(spark, c, folder, out=str(tmp_path / f"out-{c}")) for c in cli.COMMANDS}
    assert "https://a.substack.com/archive" in out["visualize"] and "A \\u003cb>" in out["visualize"] and "selected" in out["backfill"]
    assert "posts_created=0" in out["comments"]
    assert "queue failed: 1" in out["summarize"] and "(2 rows)" in out["view"] and out["centrality"].split()[:3] == ["1", "A", "<b>"]
    assert "queue_failed_with_publication: 1" in out["audit"] and json.loads(out["repair"])["queue_failed_with_publication"] == 0
    assert json.loads(out["distribution"])["n_publications"] == 2 and "https://b.substack.com" in out["failed"] and "<svg" in out["visualize"]
    assert spark.read.csv(str(tmp_path / "out-export/publications.csv"), header=True).count() == 2
    assert "&lt;b&gt;" in reports.html_table(make([("<b>",)], "x string"))
