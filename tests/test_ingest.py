"""Landed payloads end to end."""

import json

from loomwork.operators import ingest
from loomwork.plans import schema


def test_process_twice(spark):
    tables = {n: spark.createDataFrame([], schema.CORE[n]) for n in ("posts", "users", "comments")}
    archive = {"posts": [{"id": 1, "title": "one"}, {"title": "no id"}, {"id": 2, "title": "two"}, {"id": 3, "title": "beyond"}]}
    ann = {"id": "u1", "name": "Ann", "handle": "ann"}
    thread = {"comments": [{"id": "c1", "body": "hi", "user": ann, "children": [{"id": "c2", "body": "yes", "user": {"name": "A.", "handle": "ann"}}]}, {"id": "c1", "body": "hi"}, {"body": "nobody's"}]}
    archives = spark.createDataFrame([("p", json.dumps(archive)), ("q", "no json"), ("r", None)], "publication string, payload string")
    threads = spark.createDataFrame([("1", json.dumps(thread)), ("3", json.dumps(thread)), ("2", None)], "external_post_id string, payload string")
    done, counts = ingest.process(tables, archives, threads, "t1", post_limit=2)
    want = dict(posts_seen=2, posts_created=2, posts_updated=0, users_seen=1, users_created=1, users_updated=0, comments_fetched=4, comments_unique=3, comments_created=3, comments_updated=0, classified_users=0, classified_owners=0)
    assert counts == want
    by_id = {r.external_comment_id: r for r in done["comments"].collect()}
    assert by_id["c2"].parent_comment_id == by_id["c1"].id and by_id["c1"].user_id == by_id["c2"].user_id == 1 and by_id[None].user_id is None
    assert [(r.external_user_id, r.name) for r in done["users"].collect()] == [("u1", "A.")]
    again, counts = ingest.process(done, archives.limit(1), threads, "t2", post_limit=2)
    assert counts["posts_created"] == counts["comments_created"] == counts["users_created"] == 0 and counts["posts_updated"] == 0
    assert again["comments"].count() == 3 and {r.first_seen for r in again["comments"].collect()} == {"t1"}
