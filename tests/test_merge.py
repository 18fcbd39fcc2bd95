"""Upserts whose batches repeat rows."""

from loomwork.operators import merge

USER = "id long, external_user_id string, name string, handle string, profile_url string, is_publication_owner int, first_seen string, last_seen string"
KEYS = [["external_user_id"], ["profile_url"], ["handle"]]


def upsert(spark, current, batch, keys=KEYS):
    now = spark.createDataFrame(current, USER)
    rows = spark.createDataFrame([(k, *b) for k, b in enumerate(batch)], "arrival long" + USER.removeprefix("id long"))
    return {r.id: r for r in merge.upsert_by_keys(now, rows, keys, merge.USER_RULES).collect()}


def test_rows_of_one_batch_fold_in_order(spark):
    batch = [("x", "Ann", "ann", "", 1, "1", "1"), ("x", "", None, "https://p/@ann", 0, "2", "2"), ("x", "Anne", "", None, 0, "3", "3")]
    for current, action in (([], "created"), ([(9, "x", "old", None, None, 0, "0", "0")], "updated")):
        (row,) = upsert(spark, current, batch).values()
        assert (row.id, row.name, row.handle, row.profile_url, row.is_publication_owner) == (9 if current else 1, "Anne", "ann", "https://p/@ann", 1)
        assert (row.first_seen, row.last_seen, row.action) == ("0" if current else "1", "3", action)


def test_rows_are_one_over_any_key_and_new_ids_follow_arrival(spark):
    current = [(5, "e5", "five", "h5", None, 0, "0", "0"), (7, None, "seven", None, "u7", 0, "0", "0")]
    batch = [
        ("n1", "one", "h1", None, 0, "1", "1"),
        (None, "five!", "h5", "u5", 0, "1", "1"),
        ("", "late", None, "u5", 0, "2", "2"),
        (None, "uno", "h1", "u1", 0, "2", "2"),
        (None, None, None, "u1", 0, "3", "3"),
        ("", "nobody", "", None, 0, "1", "1"),
        (None, "nobody", None, "", 0, "1", "1"),
    ]
    found = upsert(spark, current, batch)
    assert sorted(found) == [5, 7, 8, 9, 10]
    assert (found[5].name, found[5].profile_url, found[5].external_user_id, found[5].action) == ("late", "u5", "e5", "updated")
    assert found[7].action is None
    assert (found[8].external_user_id, found[8].name, found[8].handle, found[8].profile_url) == ("n1", "uno", "h1", "u1")
    assert found[9].name == found[10].name == "nobody"


def test_new_ids_go_on_over_partitions(spark):
    batch = [(f"e{k:03}", None, None, None, 0, "1", "1") for k in range(200)]
    found = upsert(spark, [(3, "e000", None, None, None, 0, "1", "1")], batch, [["external_user_id"]])
    assert {i: r.external_user_id for i, r in found.items()} == {3: "e000", **{3 + k: f"e{k:03}" for k in range(1, 200)}}


def test_an_empty_batch_changes_nothing(spark):
    found = upsert(spark, [(3, "e", None, None, None, 0, "1", "1")], [])
    assert [r.action for r in found.values()] == [None]
