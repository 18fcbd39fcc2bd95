"""Posts, comments and users of landed payloads merged into the model's tables, with counts (CMT-5, SRC-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators import classify, comments, merge
from loomwork.operators.repair import linked_parents
from loomwork.plans.lineage import written

USER_KEYS = [["external_user_id"], ["profile_url"], ["handle"]]
POST_KEYS = [["external_post_id"], ["url"]]
COMMENT_KEYS = [["external_comment_id"], ["post_id", "user_id", "parent_external_comment_id", "body", "commented_at"]]


def first_posts(archives: DataFrame, post_limit: int | None = 20) -> DataFrame:
    """SRT-9: the first posts of each publication's archive; all of them with None or a negative limit."""
    posts = comments.posts_of(archives, keep=("publication",))
    if post_limit is None or post_limit < 0:
        return posts
    place = F.row_number().over(Window.partitionBy("publication").orderBy("position"))
    return posts.withColumn("_place", place).where(F.col("_place") <= post_limit).drop("_place")


def _arriving(rows: DataFrame, order: list[str], at: str) -> DataFrame:
    numbered = merge.with_new_ids(rows, rows.sparkSession.range(0), order).withColumnRenamed("id", "arrival")
    return written(numbered.withColumn("first_seen", F.lit(at)).withColumn("last_seen", F.lit(at)))


def _merged(current: DataFrame, rows: DataFrame, keys: list[list[str]], rules: dict[str, merge.Rule]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(the table, ``(arrival, id)``, rows by action)"""
    merged, ids = merge.upserted(current, rows, keys, rules)
    merged = written(merged)
    counts = {r.action: r["rows"] for r in merge.action_counts(merged).collect()}
    return merged.drop("action"), written(ids), counts


def process(
    tables: dict[str, DataFrame], archives: DataFrame, threads: DataFrame, at: str, post_limit: int | None = 20, profiles: DataFrame | None = None
) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """``(tables with posts, users and comments merged in, counts)``.

    ``archives (publication, payload)`` has one row for each publication, ``threads (external_post_id, payload)`` at
    most one for each post; threads of posts that are not among a publication's first ones are not used.
    A post that two archives list is worked on once.  Comments are deduplicated within their post; the counts are of
    the whole batch.  With ``profiles (handle, payload)`` users are classified.  Payloads that are no JSON hold nothing.
    ``tables`` itself is unchanged, so a failing run leaves nothing half done.
    """
    posts = _arriving(first_posts(archives, post_limit), ["publication", "position"], at)
    incoming = posts.select("arrival", *[c for c in posts.columns if c in merge.POST_RULES and c != "id"])
    all_posts, post_ids, post_counts = _merged(tables["posts"], incoming, POST_KEYS, merge.POST_RULES)
    known = posts.join(post_ids, "arrival").groupBy("external_post_id").agg(F.min("id").alias("post_id"))

    used = threads.join(known.withColumnRenamed("external_post_id", "_post"), F.col("external_post_id") == F.col("_post"), "left_semi")
    found = written(comments.comments_of(used, id_col="external_post_id"))
    unique = comments.deduped(found, ["path"], within=("payload_id",))
    unique = _arriving(unique.join(known.withColumnRenamed("external_post_id", "payload_id"), "payload_id"), ["post_id", "path"], at)

    people = unique.where("coalesce(external_user_id, name, handle, profile_url) IS NOT NULL")
    people = people.select("arrival", "external_user_id", "name", "handle", "profile_url", F.lit(0).alias("is_publication_owner"), "first_seen", "last_seen")
    all_users, user_ids, user_counts = _merged(tables["users"], people, USER_KEYS, merge.USER_RULES)

    authored = unique.join(user_ids.withColumnRenamed("id", "user_id"), "arrival", "left")
    rows = authored.select("arrival", *[c for c in authored.columns if c in merge.COMMENT_RULES and c != "id"])
    all_comments, _, comment_counts = _merged(tables["comments"], rows, COMMENT_KEYS, merge.COMMENT_RULES)

    counts = {"posts_seen": posts.count(), **_changes("posts", post_counts)}
    counts |= {"users_seen": sum(user_counts.values()), **_changes("users", user_counts)}
    counts |= {"comments_fetched": found.count(), "comments_unique": unique.count(), **_changes("comments", comment_counts)}
    counts |= {"classified_users": 0, "classified_owners": 0}
    if profiles is not None:
        judged = written(classify.classify_users(all_users, profiles))
        total = classify.classification_counts(judged).first()
        counts |= {"classified_users": total.updated, "classified_owners": total.owners}
        all_users = judged.select(*all_users.columns)
    return {**tables, "posts": all_posts, "users": all_users, "comments": written(linked_parents(all_comments))}, counts


def _changes(name: str, actions: dict[str, int]) -> dict[str, int]:
    return {f"{name}_{a}": actions.get(a, 0) for a in ("created", "updated")}
