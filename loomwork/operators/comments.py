"""Posts and comment trees from JSON payloads."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.text import body_text, canonical_json, first_list, first_truthy
from loomwork.plans.lineage import cut

#: Levels after which the rows found so far are cut from their lineage.
CUT_EVERY = 50

# Keys under which payloads hold their lists.
POST_LISTS = ("posts", "items", "results")
COMMENT_LISTS = ("comments", "items", "results", "thread")
CHILD_LISTS = ("children", "replies", "child_comments")
USER_OBJECTS = ("user", "commenter", "author", "creator")


def _field(node: str, *paths: str) -> Column:
    """The first truthy of several fields of a JSON object, as text."""
    return first_truthy(*[F.get_json_object(node, f"$.{p}") for p in paths])


def posts_of(payloads: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(external_post_id, publication_substack_id, title, url, published_at)`` of archive payloads (CMT-1).

    Items that are no objects are dropped, and so are posts without an id; a payload that is not JSON has none.
    With ``keep``, these columns of the payload's row and the post's ``position`` in it come first.
    """
    items = payloads.select(*keep, F.posexplode(first_list(payload, *POST_LISTS)).alias("position", "v"))
    items = items.select(*keep, "position", F.to_json("v").alias("node")).where("node LIKE '{%'")
    return items.select(
        *((*keep, "position") if keep else ()),
        _field("node", "id", "post_id").alias("external_post_id"),
        _field("node", "publication_id", "publicationId").alias("publication_substack_id"),
        _field("node", "title").alias("title"),
        _field("node", "canonical_url", "url").alias("url"),
        _field("node", "post_date", "published_at").alias("published_at"),
    ).where("external_post_id IS NOT NULL")


def _listed(node: str, keys: tuple[str, ...]) -> Column:
    v = F.try_parse_json(F.col(node))
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in keys])


def flattened(payloads: DataFrame, id_col: str = "payload_id", payload: str = "payload") -> DataFrame:
    """``(payload_id, path, node, parent)``: every comment of every tree (CMT-2).

    ``path`` holds the positions from the root, so ordering by it gives pre-order; ``parent`` is the external id of the
    nearest ancestor that has one.  The levels are unfolded one after the other, all trees at once, as many as there are.
    """
    roots = payloads.select(F.col(id_col).alias("payload_id"), F.posexplode(first_list(payload, *COMMENT_LISTS)).alias("at", "v"))
    level = roots.select("payload_id", F.array("at").alias("path"), F.to_json("v").alias("node"), F.lit(None).cast("string").alias("parent")).where("node LIKE '{%'")
    level = cut(level)
    out = level
    for depth in count(1):
        own = F.coalesce(_field("node", "id", "comment_id"), F.col("parent"))
        children = level.select("payload_id", "path", own.alias("parent"), F.posexplode(_listed("node", CHILD_LISTS)).alias("at", "v"))
        level = cut(children.select("payload_id", F.array_append("path", F.col("at")).alias("path"), F.to_json("v").alias("node"), "parent").where("node LIKE '{%'"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
        if depth % CUT_EVERY == 0:
            out = cut(out)


def users_of(nodes: DataFrame, node: str = "node") -> DataFrame:
    """``nodes`` with ``external_user_id, name, handle, profile_url`` of the comment's author (CMT-3)."""
    person = F.coalesce(*[F.when(F.get_json_object(node, f"$.{k}").startswith("{"), F.get_json_object(node, f"$.{k}")) for k in USER_OBJECTS])
    rows = nodes.withColumn("_person", person)
    return rows.select(
        *nodes.columns,
        F.coalesce(_field("_person", "id", "user_id"), _field(node, "user_id")).alias("external_user_id"),
        F.coalesce(_field("_person", "name"), _field(node, "name")).alias("name"),
        F.coalesce(_field("_person", "handle", "user_slug"), _field(node, "handle", "user_slug")).alias("handle"),
        _field("_person", "profile_url", "url").alias("profile_url"),
    )


def comments_of(payloads: DataFrame, id_col: str = "payload_id", payload: str = "payload") -> DataFrame:
    """Normalised comments with their authors, in the columns of the comments table (CMT-4)."""
    rows = users_of(flattened(payloads, id_col, payload))
    field = lambda k: F.get_json_object("node", f"$.{k}")
    return rows.select(
        "payload_id",
        "path",
        _field("node", "id", "comment_id").alias("external_comment_id"),
        F.coalesce(_field("node", "parent_id", "parent_comment_id"), F.col("parent")).alias("parent_external_comment_id"),
        _field("node", "post_id").alias("external_post_id"),
        body_text(field("body"), field("body_text"), field("text")).alias("body"),
        _field("node", "date", "created_at", "commented_at").alias("commented_at"),
        F.coalesce(field("deleted") == "true", F.lit(False)).alias("deleted"),
        "external_user_id",
        "name",
        "handle",
        "profile_url",
        canonical_json("node").alias("raw_json"),
    )


def dedupe_key() -> Column:
    """SET-3: the comment's id, else its author, parent, time and body together."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("external_user_id", "parent_external_comment_id", "commented_at", "body")]
    return F.when(F.coalesce("external_comment_id", F.lit("")) != "", F.concat(F.lit("id:"), F.col("external_comment_id"))).otherwise(F.concat_ws("|", F.lit("fallback"), *parts))


def deduped(comments: DataFrame, order: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """The first of the rows with an equal ``dedupe_key`` (and equal ``within``) in ``order``."""
    place = F.row_number().over(Window.partitionBy(*within, "_key").orderBy(*order))
    return comments.withColumn("_key", dedupe_key()).withColumn("_place", place).where("_place = 1").drop("_key", "_place")


def page_items(pages: DataFrame, payload: str = "payload", order: str = "page") -> DataFrame:
    """``(page, at, node)``: root comments of result pages, each once, in arrival order (SET-4).

    Items are the same if their ids are, or without ids their canonical JSON.
    """
    rows = pages.select(F.col(order).alias("page"), F.posexplode(first_list(payload, *COMMENT_LISTS)).alias("at", "v")).select("page", "at", F.to_json("v").alias("node"))
    key = F.coalesce(F.concat(F.lit("id:"), F.get_json_object("node", "$.id")), F.col("node"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy("page", "at"))
    return rows.withColumn("_key", key).withColumn("_place", place).where("_place = 1").select("page", "at", "node")


def thread_depth(comments: DataFrame) -> DataFrame:
    """``(external_comment_id, depth)``: 0 for comments whose parent is not there, else one below it.

    Threads may be of any depth; comments that are their own ancestors have none and are left out.  Ids must be unique.
    """
    links = cut(comments.select("external_comment_id", F.col("parent_external_comment_id").alias("parent")))
    ids = links.select(F.col("external_comment_id").alias("parent"))
    level = cut(links.join(ids, "parent", "left_anti").select("external_comment_id", F.lit(0).alias("depth")))
    out = level
    for depth in count(1):
        above = level.select(F.col("external_comment_id").alias("parent"))
        level = cut(links.join(above, "parent").select("external_comment_id", F.lit(depth).alias("depth")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
        if depth % CUT_EVERY == 0:
            out = cut(out)


def ingest_counts(actions: DataFrame) -> DataFrame:
    """``(kind, rows, created, updated, unchanged)`` from ``(kind, row_key, action)`` (AGG-11).

    A row that several actions touched counts under its strongest: created, then updated, then unchanged.
    """
    strength = F.when(F.col("action") == "created", 3).when(F.col("action") == "updated", 2).otherwise(1)
    rows = actions.groupBy("kind", "row_key").agg(F.max(strength).alias("s"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("s") == 3).alias("created"), F.count_if(F.col("s") == 2).alias("updated"), F.count_if(F.col("s") == 1).alias("unchanged"))
