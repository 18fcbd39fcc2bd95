"""Snapshot merges: an upsert is a join of the current table with the incoming rows and a rule for each column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators.components import connected_components
from loomwork.plans.lineage import cut

Rule = Callable[[Column, Column], Column]


def _empty_is_null(c: Column) -> Column:
    return F.when(c.cast("string") != "", c)


def prefer_new(old: Column, new: Column) -> Column:
    """The incoming value unless it is null or empty."""
    return F.coalesce(_empty_is_null(new), old)


def keep_old(old: Column, new: Column) -> Column:
    """The current value unless it is null or empty."""
    return F.coalesce(_empty_is_null(old), new)


def least(old: Column, new: Column) -> Column:
    return F.least(old, new)


def raised(old: Column, new: Column) -> Column:
    """A flag that, once 1, stays 1."""
    return F.greatest(F.coalesce(old, F.lit(0)), F.coalesce(new, F.lit(0)))


def replace(old: Column, new: Column) -> Column:
    return new


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order`` (WIN-8)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def merge(current: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, Rule], ignore_changes: tuple[str, ...] = ()) -> DataFrame:
    """``current`` with ``incoming`` merged in on ``keys``, with a column ``action``.

    ``action`` is ``created``, ``updated``, ``unchanged`` (matched without a change outside ``ignore_changes``)
    or null for rows that nothing came for.  Columns without a rule keep the current value where there is a row.
    ``incoming`` has at most one row for each key (see ``latest_per_key``) and may lack columns.
    """
    columns = current.columns
    missing = [c for c in columns if c not in incoming.columns]
    types = dict(current.dtypes)
    given = incoming.select(*[F.col(c).cast(types[c]) for c in columns if c not in missing], *[F.lit(None).cast(types[c]).alias(c) for c in missing])
    old = current.select(F.struct(*columns).alias("old"), *[F.col(k).alias(f"_{k}") for k in keys])
    new = given.select(F.struct(*columns).alias("new"), *[F.col(k).alias(f"_{k}") for k in keys])
    both = old.join(new, [f"_{k}" for k in keys], "full_outer")
    values, action = merged_row(columns, types, keys, rules, ignore_changes)
    return both.select(*values, action.alias("action"))


def merged_row(columns: list[str], types: dict[str, str], keys: list[str], rules: dict[str, Rule], ignore_changes: tuple[str, ...] = ()) -> tuple[list[Column], Column]:
    """The columns of a row and its action, of the structs ``old`` and ``new``, one of which may be null; see ``merge``."""
    merged, changes = [], F.lit(False)
    for c in columns:
        before, after = F.col(f"old.{c}"), F.col(f"new.{c}")
        value = rules.get(c, keep_old)(before, after) if c not in keys else F.coalesce(before, after)
        value = F.when(F.col("new").isNull(), before).when(F.col("old").isNull(), after).otherwise(value).cast(types[c])
        merged.append(value.alias(c))
        if c not in keys and c not in ignore_changes:
            changes = changes | ~value.eqNullSafe(before)
    action = F.when(F.col("new").isNull(), None).when(F.col("old").isNull(), "created").when(changes, "updated").otherwise("unchanged")
    return merged, action


def upsert_publications(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """DML-1: incoming values win unless empty, ``first_seen`` stays."""
    return merge(current, incoming, ["domain"], {"name": prefer_new, "description": prefer_new, "substack_id": prefer_new, "first_seen": keep_old, "id": keep_old}, ("first_seen",))


def upsert_queue(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """DML-2: new domains are pending; a known one keeps its status and the smaller depth."""
    fresh = incoming.groupBy("domain").agg(F.min("depth").alias("depth")).select("domain", F.lit("pending").alias("status"), "depth")
    return merge(current, fresh, ["domain"], {"depth": least, "status": keep_old})


def add_edges(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """DML-3: the edges of ``incoming`` that are not there yet, each once."""
    keys = ["source_domain", "target_domain"]
    return incoming.select(*keys).dropDuplicates().join(current.select(*keys), keys, "left_anti")


def set_status(queue: DataFrame, domains: DataFrame, status: str) -> DataFrame:
    """DML-4."""
    marked = domains.select("domain", F.lit(True).alias("_hit")).dropDuplicates(["domain"])
    value = F.when(F.col("_hit"), status).otherwise(F.col("status"))
    return queue.join(marked, "domain", "left").select(*[value.alias(c) if c == "status" else F.col(c) for c in queue.columns])


def upsert_topics(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """DML-14: ``(domain, topic_llm, topic_cluster)`` with the topics of ``incoming (domain, topic_llm)``; clusters stay.

    A topic replaces the old one even if it is null; ``incoming`` has at most one row for each domain.
    """
    return merge(current, incoming.select("domain", "topic_llm"), ["domain"], {"topic_llm": replace}).drop("action")


USER_RULES: dict[str, Rule] = {"external_user_id": keep_old, "name": prefer_new, "handle": prefer_new, "profile_url": prefer_new, "publication_substack_id": prefer_new, "publication_role": prefer_new, "is_publication_owner": raised, "first_seen": keep_old, "last_seen": replace, "id": keep_old}
POST_RULES: dict[str, Rule] = {"external_post_id": keep_old, "publication_substack_id": prefer_new, "title": prefer_new, "url": prefer_new, "published_at": prefer_new, "first_seen": keep_old, "last_seen": replace, "id": keep_old}
COMMENT_RULES: dict[str, Rule] = {"external_comment_id": keep_old, "post_id": prefer_new, "user_id": prefer_new, "parent_comment_id": prefer_new, "parent_external_comment_id": prefer_new, "body": prefer_new, "commented_at": prefer_new, "raw_json": prefer_new, "first_seen": keep_old, "last_seen": replace, "id": keep_old}


def matched_id(incoming: DataFrame, current: DataFrame, row_key: str, keys: list[list[str]]) -> DataFrame:
    """``(row_key, id)``: the current row of each incoming one by the first of several keys that finds one (JN-17).

    One equi-join for each key, null-safe for keys of several columns; of several hits the smallest id.
    """
    hits = None
    for priority, columns in enumerate(keys):
        there = current.select(*[F.col(c).alias(f"_{c}") for c in columns], "id")
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) if len(columns) > 1 else F.col(c) == F.col(f"_{c}") for c in columns]
        given = incoming.where(" AND ".join(f"{c} IS NOT NULL AND CAST({c} AS STRING) <> ''" for c in columns)) if len(columns) == 1 else incoming
        found = given.select(row_key, *columns).join(there, on).select(row_key, "id", F.lit(priority).alias("p"))
        hits = found if hits is None else hits.unionByName(found)
    return hits.groupBy(row_key).agg(F.min(F.struct("p", "id")).alias("m")).select(row_key, "m.id")


def _given(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column).cast("string") != "")


def _folded(rule: Rule, column: str, order: str) -> Column:
    """What applying ``rule`` to a group's rows one after the other in ``order`` leaves of a column."""
    if rule is raised:
        return F.max(column)
    if rule is least:
        return F.min(column)
    if rule is replace:
        return F.max_by(F.struct(column), order)[column]
    return (F.max_by if rule is prefer_new else F.min_by)(F.col(column), F.when(_given(column), F.col(order)))


def with_new_ids(rows: DataFrame, current: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with an ``id`` each, counted on from the largest of ``current`` in the order of ``order`` (unique).

    The rows are sorted by range; each partition's numbers start after the rows of the ones before it.
    """
    placed = cut(rows.drop("id").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    top = current.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    # One row for each partition.
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_base")).join(F.broadcast(top), F.lit(True))
    inside = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    numbered = inside.join(F.broadcast(before), "_part")
    return numbered.withColumn("id", F.col("_top") + F.col("_base") + F.col("_n")).drop("_part", "_n", "_top", "_base")


def _same_rows(placed: DataFrame, keys: list[list[str]], order: str) -> DataFrame:
    """``(order, _label, _linked)``: one label for all rows that keys connect, and the smallest current id among them."""
    single = [F.when(_given(k[0]), F.concat(F.lit(f"{k[0]}:"), F.col(k[0]).cast("string"))) for k in keys if len(k) == 1]
    several = [F.concat(F.lit(f"{','.join(k)}:"), F.to_json(F.struct(*k))) for k in keys if len(k) > 1]
    own = F.filter(F.array(*single), lambda x: x.isNotNull()) if single else F.array().cast("array<string>")
    row = F.concat(F.lit("row:"), F.col(order).cast("string"))
    tokens = F.when(F.size(own) > 0, own).otherwise(F.array(*several) if several else F.array(row))
    rows = placed.select(order, "_found", row.alias("_row"), tokens.alias("_tokens"))
    if len(keys) == 1:
        labelled = rows.select(order, "_found", F.col("_tokens")[0].alias("_label"))
    else:
        groups = connected_components(rows.select(F.col("_row").alias("src"), F.explode("_tokens").alias("dst")))
        labelled = rows.join(groups.select(F.col("node").alias("_row"), F.col("component").alias("_label")), "_row").select(order, "_found", "_label")
    linked = labelled.groupBy("_label").agg(F.min("_found").alias("_linked"))
    return labelled.select(order, "_label").join(linked, "_label")


def upsert_by_keys(current: DataFrame, incoming: DataFrame, keys: list[list[str]], rules: dict[str, Rule], order: str = "arrival") -> DataFrame:
    """DML-5 to DML-7: rows are matched by prioritised keys, several of one batch for the same row merge in ``order``.

    ``incoming`` has a unique ``order`` column.  Rows of the batch that any of the keys connects, directly or over other
    rows, are one row (keys of several columns connect only rows without a key of one column).  A row that finds
    no current row itself joins the smallest one that a connected row finds.  Rows of a group are folded column by
    column as ``rules`` would one after the other; new rows get ids after the largest, in order of arrival.
    Null and empty keys connect nothing; an empty batch changes nothing.
    """
    return upserted(current, incoming, keys, rules, order)[0]


def upserted(current: DataFrame, incoming: DataFrame, keys: list[list[str]], rules: dict[str, Rule], order: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """As ``upsert_by_keys``, with ``(order, id)`` of each incoming row beside it."""
    by_id = matched_id(incoming, current, order, keys)
    placed = cut(incoming.drop("id").join(by_id.withColumnRenamed("id", "_found"), order, "left"))
    same = placed.join(_same_rows(placed, keys, order), order)
    target = F.coalesce("_found", "_linked")
    same = same.withColumn("_id", target).withColumn("_label", F.when(target.isNotNull(), F.concat(F.lit("id:"), target.cast("string"))).otherwise(F.concat(F.lit("new:"), "_label")))
    columns = [c for c in incoming.columns if c not in ("id", order)]
    folded = cut(same.groupBy("_label").agg(F.min("_id").alias("id"), F.min(order).alias(order), *[_folded(rules.get(c, keep_old), c, order).alias(c) for c in columns]))
    named = cut(folded.where("id IS NOT NULL").unionByName(with_new_ids(folded.where("id IS NULL"), current, [order])))
    ids = same.select(order, "_label").join(named.select("_label", "id"), "_label").select(order, "id")
    return merge(current, named.drop("_label", order), ["id"], rules, ("last_seen",)), ids


def action_counts(merged: DataFrame) -> DataFrame:
    """``(action, rows)`` of the rows that something came for (AGG-11, DML-24)."""
    return merged.where("action IS NOT NULL").groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


def migrate_legacy(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """DML-15: legacy tables in the current shape.

    Status outside the known ones becomes pending and a missing depth 0; blank domains and edges with a missing end
    go; publication ids become text; a comment's external parent id is filled from its parent.
    """
    out = dict(tables)
    if "queue" in tables:
        q = tables["queue"].where("trim(coalesce(domain, '')) <> ''")
        out["queue"] = q.select("domain", F.when(F.col("status").isin("pending", "crawled", "failed"), F.col("status")).otherwise("pending").alias("status"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))
    if "recommendations" in tables:
        out["recommendations"] = tables["recommendations"].where("source_domain IS NOT NULL AND target_domain IS NOT NULL").dropDuplicates(["source_domain", "target_domain"])
    for name in ("posts", "users"):
        if name in tables and "publication_id" in tables[name].columns:
            out[name] = tables[name].withColumn("publication_substack_id", F.col("publication_id").cast("string")).drop("publication_id")
    if "comments" in tables:
        c = tables["comments"]
        if "parent_external_comment_id" not in c.columns:
            c = c.withColumn("parent_external_comment_id", F.lit(None).cast("string"))
        out["comments"] = fill_parent_external(c)
    return out


def fill_parent_external(comments: DataFrame) -> DataFrame:
    """REP-4, JN-11: the external parent id of rows that have only the local one, from the parent row."""
    parents = comments.select(F.col("id").alias("_pid"), F.col("external_comment_id").alias("_external"))
    filled = comments.join(parents, F.col("parent_comment_id") == F.col("_pid"), "left")
    own = F.when(F.trim("parent_external_comment_id") != "", F.col("parent_external_comment_id"))
    return filled.select(*[F.coalesce(own, "_external").alias(c) if c == "parent_external_comment_id" else F.col(c) for c in comments.columns])


def add_column(table: DataFrame, name: str, kind: str = "string") -> DataFrame:
    """DML-19: an existing column is left alone."""
    return table if name in table.columns else table.withColumn(name, F.lit(None).cast(kind))


def ordered_lookup(probes: DataFrame, table: DataFrame, keys: list[list[str]], probe_id: str, row_id: str = "id") -> DataFrame:
    """JN-20: ``probes`` with ``found``, the row of ``table`` that the first of ``keys`` with a match gives; null without one.

    ``probes`` and ``table`` have the columns of ``keys``; a key with a null or empty column is passed over.  Of several rows
    under one key that with the smallest ``row_id`` counts.  Rows with a null ``probe_id`` find nothing.  All keys are looked up in one join.
    """

    def keyed(rows: DataFrame, *kept: Column) -> DataFrame:
        lookups = []
        for place, columns in enumerate(keys):
            texts = [F.col(c).cast("string") for c in columns]
            full = reduce(lambda a, b: a & b, [F.coalesce(t, F.lit("")) != "" for t in texts])
            lookups.append(F.when(full, F.struct(F.lit(place).alias("place"), F.to_json(F.array(*texts)).alias("value"))))
        return rows.select(*kept, F.explode(F.array_compact(F.array(*lookups))).alias("k")).select("*", "k.place", "k.value").drop("k")

    held = keyed(table, F.struct(*table.columns).alias("row"))
    held = held.groupBy("place", "value").agg(F.min_by("row", f"row.{row_id}").alias("row"))
    asked = keyed(probes, F.col(probe_id).alias("_probe"))
    found = asked.join(held, ["place", "value"]).groupBy("_probe").agg(F.min_by("row", "place").alias("found"))
    return probes.join(found, F.col(probe_id) == F.col("_probe"), "left").drop("_probe")
