"""Data-quality checks as declarative specs, compiled into one scan of each table and one aggregation.

A row of a table gives a token for each check that it takes part in: that it is bad, a key that must not repeat, a key that must (or must not)
be another table's, or, for a table that is looked up, the key that is there.  Tokens of all tables are counted by check and key, combined
before the only shuffle of keys, so a value that most rows hold is one row of it; what the counts of a key mean is the check's
kind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]
# The states of a queue's row, and below the names of the checks and the columns they read.
STATUSES = ("pending", "crawled", "failed")
#: Shape of a date at the start of a text: the first ten characters with dashes in their places.
DATE_SHAPE = "____-__-__%"

#: Kinds of checks: rows for which a condition holds, keys on several rows, rows whose key is not in another table, or is.
BAD, REPEATED, ORPHAN, FOUND = "bad", "repeated", "orphan", "found"


@dataclass(frozen=True)
class Check:
    """``given`` tells which rows of ``table`` are looked at; ``reads`` names columns that it needs beside the keys."""

    name: str
    kind: str
    table: str
    keys: tuple[str, ...]
    given: Callable[[], Column] | None = None
    reads: tuple[str, ...] = ()
    parent: str | None = None
    parent_key: str | None = None

    @property
    def needs(self) -> dict[str, tuple[str, ...]]:
        own = {self.table: (*self.keys, *self.reads)}
        return own if self.parent is None else {**own, self.parent: tuple({self.parent_key, *own.get(self.parent, ())})}


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(F.col(column)) == "")


def _where(name: str, table: str, columns: tuple[str, ...], condition: Callable[[], Column]) -> Check:
    return Check(name, BAD, table, (), condition, columns)


def _repeated(name: str, table: str, keys: tuple[str, ...], given: Callable[[], Column] | None = None) -> Check:
    return Check(name, REPEATED, table, keys, given)


def _orphan(name: str, table: str, key: str, parent: str, parent_key: str, given: Callable[[], Column] | None = None, reads: tuple[str, ...] = ()) -> Check:
    return Check(name, ORPHAN, table, (key,), given, reads, parent, parent_key)


def _undated(table: str, column: str, optional: bool = False) -> Check:
    misshapen = lambda: ~F.col(column).like(DATE_SHAPE)
    bad = (lambda: ~blank(column) & misshapen()) if optional else (lambda: blank(column) | misshapen())
    return _where(f"{table}_invalid_{column}", table, (column,), bad)


def _present(column: str) -> Callable[[], Column]:
    return lambda: F.col(column).isNotNull()


def _non_blank(column: str) -> Callable[[], Column]:
    return lambda: ~blank(column)


CHECKS: tuple[Check, ...] = (
    _where("publications_null_domain", "publications", ("domain",), lambda: blank("domain")),
    _repeated("publications_duplicate_domain", "publications", ("domain",)),
    _where("recommendations_null_endpoints", "recommendations", ("source_domain", "target_domain"), lambda: F.col("source_domain").isNull() | F.col("target_domain").isNull()),
    _repeated("recommendations_duplicate_edges", "recommendations", ("source_domain", "target_domain")),
    _where("queue_null_domain", "queue", ("domain",), lambda: blank("domain")),
    _where("queue_invalid_status", "queue", ("status",), lambda: F.col("status").isNull() | ~F.col("status").isin(*STATUSES)),
    _repeated("queue_duplicate_domain", "queue", ("domain",)),
    _orphan("recommendations_orphan_source", "recommendations", "source_domain", "publications", "domain"),
    _orphan("queue_crawled_without_publication", "queue", "domain", "publications", "domain", lambda: F.col("status") == "crawled", ("status",)),
    Check("queue_failed_with_publication", FOUND, "queue", ("domain",), lambda: F.col("status") == "failed", ("status",), "publications", "domain"),
    _repeated("users_duplicate_external_user_id", "users", ("external_user_id",), _non_blank("external_user_id")),
    _repeated("posts_duplicate_external_post_id", "posts", ("external_post_id",), _non_blank("external_post_id")),
    _repeated("comments_duplicate_external_comment_id", "comments", ("external_comment_id",), _non_blank("external_comment_id")),
    _orphan("comments_orphan_post_id", "comments", "post_id", "posts", "id", _present("post_id")),
    _orphan("comments_orphan_user_id", "comments", "user_id", "users", "id", _present("user_id")),
    _orphan("comments_orphan_parent_comment_id", "comments", "parent_comment_id", "comments", "id", _present("parent_comment_id")),
    _orphan("comments_broken_parent_external_comment_id", "comments", "parent_external_comment_id", "comments", "external_comment_id", _non_blank("parent_external_comment_id")),
    _undated("users", "first_seen"),
    _undated("users", "last_seen"),
    _undated("posts", "first_seen"),
    _undated("posts", "last_seen"),
    _undated("posts", "published_at", optional=True),
    _undated("comments", "first_seen"),
    _undated("comments", "last_seen"),
    _undated("comments", "commented_at", optional=True),
)


def _token(position: int, key: Column, there: bool, when: Column | None) -> Column:
    token = F.struct(F.lit(position).alias("position"), key.alias("key"), F.lit(there).alias("there"))
    return token if when is None else F.when(F.coalesce(when, F.lit(False)), token)


def _tokens(name: str, table: DataFrame, checks: list[tuple[int, Check]]) -> DataFrame | None:
    """``(position, key, there)`` of one scan of a table; ``there`` marks keys that other rows are looked up in."""
    found = []
    for position, check in checks:
        if check.table == name:
            key = F.lit(None).cast("string")
            if check.keys:
                one = F.col(check.keys[0]).cast("string")
                key = one if check.kind in (ORPHAN, FOUND) else F.to_json(F.struct(*check.keys))
            found.append(_token(position, key, False, check.given() if check.given else None))
        if check.parent == name:
            key = F.col(check.parent_key).cast("string")
            found.append(_token(position, key, True, key.isNotNull()))
    return table.select(F.explode(F.array_compact(F.array(*found))).alias("t")).select("t.position", "t.key", "t.there") if found else None


def audit(spark: SparkSession, tables: Tables, checks: tuple[Check, ...] = CHECKS) -> DataFrame:
    """``(position, check, count)`` of all checks in one plan; a missing table or column counts 0.

    A key that repeats counts once; other checks count rows.
    """
    able = [(k, c) for k, c in enumerate(checks) if all(t in tables and set(columns) <= set(tables[t].columns) for t, columns in c.needs.items())]
    parts = [p for n, t in sorted(tables.items()) if (p := _tokens(n, t, able)) is not None]
    listed = spark.createDataFrame([(k, c.name) for k, c in enumerate(checks)], "position int, check string")
    if not parts:
        return listed.select("position", "check", F.lit(0).cast("long").alias("count"))
    own, there = F.count_if(~F.col("there")).alias("own"), F.count_if("there").alias("parents")
    keys = reduce(DataFrame.unionByName, parts).groupBy("position", "key").agg(own, there)
    rows = {
        BAD: F.col("own"),
        REPEATED: (F.col("own") > 1).cast("long"),
        ORPHAN: F.when(F.col("parents") == 0, F.col("own")).otherwise(0),
        FOUND: F.when(F.col("parents") > 0, F.col("own")).otherwise(0),
    }
    of_kind = lambda kind: F.col("position").isin([k for k, c in able if c.kind == kind])
    counted = F.when(of_kind(BAD), rows[BAD]).when(of_kind(REPEATED), rows[REPEATED]).when(of_kind(ORPHAN), rows[ORPHAN]).otherwise(rows[FOUND])
    sums = keys.groupBy("position").agg(F.sum(counted).alias("count"))
    return listed.join(F.broadcast(sums), "position", "left").select("position", "check", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def all_zero(report: DataFrame) -> bool:
    return report.where("count <> 0").isEmpty()


def report_text(report: DataFrame) -> str:
    """One line for each check in the fixed order, for the console."""
    return "\n".join(f"{r.check}: {r['count']}" for r in report.orderBy("position").collect())
