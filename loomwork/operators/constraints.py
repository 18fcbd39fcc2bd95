"""Constraints on the model's tables, tested before a write: keys, required values, allowed values, references (DML-18)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]

# The model's keys (nulls never clash), required columns, allowed values and references.
UNIQUE = {
    "publications": [("id",), ("substack_id",), ("domain",)],
    "recommendations": [("id",), ("source_domain", "target_domain")],
    "queue": [("domain",)],
    "users": [("id",), ("external_user_id",)],
    "posts": [("id",), ("external_post_id",)],
    "comments": [("id",), ("external_comment_id",)],
    "comment_publication_status": [("domain",)],
    "backfill_lock": [("id",)],
}
REQUIRED = {"publications": ["domain"], "queue": ["status"], "users": ["is_publication_owner"], "backfill_lock": ["is_locked"]}
ALLOWED = {
    "queue": {"status": ["pending", "crawled", "failed"]},
    "users": {"is_publication_owner": [0, 1]},
    "schema_version": {"singleton": [1]},
    "backfill_lock": {"id": [1], "is_locked": [0, 1]},
}
REFERENCES = {"comments": [("post_id", "posts"), ("user_id", "users"), ("parent_comment_id", "comments")]}


class ConstraintError(ValueError):
    """Tables that must not be written; the message names what they break."""


def _key(columns: tuple[str, ...]) -> Column:
    """The name and value of a unique key; null where one of its columns is."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(full, F.struct(F.lit(", ".join(columns)).alias("key"), F.to_json(F.struct(*columns)).alias("value")))


def _row_checks(name: str, table: DataFrame) -> dict[str, Column]:
    checks = {f"required {c}": F.col(c).isNull() for c in REQUIRED.get(name, []) if c in table.columns}
    return checks | {f"allowed {c}": ~F.col(c).isin(values) for c, values in ALLOWED.get(name, {}).items() if c in table.columns}


def broken(name: str, table: DataFrame) -> DataFrame:
    """``(table, rule, rows)``: rows of ``table`` beyond the first of each key, and rows that break a rule by themselves.

    All keys of a table are counted in one shuffle, combined before it, so a value that most rows hold is no large group.
    Rules of columns that the table lacks don't apply; rules that hold give no row.
    """
    keys = [k for k in UNIQUE.get(name, []) if set(k) <= set(table.columns)]
    parts = []
    if keys:
        held = table.select(F.explode(F.array_compact(F.array(*map(_key, keys)))).alias("k")).groupBy("k.key", "k.value").agg(F.count(F.lit(1)).alias("n"))
        parts.append(held.where("n > 1").groupBy("key").agg(F.sum(F.col("n") - 1).alias("rows")).select(F.concat(F.lit("unique "), "key").alias("rule"), "rows"))
    checks = _row_checks(name, table)
    if checks:
        counted = table.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
        listed = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"c{i}").alias("rows")) for i, rule in enumerate(checks)])
        parts.append(counted.select(F.inline(listed)).where("rows > 0"))
    if not parts:
        return table.sparkSession.createDataFrame([], "table string, rule string, rows long")
    return reduce(DataFrame.unionByName, parts).select(F.lit(name).alias("table"), "rule", "rows")


def violations(tables: Tables) -> DataFrame:
    """``broken`` of all tables that have rules."""
    return reduce(DataFrame.unionByName, [broken(n, t) for n, t in sorted(tables.items())])


def references_cleared(tables: Tables) -> Tables:
    """References to rows that are not there become null, as when the rows they name are deleted."""
    out = dict(tables)
    for name, references in REFERENCES.items():
        for column, target in references:
            if name not in out or target not in out or column not in out[name].columns:
                continue
            there = out[target].select(F.col("id").alias("_there")).where("_there IS NOT NULL").distinct()
            rows = out[name].join(there, F.col(column) == F.col("_there"), "left")
            out[name] = rows.select(*[F.col("_there").cast(out[name].schema[c].dataType).alias(c) if c == column else F.col(c) for c in out[name].columns])
    return out


def enforced(tables: Tables) -> Tables:
    """``tables`` fit to be written: references cleared; raises ``ConstraintError`` where another rule is broken."""
    found = violations(tables).orderBy("table", "rule").collect()
    if found:
        raise ConstraintError("; ".join(f"{r.table}: {r.rule} broken by {r.rows} rows" for r in found))
    return references_cleared(tables)
