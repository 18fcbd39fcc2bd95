"""Schema state of a set of model tables: what tables there should be, their version, and what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.merge import migrate_legacy
from loomwork.plans.locks import NotReady

Tables = dict[str, DataFrame]

# The version of the model and the columns of its core and version tables, in order.
VERSION = 3
CORE = {
    "publications": "id long, substack_id string, name string, domain string, description string, first_seen string",
    "recommendations": "id long, source_domain string, target_domain string",
    "queue": "domain string, status string, depth int",
    "users": "id long, external_user_id string, name string, handle string, profile_url string, publication_substack_id string, publication_role string, is_publication_owner int, first_seen string, last_seen string",
    "posts": "id long, external_post_id string, publication_substack_id string, title string, url string, published_at string, first_seen string, last_seen string",
    "comments": "id long, external_comment_id string, post_id long, user_id long, parent_comment_id long, parent_external_comment_id string, body string, commented_at string, raw_json string, first_seen string, last_seen string",
}
SIDE = {
    "schema_version": "singleton int, version int, updated_at string",
    "schema_migrations": "version string, applied_at string",
    "comment_ingestion_runs": "id long, started_at string, finished_at string, mode string, status string, post_limit int, target_limit int, delay_seconds double, error string, notes string",
    "comment_publication_status": "domain string, publication_substack_id string, status string, attempts int, last_attempt_at string, next_retry_at string, last_success_at string, posts_seen int, posts_created int, posts_updated int, users_seen int, users_created int, users_updated int, comments_fetched int, comments_unique int, comments_created int, comments_updated int, last_error string, updated_at string",
    "backfill_lock": "id int, is_locked int, locked_at string, owner_pid int",
}
EXPECTED = {**CORE, **SIDE}


class NewerSchema(RuntimeError):
    """The tables were written by a later version."""


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in EXPECTED[name].split(", ")]


def version(tables: Tables) -> int | None:
    """The recorded version; None without a record."""
    if "schema_version" not in tables:
        return None
    row = tables["schema_version"].where("singleton = 1").select("version").first()
    return None if row is None else int(row.version)


def with_version(spark: SparkSession, tables: Tables, number: int, at: str) -> Tables:
    """DML-23: the one version row replaced, and the migration's row added or renewed."""
    old = tables.get("schema_migrations", spark.createDataFrame([], SIDE["schema_migrations"]))
    mark = spark.range(1)
    migrations = old.where(F.col("version") != str(number)).unionByName(mark.select(F.lit(str(number)).alias("version"), F.lit(at).alias("applied_at")))
    record = mark.select(F.lit(1).alias("singleton"), F.lit(number).alias("version"), F.lit(at).alias("updated_at"))
    return {**tables, "schema_version": record, "schema_migrations": migrations}


def healed(spark: SparkSession, tables: Tables, at: str) -> Tables:
    """DML-22: missing tables created empty, present ones left as they are, the version and a free lock row recorded."""
    missing = {n: spark.createDataFrame([], s) for n, s in EXPECTED.items() if n not in tables}
    tables = with_version(spark, {**missing, **tables}, VERSION, at)
    if tables["backfill_lock"].where("id = 1").isEmpty():
        free = spark.range(1).select(F.lit(1).alias("id"), F.lit(0).alias("is_locked"), F.lit(None).cast("string").alias("locked_at"), F.lit(None).cast("int").alias("owner_pid"))
        tables["backfill_lock"] = tables["backfill_lock"].unionByName(free)
    return tables


def require_ready(tables: Tables) -> None:
    """DML-21: raises ``NotReady`` unless the tables of an ingest, version, migration and lock row are there."""
    wrong = [n for n in EXPECTED if n not in tables]
    if not wrong:
        if version(tables) != VERSION or tables["schema_migrations"].where(F.col("version") == str(VERSION)).isEmpty():
            wrong.append(f"version {VERSION}")
        if tables["backfill_lock"].where("id = 1 AND is_locked IN (0, 1)").isEmpty():
            wrong.append("lock row")
    if wrong:
        raise NotReady("missing: " + ", ".join(wrong))


def differing(tables: Tables) -> list[str]:
    """SET-8: expected tables that are missing or have other columns or another order of them."""
    return [n for n in EXPECTED if n not in tables or tables[n].columns != _columns(n)]


def anomalies(tables: Tables) -> dict[str, int]:
    """AUD-26 to AUD-28, without reading a data table."""
    found = version(tables)
    return {"schema_version_missing": int(found is None), "schema_version_mismatch": int(found not in (None, VERSION)), "schema_drift_tables": len(differing(tables))}


def current(tables: Tables) -> bool:
    return not any(anomalies(tables).values())


def ensured(spark: SparkSession, tables: Tables, at: str) -> tuple[Tables, bool]:
    """DML-16, REP-0: ``(tables of the current schema, whether anything was done)``.

    Nothing there: all tables, empty.  Core tables without a version: the legacy migration, then columns put in order.
    An older or partly applied version: missing tables created.  A newer one raises ``NewerSchema``.
    """
    if current(tables):
        return tables, False
    found = version(tables)
    if found is not None and found > VERSION:
        raise NewerSchema(f"the tables have schema version {found}, later than {VERSION}")
    if found is None and set(tables) & set(CORE):
        tables = {n: _reshaped(df, n) if n in CORE else df for n, df in migrate_legacy(tables).items()}
    return healed(spark, tables, at), True


def _reshaped(table: DataFrame, name: str) -> DataFrame:
    have = set(table.columns)
    fields = [f.split() for f in CORE[name].split(", ")]
    return table.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields])
