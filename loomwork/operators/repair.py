"""Deterministic repairs of what the audit finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.audit import all_zero, audit
from loomwork.operators.merge import fill_parent_external
from loomwork.plans.lineage import cut

Tables = dict[str, DataFrame]
MOST_ROUNDS = 3


def missing_sources(recommendations: DataFrame, publications: DataFrame) -> DataFrame:
    """REP-1: ``(domain)`` of edge sources without a publication, each once."""
    sources = recommendations.select(F.col("source_domain").alias("domain")).where("trim(coalesce(domain, '')) <> ''").distinct()
    return sources.join(publications.select("domain"), "domain", "left_anti")


def missing_crawled(queue: DataFrame, publications: DataFrame) -> DataFrame:
    """REP-2: ``(domain)`` of crawled queue rows without a publication."""
    crawled = queue.where("status = 'crawled' AND trim(coalesce(domain, '')) <> ''").select("domain").distinct()
    return crawled.join(publications.select("domain"), "domain", "left_anti")


def with_placeholders(publications: DataFrame, domains: DataFrame, first_seen: str | None) -> DataFrame:
    """``publications`` and a bare row for each of ``domains``."""
    known = {"domain": F.col("domain"), "first_seen": F.lit(first_seen)}
    rows = domains.select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in publications.dtypes])
    return publications.unionByName(rows)


def revived_queue(queue: DataFrame, publications: DataFrame) -> DataFrame:
    """REP-3: failed rows whose publication is there are crawled."""
    there = publications.select("domain", F.lit(True).alias("_there")).dropDuplicates(["domain"])
    status = F.when((F.col("status") == "failed") & F.col("_there"), "crawled").otherwise(F.col("status"))
    return queue.join(there, "domain", "left").select(*[status.alias(c) if c == "status" else F.col(c) for c in queue.columns])


def linked_parents(comments: DataFrame) -> DataFrame:
    """REP-5, DML-9: the parent's id from its external id where it resolves."""
    parents = comments.where("external_comment_id IS NOT NULL").groupBy(F.col("external_comment_id").alias("_external")).agg(F.min("id").alias("_resolved"))
    joined = comments.join(parents, F.col("parent_external_comment_id") == F.col("_external"), "left")
    return joined.select(*[F.coalesce("_resolved", "parent_comment_id").alias(c) if c == "parent_comment_id" else F.col(c) for c in comments.columns])


def repaired(tables: Tables, first_seen: str | None = None) -> Tables:
    """All repairs in order; later ones see what earlier ones added."""
    out = dict(tables)
    if {"publications", "recommendations"} <= set(out):
        out["publications"] = with_placeholders(out["publications"], missing_sources(out["recommendations"], out["publications"]), first_seen)
    if {"publications", "queue"} <= set(out):
        out["publications"] = with_placeholders(out["publications"], missing_crawled(out["queue"], out["publications"]), first_seen)
        out["queue"] = revived_queue(out["queue"], out["publications"])
    if "comments" in out:
        out["comments"] = linked_parents(fill_parent_external(out["comments"]))
    return out


def audit_and_repair(spark: SparkSession, tables: Tables, first_seen: str | None = None, rounds: int = MOST_ROUNDS) -> tuple[Tables, DataFrame]:
    """REP-6: audit, and repair and audit again while something is wrong, at most ``rounds`` repairs."""
    report = cut(audit(spark, tables))
    for _ in range(rounds):
        if all_zero(report):
            break
        tables = {name: cut(t) for name, t in repaired(tables, first_seen).items()}
        report = cut(audit(spark, tables))
    return tables, report
