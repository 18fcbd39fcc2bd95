"""Rule-based classification of probes, profiles, recommendations and topics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.text import host, normalize_handle, recommendation_url, snapped_topic, topic_prompt, ui_guess
from loomwork.plans.shipping import ship


def probe_class() -> Column:
    """FN-23 over ``homepage_url`` and status, final url and error of three probes.

    A redirect to another host comes first, over all probes; then the probes in order; then errors.
    """
    kinds = ("publication", "archive", "homepage")
    base = host("homepage_url")
    moved = F.lit(False)
    for k in kinds:
        final = host(f"{k}_final_url")
        moved = moved | ((final != "") & (final != base))
    failed = F.lit(False)
    for k in kinds:
        failed = failed | (F.coalesce(f"{k}_error", F.lit("")) != "")
    return (
        F.when(moved, "redirected_elsewhere")
        .when(F.col("publication_status") == 200, "publication_api_ok")
        .when(F.col("archive_status") == 200, "archive_ok")
        .when(F.col("homepage_status") == 200, "homepage_up")
        .when(failed, "network_error")
        .otherwise("crawler_still_failed")
    )


def class_counts(rows: DataFrame, label: str = "class") -> DataFrame:
    """``(class, rows)`` by descending number, then name (AGG-9)."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), label)


PROFILE = "struct<id:string,hasPosts:boolean,primaryPublication:struct<id:string>,publicationUsers:array<struct<user_id:string,publication_id:string,role:string,publication:struct<id:string>>>>"


def owners(profiles: DataFrame, payload: str = "payload") -> DataFrame:
    """``profiles`` with ``is_owner, publication_id, role`` from a profile's JSON (CLS-1).

    Only rows of the profile's own user count (all rows if the profile has no id), and only up to the first
    admin row; roles are compared in lower case and not trimmed.  The owner has posts and an admin row, whose publication, if it
    names one, is theirs; else the primary publication or the first that any of the rows names is given.  The role is the
    first non-empty one.  A payload that is null or no JSON gives 0 and nulls.
    """
    rows = F.coalesce("_p.publicationUsers", F.array().cast(PROFILE.partition("publicationUsers:")[2][:-1]))
    p = profiles.withColumn("_p", F.from_json(payload, PROFILE))
    p = p.withColumn("_own", F.filter(rows, lambda r: F.col("_p.id").isNull() | (F.col("_p.id") == r["user_id"])))
    place = F.array_position(F.transform("_own", lambda r: F.lower(F.coalesce(r["role"], F.lit("")))), "admin")
    p = p.withColumn("_admin", F.coalesce(place, F.lit(0)).cast("int"))
    p = p.withColumn("_seen", F.when(F.col("_admin") > 0, F.slice("_own", F.lit(1), F.col("_admin"))).otherwise(F.col("_own")))
    named = F.transform("_seen", lambda r: F.coalesce(F.nullif(r["publication_id"], F.lit("")), r["publication"]["id"]))
    of_admin = F.when(F.col("_admin") > 0, F.get(named, F.col("_admin") - 1))
    any_named = F.get(F.array_compact(named), F.lit(0))
    roles = F.filter(F.transform("_seen", lambda r: F.lower(F.coalesce(r["role"], F.lit("")))), lambda r: r != "")
    owner = F.coalesce(F.col("_p.hasPosts"), F.lit(False)) & (F.col("_admin") > 0)
    return p.select(
        *profiles.columns,
        owner.cast("int").alias("is_owner"),
        F.coalesce(of_admin, F.col("_p.primaryPublication.id"), any_named).alias("publication_id"),
        F.get(roles, F.lit(0)).alias("role"),
    )


def profile_targets(users: DataFrame, order: str = "position", most: int = -1) -> DataFrame:
    """``(handle, position)``: distinct handles in order of first appearance, at most ``most`` (SRT-10, SET-7)."""
    handles = users.select(F.coalesce(normalize_handle("handle"), normalize_handle("profile_url")).alias("handle"), F.col(order).alias("position")).where("handle IS NOT NULL")
    firsts = handles.groupBy("handle").agg(F.min("position").alias("position"))
    return firsts if most < 0 else firsts.orderBy("position").limit(most)


def classify_users(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Users with what their handle's profile says (JN-19, DML-8): new values win, the owner flag stays raised."""
    found = owners(profiles).select(normalize_handle("handle").alias("_handle"), F.col("is_owner").alias("_owner"), F.col("publication_id").alias("_publication"), F.col("role").alias("_role"))
    key = F.coalesce(normalize_handle("handle"), normalize_handle("profile_url"))
    rows = users.withColumn("_key", key).join(found, F.col("_key") == F.col("_handle"), "left")
    values = {"publication_substack_id": F.coalesce("_publication", "publication_substack_id"), "publication_role": F.coalesce("_role", "publication_role"), "is_publication_owner": F.greatest(F.coalesce("is_publication_owner", F.lit(0)), F.coalesce("_owner", F.lit(0)))}
    changed = F.lit(False)
    for c, v in values.items():
        changed = changed | ~v.eqNullSafe(F.col(c))
    return rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in users.columns], (F.col("_handle").isNotNull() & changed).alias("updated"), F.col("_handle").isNotNull().alias("resolved"))


def classification_counts(classified: DataFrame) -> DataFrame:
    """``(candidates, resolved, updated, owners)`` (AGG-17)."""
    return classified.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("resolved").alias("resolved"), F.count_if("updated").alias("updated"), F.count_if(F.col("resolved") & (F.col("is_publication_owner") == 1)).alias("owners"))


def recommendations_of(payloads: DataFrame, as_people: bool = False, payload: str = "payload") -> DataFrame:
    """``(source, url, guess)`` from recommendation payloads; those without a url are dropped (FN-21, FN-22)."""
    field = lambda k: F.get_json_object(payload, f"$.recommendedPublication.{k}")
    rows = payloads.select("source", recommendation_url(field("custom_domain"), field("subdomain")).alias("url"), ui_guess(field("is_personal_mode") == "true", as_people).alias("guess"))
    return rows.where("url IS NOT NULL")


def only_guessed(recommendations: DataFrame, guess: str | None = None) -> DataFrame:
    """FLT-9: ``person`` or ``publication`` recommendations alone; all without a guess."""
    return recommendations if guess is None else recommendations.where(F.col("guess") == guess)


def guess_counts(recommendations: DataFrame) -> DataFrame:
    """Counts by guess for each source and, with a null source, over all (AGG-10)."""
    counts = [F.count_if(F.col("guess") == g).alias(g) for g in ("person", "publication", "unknown")]
    return recommendations.rollup("source").agg(F.count(F.lit(1)).alias("recommendations"), *counts)


Labeller = Callable[[list[str]], list[str]]


def publications_to_label(publications: DataFrame, limit: int | None = None) -> DataFrame:
    """SRC-19: ``(domain, name, description)`` in the order of domains, the first ``limit`` if one is given."""
    rows = publications.select("domain", "name", "description").orderBy("domain")
    return rows if limit is None else rows.limit(limit)


def label_topics(publications: DataFrame, labels: list[str], labeller: Labeller, exact_first: bool = False) -> DataFrame:
    """``(domain, topic)`` by an external labeller over prompt texts, snapped to the given labels (CLS-3)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"domain": batch["domain"], "raw": labeller(batch["prompt"].tolist())})

    ship(publications.sparkSession)
    prompts = publications.select("domain", topic_prompt().alias("prompt"))
    return prompts.mapInPandas(run, "domain string, raw string").select("domain", snapped_topic("raw", labels, exact_first).alias("topic"))


def keep_first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def reused_probes(failed: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(failed rows with a logged probe, failed rows still to probe) by ``homepage_url`` (JN-14, SET-6)."""
    return failed.join(log, "homepage_url"), failed.join(log.select("homepage_url"), "homepage_url", "left_anti")
