"""Resumable batches: target selection, state changes and summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.ingest import process
from loomwork.plans.lineage import written

#: States from which a target may be taken; ``running`` is left out unless asked for.
OPEN = ("pending", "failed")


def targets(publications: DataFrame, status: DataFrame, max_attempts: int = 3, limit: int | None = None, domains: list[str] | None = None, include_running: bool = False) -> DataFrame:
    """``(domain, substack_id, attempts)`` to work on next, longest untouched first (JN-10, FLT-6, FLT-7, SRT-5)."""
    rows = publications.where("trim(coalesce(domain, '')) <> ''")
    if domains:
        rows = rows.where(F.col("domain").isin([d.strip().lower() for d in domains]))
    s = status.select("domain", "status", "attempts", "updated_at")
    open_states = [*OPEN, "running"] if include_running else list(OPEN)
    rows = rows.join(s, "domain", "left").where((F.col("status").isNull() | F.col("status").isin(open_states)) & (F.coalesce("attempts", F.lit(0)) < max_attempts))
    order = F.coalesce("updated_at", "first_seen", F.lit(""))
    out = rows.select("domain", "substack_id", F.coalesce("attempts", F.lit(0)).alias("attempts"), order.alias("touched"))
    return out if limit is None else out.orderBy("touched", "domain").limit(limit)


def changed(status: DataFrame, outcomes: DataFrame, at: str) -> DataFrame:
    """The status table after ``outcomes (domain, outcome, error)`` (DML-11).

    ``started`` counts an attempt and sets running; ``succeeded`` clears the error; ``failed`` keeps its text;
    ``seeded`` adds a pending row where there is none.  Times of the last attempt and success are kept where the table has
    them; its other columns stay as they are.
    """
    o = outcomes.select("domain", "outcome", F.col("error").alias("_error"))
    both = status.join(o, "domain", "full_outer")
    hit, new = F.col("outcome").isNotNull(), F.col("status").isNull()
    seeded = F.col("outcome") == "seeded"
    moves = hit & ~(seeded & ~new)
    state = F.when(F.col("outcome") == "started", "running").when(seeded, F.coalesce("status", F.lit("pending"))).otherwise(F.col("outcome"))
    began, ended = F.col("outcome") == "started", F.col("outcome") == "succeeded"
    values = {
        "status": F.when(moves, state).otherwise(F.col("status")),
        "attempts": F.coalesce("attempts", F.lit(0)) + F.when(began, 1).otherwise(0),
        "last_error": F.when(ended, F.lit(None)).when(F.col("outcome") == "failed", F.col("_error")).otherwise(F.col("last_error")),
        "updated_at": F.when(moves, F.lit(at)).otherwise(F.col("updated_at")),
    }
    for column, when in (("last_attempt_at", began), ("last_success_at", ended)):
        if column in status.columns:
            values[column] = F.when(when, F.lit(at)).otherwise(F.col(column))
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in status.columns])


def summary(status: DataFrame) -> DataFrame:
    """``(status, domains)`` (AGG-12)."""
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("domains"))


def run_log(runs: DataFrame) -> DataFrame:
    """The latest row of each run id (DML-12)."""
    return runs.groupBy("id").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "id"]), "at").alias("r")).select("id", "r.*")


def retried(queue: DataFrame, recovered: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(queue with recovered domains crawled, rows for the table of recovered domains) (STR-8, DML-13)."""
    hit = recovered.select("domain", F.lit(True).alias("_hit")).dropDuplicates(["domain"])
    back = queue.join(hit, "domain", "left")
    status = F.when(F.col("_hit") & (F.col("status") == "failed"), "crawled").otherwise(F.col("status"))
    log = queue.where("status = 'failed'").join(hit.select("domain"), "domain", "left_semi").select("domain", F.lit(at).alias("unfailed_at"))
    return back.select(*[status.alias(c) if c == "status" else F.col(c) for c in queue.columns]), log


def unfailed_rows(log: DataFrame) -> DataFrame:
    """SRT-6: recovered domains, the earliest first."""
    return log.select("domain", "unfailed_at").orderBy("unfailed_at", "domain")


@dataclass(frozen=True)
class Batch:
    """The tables after a batch and its numbers of publications."""

    tables: dict[str, DataFrame]
    selected: int
    succeeded: int
    failed: int
    skipped: int


def preview(chosen: DataFrame, shown: int = 20) -> str:
    """SNK-17: what a batch would take, nothing written: the first ``shown`` of ``targets`` and how many more there are."""
    total = chosen.count()
    rows = chosen.orderBy("touched", "domain").limit(shown).collect()
    lines = [f"Dry run: selected {total} publication(s).", *[f"  {r.domain} attempts={r.attempts} publication_substack_id={r.substack_id or ''}" for r in rows]]
    return "\n".join(lines + ([f"  ... and {total - shown} more"] if total > shown else []))


def seeded(status: DataFrame, chosen: DataFrame, at: str) -> DataFrame:
    """The status table with a pending row for each target that has none; nothing is worked on."""
    return changed(status, chosen.select("domain", F.lit("seeded").alias("outcome"), F.lit(None).cast("string").alias("error")), at)


def batch(
    tables: dict[str, DataFrame],
    landed: DataFrame,
    threads: DataFrame,
    at: str,
    post_limit: int = 3,
    stop_on_error: bool = False,
    commit: Callable[[dict[str, DataFrame]], None] | None = None,
    notes: str | None = None,
    **selection,
) -> Batch:
    """STR-3: one batch over ``targets(**selection)`` with what a fetcher has landed for them.

    ``landed (domain, payload, error)`` has at most one row for each domain: an archive, or the error met in its place.  A
    target without a row was not fetched yet and is skipped, its state unchanged.  The others count an attempt each
    and end as succeeded or failed; a failed one is a target again until its attempts reach ``max_attempts``.
    With ``stop_on_error`` the first failure in the order of targets is the last one worked on.  ``commit`` gets the tables
    twice: with the started targets running, and at the end, so a stopped batch shows what it was at.
    The run's row is added to ``comment_ingestion_runs``.
    """
    status = tables["comment_publication_status"]
    chosen = written(targets(tables["publications"], status, **selection))
    rows = chosen.select("domain", "touched").join(landed, "domain")
    if stop_on_error:
        place = F.struct("touched", "domain")
        first = rows.where("error IS NOT NULL").agg(F.min(place).alias("_first"))
        rows = rows.join(F.broadcast(first), F.col("_first").isNull() | (place <= F.col("_first"))).drop("_first")
    rows = written(rows)
    started = written(changed(status, rows.select("domain", F.lit("started").alias("outcome"), F.lit(None).cast("string").alias("error")), at))
    if commit is not None:
        commit({**tables, "comment_publication_status": started})
    n = rows.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("bad"), F.max("error").alias("error")).first()
    done = tables
    if n.ok:
        archives = rows.where("error IS NULL").select(F.col("domain").alias("publication"), "payload")
        done, _ = process(tables, archives, threads, at, post_limit)
    ends = rows.select("domain", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("outcome"), "error")
    after = written(changed(started, ends, at))
    selected = chosen.count()
    state = "succeeded" if not n.bad else ("failed" if stop_on_error else "completed_with_errors")
    runs = tables["comment_ingestion_runs"]
    values = {
        "started_at": at,
        "finished_at": at,
        "mode": "domain-list" if selection.get("domains") else "pilot",
        "status": state,
        "post_limit": post_limit,
        "target_limit": selection.get("limit"),
        "delay_seconds": 0.0,
        "error": n.error if state == "failed" else None,
        "notes": notes,
    }
    run = runs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", *[F.lit(v).cast(runs.schema[c].dataType).alias(c) for c, v in values.items()])
    result = {**done, "comment_publication_status": after, "comment_ingestion_runs": written(runs.unionByName(run))}
    if commit is not None:
        commit(result)
    return Batch(result, selected, n.ok, n.bad, selected - n.ok - n.bad)
