"""The resumable crawl: waves of pending domains against responses that a fetcher has landed.

All pending domains of the smallest depth are one wave.  What a wave enqueues lies one deeper, so taking it at once gives what
taking its domains one by one, nearest first, gives.  The state is cut from its lineage after each wave, and ``commit`` is
handed every wave's state, so a stopped crawl goes on from the last committed one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import normalize_domain
from loomwork.operators.merge import add_edges, set_status, upsert_publications, upsert_queue, with_new_ids
from loomwork.plans.lineage import written


@dataclass(frozen=True)
class State:
    """The tables of a crawl and what it has done so far."""

    publications: DataFrame
    recommendations: DataFrame
    queue: DataFrame
    attempts: int = 0
    crawled: int = 0
    edges_added: int = 0
    targets_seen: int = 0
    enrichment_errors: tuple[str, ...] = field(default=())


def enqueued(queue: DataFrame, domains: DataFrame) -> DataFrame:
    """DML-26: ``queue`` with ``domains (domain, depth)`` merged in; rows without a domain or depth are passed over, never an error."""
    return upsert_queue(queue, domains.where("trim(coalesce(domain, '')) <> '' AND depth IS NOT NULL")).drop("action")


def resumed(queue: DataFrame, default: str, seeds: DataFrame | None = None) -> DataFrame:
    """STR-2: the queue to start from: with ``seeds (domain)`` at depth 0, or as it is, or with ``default`` if nothing is pending."""
    if seeds is not None:
        return enqueued(queue, seeds.select("domain", F.lit(0).alias("depth")))
    if queue.where("status = 'pending'").isEmpty():
        return enqueued(queue, queue.sparkSession.range(1).select(F.lit(default).alias("domain"), F.lit(0).alias("depth")))
    return queue


def next_wave(queue: DataFrame, responses: DataFrame, most_publications: int | None = None, most_attempts: int | None = None) -> DataFrame:
    """The landed responses of the pending domains of the smallest depth, with ``depth`` and ``ok``.

    A domain without a response was not fetched yet and stays pending.  Limits take domains in order: at most
    ``most_attempts``, and none after the one that makes ``most_publications`` successful.
    """
    ready = queue.where("status = 'pending'").select("domain", F.coalesce("depth", F.lit(0)).alias("depth")).join(responses, "domain")
    nearest = ready.agg(F.min("depth").alias("_nearest"))
    rows = ready.join(F.broadcast(nearest), F.col("depth") == F.col("_nearest")).drop("_nearest")
    rows = rows.withColumn("ok", F.coalesce("found", F.lit(False)) & F.col("targets").isNotNull())
    if most_attempts is not None:
        rows = rows.orderBy("domain").limit(most_attempts)
    if most_publications is not None:
        hits = rows.where("ok").select("domain").orderBy("domain").limit(most_publications)
        last = hits.agg(F.when(F.count(F.lit(1)) == most_publications, F.max("domain")).alias("_last"))
        rows = rows.join(F.broadcast(last), F.lit(True)).where("_last IS NULL OR domain <= _last").drop("_last")
    return rows


def applied(state: State, wave: DataFrame, at: str) -> State:
    """STR-1, DML-3, DML-4: ``state`` after a wave.

    A publication that was found is merged in even if its recommendations (``targets``) could not be read; its domain
    has then failed, as one that was not found has.  Targets without a domain are dropped; each other one becomes an edge,
    once, and is enqueued one deeper.
    """
    info = wave.where("found").select("domain", "substack_id", "name", "description", F.lit(at).alias("first_seen"))
    publications = upsert_publications(state.publications, info).drop("action")
    named = publications.where("id IS NOT NULL").unionByName(with_new_ids(publications.where("id IS NULL"), state.publications, ["domain"]).select(*publications.columns))
    links = wave.where("ok").select(F.col("domain").alias("source_domain"), "depth", F.explode("targets").alias("_url"))
    links = written(links.select("source_domain", "depth", normalize_domain("_url").alias("target_domain")).where("target_domain <> ''"))
    edges = add_edges(state.recommendations, links)
    if "id" in state.recommendations.columns:
        edges = with_new_ids(edges.withColumn("id", F.lit(None).cast("long")), state.recommendations, ["source_domain", "target_domain"])
    edges = written(edges)
    deeper = links.select(F.col("target_domain").alias("domain"), (F.col("depth") + 1).alias("depth"))
    queue = set_status(enqueued(state.queue, deeper), wave.where("ok"), "crawled")
    queue = set_status(queue, wave.where("NOT ok"), "failed")
    done = wave.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok")).first()
    return replace(
        state,
        publications=written(named),
        recommendations=written(state.recommendations.unionByName(edges)),
        queue=written(queue),
        attempts=state.attempts + done.n,
        crawled=state.crawled + done.ok,
        edges_added=state.edges_added + edges.count(),
        targets_seen=state.targets_seen + links.count(),
    )


def crawl(
    state: State,
    responses: DataFrame,
    at: str,
    most_publications: int | None = None,
    most_attempts: int | None = None,
    commit: Callable[[State], None] | None = None,
    enrich: Callable[[DataFrame], None] | None = None,
) -> State:
    """Waves until nothing pending has a response, or a limit is reached.

    ``responses`` has at most one row for each domain: ``(domain, found boolean, substack_id, name, description,
    targets array<string>)``.  ``enrich`` gets each wave's crawled domains after the commit; an error there is kept in
    ``enrichment_errors`` and changes no status (STR-4).
    """
    while True:
        left = None if most_attempts is None else most_attempts - state.attempts
        wanted = None if most_publications is None else most_publications - state.crawled
        if (left is not None and left <= 0) or (wanted is not None and wanted <= 0):
            return state
        wave = written(next_wave(state.queue, responses, wanted, left))
        if wave.isEmpty():
            return state
        state = applied(state, wave, at)
        if commit is not None:
            commit(state)
        if enrich is not None:
            try:
                enrich(wave.where("ok").select("domain"))
            except Exception as error:  # Whatever fails in an enrichment, the crawl goes on.
                state = replace(state, enrichment_errors=(*state.enrichment_errors, str(error)))
