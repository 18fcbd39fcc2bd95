"""URL filter by trust and distrust on the link graph.

Every url is first held against explicit rules.  Where none fits, its host's place in the link graph decides:
personalised PageRank spreads trust from hosts with allowed pages along links, and distrust from hosts with
blocked pages against them (who links to bad hosts is suspect).  Both start from numbers of pages, so the two
masses of a host can be compared with each other and with its own number of pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.plans.lineage import cut

DAMPING = 0.85
ROUNDS = 20
#: A cut of the lineage every so many rounds.
CUT_EVERY = 5
#: A host is blocked if distrust is at least this share of its trust and distrust together ...
DISTRUST_SHARE = 0.5
#: ... and at least this much for each of its pages.
DISTRUST_PER_PAGE = 0.05

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``host/path``: fits the host and its subdomains if the url's path starts with the rule's."""

    text: str
    allow: bool

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for other urls."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, allowed)``; the longest fitting rule wins, null where none fits.

    The rules are configuration: they are compiled into one expression.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    chosen = F.lit(None).cast("struct<rule:string,allowed:boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        chosen = F.when(rule.fits(F.col("host"), F.col("path")), F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.allow).alias("allowed"))).otherwise(chosen)
    return rows.withColumn("r", chosen).select("page_id", "host", "path", "r.rule", "r.allowed")


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst, links)``: pages of ``src`` with an absolute link to another host ``dst``, each page once for a host."""
    rows = pages.select(host_of(F.col(url_col).cast("string")).alias("src"), F.col(html_col).cast("string").alias("html")).where("html IS NOT NULL AND src <> ''")
    targets = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""), F.lit(1))
    links = rows.select("src", F.explode(F.array_distinct(F.transform(targets, lambda h: F.translate(h, _UPPER, _LOWER)))).alias("dst"))
    return links.where("src <> dst AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank of both kinds: ``(kind, host, mass)``.

    ``seeds`` has ``(kind, host, mass)`` with kind ``trust`` or ``distrust`` and each (kind, host) once.  Trust
    follows the links, distrust runs against them; a host without onward links gives its mass back to the seeds
    in proportion.  The whole mass of a kind stays that of its seeds.
    """
    forward = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "links")
    both = forward.union(backward)
    out = both.groupBy("kind", "host").agg(F.sum("links").alias("all_links"))
    edges = cut(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("all_links")).alias("share")))
    if edges.isEmpty():
        return seeds.select("kind", "host", "mass")
    ends = cut(out.select("kind", "host"))
    # The tables by kind have two rows, so broadcasting them is bounded.
    totals = F.broadcast(seeds.groupBy("kind").agg(F.sum("mass").alias("total")))
    seeds = cut(seeds.join(totals, "kind").select("kind", "host", F.col("mass").alias("seed"), "total"))
    mass = seeds.select("kind", "host", F.col("seed").alias("mass"))
    for k in range(1, rounds + 1):
        moved = edges.join(mass, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("mass") * F.col("share")).alias("moved"))
        stuck = mass.join(ends, ["kind", "host"], "left_anti").groupBy("kind").agg(F.sum("mass").alias("stuck"))
        back = seeds.join(F.broadcast(stuck), "kind", "left").select("kind", "host", ((1 - damping) * F.col("seed") + damping * F.coalesce("stuck", F.lit(0.0)) * F.col("seed") / F.col("total")).alias("back"))
        mass = back.join(moved, ["kind", "host"], "full").select("kind", "host", (F.coalesce("back", F.lit(0.0)) + damping * F.coalesce("moved", F.lit(0.0))).alias("mass"))
        if k % CUT_EVERY == 0 or k == rounds:
            mass = cut(mass)
    return mass


def judged(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for every row of ``pages``.

    ``rule`` is null and ``verdict`` (allow or block) that of the host where no rule fits.  Hosts that no
    mass reaches, and the empty host of null and malformed urls, are allowed.  A null html has no links.  Repeated
    rows stay, and count as pages; other columns are ignored; an empty table gives an empty result.
    """
    marked = with_rules(pages, rules, id_col, url_col)
    hosts = cut(marked.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if("allowed").alias("trust"), F.count_if(~F.col("allowed")).alias("distrust")))
    seeds = hosts.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, n)")).where("n > 0").select("kind", "host", F.col("n").cast("double").alias("mass"))
    mass = spread(seeds, host_links(pages, url_col, html_col))
    sides = mass.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    scored = hosts.select("host", "pages").join(sides, "host", "left").select("host", "pages", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    bad = (F.col("distrust") >= DISTRUST_SHARE * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") >= DISTRUST_PER_PAGE * F.col("pages"))
    # Cut, so that both sides of the join below are dealt for it alone and a host with many pages can be split.
    scored = cut(scored.select("host", "trust", "distrust", bad.alias("bad")))
    allowed = F.coalesce(F.col("allowed"), ~F.col("bad"), F.lit(True))
    verdict = F.when(allowed, "allow").otherwise("block")
    return marked.join(scored, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
