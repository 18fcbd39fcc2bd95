"""CSV, JSON, HTML and Markdown exports.

Pages show a bounded number of rows, which are what comes to the driver; tables are written by the executors.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import console_depth, console_domain, console_name, publication_url

#: Most rows that a page shows.
MOST_ROWS = 1000


def write_csv(df: DataFrame, folder: str, one_file: bool = True, sep: str = ",") -> None:
    """SNK-1 to SNK-4: with a header, null as the empty text; ``one_file`` only for small exports."""
    shown = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    (shown.coalesce(1) if one_file else shown).write.mode("overwrite").csv(folder, header=True, emptyValue="", sep=sep)


def ranking_rows(ranked: DataFrame) -> DataFrame:
    """SNK-2: rank, domain, name, pagerank with six decimals, in_degree, depth (empty if unknown)."""
    return ranked.select("rank", "domain", "name", F.format_string("%.6f", "pagerank").alias("pagerank"), "in_degree", F.coalesce(F.col("depth").cast("string"), F.lit("")).alias("depth"))


def failed_rows(queue: DataFrame) -> DataFrame:
    """SNK-3."""
    return queue.where("status = 'failed'").select("domain", "depth", publication_url("domain").alias("url")).orderBy("depth", "domain")


def distribution_json(points: DataFrame, fit: DataFrame, n_publications: int) -> str:
    """SNK-5: ``{points, power_law, n_publications}`` of sampled points."""
    rows = points.orderBy("rank").select("rank", "domain", "pagerank").collect()
    f = fit.first()
    return json.dumps({"points": [r.asDict() for r in rows], "power_law": {"c": f.c, "alpha": f.alpha, "r_squared": f.r_squared}, "n_publications": n_publications})


def console_table(df: DataFrame, limit: int = 50, width: int = 40) -> str:
    """SNK-12: the first rows, cells cut, and the total number of rows."""
    total = df.count()
    rows = [[("" if v is None else str(v))[:width] for v in r] for r in df.limit(limit).collect()]
    sizes = [min(width + 2, max(len(x) for x in column)) for column in zip(df.columns, *rows, strict=True)]
    lines = ["  ".join(x.ljust(n) for x, n in zip(r, sizes, strict=True)).rstrip() for r in [df.columns, *rows]]
    return "\n".join([lines[0], "  ".join("-" * n for n in sizes), *lines[1:], f"({total} rows)"])


def ranking_table(ranked: DataFrame) -> str:
    """SNK-15: a ranking for the console."""
    rows = ranked.select("rank", console_name("name").alias("name"), console_domain("domain").alias("domain"), F.format_string("%.6f", "pagerank").alias("pagerank"), "in_degree", console_depth("depth").alias("depth")).orderBy("rank").limit(MOST_ROWS).collect()
    return "\n".join(f"{r.rank:>4}  {r.name:<29}  {r.domain:<34}  {r.pagerank}  {r.in_degree:>6}  {r.depth}" for r in rows)


def page(title: str, body: str, back: str = "index.html") -> str:
    """SNK-18: the frame that all pages share."""
    t = html.escape(title)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{t}</title></head><body><h1>{t}</h1>{body}<p><a href="{html.escape(back)}">Back</a></p></body></html>'


def html_table(df: DataFrame, order: list | None = None) -> str:
    """All rows of a report as an HTML table (SNK-7 to SNK-10); they come to the driver a partition at a time."""
    rows = (df.orderBy(*order) if order else df).toLocalIterator()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def graph_html(nodes: DataFrame, edges: DataFrame, title: str = "Network") -> str:
    """SNK-6: an interactive page of the nodes ``(node, label, size, url)``, the caller's top, and all edges among them."""
    points = [r.asDict() for r in nodes.select("node", "label", "size", "url").orderBy("node").collect()]
    inside = edges.select("src", "dst").join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    lines = [[r.src, r.dst] for r in inside.select("src", "dst").orderBy("src", "dst").toLocalIterator()]
    data = json.dumps({"nodes": points, "edges": lines}).replace("<", "\\u003c")
    script = (
        "const place={};let frozen=false;const svg=document.getElementById('net');"
        "data.nodes.forEach((n,i)=>{const a=2*Math.PI*i/data.nodes.length;place[n.node]=[500+450*Math.cos(a),500+450*Math.sin(a)]});"
        "const add=(t,a)=>{const e=document.createElementNS('http://www.w3.org/2000/svg',t);for(const k in a)e.setAttribute(k,a[k]);svg.appendChild(e);return e};"
        "data.edges.forEach(([s,d])=>add('line',{x1:place[s][0],y1:place[s][1],x2:place[d][0],y2:place[d][1],stroke:'#ccc'}));"
        "data.nodes.forEach(n=>{const c=add('circle',{cx:place[n.node][0],cy:place[n.node][1],r:n.size/4});c.appendChild(Object.assign(document.createElementNS('http://www.w3.org/2000/svg','title'),{textContent:n.label}));"
        "c.onclick=e=>{if(e.shiftKey){frozen=!frozen}else if(!frozen){window.open(n.url)}}});"
    )
    return page(title, f'<svg id="net" viewBox="0 0 1000 1000"></svg><script>const data={data};{script}</script>')


def layers_html(stats: DataFrame, working: DataFrame) -> str:
    """SNK-8: the layer table, the chart's arrays (without the layer that still grows) and the progress."""
    rows = stats.orderBy("depth").collect()
    charts = {k: [r[k] for r in rows if not r["last"]] for k in ("depth", "l", "a", "l1", "r")}
    w = working.first()
    done = "" if w is None else f"<p>Working on depth {w.depth}: {w.processed} of {w.l} done.</p>"
    return page("Layers", html_table(stats, ["depth"]) + done + f"<script>const layers={json.dumps(charts)};</script>")


def recommendations_markdown(recommendations: DataFrame, counts: DataFrame) -> str:
    """SNK-11: for each source its counts and list, then the totals."""
    listed: dict[str, list] = {}
    for r in recommendations.orderBy("source", "url").toLocalIterator():
        listed.setdefault(r.source, []).append(r)
    out = ["# Recommendations", ""]
    rows = counts.orderBy(F.col("source").asc_nulls_last()).collect()
    for c in rows:
        out += [f"## {c.source if c.source is not None else 'All'}", "", f"{c.recommendations} recommendations: {c.person} people, {c.publication} publications, {c.unknown} unknown", ""]
        out += [f"- {r.url} ({r.guess})" for r in listed.get(c.source, [])] + [""]
    return "\n".join(out)


# The marks, headings and stated sources of a recommendation's guess.
MARKS = {"publication": "📰", "person": "👤", "unknown": "❓"}
HEADINGS = {"publication": "Best-Effort Publications", "person": "Best-Effort People"}
SOURCES = {
    "person": "best-effort from recommendedPublication.is_personal_mode=true",
    "publication": "best-effort from recommendedPublication.is_personal_mode=false",
    "unknown": "no reliable public UI-split signal present",
}
FORCED = "forced via --as-people"


def recommendation_lines(recommendations: DataFrame, as_people: bool = False) -> DataFrame:
    """``recommendations (guess, url)`` with ``line``: mark, guess, where the guess is from and url, parted by tabs."""
    by_guess = lambda names: F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("guess"))
    source = F.lit(FORCED) if as_people else by_guess(SOURCES)
    return recommendations.withColumn("line", F.concat_ws("\t", by_guess(MARKS), "guess", source, "url"))


def recommendation_listing(recommendations: DataFrame, order: list[str], guess: str | None = None, separate: bool = False, as_people: bool = False) -> Iterator[str]:
    """SNK-16: the lines of one guess, of all recommendations, or of two sections; they come a partition at a time."""
    lines = recommendation_lines(recommendations, as_people)
    if not separate:
        wanted = lines if guess is None else lines.where(F.col("guess") == guess)
        yield from (r.line for r in wanted.orderBy(*order).select("line").toLocalIterator())
        return
    for k, (kind, heading) in enumerate(HEADINGS.items()):
        yield from ([""] if k else []) + [f"=== {MARKS[kind]} {heading} ==="]
        yield from (f"  {r.line}" for r in lines.where(F.col("guess") == kind).orderBy(*order).select("line").toLocalIterator())


def failed_list(spark: SparkSession, folder: str, queue: DataFrame | None) -> DataFrame | None:
    """SRC-18: the failed list in ``folder``; one that is missing is written from ``queue``; None if there is no queue either."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        if queue is None:
            return None
        write_csv(failed_rows(queue), folder)
    return spark.read.csv(folder, header=True, schema="domain string, depth int, url string")
