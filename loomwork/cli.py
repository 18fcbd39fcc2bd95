"""Command line: ``python -m loomwork.cli COMMAND FOLDER`` over Parquet tables of the model in a folder."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text
from loomwork.functions.text import iso_now
from loomwork.operators import audit, backfill, graph, ingest, layers, repair, stats
from loomwork.plans.lineage import cut
from loomwork.sinks import reports

TABLES = ("publications", "recommendations", "queue", "users", "posts", "comments", "comment_publication_status")


class Missing(ValueError):
    """A command's tables are not in the folder."""


def exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def load(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The named tables that are in a folder of any file system."""
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in names if exists(spark, f"{folder}/{t}.parquet")}


#: Tables without which a command can't run.
NEEDED = {
    "centrality": ("recommendations", "publications", "queue"),
    "visualize": ("recommendations", "publications"),
    "layers": ("queue",),
    "distribution": ("recommendations", "publications"),
    "failed": ("queue",),
    "comments": ("posts", "users", "comments", "archives", "threads"),
    "backfill": ("publications", "comment_publication_status"),
}


def run(spark: SparkSession, command: str, folder: str, top: int = 50, out: str | None = None) -> str:
    """The text that a command prints; files go to ``out`` if it is given."""
    t = load(spark, folder)
    landed = load(spark, folder, ("archives", "threads")) if command == "comments" else {}
    lacking = [n for n in NEEDED.get(command, ()) if n not in t and n not in landed]
    if lacking:
        raise Missing(f"{folder} has no {', '.join(f'{n}.parquet' for n in lacking)}")
    if command == "summarize":
        counts = "\n".join(f"{name}: {df.count()}" for name, df in t.items())
        by_status = "\n".join(f"queue {r.status}: {r.domains}" for r in backfill.summary(t["queue"].select("status")).orderBy("status").collect()) if "queue" in t else ""
        return f"{counts}\n{by_status}".rstrip()
    if command == "view":
        return "\n\n".join(f"{name}\n{reports.console_table(df)}" for name, df in t.items())
    if command == "export":
        for name, df in t.items():
            reports.write_csv(df, f"{out or folder}/{name}.csv")
        return f"{len(t)} tables"
    if command == "centrality":
        edges = cut(graph.edges_of(t["recommendations"]))
        ranked = cut(graph.ranking(graph.pagerank(edges), edges, t["publications"], t["queue"], top=top))
        if out:
            reports.write_csv(reports.ranking_rows(ranked).orderBy("rank"), out)
        return reports.ranking_table(ranked)
    if command == "visualize":
        edges = cut(graph.edges_of(t["recommendations"]))
        nodes = cut(stats.sizes(graph.top_nodes(graph.pagerank(edges), top)))
        names = t["publications"].select(F.col("domain").alias("node"), "name").dropDuplicates(["node"])
        shown = nodes.join(names, "node", "left").select("node", text.graph_label(text.display_name("name", "node")).alias("label"), "size", text.archive_url("node").alias("url"))
        return reports.graph_html(shown, graph.induced(edges, nodes))
    if command == "layers":
        return reports.layers_html(layers.layer_stats(t["queue"]), layers.progress(t["queue"]))
    if command == "distribution":
        edges = cut(graph.edges_of(t["recommendations"]))
        points = cut(stats.ranked(graph.publication_list(t["publications"], graph.pagerank(edges), edges)))
        return reports.distribution_json(stats.chart_sample(points), stats.power_law(points), points.count())
    if command == "failed":
        return reports.page("Failed", reports.html_table(reports.failed_rows(t["queue"])))
    if command == "audit":
        return audit.report_text(audit.audit(spark, t))
    if command == "repair":
        fixed, report = repair.audit_and_repair(spark, t)
        for name, df in fixed.items():
            df.write.mode("overwrite").parquet(f"{out or folder + '-repaired'}/{name}.parquet")
        return json.dumps({r.check: r["count"] for r in report.collect()}, sort_keys=True)
    if command == "comments":
        at = iso_now()
        result, counts = ingest.process(t, landed["archives"], landed["threads"], at)
        for name, df in result.items():
            df.write.mode("overwrite").parquet(f"{out or folder + '-ingested'}/{name}.parquet")
        return " ".join(["Comments ingested:", *[f"{k}={n}" for k, n in counts.items()]])
    if command == "backfill":
        return backfill.preview(backfill.targets(t["publications"], t["comment_publication_status"]))
    raise ValueError(f"unknown command {command}")


COMMANDS = ("summarize", "view", "export", "centrality", "visualize", "layers", "distribution", "failed", "audit", "repair", "comments", "backfill")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomwork")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("folder")
    parser.add_argument("-n", "--top", type=int, default=50)
    parser.add_argument("-o", "--out")
    args = parser.parse_args(argv)
    try:
        print(run(SparkSession.builder.appName("loomwork").getOrCreate(), args.command, args.folder, args.top, args.out))
    except Exception as error:
        print(f"{args.command}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
