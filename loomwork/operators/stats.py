"""Rank distributions and power-law fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.text import scaled_size


def ranked(listed: DataFrame, value: str = "pagerank", name: str = "domain") -> DataFrame:
    """``(rank, domain, pagerank)`` from 1 by descending value, then name (WIN-6).

    Numbering all rows needs a global order.  Rows are sorted by range over all partitions and each partition's
    numbers start after the rows of the ones before it, so no task sees more than its own range.
    """
    keyed = listed.select(F.col(value).alias("pagerank"), F.col(name).alias("domain"))
    placed = keyed.repartitionByRange(F.desc("pagerank"), F.asc("domain")).sortWithinPartitions(F.desc("pagerank"), "domain")
    placed = placed.select("domain", "pagerank", F.spark_partition_id().alias("part"))
    inside = placed.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("pagerank"), "domain")))
    counts = inside.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("base"))
    return inside.join(before, "part").select((F.col("base") + F.col("n")).alias("rank"), "domain", "pagerank")


def power_law(points: DataFrame) -> DataFrame:
    """``(n, c, alpha, r_squared)`` of value = c * rank^-alpha over the positive values (ST-1, ST-2).

    Fewer than two points, or a constant value, give zeros for what can't be fitted.
    """
    logs = points.where("pagerank > 0").select(F.log(F.col("rank").cast("double")).alias("x"), F.log("pagerank").alias("y"))
    fit = logs.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("cut"), F.regr_r2("y", "x").alias("r2"), F.var_pop("y").alias("spread"))
    enough = F.col("n") >= 2
    return fit.select(
        "n",
        F.when(enough, F.exp("cut")).otherwise(F.lit(0.0)).alias("c"),
        F.when(enough, -F.col("slope")).otherwise(F.lit(0.0)).alias("alpha"),
        F.when(enough & (F.col("spread") > 0), F.col("r2")).otherwise(F.lit(0.0)).alias("r_squared"),
    )


def fitted_line(points: DataFrame, fit: DataFrame, steps: int = 250) -> DataFrame:
    """``(rank, value)`` at ``steps + 1`` even places from the first to the last rank (ST-3); none unless alpha > 0."""
    ends = points.agg(F.max("rank").alias("last"))
    both = ends.join(F.broadcast(fit.where("alpha > 0")), F.lit(True))
    at = both.select("c", "alpha", "last", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    place = 1 + (F.col("last") - 1) * F.col("k") / steps
    return at.select(place.alias("rank"), (F.col("c") * F.pow(place, -F.col("alpha"))).alias("value"))


def chart_sample(points: DataFrame, all_up_to: int = 1000, then_every: int = 100) -> DataFrame:
    """Points a chart draws: the first ranks, then every hundredth (SRT-8)."""
    return points.where((F.col("rank") <= all_up_to) | ((F.col("rank") - all_up_to - 1) % then_every == 0))


def sizes(nodes: DataFrame, value: str = "pr") -> DataFrame:
    """``nodes`` with a drawing ``size`` scaled between their least and largest value (FN-11, AGG-13)."""
    ends = nodes.agg(F.min(value).alias("_least"), F.max(value).alias("_most"))
    return nodes.join(F.broadcast(ends), F.lit(True)).withColumn("size", scaled_size(value, "_least", "_most")).drop("_least", "_most")
