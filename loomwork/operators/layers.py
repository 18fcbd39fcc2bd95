"""Growth of the network by breadth-first depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def layer_stats(queue: DataFrame) -> DataFrame:
    """``(depth, l, a, l1, l2, r, last)``: size, running total, first and second difference and ratio of each layer.

    Differences are to the previous row, whatever its depth; they and the ratio are null where there is none,
    the ratio also after an empty layer.  ``last`` marks the deepest layer, which charts leave out because it is still
    growing.  The windows run over one row for each depth.
    """
    sizes = queue.where("depth IS NOT NULL").groupBy("depth").agg(F.count(F.lit(1)).alias("l"))
    by_depth = Window.orderBy("depth")
    rows = sizes.select("depth", "l", F.sum("l").over(by_depth.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.lag("l").over(by_depth).alias("p"), F.lead("depth").over(by_depth).isNull().alias("last"))
    rows = rows.select("depth", "l", "a", (F.col("l") - F.col("p")).alias("l1"), F.round(F.try_divide("l", "p"), 6).alias("r"), "last")
    return rows.select("depth", "l", "a", "l1", (F.col("l1") - F.lag("l1").over(by_depth)).alias("l2"), "r", "last")


def peak(queue: DataFrame) -> DataFrame:
    """``(depth, l)`` of the largest layer, the shallowest of equal ones."""
    sizes = queue.where("depth IS NOT NULL").groupBy("depth").agg(F.count(F.lit(1)).alias("l"))
    return sizes.agg(F.max_by(F.struct("depth", "l"), F.struct("l", (-F.col("depth")).alias("d"))).alias("top")).select("top.depth", "top.l")


def progress(queue: DataFrame) -> DataFrame:
    """``(depth, processed, l)`` of the working layer: the shallowest with a pending row, else the deepest."""
    rows = queue.where("depth IS NOT NULL").groupBy("depth").agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status").isin("crawled", "failed")).alias("processed"),
        F.count(F.lit(1)).alias("l"),
    )
    working = F.coalesce(F.min(F.when(F.col("pending") > 0, F.col("depth"))), F.max("depth"))
    return rows.join(F.broadcast(rows.agg(working.alias("depth"))), "depth").select("depth", "processed", "l")


def saturation(queue: DataFrame) -> DataFrame:
    """``(depth, share)``: the part of the whole network reached at each depth."""
    stats = layer_stats(queue)
    return stats.select("depth", F.round(F.col("a") / F.max("a").over(Window.partitionBy()), 6).alias("share"))
