"""Text, CSV, TSV and JSON landing sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.text import normalize_domain

# Columns of the probe log.
PROBE_COLUMNS = ("homepage_url", "publication_status", "publication_final_url", "publication_error", "archive_status", "archive_final_url", "archive_error", "homepage_status", "homepage_final_url", "homepage_error", "checked_at")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(position, value)``: the lines of a text file; positions ascend within and over its splits."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("position"), "value")


def _first_each(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min("position").alias("position"))


def seed_domains(spark: SparkSession, path: str) -> DataFrame:
    """``(domain, position)`` of a seed list (SRC-6): each line's first url, without comments and encyclopedia links, each domain once."""
    lines = numbered_lines(spark, path).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    url = F.rtrim(F.regexp_extract("value", r"https?://\S+", 0), F.lit("/"))
    urls = lines.select("position", url.alias("url")).where("url <> '' AND NOT contains(lower(url), 'wikipedia.org')")
    return _first_each(urls.select("position", normalize_domain("url").alias("domain")).where("domain <> ''"), "domain")


def listed_domains(spark: SparkSession, path: str) -> DataFrame:
    """``(domain, position)`` of a domains file (SRC-7): each line's first word without schemes and path, in lower case.

    Hosts stay whole, with their port and platform suffix, as the tables that they are looked up in hold them.
    """
    lines = numbered_lines(spark, path).select("position", F.regexp_replace("value", r"^\s+", "").alias("value")).where("value <> '' AND NOT startswith(value, '#')")
    word = F.regexp_extract("value", r"^\S+", 0)
    host = F.lower(F.split_part(F.replace(F.replace(word, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("/"), F.lit(1)))
    return _first_each(lines.select("position", host.alias("domain")).where("domain <> ''"), "domain")


def failed_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(domain, depth, url)`` of a CSV file with a header (SRC-8); a missing depth is 0."""
    rows = spark.read.csv(path, header=True, schema="domain string, depth int, url string")
    return rows.select("domain", F.coalesce("depth", F.lit(0)).alias("depth"), "url")


def probe_log(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each homepage in a probe log (SRC-9); empty if the header is not the expected one.

    Lines with another number of fields are dropped.
    """
    lines = numbered_lines(spark, path)
    header = "\t".join(PROBE_COLUMNS)
    first = lines.orderBy("position").limit(1).collect()
    if not first or first[0].value != header:
        lines = lines.where(F.lit(False))
    fields = lines.where(F.col("value") != header).select("position", F.split("value", "\t").alias("f")).where(F.size("f") == len(PROBE_COLUMNS))
    typed = [F.get("f", F.lit(k)).try_cast("int").alias(c) if c.endswith("_status") else F.get("f", F.lit(k)).alias(c) for k, c in enumerate(PROBE_COLUMNS)]
    rows = fields.select("position", *typed)
    place = F.row_number().over(Window.partitionBy("homepage_url").orderBy(F.desc("position")))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place", "position")


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(payload)``: raw JSON responses that a fetcher landed, one in a line (SRC-10 to SRC-15)."""
    return spark.read.text(path).select(F.col("value").alias("payload"))


def usable_pages(pages: DataFrame, listed: Column, source: str = "source", order: str = "page", size: int = 20, most: int = 5) -> DataFrame:
    """Pages of each source before paging stops (SRC-10): at an empty or short page, ``has_more`` false or the limit.

    ``listed`` is the array of items of a page; a short page is the last one used.
    """
    n = F.coalesce(F.size(listed), F.lit(0))
    more = F.coalesce(F.get_json_object("payload", "$.has_more") != "false", F.lit(True))
    marked = pages.withColumn("_n", n).withColumn("_ends", (n < size) | ~more)
    before = Window.partitionBy(source).orderBy(order)
    ended = F.coalesce(F.max(F.col("_ends").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("_stop", ended).withColumn("_k", F.row_number().over(before)).where((F.col("_stop") == 0) & (F.col("_n") > 0) & (F.col("_k") <= most)).drop("_n", "_ends", "_stop", "_k")
