"""Incremental ingest of landed comment payloads with Structured Streaming.

Each micro-batch of a landing folder is parsed, deduplicated and merged into a hash-bucketed table: only the buckets that
its comments fall into are read and written again, and the table's rows are not shuffled.  ``availableNow`` makes a run a
resumable batch.  The batch's number is committed with its rows, so a batch that is replayed after a crash changes nothing (STR-6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.operators.comments import comments_of, deduped
from loomwork.operators.merge import COMMENT_RULES, merge
from loomwork.sinks.snapshots import SnapshotTable

COLUMNS = ("external_comment_id", "parent_external_comment_id", "external_user_id", "body", "commented_at", "raw_json", "first_seen", "last_seen")
KEYS = ["external_comment_id"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


def arrived(payloads: DataFrame, at: str) -> DataFrame:
    """One row for each comment of a batch of payloads."""
    keyed = payloads.withColumn("payload_id", F.xxhash64("payload"))
    rows = comments_of(keyed).where("coalesce(external_comment_id, '') <> ''")
    seen = deduped(rows, ["payload_id", "path"]).withColumns({"first_seen": F.lit(at), "last_seen": F.lit(at)})
    return seen.groupBy("external_comment_id").agg(F.min_by(F.struct(*COLUMNS), "payload_id").alias("r")).select("r.*")


def merged_comments(current: DataFrame, payloads: DataFrame, at: str) -> DataFrame:
    """The snapshot of comments after a batch of payloads, with each row's ``action``."""
    return merge(current, arrived(payloads, at), KEYS, COMMENT_RULES, ("last_seen",))


def ingest(spark: SparkSession, landing: str, table: SnapshotTable, progress: str, at: str, buckets: int = 64) -> StreamingQuery:
    """Merge all files that are new in ``landing``; the query ends when they are done."""

    def merge_batch(batch: DataFrame, number: int) -> None:
        table.merge(arrived(batch, at), KEYS, COMMENT_RULES, SCHEMA, buckets=buckets, ignore_changes=("last_seen",), token=(progress, number))

    stream = spark.readStream.text(landing).select(F.col("value").alias("payload"))
    return stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", progress).trigger(availableNow=True).start()
