"""Incremental embedding by content hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import collapsed, content_hash, source_text
from loomwork.plans.shipping import ship

Embedder = Callable[[list[str], str], list[list[float]]]


def sources(table: DataFrame, kind: str) -> DataFrame:
    """``(source_id, text)`` to embed of a table of that kind."""
    return table.select(F.col("id").alias("source_id"), source_text(kind).alias("text"))


def candidates(rows: DataFrame, existing: DataFrame, kind: str, model: str, limit: int | None = None, limit_after_skip: bool = False) -> DataFrame:
    """``(source_id, text, source_hash)`` of texts that are new or changed (EMB-1, JN-13).

    The limit counts rows in id order before skipping, or with ``limit_after_skip`` the rows that are left.
    """
    if limit is not None and not limit_after_skip:
        rows = rows.orderBy("source_id").limit(limit)
    clean = rows.select("source_id", collapsed("text").alias("text")).where("text <> ''")
    hashed = clean.withColumn("source_hash", content_hash("text"))
    known = existing.where((F.col("source_table") == kind) & (F.col("model") == model)).select("source_id", F.col("source_hash").alias("_known"))
    left = hashed.join(known, "source_id", "left").where(~F.col("source_hash").eqNullSafe(F.col("_known"))).drop("_known")
    return left.orderBy("source_id").limit(limit) if limit is not None and limit_after_skip else left


def embedded(found: DataFrame, embedder: Embedder, kind: str, model: str, at: str) -> DataFrame:
    """Rows of the embeddings table for candidates; a wrong number of vectors fails the run (EMB-2)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embedder(batch["text"].tolist(), model)
            if len(vectors) != len(batch):
                raise ValueError(f"{len(batch)} texts gave {len(vectors)} vectors")
            yield pd.DataFrame({"source_id": batch["source_id"], "source_hash": batch["source_hash"], "vector": vectors})

    ship(found.sparkSession)
    made = found.mapInPandas(run, "source_id long, source_hash string, vector array<double>")
    return made.select(F.lit(kind).alias("source_table"), "source_id", "source_hash", F.lit(model).alias("model"), F.size("vector").alias("dimensions"), F.to_json("vector").alias("embedding_json"), F.lit(at).alias("embedded_at"))


def upsert_embeddings(existing: DataFrame, new: DataFrame) -> DataFrame:
    """DML-10: a new row replaces the one with its table, id and model."""
    keys = ["source_table", "source_id", "model"]
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def run_counts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(processed, embedded, skipped)`` (AGG-18)."""
    a, b = rows.agg(F.count(F.lit(1)).alias("processed")), found.agg(F.count(F.lit(1)).alias("embedded"))
    return a.join(F.broadcast(b), F.lit(True)).select("processed", "embedded", (F.col("processed") - F.col("embedded")).alias("skipped"))
