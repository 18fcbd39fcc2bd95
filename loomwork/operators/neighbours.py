"""Nearest vectors by cosine: inverted cells, block matrix products, and a bound by the triangle inequality (GR-15).

Vectors on the unit sphere belong to the cell of their nearest centre.  A query first looks into the cells nearest to it (the fast
way); the angle to the worst of its best ``k`` then bounds where better ones can be: angles obey the triangle inequality, so a cell
whose centre is farther away than that angle and the cell's radius together holds none.  The exact way looks into all cells that
this leaves.

A cell's vectors and the queries that look into it are dealt in blocks of bounded size, so neither a large cell nor a large
number of queries or copies is one group; every pair of blocks is one matrix product in one task, of which the best ``k`` for each query
are handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.plans.lineage import discard, written
from loomwork.plans.shipping import ship

#: Vectors of the bounded sample that centres are learnt from, how often they are moved, and the most of them.
SAMPLE, MOVES, MOST_CELLS = 4096, 6, 256
#: Cells that every query looks into first.
FIRST_CELLS = 4
#: Most vectors and queries of a matrix product.
BLOCK, QUERY_BLOCK = 4096, 512
#: Digits that cosines are rounded to; equal ones are told apart by id.
DIGITS = 6


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def unit_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, e)`` with vectors of length 1; those that are null, hold nulls or have no length are left out."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e")).where("e IS NOT NULL AND NOT exists(e, x -> x IS NULL)")
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("norm", norm).where("norm > 0").select("vec_id", F.transform("e", lambda x: x / F.col("norm")).alias("e"))


def centres(units: DataFrame, cells: int) -> np.ndarray:
    """Centres of ``cells`` cells, learnt from a bounded sample of ``SAMPLE`` vectors by spherical k-means."""
    rows = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("e").toArrow()
    sample = _matrix(rows.column(0))
    found = sample[:cells]
    for _ in range(MOVES if len(sample) else 0):
        of = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), found)
    return found


def placed(units: DataFrame, middle: np.ndarray) -> DataFrame:
    """``(vec_id, e, cell, away)``: each vector with its nearest centre and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosines = _matrix(batch.column(1)) @ middle.T
                of = cosines.argmax(axis=1)
                away = np.arccos(np.clip(cosines[np.arange(len(of)), of], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(away)], names=["vec_id", "e", "cell", "away"])

    kind = units.schema["vec_id"].dataType.simpleString()
    return units.mapInArrow(run, f"vec_id {kind}, e array<double>, cell int, away double")


def angles(queries: DataFrame, middle: np.ndarray) -> DataFrame:
    """``(query_id, e, cell, angle, place)`` for each query and cell: the angle to the centre and its place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = np.arccos(np.clip(_matrix(batch.column(1)) @ middle.T, -1, 1))
                place = angle.argsort(axis=1, kind="stable").argsort(axis=1)
                n, cells = angle.shape
                whose = pa.array(np.repeat(np.arange(n), cells))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(whose), pa.array(np.tile(np.arange(cells, dtype=np.int32), n)), pa.array(angle.ravel()), pa.array(place.ravel().astype(np.int32))], names=["query_id", "cell", "angle", "place"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "e").mapInArrow(run, f"query_id {kind}, cell int, angle double, place int")


def _best(k: int):
    """The matrix product of a block of queries and one of vectors, and the best ``k`` of each query."""

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, others = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        if not len(ids) or not len(others):
            return pa.table({"query_id": left.column("query_id").slice(0, 0), "vec_id": right.column("vec_id").slice(0, 0), "cosine": pa.array([], pa.float64())})
        raw = _matrix(left.column("e")) @ _matrix(right.column("e")).T
        cosine = np.copysign(np.floor(np.abs(raw) * 10**DIGITS + 0.5) / 10**DIGITS, raw)
        cosine[ids[:, None] == others[None, :]] = -np.inf
        least = np.partition(cosine, -k, axis=1)[:, -k] if cosine.shape[1] > k else np.full(len(ids), -np.inf)
        q, v = np.nonzero((cosine >= least[:, None]) & (cosine > -np.inf))
        order = np.lexsort((others[v], -cosine[q, v], q))
        q, v = q[order], v[order]
        opens = np.searchsorted(q, np.arange(len(ids)))
        first = np.arange(len(q)) - opens[q] < k
        q, v = q[first], v[first]
        return pa.table({"query_id": left.column("query_id").take(pa.array(q)), "vec_id": right.column("vec_id").take(pa.array(v)), "cosine": pa.array(cosine[q, v] + 0.0)})

    return product


def _looked_up(asked: DataFrame, queries: DataFrame, inside: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, cosine)``: the best ``k`` of each query in each block of the cells of ``asked (query_id, cell)``."""
    wanted = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("asking")).join(sizes, "cell")
    blocks = written(wanted.select("cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("asking") / QUERY_BLOCK).cast("int").alias("queues")), "blocks")
    some = F.broadcast(blocks)  # one row for each cell
    left = asked.join(queries, "query_id").join(some, "cell")
    left = left.select("query_id", "e", "cell", F.pmod(F.xxhash64("query_id"), F.col("queues")).cast("int").alias("queue"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = inside.join(some, "cell")
    right = right.select("vec_id", "e", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("queues") - 1)).alias("queue"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {inside.schema['vec_id'].dataType.simpleString()}, cosine double"
    return left.groupBy("cell", "part", "queue").cogroup(right.groupBy("cell", "part", "queue")).applyInArrow(_best(k), kinds)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "cosine")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, exact: bool = True, cells: int | None = None) -> DataFrame:
    """``(query_id, vec_id, rank, cosine)``: the ``k`` most alike other vectors of each query, cosines rounded to ``DIGITS`` digits.

    Both sides have ``(vec_id, embedding)`` with integer ids and vectors of one dimension; ids are unique.  Without ``exact`` only the
    ``FIRST_CELLS`` nearest cells are looked into.  Vectors without length or with nulls are no neighbours and find none; an empty side
    gives an empty result.
    """
    ship(vectors.sparkSession)
    units = written(unit_vectors(vectors), "units")
    asked_for = written(unit_vectors(queries).withColumnRenamed("vec_id", "query_id"), "queries")
    many = units.count()
    middle = centres(units, cells or min(MOST_CELLS, max(1, int(many**0.5) // 2)))
    if not len(middle):
        return units.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).alias("rank"), F.lit(0.0).alias("cosine")).where("false")
    inside = written(placed(units, middle), "cells")
    discard(units)
    sizes = written(inside.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("away").alias("radius")), "sizes")
    seen = written(angles(asked_for, middle).join(F.broadcast(sizes), "cell"), "angles")
    first = written(_looked_up(seen.where(F.col("place") < FIRST_CELLS).select("query_id", "cell"), asked_for, inside, sizes, k), "first")
    if not exact:
        return _ranked(first, k)
    # The worst of the best k so far; without k of them, everything may be better.
    worst = _ranked(first, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("cosine")).otherwise(-1.0).alias("worst"))
    reach = F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius") - 1e-7))
    more = seen.where(F.col("place") >= FIRST_CELLS).join(worst, "query_id", "left").where(reach >= F.coalesce("worst", F.lit(-1.0)) - 10.0**-DIGITS)
    more = written(more.select("query_id", "cell"), "more")
    return _ranked(first.union(_looked_up(more, asked_for, inside, sizes, k)), k)
