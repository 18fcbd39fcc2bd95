"""Arrow batch plumbing that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.plans.shipping import ship

#: Bytes of text that one call of a kernel sees at most, unless a single text is longer.
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch where whole texts travel: Spark's 10,000 take tens of MB in each task, in the JVM and in Python.
BATCH_ROWS, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, what runs hands at most ``BATCH_ROWS`` rows at once to Python."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def few_rows_at_once(spark: SparkSession) -> None:
    """From now on the session hands at most ``BATCH_ROWS`` rows at once to Python: a plan reads the setting when it runs, not when it is made."""
    before = int(spark.conf.get(BATCH_CONF))
    if not 0 < before <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Cut a string or binary column into runs of about ``limit`` bytes; yields (first row, run)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, column.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, column.slice(start)


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just ``(doc_id, text)``: other columns, whatever their names, never reach a kernel."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_texts(pairs: DataFrame, kernel: Callable[[pa.Array], dict[str, pa.Array]], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Apply ``kernel(texts) -> columns`` to ``(doc_id, text)`` rows in runs of about ``limit`` bytes of text.

    ``schema`` names the kernel's columns; ``doc_id`` comes first in the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, part in slices(texts, limit):
                made = kernel(part)
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(part)), *made.values()], names=["doc_id", *made])

    ship(pairs.sparkSession)
    return pairs.mapInArrow(run, f"doc_id long, {schema}")


