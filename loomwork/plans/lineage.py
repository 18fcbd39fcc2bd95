"""Cutting lineage with reliable checkpoints.

Iterative operators call :func:`cut` once per round.  The files go to the folder named by
``spark.checkpoint.dir``, which every executor shares; only where that setting is absent (unit tests
and single-machine sessions) is a folder next to the warehouse used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as a URI without a trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, reliably, and return it with no lineage behind it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new, unused folder under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as Parquet files in the shared folder, read back.

    Unlike a checkpoint, files tell the planner their size, so that small sides of later joins are broadcast.
    """
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.written_to = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made and that nothing reads any more."""
    for table in tables:
        folder = table.__dict__.pop("written_to", None)
        if folder:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
