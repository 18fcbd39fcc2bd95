"""Making this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application.

    A cluster's workers do not see the driver's folders, so functions that run in Python workers call
    this before their plan is built.
    """
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="loomwork-")) / "loomwork.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, os.path.join(package.name, source.relative_to(package)))
    context.addPyFile(str(archive))
    _DONE.add(context.applicationId)
