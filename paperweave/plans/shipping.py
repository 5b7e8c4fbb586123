"""Getting this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that they need no copy of the repository."""
    context = spark.sparkContext
    if getattr(context, "_paperweave_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    path = f"{tempfile.mkdtemp(prefix='paperweave-')}/paperweave.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in package.rglob("*.py"):
            out.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(path)
    context._paperweave_shipped = True
