"""Cutting the lineage of iterative work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only where it is unset, as in local tests, one of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="paperweave-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing else has."""
    return f"{shared_folder(spark).rstrip('/')}/paperweave-{uuid.uuid4().hex}-{name}"


def cut(frame: DataFrame) -> DataFrame:
    """The frame as files in the shared folder: compressed columns, whose size is known to the joins that read them."""
    path = shared_path(frame.sparkSession, "cut")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
