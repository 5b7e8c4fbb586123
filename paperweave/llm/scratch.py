"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset, as in local tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="paperweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of an Arrow batch at most. Texts are long; a batch stands in memory several times, in the executor and in its Python workers.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most ``BATCH_ROWS`` rows from here on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark


class Scratch:
    """Named Parquet tables below a folder of their own; a table that is no longer read can be dropped."""

    #: Where tables are made while ``passing`` is open.
    _open: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = small_batches(spark), f"{shared_folder(spark)}/paperweave-{uuid.uuid4().hex}", 0
        if self._open:
            self._open[-1].append(self)

    @classmethod
    @contextmanager
    def passing(cls) -> Iterator[None]:
        """All tables made inside are deleted at the end; what is to stay must be written to a folder made outside."""
        cls._open.append([])
        try:
            yield
        finally:
            for made in cls._open.pop():
                made.clear()

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, name: str, frame: DataFrame, *parts: str) -> DataFrame:
        """The frame as a table of its own, in a folder for each value of the ``parts`` columns, which then come last."""
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        frame.write.mode("overwrite").partitionBy(*parts).parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._scratch_path = path
        return out

    def write_bucketed(self, name: str, frame: DataFrame, buckets: int, *by: str) -> DataFrame:
        """A table dealt into buckets by columns and sorted by them, so that joins on them move none of its rows."""
        self.n += 1
        path, table = f"{self.root}/{name}-{self.n}", f"paperweave_{uuid.uuid4().hex}"
        frame.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        out._scratch_path, out._scratch_table = path, table
        return out

    def plain(self, table: DataFrame) -> DataFrame:
        """A written table without regard to its buckets."""
        return self.spark.read.schema(table.schema).parquet(table._scratch_path)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if name := t.__dict__.get("_scratch_table"):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._delete(t._scratch_path)
