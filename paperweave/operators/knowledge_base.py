"""Named vector collections as tables: create, add, search, delete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import placed


def entries(rows: DataFrame, name: str, cui: str, embed: Callable[[Column], Column]) -> DataFrame:
    """(id, document, metadata, embedding): lower-cased names, their embeddings, name and cui as metadata, and an id of its own for each."""
    meta = F.struct(F.col(name).cast("string").alias("name"), F.col(cui).cast("string").alias("cui"))
    return rows.select(F.expr("uuid()").alias("id"), F.lower(name).alias("document"), meta.alias("metadata"), embed(F.lower(name)).alias("embedding"))


def fold_entries(rows: DataFrame, fold: str, k: int, document: str, key: str) -> DataFrame:
    """(id, document, metadata) of all rows outside fold k: ids from 0 in the order of an integer key, all other columns as strings."""
    kept = placed(rows.where(F.col(fold) != k), [key], "id")
    others = [c for c in rows.columns if c != document]
    return kept.select(F.col("id").cast("string").alias("id"), F.col(document).alias("document"), F.struct(*[F.col(c).cast("string").alias(c) for c in others]).alias("metadata"))


class Collections:
    """Collections below a folder that all executors share; vectors are compared by cosine."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        path, fs = self._path("")
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def create(self, name: str, schema: str = "id string, document string, metadata struct<name: string, cui: string>, embedding array<float>") -> DataFrame:
        """The collection, made if it is not there."""
        if name not in self.names():
            self.spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def add(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")
        return self.get(name)

    def delete(self, name: str) -> None:
        """Nothing happens where there is no such collection."""
        path, fs = self._path(name)
        fs.delete(path, True)
