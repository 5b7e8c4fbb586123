"""File tables, sinks, id maps and run folders."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A table by its extension: csv (with header), json, orc, parquet or a spreadsheet; csv without a schema is read as strings.

    Spreadsheets are small and read on the driver; they need a reader that pandas finds.
    """
    name = path.lower().rstrip("/")
    if ".xls" in name:
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path), schema)
    reader = spark.read.schema(schema) if schema else spark.read
    if name.endswith((".csv", ".csv.gz")):
        return reader.csv(path, header=True, mode="FAILFAST" if schema else "PERMISSIVE")
    if name.endswith((".json", ".jsonl")):
        return reader.json(path)
    if name.endswith(".orc"):
        return reader.orc(path)
    return reader.parquet(path)


def write_table(frame: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A table by its extension, overwriting; parquet unless csv or json is asked for."""
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.endswith(".csv"):
        writer.csv(path, header=True)
    elif path.endswith(".json"):
        writer.json(path)
    else:
        writer.parquet(path)


def write_id_map(ids: DataFrame, path: str, key: str) -> None:
    """A map from key to id as JSON lines."""
    ids.select(F.col(key).cast("string").alias("key"), "id").write.mode("overwrite").json(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, id long").json(path)


def run_name(model: str, dataset: str, k: int, few_shot: int = 0, alternatives: bool = False, chain: bool = False, confidence: bool = False) -> str:
    """Name of a run from its parameters."""
    return f"{model}_{dataset}_k{k}_shots{few_shot}" + "_ALT" * alternatives + "_COT" * chain + "_CONF" * confidence


def run_names(model: Column, dataset: Column, k: Column, shots: Column, alternatives: Column, chain: Column, confidence: Column) -> Column:
    """The same over columns."""
    suffixes = [F.when(c, s).otherwise("") for c, s in ((alternatives, "_ALT"), (chain, "_COT"), (confidence, "_CONF"))]
    return F.concat(model, F.lit("_"), dataset, F.lit("_k"), k.cast("string"), F.lit("_shots"), shots.cast("string"), *suffixes)


class Memo:
    """Results by name and parameters, written once below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def get(self, name: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
        key = hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}-{key}/_SUCCESS")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            build().write.mode("overwrite").parquet(f"{self.folder}/{name}-{key}")
        return self.spark.read.parquet(f"{self.folder}/{name}-{key}")


class RunStore:
    """Results of a run by row, resumable: rows that are stored are not asked for again."""

    def __init__(self, spark: SparkSession, folder: str, name: str, schema: str):
        self.spark, self.path, self.schema = spark, f"{folder.rstrip('/')}/run={name}", schema

    def params(self, **values) -> None:
        self.spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "params string").write.mode("overwrite").text(f"{self.path}/params")

    def done(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/results")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/results")

    def pending(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.join(self.done().select(key), key, "left_anti")

    def append(self, results: DataFrame, dialogues: DataFrame | None = None) -> None:
        results.write.mode("append").parquet(f"{self.path}/results")
        if dialogues is not None:
            dialogues.write.mode("append").json(f"{self.path}/dialogues")

    def index(self) -> int:
        """How many rows are done."""
        return self.done().count()
