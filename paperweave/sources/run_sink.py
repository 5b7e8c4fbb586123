"""A sink for whole runs: tasks stage files, one commit publishes them together with an index and the run's parameters.

A run is a folder of Parquet files and an index that names those that count. Files of failed, repeated or abandoned tasks are never in
the index, so no reader sees them. ``publish`` claims a run's name before anything is written; a second writer of the name is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

INDEX, CLAIM = "_index.json", "_claim"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class RunSink(DataSource):
    """frame.write.format("run_sink").option("run", folder of the run).option("params", JSON).mode("append").save()"""

    @classmethod
    def name(cls) -> str:
        return "run_sink"

    def schema(self) -> StructType:
        raise NotImplementedError("runs are read by read_run")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _RunWriter(self.options["run"], self.options.get("params", "{}"), schema)


class _RunWriter(DataSourceArrowWriter):
    def __init__(self, run: str, params: str, schema: StructType):
        self.run, self.params, self.types = run.rstrip("/"), params, schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        """One file a task and attempt, batch by batch; its name is the attempt's own, so that attempts cannot meet."""
        store, path = _store(self.run)
        name, rows, out = f"part-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in batches:
                if out is None:
                    out = pq.ParquetWriter(f"{path}/{name}", batch.schema, filesystem=store)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Staged(name if out is not None else "", rows)

    def commit(self, messages: list[Staged | None]) -> None:
        """The index appears by one rename, after all files are whole."""
        store, path = _store(self.run)
        done = [m for m in messages if m is not None and m.file]
        index = {"files": sorted(m.file for m in done), "rows": sum(m.rows for m in done), "params": json.loads(self.params), "schema": self.types.jsonValue()}
        if store.get_file_info(f"{path}/{INDEX}").type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.run} is published")
        temporary = f"{path}/{INDEX}.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            out.write(json.dumps(index, sort_keys=True).encode())
        store.move(temporary, f"{path}/{INDEX}")

    def abort(self, messages: list[Staged | None]) -> None:
        store, path = _store(self.run)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{path}/{m.file}")


def publish(frame: DataFrame, folder: str, run: str, params: dict) -> str:
    """Writes the frame as ``run`` below a folder that all executors share, whole or not at all; returns the folder.

    The name is claimed by creating a file that must not exist, which the file system does atomically. If the write fails its claim is
    given back; if the driver is lost the claim stays, and ``release`` gives the name free.
    """
    spark = frame.sparkSession
    spark.dataSource.register(RunSink)
    home = f"{folder.rstrip('/')}/run={run}"
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{CLAIM}")
    store = claim.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.createNewFile(claim):
        raise FileExistsError(f"{home} is written already or being written")
    try:
        frame.write.format("run_sink").option("run", home).option("params", json.dumps(params, sort_keys=True)).mode("append").save()
    except BaseException:
        store.delete(claim, False)
        raise
    return folder


def release(spark: SparkSession, folder: str, run: str) -> bool:
    """Gives the name of an unpublished run free, whose writer is known to be gone; False if it is published or was not claimed."""
    home = f"{folder.rstrip('/')}/run={run}"
    claim, index = (spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{n}") for n in (CLAIM, INDEX))
    store = claim.getFileSystem(spark._jsc.hadoopConfiguration())
    return not store.exists(index) and store.delete(claim, False)


def run_index(folder: str, run: str) -> dict:
    """The index of a published run: files, rows, params, schema."""
    store, path = _store(f"{folder.rstrip('/')}/run={run}")
    with store.open_input_stream(f"{path}/{INDEX}") as f:
        return json.loads(f.read())


def read_run(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """The rows of a published run: the files that its index names, one for each task that wrote."""
    index = run_index(folder, run)
    schema = StructType.fromJson(index["schema"])
    if not index["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder.rstrip('/')}/run={run}/{f}" for f in index["files"]])
