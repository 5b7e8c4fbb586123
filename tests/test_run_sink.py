"""Runs that are published whole, and pulls that go on where they stopped."""

import pytest
from pyspark.sql import functions as F

from paperweave.sources import literature as L
from paperweave.sources import run_sink as R
from paperweave.streaming import pulls as T

CLIENT = "paperweave.sources.literature:stub_client"


def test_run_is_published_with_index_and_params(spark, tmp_path):
    rows = spark.range(100).withColumn("label", F.when(F.col("id") % 3 == 0, F.lit("x"))).repartition(5)
    R.publish(rows, str(tmp_path), "a", {"k": 3})
    assert sorted(map(tuple, R.read_run(spark, str(tmp_path), "a").collect())) == sorted(map(tuple, rows.collect()))
    index = R.run_index(str(tmp_path), "a")
    assert index["rows"] == 100 and index["params"] == {"k": 3} and len(index["files"]) == 5


def test_failed_task_leaves_no_visible_row(spark, tmp_path):
    @F.udf("long")
    def broken(x):
        if x == 77:
            raise RuntimeError("half-way")
        return x

    with pytest.raises(Exception, match="half-way"):
        R.publish(spark.range(0, 100, 1, 4).select(broken("id").alias("id")), str(tmp_path), "a", {})
    with pytest.raises(FileNotFoundError):
        R.read_run(spark, str(tmp_path), "a")
    R.publish(spark.range(7), str(tmp_path), "a", {})  # the name is free again, what was staged does not count
    assert R.read_run(spark, str(tmp_path), "a").count() == 7


def test_second_writer_is_refused(spark, tmp_path):
    R.publish(spark.range(3), str(tmp_path), "a", {})
    with pytest.raises(FileExistsError):
        R.publish(spark.range(9), str(tmp_path), "a", {})
    assert not R.release(spark, str(tmp_path), "a")
    assert R.read_run(spark, str(tmp_path), "a").count() == 3


def test_lost_writer_can_be_released_and_empty_frames_kept(spark, tmp_path):
    (tmp_path / "run=a").mkdir()
    (tmp_path / "run=a" / R.CLAIM).touch()
    with pytest.raises(FileExistsError):
        R.publish(spark.range(3), str(tmp_path), "a", {})
    assert R.release(spark, str(tmp_path), "a")
    R.publish(spark.range(0), str(tmp_path), "a", {})
    assert R.read_run(spark, str(tmp_path), "a").columns == ["id"] and R.read_run(spark, str(tmp_path), "a").count() == 0


def test_stream_of_windows_goes_on_after_a_stop(spark, tmp_path):
    target, log = str(tmp_path / "articles"), str(tmp_path / "log")

    def run(last):
        stream = L.pull_stream(spark, T.month_windows(spark, "2020-01-01", last), CLIENT)
        return T.progress(T.append_once(stream, target, ["_id"], ["title"], log))["rows"]

    assert run("2020-02-01") == 6
    assert run("2020-02-01") == 0
    assert run("2020-05-01") == 9
    ids = [r._id for r in spark.read.parquet(target).collect()]
    assert len(ids) == len(set(ids)) == 15


def test_batch_that_was_not_committed_is_replayed_once(spark, tmp_path):
    target, log = str(tmp_path / "articles"), tmp_path / "log"
    windows = T.month_windows(spark, "2020-01-01", "2020-03-01")
    T.append_once(L.pull_stream(spark, windows, CLIENT), target, ["_id"], ["title"], str(log))
    for f in list((log / "commits").glob("*0")) + list((log / "commits").glob(".*0.crc")):
        f.unlink()  # as if the driver had been lost between the rows and the commit
    again = T.append_once(L.pull_stream(spark, windows, CLIENT), target, ["_id"], ["title"], str(log))
    assert T.progress(again)["rows"] == 9
    assert spark.read.parquet(target).count() == 9
