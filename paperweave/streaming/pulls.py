"""Monthly pulls and event streams: windows, exactly-once appends, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.upserts import insert_new


def month_windows(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(start, end) of monthly pulls from the month of ``first`` to that of ``last``; a window's end is the next one's start."""
    span = spark.range(1).select(F.lit(first).cast("date").alias("a"), F.lit(last).cast("date").alias("b"))
    n = (F.year("b") - F.year("a")) * 12 + F.month("b") - F.month("a")
    return span.select(F.explode(F.sequence(F.lit(0), n)).alias("i"), "a").select(F.add_months("a", F.col("i")).alias("start"), F.add_months("a", F.col("i") + 1).alias("end"))


def in_windows(rows: DataFrame, windows: DataFrame, date: str) -> DataFrame:
    """Rows with each window that contains their date, both ends included; a row on a boundary is in two.

    Windows are calendar steps, so the join is on the month of the start and the one before, not on a range.
    """
    day = F.col(date).cast("date")
    w = windows.select("start", "end", F.explode(F.array(F.trunc("start", "month"), F.trunc("end", "month"))).alias("_m")).distinct()
    j = rows.withColumn("_d", day).withColumn("_m", F.trunc(day, "month")).join(w, "_m")
    return j.where((F.col("_d") >= F.col("start")) & (F.col("_d") <= F.col("end"))).drop("_d", "_m")


def daily_counts(events: DataFrame) -> DataFrame:
    """Distinct events per day and type of (event_id, ts, event_type, value); a batch."""
    one = events.dropDuplicates(["event_id"])
    return one.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def event_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Parquet files of events as a stream, with a timestamp that watermarks accept."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same over a stream: days leave once the watermark has passed them; repeated events within it count once."""
    one = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    w = one.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


def append_once(stream: DataFrame, target: str, key: list[str], order: list[str], checkpoint: str):
    """Runs a stream to its end, appending rows whose key the target lacks; a replayed batch adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        old = spark.read.schema(batch.schema).parquet(target) if there else batch.limit(0)
        insert_new(old, batch, key, order).select(*batch.columns).write.mode("append").parquet(target)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def progress(query) -> dict[str, int]:
    """Counters of a finished query: batches and rows read."""
    reports = query.recentProgress
    return {"batches": len(reports), "rows": sum(p["numInputRows"] for p in reports)}
