"""Sources, sinks, streams, models and plans."""

import uuid

from pyspark.sql import functions as F

from paperweave.functions import models as M
from paperweave.plans.graph_view import GraphView
from paperweave.sources import files as S
from paperweave.sources import literature as L
from paperweave.streaming import pulls as T


def test_tables_by_extension(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for name in ("x.csv", "x.json", "x.parquet"):
        S.write_table(rows, str(tmp_path / name))
        assert sorted(map(tuple, S.read_table(spark, str(tmp_path / name), "k long, v string").collect())) == [(1, "a"), (2, "b")]
    S.write_id_map(rows.withColumnRenamed("k", "id"), str(tmp_path / "ids"), "v")
    assert {r.key: r.id for r in S.read_id_map(spark, str(tmp_path / "ids")).collect()} == {"a": 1, "b": 2}


def test_runs_resume(spark, tmp_path):
    store = S.RunStore(spark, str(tmp_path), S.run_name("m", "gold", 1, chain=True), "row long, label string")
    rows = spark.range(5).withColumnRenamed("id", "row")
    assert store.pending(rows, "row").count() == 5
    store.append(rows.where("row < 3").withColumn("label", F.lit("na")))
    assert [r.row for r in store.pending(rows, "row").orderBy("row").collect()] == [3, 4]
    assert store.path.endswith("run=m_gold_k1_shots0_COT")


def test_literature(spark):
    got = L.pull(spark, T.month_windows(spark, "2020-01-15", "2020-02-15"), "paperweave.sources.literature:stub_client")
    assert got.count() == 6
    rows = spark.createDataFrame([("1", " ", "2020", "x"), ("2", "t", "2020", "x"), ("3", "t", None, None)], "_id string, title string, publication_date string, abstract string")
    assert [r._id for r in L.valid_articles(rows).collect()] == ["2"]
    assert {r._id: r.missing for r in L.rejected_articles(rows).collect()} == {"1": ["title"], "3": ["publication_date", "abstract"]}


def test_windows_share_their_boundary_day(spark):
    rows = spark.createDataFrame([("2020-02-01",), ("2020-02-02",)], "d string")
    got = T.in_windows(rows, T.month_windows(spark, "2020-01-01", "2020-02-01"), "d").groupBy("d").count().collect()
    assert {r.d: r["count"] for r in got} == {"2020-02-01": 2, "2020-02-02": 1}


def test_appends_are_made_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string").write.parquet(source)
    stream = lambda: spark.readStream.schema("k long, v string").parquet(source)
    query = T.append_once(stream(), target, ["k"], ["v"], str(tmp_path / "c1"))
    assert T.progress(query)["rows"] == 3
    T.append_once(stream(), target, ["k"], ["v"], str(tmp_path / "c2"))  # a replay from the start
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(1, "a"), (2, "c")]


def test_stream_drops_repeated_events(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "x", 1.0), (1, "2024-01-01 10:00:00", "x", 1.0), (2, "2024-01-01 11:00:00", "x", 2.0), (3, "2024-01-03 00:00:00", "x", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    name = f"t_{uuid.uuid4().hex}"
    q = T.daily_counts_stream(T.event_stream(spark, str(tmp_path / "events"), df.schema)).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(str(r.day), r.n, r.total) for r in spark.table(name).collect()] == [("2024-01-01", 2, 3.0)]


def test_models_are_called_in_batches_and_retried(spark):
    def flaky(texts):
        if "bad" in texts:
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([("a",), ("bad",), ("b",)], "t string").coalesce(1)
    assert [r.x for r in rows.select(M.scalar_model(flaky, batch=1)("t").alias("x")).collect()] == ["A", None, "B"]
    assert len(rows.select(M.embedding_model(M.stub_embedding)("t").alias("e")).first().e) == 16


def test_scans_read_only_what_they_need(spark, sf):
    plan = GraphView(spark, sf).strengths._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan and "l_comment" not in plan and "l_tax" not in plan
    assert "partial_sum" in plan and "Python" not in plan
    filtered = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_partkey = 7").select("l_suppkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_partkey), EqualTo(l_partkey,7)]" in filtered


def test_table_client_reads_only_what_a_page_needs(tmp_path):
    from datetime import datetime, timedelta

    import pyarrow as pa
    import pyarrow.parquet as pq

    from paperweave.sources.literature import table_client

    days = [datetime(2020, 1, 1) + timedelta(minutes=i // 50) for i in range(2_000_000)]
    text = pa.array([f"{i % 1000:0100d}" for i in range(len(days))])
    pq.write_table(pa.table({"o_orderkey": range(len(days)), "o_orderdate": pa.array(days, pa.timestamp("us")), "o_orderpriority": text, "o_orderstatus": text}), tmp_path / "o.parquet", row_group_size=50_000)
    del days, text
    pool = pa.system_memory_pool()
    held, before = pa.default_memory_pool(), pa.proxy_memory_pool(pool)
    pa.set_memory_pool(before)
    try:
        got = [int(r[0]) for r in table_client("2020-01-01", "2020-02-01", 700_000, 10, str(tmp_path))]
    finally:
        pa.set_memory_pool(held)
    assert got == list(range(700_000, 700_010))
    assert before.max_memory() < 100 << 20  # the whole table has 400 MB of text
