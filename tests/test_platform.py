"""The write path, collections, augmentation, endpoints and training, against plain versions."""

import math

import pytest
from pyspark.sql import functions as F

from paperweave.functions import endpoints as H
from paperweave.functions import text as X
from paperweave.operators import augment as A
from paperweave.operators import experiments as T
from paperweave.operators import graph_ml as G
from paperweave.operators import knowledge_base as B
from paperweave.operators import properties as R
from paperweave.sources import files as S
from paperweave.sources import literature as L


def test_rephrasing_gives_up_after_four_tries(spark):
    rows = [("a b c d", "c", "d"), ("a b c d", "a", "d"), ("a b", "x", "a"), (None, "x", "a")]
    got = spark.createDataFrame(rows, "t string, m string, d string").select(A.rephrased(A.stub_rephrase)("t", "m", "d")).collect()

    def plain(t, m, d):
        tries = [A.stub_rephrase(t or "", i) for i in range(4)]
        return next((x for x in tries if m in x and d in x), None)

    assert [r[0] for r in got] == [plain(*r) for r in rows] and got[2][0] is None


def test_insistent_model_warms_up_and_then_draws(spark):
    texts = ["x" * n for n in range(15)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(H.insistent(H.stub_hesitant, ("positive", "negative", "na"))("t")).collect()
    sure = {n: ("positive", "negative")[n % 2] for n in range(15) if n % 7}
    assert {n: r[0] for n, r in enumerate(got) if n in sure} == sure and {r[0] for r in got} <= {"positive", "negative", "na"}


def test_training_stops_and_keeps_the_best_epoch(spark):
    rows = [([float(x), 1.0 - x], int(x > 0.5), "validation" if i % 5 == 0 else "train") for i, x in enumerate(j / 40 for j in range(40))]
    frame = spark.createDataFrame(rows, "x array<double>, y int, split string")
    w, log = T.train_epochs(frame, "x", "y", "split", epochs=12, patience=3)
    assert [e["epoch"] for e in log] == list(range(1, len(log) + 1)) and log[0]["train_loss"] == pytest.approx(math.log(2))
    assert log[-1]["val_loss"] < log[0]["val_loss"]
    hits = T.predicted(frame, "x", w).where("prediction = y").count()
    assert hits >= 30
    assert T.train_epochs(frame.limit(0), "x", "y", "split") == ([], [])


def test_unseen_links_are_neither_known_nor_taught(spark):
    known = spark.createDataFrame([(f"p{i}", f"n{j}") for i in range(12) for j in range(8) if (i * 3 + j) % 4 == 0], "m string, d string")
    edges = known.select(F.col("m").alias("a"), F.col("d").alias("b"), F.lit(1.0).alias("weight"))
    emb = G.fastrp(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), dim=4)
    got = G.predict_unseen(known, known, emb, n=3).collect()
    have = {tuple(r) for r in known.collect()}
    assert got and not {(r.m, r.d) for r in got} & have and max(r.ranking for r in got) <= 3


def test_collections_are_made_filled_and_deleted(spark, tmp_path):
    store = B.Collections(spark, str(tmp_path))
    assert store.names() == []
    assert store.create("a", "id string").count() == 0
    assert store.add("a", spark.createDataFrame([("1",)], "id string")).count() == 1
    assert store.create("a").count() == 1 and store.names() == ["a"]
    store.delete("a")
    store.delete("a")
    assert store.names() == []


def test_memo_builds_once(spark, tmp_path):
    memo, built = S.Memo(spark, str(tmp_path)), []

    def build():
        built.append(1)
        return spark.range(3)

    assert [memo.get("x", {"a": 1}, build).count() for _ in range(3)] == [3, 3, 3] and len(built) == 1
    memo.get("x", {"a": 2}, build)
    assert len(built) == 2


def pages(start, end, first, most):
    for i in range(first, min(25, first + most)):
        yield (f"{start}-{i}", "T", "2020", "A", "J", None, None, None)


def test_literature_is_read_past_the_first_page(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_HITS", 10)
    reader = L._Reader({"client": "tests.test_platform:pages", "windows": "2020-01-01/2020-02-01"})
    (window,) = reader.partitions()
    assert [r[0] for r in reader.read(window)] == [f"2020-01-01-{i}" for i in range(25)]


def test_unknown_answers_are_an_error(spark):
    rows = spark.createDataFrame([("na", "na"), ("?", "na")], "answer string, ours string").coalesce(1)
    assert T.verified(rows.where("answer = ours"), ("na",), "ours").first().ours == 100.0
    with pytest.raises(Exception, match="unknown label"):
        T.verified(rows, ("na",), "ours").collect()


def test_sampled_neighbours_are_few_per_hop(spark):
    edges = spark.createDataFrame([(i, j) for i in range(10) for j in range(10) if i != j], "a int, b int")
    got = R.sampled_neighbours(edges, spark.createDataFrame([(0,)], "node int"), [2, 3], F.col("b")).collect()
    assert {(r.hop, r.a, r.b) for r in got} == {(1, 0, 1), (1, 0, 2), (2, 1, 0), (2, 1, 2), (2, 1, 3), (2, 2, 0), (2, 2, 1), (2, 2, 3)}
