"""Queries do the whole job: no row, text or neighbour is left out. Where the registered SQL leaves some out, the test has its own."""

import inspect

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperweave.operators import graph_ml as G


TABLES = "nation supplier part orders lineitem".split()


def run(spark, folder, name):
    return sorted((tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()), key=repr)


def test_yes_no_reads_whole_texts(spark, tmp_path):
    tail = "x" * 100
    rows = [(1, 0, tail + " yes"), (1, 1, tail + " no "), (1, 2, f" {tail}\n")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert run(spark, tmp_path, "yes_no") == [(1, 0, "yes"), (1, 1, "no"), (1, 2, tail)]


def test_token_to_word_takes_every_sentence(spark, tmp_path):
    spark.createDataFrame([(1, "Ab cdef. Second one"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = run(spark, tmp_path, "token_to_word")
    assert [r[:4] for r in got] == [(1, 0, 1, "ab"), (1, 0, 2, "cdef"), (1, 1, 1, "second"), (1, 1, 2, "one")]
    assert [r[4] for r in got] == [1, 1, 2, 2]


def test_knn_cosine_asks_for_every_vector(spark, tmp_path):
    v = np.random.default_rng(5).normal(size=(60, 4))
    v[7] = v[21] = v[40]
    pq.write_table(pa.table({"vec_id": np.arange(60) * 3 + 1, "embedding": pa.array(list(v))}), tmp_path / "embeddings.parquet")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 12)
    want = {(i * 3 + 1, j * 3 + 1, r + 1) for i in range(60) for r, j in enumerate(sorted(set(range(60)) - {i}, key=lambda j: (-near[i, j], j))[:10])}
    got = {(r.query, r.neighbour, r.ranking) for r in entry.queries()["knn_cosine"](spark, str(tmp_path)).collect()}
    assert got == want


def test_similar_bacteria_takes_the_first_of_equal_lines(spark, tmp_path):
    rows = [(1, 9 if i == 0 else 3 * i + 9, 1, 0.0) for i in range(40)] + [(2, 6, 2, 0.0), (2, 3, 1, 0.0), (2, 9, 1, 0.0)]
    for parts in (rows, rows[::-1]):
        folder = tmp_path / str(parts[0][0])
        folder.mkdir()
        keys = ("l_orderkey", "l_partkey", "l_linenumber", "l_discount")
        pq.write_table(pa.table(dict(zip(keys, zip(*parts)))), folder / "lineitem.parquet", row_group_size=7)
        want = {k: next(r[1] for r in parts if r[0] == k and r[2] == 1) for k in (1, 2)}
        assert dict(run(spark, folder, "similar_bacteria")) == want


def test_similar_bacteria_takes_lines_without_a_number_last(spark, tmp_path):
    rows = {"l_orderkey": [1, 1, 2, 3, 3], "l_partkey": [3, 6, 9, 12, 15], "l_linenumber": pa.array([None, 2, None, 1, None], pa.int32()), "l_discount": [0.0] * 5}
    pq.write_table(pa.table(rows), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = sorted(con.sql(entry.oracle_sql()["similar_bacteria"]).fetchall())
    assert want == [(1, 6), (2, 9), (3, 12)] and run(spark, tmp_path, "similar_bacteria") == want


def test_two_hop_relatives_take_part_edges(spark, tmp_path):
    parts = [(1, "B1", "T1"), (2, "B1", "T2"), (3, "B2", "T2"), (4, "B2", "T2")]
    nations = [(1, 0), (2, 0), (3, 1)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string").withColumn("p_name", F.col("p_type")).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(nations, "n_nationkey int, n_regionkey int").withColumn("n_name", F.lit("n")).write.parquet(f"{tmp_path}/nation.parquet")
    edges = {e for k, b, t in parts for e in ((f"p{k}", f"b{b}"), (f"b{b}", f"t{t}"))} | {e for n, r in nations for e in ((f"n{n}", f"r{r}"), (f"r{r}", "root"))}
    ends = [(x, y, e) for e in edges for x, y in (e, e[::-1])]
    want = {(x, z) for x, y, e in ends for w, z, f in ends if y == w and e != f}
    assert {("p1", "tT1"), ("p3", "p4"), ("tT2", "p3")} <= want
    assert run(spark, tmp_path, "two_hop_relatives") == sorted(want, key=repr)


def test_two_hop_relatives_shuffle_no_pairs(spark):
    from paperweave.operators import paths as P

    def written():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    star = spark.range(1500).select(F.concat(F.lit("c"), "id").alias("child"), F.lit("hub").alias("parent"))
    before = written()
    assert P.two_hop_relatives(star).count() == 1500 * 1499
    assert written() - before < 2 << 20


def test_two_hop_relatives_share_the_pairs_of_one_hub(spark):
    from paperweave.operators import paths as P

    star = spark.range(1500).select(F.concat(F.lit("c"), "id").alias("child"), F.lit("hub").alias("parent"))
    found = P.two_hop_relatives(star).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in found) == 1500 * 1499
    assert max(r[1] for r in found) < 1500 * 1499 / 3


@pytest.mark.parametrize("seed", range(3))
def test_two_hop_relatives_of_any_edges(spark, seed):
    from paperweave.operators import paths as P

    draw = np.random.default_rng(seed)
    names = [None, *"abcdefgh"]
    edges = [(names[i], names[j]) for i, j in draw.integers(0, 9, (14, 2))] + [("x", "h"), ("y", "h"), ("h", "x"), ("z", "z"), ("z", "a")]
    con = duckdb.connect()
    con.execute("CREATE TABLE p (child VARCHAR, parent VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", edges)
    want = con.sql(
        """WITH parents AS (SELECT DISTINCT * FROM p), e AS (SELECT child AS x, parent AS y, child, parent FROM parents UNION ALL SELECT parent, child, child, parent FROM parents)
        SELECT DISTINCT o.x AS node, t.y AS relative FROM e o JOIN e t ON o.y = t.x AND NOT (o.child = t.child AND o.parent = t.parent)"""
    ).fetchall()
    got = [tuple(r) for r in P.two_hop_relatives(spark.createDataFrame(edges, "child string, parent string")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["association_normalise", "external_majority", "external_statistics", "external_compare", "external_summary"])
def test_external_source_has_every_line(spark, sf, name):
    from .test_contract import value

    sql = entry.oracle_sql()[name]
    whole = sql.replace("FROM lineitem WHERE l_linenumber <= 4", "FROM lineitem")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(whole)
    got = entry.queries()[name](spark, sf).select(*want.columns).collect()
    plain = lambda rows: sorted(tuple(value(v) for v in r) for r in rows)
    assert plain(got) == plain(want.fetchall())
    assert plain(got) != plain(con.sql(sql).fetchall()) or whole == sql


def parts(spark, folder, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")


def test_stop_entities_reads_every_part(spark, tmp_path):
    parts(spark, tmp_path, [(1, "a", "B", "T", 1), (2, "b", "B", "T", 2), (3, "Bacteria", "B", "T", 3), (4, "c", "B", "Diseases", 4)])
    assert run(spark, tmp_path, "stop_entities") == [(1, "T", "a"), (2, "T", "b")]


def test_synonym_cascade_knows_every_name(spark, tmp_path):
    parts(spark, tmp_path, [(1, "a", "Brand#1", "T", 1), (50, "b", "Brand#3", "T", 1), (52, "b", "Brand#3", "T", 1), (60, None, "Brand#3", "T", 1), (61, None, None, "A", 1), (62, None, None, "C", 1)])
    assert run(spark, tmp_path, "synonym_cascade") == [(1, 1), (50, 50), (52, 50), (60, 100050), (61, 1), (62, None)]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_lsh_finds_nearly_all_of_the_nearest(spark, size):
    folder, k = f"/root/testdata/{size}", 10
    x = pq.read_table(f"{folder}/embeddings.parquet").to_pydict()
    v, ids = np.array(x["embedding"], float), np.array(x["vec_id"])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in entry.queries()["lsh_knn"](spark, folder).collect():
        got.setdefault(r.query, set()).add(r.neighbour)
    queries = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    best = {ids[i]: set(ids[[j for j in np.argsort(-(v @ v[i]), kind="stable") if j != i][:k]]) for i in queries}
    assert {q: len(n) for q, n in got.items()} == {q: min(k, len(ids) - 1) for q in best}
    assert sum(len(best[q] & got[q]) for q in best) >= 0.9 * sum(map(len, best.values()))


def test_sentences_reach_past_a_million_characters(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 220_000 + ". The LAST one.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r[1:] for r in run(spark, tmp_path, "sentence_split")][-1] == (1, "the last one")


@pytest.mark.parametrize(
    "name, steps",
    [("kmeans_clusters", {"kmeans": ["restarts"]}), ("walk_word2vec", {"random_walks": ["length", "per_node"]}), ("metapath_word2vec", {"random_walks": ["per_node"]}), ("link_prediction", {"fastrp": ["dim"], "train_link_prediction": ["folds"]})],
)
def test_learning_queries_use_the_operators_defaults(spark, sf, monkeypatch, name, steps):
    used = {}

    class Stop(Exception):
        pass

    def watched(step, f):
        def call(*a, **b):
            bound = inspect.signature(f).bind(*a, **b)
            used[step] = {k: bound.arguments[k] for k in steps[step] if k in bound.arguments}
            if len(used) == len(steps):
                raise Stop
            return f(*a, **b)

        return call

    for step in steps:
        monkeypatch.setattr(G, step, watched(step, getattr(G, step)))
    with pytest.raises(Stop):
        entry.queries()[name](spark, sf)
    assert used == {step: {} for step in steps}


def test_places_in_even_ranges(spark):
    """Outlying and frequent values put no more rows into a range than others."""
    from pyspark.sql import functions as F

    from paperweave.operators.folds import placed

    rows = spark.range(20_000).select(F.when(F.col("id") == 0, 10**15).when(F.col("id") < 8000, 5).otherwise(F.col("id") % 1000).cast("long").alias("k"), "id")
    got = placed(rows, ["k", "id"]).collect()
    want = sorted((r.k, r.id) for r in got)
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r._i)] == want and sorted(r._i for r in got) == list(range(20_000))
    n = [r["count"] for r in rows.repartitionByRange(16, "k", "id").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(n) < 2 * 20_000 / len(n) and len(n) == 16
    few = placed(spark.createDataFrame([(None, 1), (3, 2), (None, 0)], "k long, id long"), ["k", "id"]).collect()
    assert {(r.k, r.id): r._i for r in few} == {(None, 0): 0, (None, 1): 1, (3, 2): 2}
