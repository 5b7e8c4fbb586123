"""The map in two dimensions against its definitions."""

import numpy as np
from pyspark.sql import functions as F

from paperweave.operators import graph_ml as G
from paperweave.operators import layout as L


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")


def places(df, key="id"):
    return np.array([(r.dim1, r.dim2) for r in df.orderBy(key).collect()])


def test_curve_is_the_known_one():
    a, b = L.curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01


def test_weights_add_up_and_are_united(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (i + j) % 12, float(1 - rng.random() / 2)) for i in range(12) for j in range(1, 6)]
    near = spark.createDataFrame(rows, "query long, neighbour long, similarity double")
    got = {(r.src, r.dst): r.w for r in L.fuzzy_graph(near).collect()}
    assert set(got) == {r[:2] for r in rows}
    single = {}
    for q in range(12):
        mine = {n: np.sqrt(2 - 2 * s) for k, n, s in rows if k == q}
        far = {n: d - min(mine.values()) for n, d in mine.items()}
        low, high = 1e-9, 1e3
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(np.exp(-d / mid) for d in far.values()) > np.log2(5) else (mid, high)
        single.update({(q, n): np.exp(-d / low) for n, d in far.items()})
    for (s, d), w in got.items():
        back = single.get((d, s), 0.0)
        assert abs(w - (single[s, d] + back - single[s, d] * back)) < 1e-6


def test_map_keeps_neighbours_better_than_components(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").limit(600)
    e = spark.createDataFrame([tuple(r) for r in e.select("vec_id", "embedding").collect()], "vec_id long, embedding array<float>")
    v = np.array([r.embedding for r in e.orderBy("vec_id").collect()], float)
    one = places(L.neighbour_layout(e, "vec_id", "embedding", block=256, rounds=6), "vec_id")
    again = places(L.neighbour_layout(e.repartition(7), "vec_id", "embedding", block=256, rounds=6), "vec_id")
    assert np.array_equal(one, again)
    pca = places(G.project_2d(e, "vec_id", "embedding"), "vec_id")
    assert L.trustworthiness(v, one) > L.trustworthiness(v, pca) + 0.02


def test_hub_and_copies_stay_finite(spark):
    rng = np.random.default_rng(1)
    v = np.vstack([np.ones((1, 5)), np.ones((40, 5)), np.ones((60, 5)) + rng.normal(size=(60, 5))])
    got = places(L.neighbour_layout(frame(spark, v), "id", "v", block=16, rounds=3))
    assert got.shape == (101, 2) and np.isfinite(got).all() and np.abs(got).max() < 1000


def test_few_rows_and_rows_without_vector(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert L.neighbour_layout(none, "id", "v").count() == 0
    some = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (None, [1.0, 1.0])], "id long, v array<double>")
    assert [r.id for r in L.neighbour_layout(some, "id", "v").collect()] == [1]
