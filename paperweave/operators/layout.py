"""A map in two dimensions that keeps neighbours: a fuzzy neighbour graph, laid out by random blocks of vertices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .graph_ml import project_2d
from .vectors import nearest

#: Vertices that one task moves on average.
BLOCK = 2048


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a and b of the closeness 1 / (1 + a d^2b) that comes nearest to 1 up to ``min_dist`` and exponential decay beyond (damped Gauss-Newton)."""
    x = np.linspace(1e-3, 3 * spread, 300)
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))

    def left(at):
        return 1 / (1 + np.exp(at[0]) * x ** (2 * np.exp(at[1]))) - want

    at, damping = np.zeros(2), 1e-3
    for _ in range(200):
        r = left(at)
        slope = np.stack([(left(at + h) - r) / 1e-6 for h in 1e-6 * np.eye(2)], 1)
        step = np.linalg.solve(slope.T @ slope + damping * np.eye(2), -slope.T @ r)
        better = (left(at + step) ** 2).sum() < (r**2).sum()
        at, damping = (at + step, damping / 3) if better else (at, damping * 3)
    return float(np.exp(at[0])), float(np.exp(at[1]))


def _bandwidth(d: Column, target: float, rounds: int = 48) -> Column:
    """The s for which the exponentials of -d/s add up to ``target``, by doubling until it is passed and bisection from there."""
    total = lambda s: F.aggregate(d, F.lit(0.0), lambda t, x: t + F.exp(-x / s))

    def halve(s: Column, _: Column) -> Column:
        over = total(s["mid"]) > target
        low, high = F.when(over, s["low"]).otherwise(s["mid"]), F.when(over, s["mid"]).otherwise(s["high"])
        return F.struct(low.alias("low"), high.alias("high"), F.when(high < 0, 2 * s["mid"]).otherwise((low + F.abs(high)) / 2).alias("mid"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(-1.0).alias("high"), F.lit(1.0).alias("mid"))  # a negative end: none found yet
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)["mid"]


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """(src, dst, w) of neighbours (query, neighbour, similarity), each row one that ``query`` owns.

    Distances are those on the unit sphere, less that of a vertex's nearest other place; its bandwidth makes its weights add up to the
    binary logarithm of its number of neighbours. A pair that both ends chose has w1 + w2 - w1 w2 in both of its rows. A vertex owns as many
    rows as it has neighbours, however many chose it.
    """
    d = near.select("query", "neighbour", F.sqrt(F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0))).alias("d"))
    own = d.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("d", "neighbour"))).alias("all"))  # k rows each
    apart = F.filter(F.col("all")["d"], lambda x: x > 0)
    own = own.withColumn("rho", F.coalesce(F.try_element_at(apart, F.lit(1)), F.lit(0.0)))
    own = own.withColumn("far", F.transform(F.col("all")["d"], lambda x: F.greatest(x - F.col("rho"), F.lit(0.0))))
    floor = F.aggregate(F.col("all")["d"], F.lit(0.0), lambda t, x: t + x) / F.size("all") * 1e-3 + 1e-12
    own = own.withColumn("s", F.greatest(_bandwidth(F.col("far"), F.log2(F.size("all").cast("double"))), floor))
    one = own.select(F.col("query").alias("src"), F.inline(F.arrays_zip(F.col("all")["neighbour"].alias("dst"), F.transform("far", lambda x: F.exp(-x / F.col("s"))).alias("w"))))
    pairs = one.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.collect_list(F.struct("src", "dst", "w")).alias("ways"))  # at most two
    w = F.aggregate("ways", F.lit(1.0), lambda t, x: t * (1 - x["w"]), lambda t: 1 - t)
    return pairs.select(F.explode("ways").alias("way"), F.round(w, 9).alias("w")).select("way.src", "way.dst", "w")


def _block_step(a: float, b: float, rates: np.ndarray, negatives: int, turn: tuple[int, int]) -> Callable:
    """New places of the vertices that own a block's edges; the other ends of the edges stay where they are."""

    def step(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["src", "dst"])
        ids = np.unique(pdf[["src", "dst"]].to_numpy())
        i, j = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
        w, n = pdf["w"].to_numpy(), len(ids)
        at = np.zeros((n, 2))
        at[j] = pdf[["dx", "dy"]].to_numpy()
        at[i] = pdf[["sx", "sy"]].to_numpy()
        own = np.zeros(n, bool)
        own[i] = True
        draw = np.random.default_rng([*turn, int(key[0])])
        mine = np.flatnonzero(own)
        for rate in rates:
            hit = draw.random(len(i)) < w
            p, q = i[hit], j[hit]
            d = at[p] - at[q]
            s = np.maximum((d * d).sum(1), 1e-12)
            pull = np.clip((-2 * a * b * s ** (b - 1) / (1 + a * s**b))[:, None] * d, -4, 4)
            move, times = np.zeros((n, 2)), np.bincount(p, minlength=n) + np.bincount(q, minlength=n)
            np.add.at(move, p, pull)
            np.add.at(move, q, -pull)
            for _ in range(negatives):
                o = mine[draw.integers(0, len(mine), len(p))]
                d = at[p] - at[o]
                s = (d * d).sum(1)
                g = np.where(p == o, 0.0, 2 * b / ((1e-3 + s) * (1 + a * s**b)))
                np.add.at(move, p, np.clip(g[:, None] * d, -4, 4))
            # all edges of an epoch act at once: their mean, or a hub would overshoot; what other blocks own stays
            at += np.where(own, rate / np.maximum(times, 1), 0.0)[:, None] * move
        return pd.DataFrame({"id": ids[own], "nx": at[own, 0], "ny": at[own, 1]})

    return step


def neighbour_layout(
    rows: DataFrame,
    key: str,
    vector: str,
    k: int = 10,
    min_dist: float = 0.1,
    rounds: int = 12,
    epochs: int = 20,
    negatives: int = 5,
    rate: float = 0.5,
    seed: int = 42,
    block: int = BLOCK,
    near: DataFrame | None = None,
) -> DataFrame:
    """(key, dim1, dim2) of all rows with a vector, neighbours close to each other.

    ``near`` (query, neighbour, similarity) are neighbours found otherwise; without it they are exact, by blocks of queries. The first
    places are principal components, and equal ones are told apart by the key. In each round vertices are dealt anew into blocks of about
    ``block`` by a hash; a task sees its block's edges and the places of their other ends, and takes ``epochs`` steps against
    vertices drawn from the block, which is itself a draw from all; a vertex is moved by its own block only. Keys are whole numbers, one a row.
    The same seed gives the same map: what depends on the order of sums, components and weights, is rounded before it is used. Rows without a vector are left out, a row without neighbours stays at its first place.
    """
    rows = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    n = rows.count()
    if n < 3:
        return rows.select(F.col("id").alias(key), F.row_number().over(_one_row_window()).cast("double").alias("dim1"), F.lit(0.0).alias("dim2"))
    near = nearest(rows, rows, k, "id", "v") if near is None else near
    edges = cut(fuzzy_graph(near))
    first = project_2d(rows, "id", "v")
    widest = first.agg(F.greatest(F.max(F.abs("dim1")), F.max(F.abs("dim2")), F.lit(1e-9))).first()[0]
    jitter = lambda salt: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(2001)) - 1000) * 1e-6
    places = cut(first.select("id", *[(F.round(F.col(c) * (10 / widest), 4) + jitter(c)).alias(t) for c, t in (("dim1", "x"), ("dim2", "y"))]))
    a, b = curve(min_dist)
    blocks = -(-n // block)
    rates = np.linspace(rate, 0.0, rounds * epochs, endpoint=False).reshape(rounds, epochs)
    for r in range(rounds):
        ends = [places.select(F.col("id").alias(e), F.col("x").alias(f"{e[0]}x"), F.col("y").alias(f"{e[0]}y")) for e in ("src", "dst")]
        dealt = edges.join(ends[0], "src").join(ends[1], "dst").withColumn("block", F.pmod(F.xxhash64("src", F.lit(seed), F.lit(r)), F.lit(blocks)))
        moved = dealt.groupBy("block").applyInPandas(_block_step(a, b, rates[r], negatives, (seed, r)), "id long, nx double, ny double")
        places = cut(places.join(moved, "id", "left").select("id", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y")))
    return places.select(F.col("id").alias(key), F.col("x").alias("dim1"), F.col("y").alias("dim2"))


def _one_row_window():
    """Order for one or two rows."""
    from pyspark.sql import Window

    return Window.orderBy("id")


def trustworthiness(vectors: np.ndarray, places: np.ndarray, k: int = 10) -> float:
    """How far the k nearest rows of a map are near in the given space too, 1 at best; of a bounded number of rows, on the driver."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    n = len(unit)
    far = 1 - unit @ unit.T
    apart = ((places[:, None] - places[None]) ** 2).sum(2)
    np.fill_diagonal(far, -np.inf)
    np.fill_diagonal(apart, np.inf)
    rank = np.empty((n, n), int)
    rank[np.arange(n)[:, None], np.argsort(far, axis=1, kind="stable")] = np.arange(n)
    chosen = np.argsort(apart, axis=1, kind="stable")[:, :k]
    over = np.maximum(rank[np.arange(n)[:, None], chosen] - k, 0).sum()
    return 1 - 2 * over / (n * k * (2 * n - 3 * k - 1))
