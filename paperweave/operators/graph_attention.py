"""Attention over typed neighbourhoods, as groupings and joins.

A node's incoming edges of a type are weighted by the softmax of a score of both ends, then the types by one of how the nodes' results
agree with a learnt direction. A hub's edges are dealt into parts: each part gives its largest score and, against the hub's largest,
its sum, so neither a softmax nor a sum needs a node's edges in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph_network import Relation

#: Parts into which the edges of a node are dealt.
SALTS = 32


def segment_softmax(rows: DataFrame, group: list[str], scores: list[str], salts: int = SALTS) -> DataFrame:
    """``rows`` with each of ``scores`` replaced by its softmax within the group."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    keys, whole = [*group, "_salt"], Window.partitionBy(*group)
    top = salted.groupBy(*keys).agg(*[F.max(s).alias(f"_m{i}") for i, s in enumerate(scores)])
    top = top.select(*keys, *[F.max(f"_m{i}").over(whole).alias(f"_m{i}") for i in range(len(scores))])
    raised = salted.join(top, keys).select(*keys, *[c for c in rows.columns if c not in (*group, *scores)], *[F.exp(F.col(s) - F.col(f"_m{i}")).alias(s) for i, s in enumerate(scores)])
    sums = raised.groupBy(*keys).agg(*[F.sum(s).alias(f"_s{i}") for i, s in enumerate(scores)])
    sums = sums.select(*keys, *[F.sum(f"_s{i}").over(whole).alias(f"_s{i}") for i in range(len(scores))])
    out = raised.join(sums, keys)
    for i, s in enumerate(scores):
        out = out.withColumn(s, F.col(s) / F.col(f"_s{i}"))
    return out.select(*rows.columns)


def _dot(vector: Column, weights: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def _affine(vector: Column, weights: np.ndarray, bias: np.ndarray) -> Column:
    """vector times weights (in, out) plus bias."""
    return F.array(*[_dot(vector, weights[:, j]) + F.lit(float(bias[j])) for j in range(weights.shape[1])])


def random_weights(relations: list[Relation], width: int, heads: int, size: int, seed: int = 0) -> dict[str, np.ndarray]:
    draw, total = np.random.default_rng(seed), heads * size
    kinds = dict.fromkeys(k for _, a, b in relations for k in (a, b))
    out = {f"{p}.{k}": draw.normal(0, 0.5, s) for k in kinds for p, s in (("project", (width, total)), ("bias", (total,)))}
    out |= {f"{p}.{name}": draw.normal(0, 0.5, (heads, size)) for name, _, _ in relations for p in ("from", "to")}
    return out | {"agree": draw.normal(0, 0.5, (total, total)), "agree_bias": draw.normal(0, 0.5, total), "direction": draw.normal(0, 0.5, total)}


def edge_attention(nodes: DataFrame, edges: DataFrame, relation: Relation, weights: dict[str, np.ndarray], slope: float = 0.2) -> DataFrame:
    """(src, dst, a0, a1, ...): the attention that each head pays to each edge of a type. ``nodes`` are projected (node, kind, h)."""
    name, a, b = relation
    heads, size = weights[f"from.{name}"].shape
    part = lambda v, i: F.slice(v, i * size + 1, size)
    one = edges.where(F.col("type") == name).select("src", "dst")
    src = nodes.where(F.col("kind") == a).select(F.col("node").alias("src"), *[_dot(part(F.col("h"), i), weights[f"from.{name}"][i]).alias(f"_f{i}") for i in range(heads)])
    dst = nodes.where(F.col("kind") == b).select(F.col("node").alias("dst"), *[_dot(part(F.col("h"), i), weights[f"to.{name}"][i]).alias(f"_t{i}") for i in range(heads)])
    z = lambda i: F.col(f"_f{i}") + F.col(f"_t{i}")
    scored = one.join(src, "src").join(dst, "dst").select("src", "dst", *[F.when(z(i) > 0, z(i)).otherwise(slope * z(i)).alias(f"a{i}") for i in range(heads)])
    return segment_softmax(scored, ["dst"], [f"a{i}" for i in range(heads)])


def attention_layer(nodes: DataFrame, edges: DataFrame, relations: list[Relation], weights: dict[str, np.ndarray]) -> DataFrame:
    """(node, kind, embedding) of the nodes (node, kind, x) at which some type points; nodes without edges of a type have zeros from it."""
    from ..plans.lineage import cut

    kinds = list(dict.fromkeys(k for _, a, b in relations for k in (a, b)))
    projected = None
    for k in kinds:
        one = nodes.where(F.col("kind") == k).select("node", "kind", _affine(F.col("x"), weights[f"project.{k}"], weights[f"bias.{k}"]).alias("h"))
        projected = one if projected is None else projected.unionByName(one)
    projected = cut(projected)
    total = len(weights["direction"])
    zero = F.array(*[F.lit(0.0)] * total)
    seen = None
    for relation in relations:
        name, _, b = relation
        heads, size = weights[f"from.{name}"].shape
        paid = edge_attention(projected, edges, relation, weights).join(projected.select(F.col("node").alias("src"), "h"), "src")
        sums = paid.groupBy("dst").agg(F.array(*[F.sum(F.col(f"a{i // size}") * F.col("h")[i]) for i in range(total)]).alias("o"))
        mine = projected.where(F.col("kind") == b).join(sums.withColumnRenamed("dst", "node"), "node", "left")
        one = mine.select("node", "kind", F.lit(name).alias("type"), F.transform(F.coalesce("o", zero), lambda v: F.greatest(v, F.lit(0.0))).alias("o"))
        seen = one if seen is None else seen.unionByName(one)
    seen = cut(seen)
    # how much the nodes of a kind agree on a type, on average: as many rows as kinds and types
    agree = F.transform(_affine(F.col("o"), weights["agree"], weights["agree_bias"]), lambda v: F.tanh(v))
    means = seen.select("kind", "type", _dot(agree, weights["direction"]).alias("s")).groupBy("kind", "type").agg(F.avg("s").alias("s"))
    shares = segment_softmax(means, ["kind"], ["s"], 1)
    both = seen.join(F.broadcast(shares), ["kind", "type"])
    return both.groupBy("node", "kind").agg(F.array(*[F.sum(F.col("s") * F.col("o")[i]) for i in range(total)]).alias("embedding"))
