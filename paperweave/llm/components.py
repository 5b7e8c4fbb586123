"""Connected components of a link table, on the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


#: Links that a task joins at once.
AT_ONCE = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """Links with the same components, each node linked to the smallest that it reaches within ``at_once`` links of the task or so."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def out() -> Iterator[pa.RecordBatch]:
        nodes = list(up)
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], ["a", "b"])

    done = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
        done += batch.num_rows
        if done >= at_once:
            yield from out()
            up.clear()
            done = 0
    yield from out()


def connected(links: DataFrame, scratch: Scratch, at_once: int = AT_ONCE) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node it can reach.

    Each task first replaces its links by stars, which have the same components. While any edge has two labels, a round takes the smallest
    label among neighbours and then the label's own label, so long chains shorten by halves.
    """
    stars = links.select("a", "b").mapInArrow(lambda batches: _stars(batches, at_once), "a long, b long")
    ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = scratch.write("edges", stars.select(F.inline(ways)).distinct())
    labels = scratch.write("labels", both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.where("u < v").join(labels.toDF("u", "_u"), "u").join(labels.toDF("v", "_v"), "v")
        if not near.where("_u != _v").head(1):
            scratch.drop(both)
            return labels
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("m"))
        step = scratch.write("step", labels.join(near, labels.node == near.u).select("node", F.least("label", "m").alias("label")))
        up = step.toDF("parent", "top")
        new = scratch.write("labels", step.join(up, step.label == up.parent, "left").select("node", F.least("label", "top").alias("label")))
        scratch.drop(step, labels)
        labels = new
