"""Node properties as columns: projected, written, aligned, dropped, renamed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column whose name may hold any character."""
    return F.col("`" + name.replace("`", "``") + "`")


def property_of(nodes: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """(key, out): a node property by its name."""
    return nodes.select(key, quoted(name).alias(out))


def write_property(nodes: DataFrame, key: str, values: DataFrame, name: str) -> DataFrame:
    """Nodes with values (key, value) as a property; a property of that name is replaced, nodes without a value get null."""
    return without_property(nodes, name).join(values.toDF(key, name), key, "left")


def without_property(nodes: DataFrame, *names: str) -> DataFrame:
    return nodes.drop(*names)


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All keys of either table with the columns of both."""
    return left.join(right, key, "full_outer")


def reshaped(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of the mapping alone, in its order, under its names."""
    return rows.select(*[quoted(old).alias(new) for old, new in columns.items()])


def as_strings(rows: DataFrame) -> DataFrame:
    return rows.select(*[quoted(c).cast("string").alias(c) for c in rows.columns])


def homogeneous(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(src, dst) of edges between two kinds of nodes as numbers from 0: those of ``a`` first, those of ``b`` after them.

    Kinds are numbered in the order of their integer keys.
    """
    from .lookups import surrogate_ids

    left, right = surrogate_ids(edges, a), surrogate_ids(edges, b)
    offset = left.agg(F.count(F.lit(1)).alias("_offset"))
    right = right.crossJoin(F.broadcast(offset)).select(b, (F.col("id") + F.col("_offset")).alias("dst"))  # one row
    return edges.join(left.withColumnRenamed("id", "src"), a).join(right, b).select("src", "dst")


def typed_edges(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """(type, src, dst) of edge tables (src, dst) by type, ends replaced by ids (node, id) of their own kind."""
    out = None
    for kind, edges in tables.items():
        one = edges.select(F.lit(kind).alias("type"), "src", "dst")
        out = one if out is None else out.unionByName(one)
    left, right = ids.toDF("src", "src_id"), ids.toDF("dst", "dst_id")
    return out.join(left, "src").join(right, "dst").select("type", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def sampled_neighbours(edges: DataFrame, seeds: DataFrame, fan_outs: list[int], draw: Column) -> DataFrame:
    """(hop, a, b) of edges (a, b) taken from the seeds (node) on: at hop h at most fan_outs[h] of each node just reached, by smallest draw."""
    from ..plans.lineage import cut

    few = edges.select("a", "b").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(draw, "b"))).where(F.col("_r") <= max(fan_outs))
    few = cut(few)
    out, at = None, seeds.select("node").distinct()
    for hop, n in enumerate(fan_outs, 1):
        step = few.where(F.col("_r") <= n).join(at, F.col("a") == F.col("node"), "left_semi").select(F.lit(hop).alias("hop"), "a", "b")
        out = step if out is None else out.unionByName(step)
        at = step.select(F.col("b").alias("node")).distinct()
    return out
