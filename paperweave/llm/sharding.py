"""Sharding by a hierarchical weighted hash tree; DataFrame functions only.

A tree has regions, regions have racks, racks have shards, and shards have weights. A row descends: at each level every child draws
-ln(u)/w, u being a hash of the row's key, the path so far and the child's number, and w the sum of the weights below; the smallest
draw wins. A child is thus taken in proportion to its weight, and a changed weight moves rows into or out of that child only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick, uniform

Tree = list[list[list[float]]]
#: Buckets by which the rows of a shard are numbered in parallel.
SLOT_BUCKETS = 256


def even_tree(shards: int, regions: int = 4, racks: int = 2) -> Tree:
    """Shards of weight 1 over regions and racks, as even as they go; none empty."""
    racks_all = [[1.0] * (shards // (regions * racks) + (i < shards % (regions * racks))) for i in range(regions * racks)]
    out = [[r for r in racks_all[i * racks : (i + 1) * racks] if r] for i in range(regions)]
    return [r for r in out if r]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, as a region of its own: no weight of another subtree changes, so rows move into the new shard only."""
    return [*tree, [[weight]]]


def _draw(key: Column, path: list[Column], weights: Column) -> Column:
    """Number of the child with the smallest draw. ``weights``: an array, one for each child."""

    def score(w: Column, j: Column) -> Column:
        return F.struct((-F.log(uniform(key, *path, j)) / w).alias("s"), j.alias("j"))

    return F.array_min(F.transform(weights, score))["j"]


def place(rows: DataFrame, key: str, out: str, tree: Tree, seed: int = 0) -> DataFrame:
    """Adds the shard of a key column, numbered through the tree from 0. Each level is a projection of its own that the next refers to."""
    width = max(len(r) for r in tree)
    flat = [r[j] if j < len(r) else [] for r in tree for j in range(width)]
    firsts = [sum(map(len, flat[:i])) for i in range(len(flat))]

    def doubles(values: list[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")

    region, rack = F.col("_region"), F.col("_rack")
    rows = rows.withColumn("_region", _draw(F.col(key), [F.lit(seed), F.lit("region")], doubles([sum(map(sum, r)) for r in tree])))
    rows = rows.withColumn("_rack", _draw(F.col(key), [F.lit(seed), F.lit("rack"), region], F.get(F.array(*[doubles([sum(k) for k in r]) for r in tree]), region)))
    rows = rows.withColumn("_at", region * width + rack)
    rows = rows.withColumn("_shard", _draw(F.col(key), [F.lit(seed), F.lit("shard"), region, rack], F.get(F.array(*map(doubles, flat)), F.col("_at"))))
    first = F.get(F.array(*[F.lit(i) for i in firsts]), F.col("_at"))
    return rows.withColumn(out, (first + F.col("_shard")).cast("int")).drop("_region", "_rack", "_at", "_shard")


def with_slots(rows: DataFrame, shard: str, order: list[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: a bucket's first slot is a prefix sum of bucket counts, at most shards x buckets rows."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    firsts = rows.groupBy(shard, "_b").agg(F.count(F.lit(1)).alias("_n"))
    firsts = firsts.select(shard, "_b", (F.sum("_n").over(Window.partitionBy(shard).orderBy("_b")) - F.col("_n")).alias("_first"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(shard, "_b").orderBy(*order)))
    # shards x buckets rows at most, whatever the table
    return ranked.join(F.broadcast(firsts), [shard, "_b"]).withColumn("slot", F.col("_first") + F.col("_r").cast("long") - 1).drop("_b", "_first", "_r")


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 0, tree: Tree | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the tree decide alone, so equal doc_ids share a shard whatever their texts. size is the UTF-8
    length of the text plus 16 and text_crc32 its CRC-32; a null text has no bytes (16 and 0). A null doc_id is a key like another.
    Repeated rows each take a slot. grown_shard is the shard after one more, of weight 1, joins as a region of its own. Other
    columns are not read. An empty table gives no rows. Rows are numbered without their texts.
    """
    tree = tree or even_tree(shards)
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32")
    )
    rows = place(place(rows.withColumn("law", F.lit("key")), "doc_id", "shard", tree, seed), "doc_id", "grown_shard", grown(tree), seed)
    rows = with_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
