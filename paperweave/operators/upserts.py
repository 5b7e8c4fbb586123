"""Create-if-absent and incremental work; the first writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def insert_new(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` to append: the first of each key that ``old`` does not have. Rows without a whole key are rejected."""
    whole = new.dropna(subset=key)
    return first_by(whole.join(old.select(*key).distinct(), key, "left_anti"), key, order)


def rejected(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The other rows of ``new``, with the reason: a null key, a key that ``old`` has, or a later row of a key."""
    known = old.select(*key).distinct().withColumn("_old", F.lit(True))
    ranked = new.join(known, key, "left").withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    null = F.greatest(*[F.col(k).isNull().cast("int") for k in key], F.lit(0)) == 1
    reason = F.when(null, "null key").when(F.col("_old"), "present").when(F.col("_r") > 1, "repeated")
    return ranked.withColumn("reason", reason).where("reason IS NOT NULL").drop("_old", "_r")


def pending(source: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Keys of the source that no table of finished, lost or rejected work has."""
    out = source.select(key).distinct()
    for d in done:
        out = out.join(d.select(key).distinct(), key, "left_anti")
    return out


def upsert_nodes(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """All nodes by cui; the first definition of a cui stays."""
    return old.unionByName(insert_new(old, new, ["cui"], order).select(*old.columns))


def upsert_evidence(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """All evidence edges: at most one per microbe, disease and paper, whatever its type."""
    return old.unionByName(insert_new(old, new, ["cui_microbe", "cui_disease", "pmid"], order).select(*old.columns))


def upsert_parents(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """All (child, parent) edges: no loops, one edge per pair of nodes in whichever direction came first."""
    ends = lambda f: f.withColumn("_lo", F.least("child", "parent")).withColumn("_hi", F.greatest("child", "parent"))
    fresh = insert_new(ends(old), ends(new.where("child <> parent")), ["_lo", "_hi"], order)
    return old.unionByName(fresh.select(*old.columns))


def upsert_strengths(old: DataFrame, new: DataFrame) -> DataFrame:
    """All strengths; a pair that ``new`` has is overwritten."""
    return old.join(new, ["cui_microbe", "cui_disease"], "left_anti").unionByName(new)


def lineage_edges(lineages: DataFrame, line: list[str], position: str, node: str) -> DataFrame:
    """(child, parent) of consecutive nodes of each lineage, loops left out, distinct."""
    after = F.lead(node).over(Window.partitionBy(*line).orderBy(position))
    return lineages.select(F.col(node).alias("child"), after.alias("parent")).where("parent IS NOT NULL AND child <> parent").distinct()
