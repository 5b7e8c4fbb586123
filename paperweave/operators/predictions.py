"""Clean-up and ranking of predicted links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_predictions(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Of (src, src_label, dst, dst_label, type, pred_strength): microbe to disease only, no pair that a type has twice, none below ``least``.

    All copies of a repeated pair go, not all but one.
    """
    forward = rows.where((F.col("src_label") == "Microbe") & (F.col("dst_label") == "Disease"))
    single = forward.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("src", "dst", "type"))).where("_n = 1").drop("_n")
    return single.where(F.col("pred_strength") >= least)


def top_predictions(rows: DataFrame, key: str, cui: int, n: int = 10) -> DataFrame:
    """The n likeliest links of a node for each type."""
    mine = rows.where(F.col(key) == cui)
    r = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("pred_strength"), "src", "dst"))
    return mine.withColumn("ranking", r).where(F.col("ranking") <= n)


def named(rows: DataFrame, microbes: DataFrame, diseases: DataFrame) -> DataFrame:
    """Adds the names of both ends."""
    m = microbes.select(F.col("cui").alias("src"), F.col("name").alias("microbe"))
    d = diseases.select(F.col("cui").alias("dst"), F.col("name").alias("disease"))
    return rows.join(m, "src").join(d, "dst")
