"""Signed, impact-weighted strengths of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_IMPACT, DEFAULT_QUARTILE = 3.5, 2
MEASURES = ("strength_raw", "strength_if", "strength_ifq")


def sign(rel_type: Column) -> Column:
    return F.when(rel_type == "positive", 1).otherwise(-1)


def log10_strict(x: Column) -> Column:
    """log10 that is -Infinity at 0 and NaN below, where Spark's own gives null and a sum would skip the row."""
    return F.when(x > 0, F.log10(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def quartile_digit(quartile: Column) -> Column:
    """2 of 'Q2'; null where there is no digit."""
    return F.substring(quartile, 2, 1).try_cast("int")


def impact_weight(impact: Column) -> Column:
    """log10 of the impact factor; a missing factor counts 3.5 as it is, without the logarithm."""
    return F.when(impact.isNull(), DEFAULT_IMPACT).otherwise(log10_strict(impact))


def quartile_weight(impact: Column, quartile: Column) -> Column:
    """log10 of impact factor over quartile, both defaults inside the logarithm."""
    return log10_strict(F.coalesce(impact, F.lit(DEFAULT_IMPACT)) / F.coalesce(quartile_digit(quartile), F.lit(DEFAULT_QUARTILE)))


def edge_strengths(evidence: DataFrame) -> DataFrame:
    """One row per (cui_microbe, cui_disease): the three measures over its evidence, na already left out.

    Partial sums are made before the one shuffle on the pair.
    """
    s = sign(F.col("rel_type"))
    return evidence.groupBy("cui_microbe", "cui_disease").agg(
        F.sum(s).cast("long").alias("strength_raw"),
        (F.round(F.sum(s * impact_weight(F.col("impact_factor"))), 3) + F.lit(0.0)).alias("strength_if"),
        (F.round(F.sum(s * quartile_weight(F.col("impact_factor"), F.col("quartile"))), 3) + F.lit(0.0)).alias("strength_ifq"),
    )


def refresh_strengths(strengths: DataFrame, evidence: DataFrame, touched: DataFrame) -> DataFrame:
    """``strengths`` with the pairs of ``touched`` recomputed from ``evidence`` and all others as they are."""
    pair = ["cui_microbe", "cui_disease"]
    touched = touched.select(*pair).distinct()
    return strengths.join(touched, pair, "left_anti").unionByName(edge_strengths(evidence.join(touched, pair, "left_semi")))


def split_by_threshold(strengths: DataFrame, measure: str, threshold: float = 0.0) -> DataFrame:
    """Class 'positive' or 'negative' of each pair, others left out.

    At threshold 0 the sign decides and zero is out; else positive is >= threshold and negative is < -threshold.
    """
    x = F.col(measure)
    kind = F.when(x > 0, "positive").when(x < 0, "negative") if threshold == 0 else F.when(x >= threshold, "positive").when(x < -threshold, "negative")
    return strengths.withColumn("kind", kind).where("kind IS NOT NULL")


def sign_split_edges(strengths: DataFrame, parents: DataFrame, measure: str = "strength_raw") -> DataFrame:
    """(src, dst, type, strength): positive and negative strengths as edges of their own with their size, parents with 1; zero is absent."""
    x = F.col(measure).cast("double")
    pairs = strengths.select(F.col("cui_microbe").cast("string").alias("src"), F.col("cui_disease").cast("string").alias("dst"), x.alias("x"))
    signed = pairs.where("x != 0").select("src", "dst", F.when(F.col("x") > 0, "STRENGTH_POSITIVE").otherwise("STRENGTH_NEGATIVE").alias("type"), F.abs("x").alias("strength"))
    up = parents.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit("PARENT").alias("type"), F.lit(1.0).alias("strength"))
    return signed.unionByName(up)
