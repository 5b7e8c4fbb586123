"""Reports on predictions, and class balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classification_report(rows: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support) of each class, then 'accuracy', 'macro avg' and 'weighted avg'.

    Ratios without a denominator are 0. One pass counts the pairs of classes; the rest works on these few counts.
    """
    pairs = rows.groupBy(F.col(truth).cast("string").alias("t"), F.col(prediction).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        pairs.select(F.col("p").alias("class"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("hit"))
    )
    each = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    each = each.select("class", "support", "hit", ratio(F.col("hit"), F.col("predicted")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"))
    each = each.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    total = F.sum("support")
    accuracy = F.sum("hit") / total

    def line(name: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), total.alias("support"))

    names = ("precision", "recall", "f1")
    lines = [line("accuracy", accuracy, accuracy, accuracy), line("macro avg", *map(F.avg, names)), line("weighted avg", *[F.sum(F.col(c) * F.col("support")) / total for c in names])]
    tail = each.agg(F.array(*lines).alias("x")).select(F.inline("x"))
    out = each.select("class", "precision", "recall", "f1", "support").union(tail)
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def confusion_matrix(rows: DataFrame, classes: list, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """One row per true class, one column p_<class> per predicted class."""
    return rows.groupBy(truth).agg(*[F.count_if(F.col(prediction) == F.lit(c)).alias(f"p_{c}") for c in classes])


def certain_only(rows: DataFrame, entropy: Column, most: float) -> DataFrame:
    return rows.where(entropy <= most)


def all_agree(votes: Column) -> Column:
    return F.size(F.array_distinct(votes)) == 1


def agree_and_two_certain(votes: Column, entropies: Column, most: float) -> Column:
    """All members agree and exactly two of them are certain."""
    return all_agree(votes) & (F.size(F.filter(entropies, lambda e: e <= most)) == 2)


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Inverse frequencies that add up to 1."""
    inverse = class_counts(rows, label).withColumn("inverse", 1 / F.col("n"))
    return inverse.select("class", "n", F.round(F.col("inverse") / F.sum("inverse").over(Window.partitionBy(F.lit(0))), 9).alias("weight"))


def needed_to_balance(rows: DataFrame, label: str, reference: object) -> DataFrame:
    """How many rows each class lacks to match the reference class."""
    counts = class_counts(rows, label)
    target = counts.where(F.col("class") == F.lit(reference)).agg(F.max("n").alias("target"))
    return counts.crossJoin(target).select("class", "n", (F.coalesce("target", F.lit(0)) - F.col("n")).alias("needed"))


def over_folds(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, population deviation and sum of a per-fold value."""
    return rows.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("deviation"), F.round(F.sum(value), 6).alias("total"))


def percent_equal(a: Column, b: Column) -> Column:
    """An aggregate: percent of rows with equal values, one decimal."""
    return F.round(100 * F.avg((a == b).cast("double")), 1)
