"""Classes, samples and augmented rows of labelled relations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import substitute_entities
from .folds import placed_within


def by_class(rows: DataFrame, label: str, classes: list[str]) -> dict[str, DataFrame]:
    """The rows of each class."""
    return {c: rows.where(F.col(label) == c) for c in classes}


def three_classes(label: Column, kept: str = "na") -> Column:
    """relate and na as one class, the one that is kept."""
    return F.when(label.isin("relate", "na"), kept).otherwise(label)


def sample_per_group(rows: DataFrame, group: str, order: list[Column], large: int = 30, rates: tuple[float, float] = (0.05, 0.1)) -> DataFrame:
    """Of groups of more than ``large`` rows the first part, of other groups of more than one row the second, of single rows all.

    Rows are taken in the given order, which makes the sample repeatable; half a row or more counts as one.
    """
    names = [f"_o{i}" for i in range(len(order))]
    ranked = placed_within(rows.withColumns(dict(zip(names, order, strict=True))), group, names).drop(*names)
    rate = F.when(F.col("_n") > large, rates[0]).when(F.col("_n") > 1, rates[1]).otherwise(1.0)
    return ranked.where(F.col("_i") < F.floor(F.col("_n") * rate + 0.5)).drop("_n", "_i")


def one_per_group(rows: DataFrame, group: str, value: str, order: Column) -> DataFrame:
    """(group, value): that of the row with the smallest order."""
    return rows.groupBy(group).agg(F.min_by(value, order).alias(value))


def shuffled_entities(rows: DataFrame, label: str, order: list[str], shift: int = 1) -> DataFrame:
    """Rows (text, microbe, disease, label, ...) with the entities of another row of their class in their text.

    The other row is ``shift`` places on, in order, and the first rows lend theirs to the last.
    """
    ranked = placed_within(rows, label, order)
    lender = ranked.select(label, F.pmod(F.col("_i") - shift, F.col("_n")).alias("_i"), F.col("microbe").alias("new_microbe"), F.col("disease").alias("new_disease"))
    out = ranked.join(lender, [label, "_i"]).drop("_i", "_n")
    return out.withColumn("text", substitute_entities(F.col("text"), F.col("disease"), F.col("new_disease"), F.col("microbe"), F.col("new_microbe")))


def rephrased(model: Callable[[str, int], str], tries: int = 4) -> Callable[..., Column]:
    """A column function of (text, microbe, disease): what the model, called with a text and the number of the try, writes first that
    names both entities; null after so many tries."""
    @F.pandas_udf("string")
    def run(text: pd.Series, microbe: pd.Series, disease: pd.Series) -> pd.Series:
        def one(t, m, d):
            found = (model(t or "", i) for i in range(tries))
            return next((x for x in found if (m or "") in x and (d or "") in x), None)

        return pd.Series([one(*x) for x in zip(text, microbe, disease, strict=True)], index=text.index)

    return run


def stub_rephrase(text: str, attempt: int) -> str:
    """The words from the attempt's on, and the text itself at the last try."""
    return text if attempt == 3 else " ".join(text.split()[3 - attempt :])


def fold_augmentations(augmented: DataFrame, folds: DataFrame, key: str, k: int) -> DataFrame:
    """Augmented rows whose base row is in a fold other than k."""
    return augmented.join(folds.where(F.col("fold") != k).select(key, "fold"), key)
