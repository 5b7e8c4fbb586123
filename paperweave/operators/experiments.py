"""Few-shot prompts, model inputs, verification of disagreements and training by epochs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chat import answer_label, fill_template, first_line, message
from .augment import three_classes

#: The numbers of the classes.
CLASS_IDS = {"positive": 0, "negative": 1, "relate": 2, "na": 3}
TEMPLATE = "{evidence} What relation is there between {microbe} and {disease}?"


def model_input(evidence: Column, question: Column) -> Column:
    return F.concat(evidence, F.lit(" [SEP] "), question)


def class_id(label: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, i in CLASS_IDS.items():
        out = F.when(label == name, i).otherwise(out)
    return out


def question(rows: DataFrame, template: str = TEMPLATE) -> Column:
    return fill_template(template, evidence=F.col("evidence"), microbe=F.col("microbe"), disease=F.col("disease"))


def few_shot(neighbours: DataFrame, examples: DataFrame, key: str, shots: int, system: str) -> DataFrame:
    """(query, messages): the system text, then the ``shots`` nearest examples (key, question, label) as user and assistant turns.

    neighbours are (query, neighbour, ranking); the nearest example comes first, and relate is told as na.
    """
    near = neighbours.where(F.col("ranking") <= shots).join(examples, F.col("neighbour") == F.col(key))
    turns = F.array(message("user", F.col("question")), message("assistant", three_classes(F.col("label"))))
    each = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ranking", turns.alias("turns")))).alias("x"))
    return each.select("query", F.concat(F.array(message("system", F.lit(system))), F.flatten(F.transform("x", lambda x: x["turns"]))).alias("messages"))


def evaluate(rows: DataFrame, model: Callable[[Column], Column], prompt: Column, key: str) -> DataFrame:
    """(key, prompt, answer, prediction, label) of rows with a label: the model's answer to the prompt and the label read out of it."""
    asked = rows.select(key, "label", prompt.alias("prompt")).withColumn("answer", first_line(model(F.col("prompt"))))
    return asked.select(key, "prompt", "answer", answer_label(F.col("answer")).alias("prediction"), three_classes(F.col("label")).alias("label"))


def verification_prompt(text: Column, ours: Column, theirs: Column, ways: int = 3) -> Column:
    """What a third party is asked where two sources disagree: which of the two it is, or with three ways maybe neither."""
    head = F.concat(text, F.lit(" Is the relation "), ours, F.lit(" or "), theirs)
    return F.concat(head, F.lit(", or is there none?" if ways == 3 else "?"))


def verified(answers: DataFrame, labels: tuple[str, ...], *sources: str) -> DataFrame:
    """One row: percent of the answers (answer and one column per source) that equal each source's label. An unknown answer is an error."""
    known = F.when(F.col("answer").isin(*labels), F.col("answer")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("answer", F.lit("null")))).cast("string"))
    checked = answers.withColumn("answer", known)
    return checked.agg(*[F.round(100 * F.avg((F.col("answer") == F.col(s)).cast("double")), 1).alias(s) for s in sources])


def support_ratio(rows: DataFrame, model: str, support: str, gold: int = 1100) -> DataFrame:
    """(model, ratio): the folds' supports added up, over the size of the gold set."""
    return rows.groupBy(model).agg(F.round(F.sum(support) / gold, 6).alias("ratio"))


def chosen_only(rows: DataFrame, prediction: str) -> DataFrame:
    """Rows on which an ensemble agreed, others being -1."""
    return rows.where(F.col(prediction) != -1)


class Epoch(NamedTuple):
    """Mean losses of the rows that teach and that validate, the latter's accuracy, and the mean gradient."""

    t: float | None
    v: float | None
    a: float | None
    g: np.ndarray | None


def _epoch_sums(data: DataFrame, w: np.ndarray) -> tuple[tuple[int, float], tuple[int, float, float], np.ndarray]:
    """Of rows (x, y, v): number and summed loss of those that teach; number, summed loss and hits of the others; the former's gradient.

    Batches are summed where they lie, as products with the matrix of their rows, and added up as decimals, the same in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(w))
            y, v = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            held, teach = (v.fill_null(no).to_numpy(zero_copy_only=False) == want for no, want in ((False, True), (True, False)))
            with np.errstate(over="ignore"):
                p = np.clip(1 / (1 + np.exp(-(x @ w))), 1e-12, 1 - 1e-12)
            loss = -(y * np.log(p) + (1 - y) * np.log(1 - p))
            sums = [teach.sum(), loss[teach].sum(), held.sum(), loss[held].sum(), ((p >= 0.5) == y)[held].sum(), *((p - y)[teach] @ x[teach])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(np.array(sums, float))], ["at", "v"])

    parts = data.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,15)")).cast("double").alias("v"))
    out = np.zeros(5 + len(w))
    for r in parts.collect():  # as many as weights
        out[r.at] = r.v
    return (round(out[0]), out[1].item()), (round(out[2]), out[3].item(), out[4].item()), out[5:]


def train_epochs(rows: DataFrame, features: str, label: str, split: str, epochs: int = 300, patience: int = 50, rate: float = 1.0) -> tuple[list[float], list[dict]]:
    """Weights, the bias last, of a logistic model by gradient descent, and a log of (epoch, train_loss, val_loss, val_accuracy).

    ``features`` is an array of doubles of one size. Each epoch is one aggregation; rows without features or label do not count; training stops when the loss on the rows whose split
    is 'validation' has not fallen for ``patience`` epochs, and the weights of its best epoch are the result.
    """
    data = rows.select(F.concat(F.col(features), F.array(F.lit(1.0))).alias("x"), F.col(label).cast("double").alias("y"), (F.col(split) == "validation").alias("v"))
    data = data.dropna(subset=["x", "y"])
    first = data.select(F.size("x")).first()
    if first is None:
        return [], []
    width = first[0]
    data = data.persist()
    try:
        w, best, log = [0.0] * width, (math.inf, [0.0] * width, 0), []
        for epoch in range(1, epochs + 1):
            (n, t), (held, v, a), sums = _epoch_sums(data, np.array(w))
            r = Epoch(t / n if n else None, v / held if held else None, a / held if held else None, sums / n if n else None)
            log.append({"epoch": epoch, "train_loss": r.t, "val_loss": r.v, "val_accuracy": r.a})
            judged = r.v if r.v is not None else r.t
            if judged is None:
                break
            if judged < best[0] - 1e-9:
                best = judged, list(w), epoch
            elif epoch - best[2] >= patience:
                break
            if r.g is not None:
                w = (np.array(w) - rate * r.g).tolist()
        return best[1], log
    finally:
        data.unpersist()


def predicted(rows: DataFrame, features: str, weights: list[float]) -> DataFrame:
    """Rows with ``probability`` and ``prediction`` of the trained weights."""
    x = F.concat(F.col(features), F.array(F.lit(1.0)))
    z = F.aggregate(F.zip_with(x, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("probability", 1 / (1 + F.exp(-z))).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def last_reversed(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows, numbered as they are shown: the last of them first."""
    top = rows.orderBy(*order).limit(n).withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    return top.withColumn("shown", F.row_number().over(Window.orderBy(F.desc("_r")))).drop("_r")  # n rows
