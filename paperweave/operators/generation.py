"""Classes filled by generation: a round over the rows that are still open for each attempt.

Every row that a class lacks is a slot. An attempt draws a microbe, a disease and examples of the slot's class, asks the model, and
keeps an answer that names both entities. Only slots without such an answer enter the next attempt. Attempts are tables in the run's
folder, so a run that was stopped goes on with the first attempt that is not whole there.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chat import fill_template, message
from .folds import placed, placed_within

SYSTEM = "You write sentences for a collection of relations between microbes and diseases."
TASK = "Write one sentence. Microbe: {microbe}. Disease: {disease}. Relation: {relation}."
REMINDER = "The sentence must name the microbe {microbe} and the disease {disease}."
#: Multipliers of the draws, primes larger than any pool is likely to have for a factor.
STEPS = {"microbe": (7919, 104729), "disease": (15485863, 32452843), "example": (49979687, 86028121)}
#: Slots that one copy of a drawn row serves; rows that more slots draw are copied before the join.
SERVED = 4096
#: Examples of a class that are never shown, as the smallest classes would otherwise be shown whole.
KEPT_BACK = 5


def draw(slot: Column, attempt: int, kind: str, n: Column) -> Column:
    """A place below n; an attempt with a reminder, every second one, draws what the attempt before it drew."""
    a, b = STEPS[kind]
    return F.pmod(slot * F.lit(a) + F.lit((attempt - 1) // 2 * b), F.nullif(n, F.lit(0)))


def heat(attempt: int, base: float = 0.8, patience: int = 5, step: float = 0.01) -> float:
    """The temperature of an attempt: ``step`` more for each one after the first ``patience``."""
    return round(base + step * max(0, attempt - patience), 6)


def copies(needed: Column, n: Column, shots: int) -> Column:
    """How often each of n examples stands in the join, so that no copy serves many more than ``SERVED`` slots."""
    many = F.ceil(F.greatest(F.coalesce(needed, F.lit(0)), F.lit(0)) * F.lit(shots) / (F.greatest(n, F.lit(1)) * F.lit(SERVED)))
    return F.greatest(many.cast("long"), F.lit(1).cast("long"))


def open_slots(needed: DataFrame, sizes: DataFrame, shots: int) -> DataFrame:
    """(label, slot, n, copies): slots from 0 for every row that a class of (class, needed) lacks, with its number of examples."""
    classes = needed.where("class IS NOT NULL AND needed > 0").select(F.col("class").cast("string").alias("label"), F.col("needed").cast("long").alias("needed"))
    classes = classes.join(sizes, "label", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    blocks = classes.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("needed") - 1) / SERVED)))).repartition("label", "_b")
    each = blocks.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(SERVED - 1)))).withColumn("slot", F.col("_b") * SERVED + F.col("_o"))
    return each.where("slot < needed").select("label", "slot", "n", copies(F.col("needed"), F.col("n"), shots).alias("copies"))


def _named(rows: DataFrame, kind: str) -> tuple[DataFrame, int]:
    names = placed(rows.select(kind).where(F.col(kind).isNotNull()).distinct(), [kind])
    return names, names.count()


def _with_name(asked: DataFrame, names: tuple[DataFrame, int], kind: str, attempt: int, slots: int) -> DataFrame:
    pool, n = names
    copies = max(1, -(-slots // (max(n, 1) * SERVED)))
    pool = pool.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(F.col("_i").alias("_place"), F.col("_c").cast("long").alias("_c"), kind)
    at = draw(F.col("slot"), attempt, kind, F.lit(n).cast("long"))
    return asked.withColumn("_place", at).withColumn("_c", F.pmod(F.floor(F.col("slot") / max(n, 1)), F.lit(copies))).join(pool, ["_place", "_c"], "left").drop("_place", "_c")


def _task(template: str) -> Column:
    return fill_template(template, microbe=F.col("microbe"), disease=F.col("disease"), relation=F.upper("label"))


def _with_examples(asked: DataFrame, examples: DataFrame, attempt: int, shots: int) -> DataFrame:
    """Adds ``shown``, the turns of ``shots`` examples of the class, fewer where it is small, and their number ``shots``."""
    many = F.least(F.lit(shots).cast("long"), F.greatest(F.col("n") - KEPT_BACK, F.lit(0).cast("long")))
    asked = asked.withColumn("shots", many)
    each = asked.where("shots > 0").select("label", "slot", "n", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shots") - 1)).alias("_j"))
    at = F.pmod(draw(F.col("slot"), attempt, "example", F.col("n")) + F.col("_j"), F.nullif(F.col("n"), F.lit(0)))
    # slots that draw one place are n apart
    each = each.select("label", "slot", "_j", at.alias("_i"), F.pmod(F.floor(F.col("slot") / F.col("n")), F.col("copies")).alias("_c"))
    pool = examples.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select("label", "_i", "_c", _task(TASK).alias("_asked"), "text")
    turns = F.array(message("user", F.col("_asked")), message("assistant", F.col("text")))
    met = each.join(pool, ["label", "_i", "_c"]).groupBy("label", "slot").agg(F.array_sort(F.collect_list(F.struct("_j", turns.alias("t")))).alias("x"))
    met = met.select("label", "slot", F.flatten(F.transform("x", lambda x: x["t"])).alias("shown"))
    return asked.join(met, ["label", "slot"], "left")


def _asking(model: Callable[[str, float], str | None], warmth: float) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else model(p, warmth))

    return run


def attempted(open_: DataFrame, examples: DataFrame, microbes: tuple[DataFrame, int], diseases: tuple[DataFrame, int], model: Callable[[str, float], str | None], attempt: int, shots: int, slots: int) -> DataFrame:
    """One attempt at slots (label, slot, n, copies, answer): the same with microbe, disease, shots, attempts, answer and, if it names both
    entities, text."""
    asked = _with_name(_with_name(open_.withColumnRenamed("answer", "_before"), microbes, "microbe", attempt, slots), diseases, "disease", attempt, slots)
    asked = _with_examples(asked, examples, attempt, shots)
    none = F.array().cast("array<struct<role: string, content: string>>")
    turns = F.concat(F.array(message("system", F.lit(SYSTEM))), F.coalesce("shown", none), F.array(message("user", _task(TASK))))
    if attempt % 2 == 0:
        turns = F.concat(turns, F.array(message("assistant", F.coalesce("_before", F.lit(""))), message("user", F.concat(_task(REMINDER), F.lit(" "), _task(TASK)))))
    whole = F.col("microbe").isNotNull() & F.col("disease").isNotNull()
    out = asked.withColumn("answer", F.trim(F.replace(_asking(model, heat(attempt))(F.when(whole, F.to_json(turns))), F.lit("\n"), F.lit(""))))
    low = F.lower("answer")
    both = F.contains(low, F.lower("microbe")) & F.contains(low, F.lower("disease"))
    return out.select("label", "slot", "n", "copies", "microbe", "disease", "shots", F.lit(attempt).alias("attempts"), "answer", F.when(both, F.col("answer")).alias("text"))


def _finished(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def fill_classes(examples: DataFrame, needed: DataFrame, model: Callable[[str, float], str | None], folder: str, shots: int = 15, attempts: int = 6) -> DataFrame:
    """One row for each row that a class lacks: label, slot, attempts, microbe, disease, shots, text.

    ``examples`` are (text, microbe, disease, label), without the rows of a fold that is held out; ``needed`` is (class, needed). The
    model gets the turns as JSON and a temperature. ``text`` is null where ``attempts`` were spent in vain. Examples with a null column
    are not shown, null names not drawn; a class without examples is asked for without any; a class that lacks nothing has no rows;
    without a microbe or a disease to draw, nothing is written. ``folder`` must be shared by all executors and is the run: attempts
    found whole there are not made again.
    """
    spark = examples.sparkSession
    rows = examples.select("text", "microbe", "disease", F.col("label").cast("string").alias("label"))
    lack = needed.groupBy(F.col("class").cast("string").alias("label")).agg(F.sum("needed").alias("_lack"))
    whole = placed_within(rows.dropna().withColumn("_h", F.xxhash64("text")), "label", ["_h", "text", "microbe", "disease"]).drop("_h")
    sizes = whole.groupBy("label").agg(F.max("_n").alias("n"))
    shown = whole.join(lack, "label", "left").withColumn("copies", copies(F.col("_lack"), F.col("_n"), shots)).drop("_lack", "_n")
    microbes, diseases = _named(rows, "microbe"), _named(rows, "disease")
    slots = open_slots(needed, sizes, shots).withColumn("answer", F.lit(None).cast("string"))
    made, total = [], None
    for attempt in range(1, attempts + 1):
        path = f"{folder.rstrip('/')}/attempt-{attempt:03d}"
        if not _finished(spark, path):
            total = slots.count() if total is None else total
            attempted(slots, shown, microbes, diseases, model, attempt, shots, total).write.mode("overwrite").parquet(path)
        done = spark.read.parquet(path)
        left = done.where("text IS NULL")
        last = attempt == attempts or left.isEmpty()
        made.append(done if last else done.where("text IS NOT NULL"))
        if last:
            break
        slots = left.select("label", "slot", "n", "copies", "answer")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.select("label", "slot", "attempts", "microbe", "disease", "shots", "text")


def stub_writer(prompt: str, warmth: float) -> str:
    """A sentence with both names of the last turn; without the disease for names whose lengths add up to a multiple of 4, and, unless
    it is reminded, of 3."""
    last = json.loads(prompt)[-1]["content"]
    microbe, rest = last.rsplit("Microbe: ", 1)[1].split(". Disease: ", 1)
    disease = rest.rsplit(". Relation: ", 1)[0]
    size = len(microbe) + len(disease)
    forgets = size % 4 == 0 or (size % 3 == 0 and not last.startswith("The sentence must"))
    return microbe if forgets else f"{microbe} is seen\n with {disease}"
