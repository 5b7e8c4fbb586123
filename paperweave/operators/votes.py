"""Votes of models, of stages and of the sentences of a paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ties go to the first of these.
LABELS = ("positive", "negative", "na")


def tally(votes: Column) -> Column:
    """Counts by label of an array of labels."""

    def count(label: str) -> Column:
        return F.size(F.filter(votes, lambda v: v == label))

    return F.struct(*[count(x).alias(x) for x in LABELS])


def winner(counts: Column) -> Column:
    most = F.greatest(*[counts[x] for x in LABELS])
    out = F.lit(LABELS[-1])
    for x in reversed(LABELS):
        out = F.when(counts[x] == most, x).otherwise(out)
    return out


def vote_entropy(counts: Column) -> Column:
    """Natural entropy of the shares, 0 for a unanimous vote (and not -0)."""
    total = sum((counts[x] for x in LABELS[1:]), counts[LABELS[0]]).cast("double")
    terms = [F.when(counts[x] > 0, -(counts[x] / total) * F.log(counts[x] / total)).otherwise(0.0) for x in LABELS]
    return sum(terms[1:], terms[0]) + F.lit(0.0)


def certain(counts: Column) -> Column:
    """The winner of a unanimous vote; na otherwise."""
    return F.when(vote_entropy(counts) == 0, winner(counts)).otherwise("na")


def final_selection(stages: Column) -> Column:
    """Most common label of the stages' answers; a tie goes to na where it takes part, else to the earliest."""
    count = lambda x: F.size(F.filter(stages, lambda v: v == x))
    most = F.array_max(F.transform(stages, count))
    best = F.filter(stages, lambda x: count(x) == most)
    return F.when(F.array_contains(best, "na"), "na").otherwise(best[0])


def paper_votes(mentions: DataFrame, group: list[str], order: list[str], evidence: Column) -> DataFrame:
    """One relation per group: the most common one, ties to the first seen, then by label; its distinct evidences in order, joined by ' ||| '.

    Mentions labelled na or relate have no vote.
    """
    real = mentions.where(~F.col("rel_type").isin("na", "relate"))
    counts = real.groupBy(*group, "rel_type").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct(*order)).alias("_first"), F.array_join(F.array_sort(F.collect_set(evidence)), " ||| ").alias("evidence"))
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("votes"), "_first", "rel_type"))
    return counts.withColumn("_r", best).where("_r = 1").select(*group, F.col("rel_type").alias("relation"), "votes", "evidence")


def ensemble_softmax(logits: Column) -> Column:
    """argmax of the members' softmaxes added up. ``logits``: an array of arrays."""

    def softmax(x: Column) -> Column:
        e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    soft = F.transform(logits, softmax)
    total = F.aggregate(F.slice(soft, 2, F.size(soft)), soft[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.array_position(total, F.array_max(total)).cast("int") - 1


def ensemble_vote(votes: Column) -> Column:
    """Most common of the members' classes; on a tie 2 if it is among the best, else 3, else the first."""
    count = lambda x: F.size(F.filter(votes, lambda v: v == x))
    most = F.array_max(F.transform(votes, count))
    best = F.array_distinct(F.filter(votes, lambda x: count(x) == most))
    return F.when(F.size(best) == 1, best[0]).when(F.array_contains(best, 2), 2).when(F.array_contains(best, 3), 3).otherwise(best[0])


def ensemble_agreement(votes: Column) -> Column:
    """The class on which the first three members agree, else -1."""
    return F.when((votes[0] == votes[1]) & (votes[1] == votes[2]), votes[0]).otherwise(-1)


def preferred_vote(votes: Column, preference: list[str]) -> Column:
    """Most common label; a tie goes to the first in the order of preference."""
    count = lambda x: F.size(F.filter(votes, lambda v: v == x))
    most = F.array_max(F.transform(votes, count))
    return F.filter(F.array(*[F.lit(p) for p in preference]), lambda p: count(p) == most)[0]
