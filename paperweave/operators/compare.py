"""Comparison of the graph with relation tables of other sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise_association(c: Column, words: Mapping[str, str]) -> Column:
    """A source's own word by its mapping; else by what it contains; else na."""
    out = F.when(F.contains(F.lower(c), F.lit("positive corr")), "positive").when(F.contains(F.lower(c), F.lit("negative corr")), "negative").otherwise("na")
    for word, relation in words.items():
        out = F.when(c == word, relation).otherwise(out)
    return F.when(c.isNull(), "na").otherwise(out)


def resolve_duplicates(rows: DataFrame) -> DataFrame:
    """Of (b_cui, d_cui, relation, seq, ...): one row per pair with its most common relation, ties by name, other columns of its last row.

    Rows without either key go.
    """
    pair = ["b_cui", "d_cui"]
    whole = rows.dropna(subset=pair)
    counts = whole.groupBy(*pair, "relation").agg(F.count(F.lit(1)).alias("n"))
    common = counts.groupBy(*pair).agg(F.min_by("relation", F.struct(-F.col("n"), F.col("relation"))).alias("relation"))
    others = [c for c in rows.columns if c not in (*pair, "relation")]
    last = whole.groupBy(*pair).agg(F.max(F.struct("seq", *[c for c in others if c != "seq"])).alias("x")).select(*pair, "x.*")
    return last.join(common, pair).select(*rows.columns)


def source_statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("b_cui").alias("n_bacteria"), F.count_distinct("d_cui").alias("n_diseases"), F.count(F.lit(1)).alias("n_rows"))


def considered(rows: DataFrame) -> DataFrame:
    """Adds ``status``: null key, repeated (not the first row of its pair) or first."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("b_cui", "d_cui").orderBy("seq")))
    null = F.col("b_cui").isNull() | F.col("d_cui").isNull()
    return ranked.withColumn("status", F.when(null, "null key").when(F.col("_r") > 1, "repeated").otherwise("first")).drop("_r")


def lookup_with_relatives(pairs: DataFrame, strengths: DataFrame, microbe_steps: DataFrame, disease_relatives: DataFrame) -> DataFrame:
    """Of distinct (b_cui, d_cui): the pair's strength, or that of the first pair of two-hop relatives which has one.

    Microbes are (node, via) with each node one hop away, diseases (node, relative) two hops away; the first is that with the smallest
    microbe, then the smallest disease. Pairs without any keep nulls. Siblings never meet: of the microbes that a node between them
    joins to a disease the two smallest are kept, one of which is not the pair's own.
    """
    s = strengths.select(F.col("cui_microbe").alias("b_out"), F.col("cui_disease").alias("d_out"), "strength_raw", "strength_if")
    exact = pairs.join(s, (F.col("b_cui") == F.col("b_out")) & (F.col("d_cui") == F.col("d_out")))
    open_ = pairs.join(strengths, (F.col("b_cui") == F.col("cui_microbe")) & (F.col("d_cui") == F.col("cui_disease")), "left_anti")
    smallest = s.join(microbe_steps, F.col("b_out") == F.col("node"))
    smallest = smallest.withColumn("_r", F.row_number().over(Window.partitionBy("via", "d_out").orderBy("b_out"))).where("_r <= 2").drop("_r", "node")
    d = disease_relatives.select(F.col("node").alias("d_cui"), F.col("relative").alias("d_out"))
    ways = open_.join(microbe_steps, F.col("b_cui") == F.col("node")).drop("node").join(d, "d_cui")
    near = ways.join(smallest, ["via", "d_out"]).where("b_out != b_cui")
    near = near.groupBy("b_cui", "d_cui").agg(F.min(F.struct("b_out", "d_out", "strength_raw", "strength_if")).alias("x")).select("b_cui", "d_cui", "x.*")
    found = exact.select("b_cui", "d_cui", "b_out", "d_out", "strength_raw", "strength_if").unionByName(near)
    return pairs.join(found, ["b_cui", "d_cui"], "left")


def coincidence(strength: Column, relation: Column) -> Column:
    """unsure at 0, coincide at one sign, else wrong, also where the other source says na; null without a strength."""
    same = ((strength > 0) & (relation == "positive")) | ((strength < 0) & (relation == "negative"))
    return F.when(strength.isNull(), None).when(strength == 0, "unsure").when(same, "coincide").otherwise("wrong")


def coincidence_weighted(strength: Column, relation: Column) -> Column:
    """The same for weighted strengths, where a relation of na against a sign is left out."""
    return F.when((strength != 0) & (relation == "na"), None).otherwise(coincidence(strength, relation))


def compare(rows: DataFrame, strengths: DataFrame, microbe_steps: DataFrame, disease_relatives: DataFrame) -> DataFrame:
    """The first row of each pair with what the graph says of it and how the two agree."""
    first = considered(rows).where("status = 'first'").drop("status")
    found = lookup_with_relatives(first.select("b_cui", "d_cui"), strengths, microbe_steps, disease_relatives)
    j = first.join(found, ["b_cui", "d_cui"])
    return j.withColumn("agreement", coincidence(F.col("strength_raw"), F.col("relation"))).withColumn("agreement_if", coincidence_weighted(F.col("strength_if"), F.col("relation")))


def percent(a: Column, b: Column) -> Column:
    return F.round(100 * a / F.nullif(b, F.lit(0)), 2)


def summary(rows: DataFrame, compared: DataFrame, microbes: DataFrame, diseases: DataFrame) -> DataFrame:
    """One row of counters. ``total`` has the first rows that say positive or negative, ``existing`` those of any relation that the graph knows."""
    status = considered(rows).agg(F.count_if(F.col("status") == "null key").alias("not_considered"), F.count_if(F.col("status") == "repeated").alias("repeated"))
    b = rows.select(F.col("b_cui").alias("cui")).dropna().distinct().join(microbes.select("cui").withColumn("m", F.lit(1)), "cui", "left")
    d = rows.select(F.col("d_cui").alias("cui")).dropna().distinct().join(diseases.select("cui").withColumn("m", F.lit(1)), "cui", "left")
    b, d = (x.agg(percent(F.count("m"), F.count(F.lit(1))).alias(n)) for x, n in ((b, "bacteria_percent"), (d, "disease_percent")))
    c = compared.agg(
        F.count_if(F.col("relation").isin("positive", "negative")).alias("total"),
        F.count("agreement").alias("existing"),
        *[F.count_if(F.col("agreement") == x).alias(x) for x in ("coincide", "unsure")],
        *[F.count_if(F.col("agreement_if") == x).alias(f"{x}_if") for x in ("coincide", "unsure")],
    )
    c = c.select("*", percent(F.col("existing"), F.col("total")).alias("existing_percent"), *[percent(F.col(x), F.col("existing")).alias(f"{x}_percent") for x in ("coincide", "unsure", "coincide_if", "unsure_if")])
    return c.crossJoin(status).crossJoin(b).crossJoin(d)


def evidence_digest(evidence: DataFrame, positive: bool, most: int = 10) -> DataFrame:
    """Per pair: its evidence of one direction, the first ``most`` as '[pmid] seq' joined, and how many there are."""
    mine = evidence.where(F.col("rel_type") == ("positive" if positive else "negative"))
    line = F.concat(F.lit("["), F.col("pmid").cast("string"), F.lit("] "), F.col("seq").cast("string"))
    ranked = mine.withColumn("_r", F.row_number().over(Window.partitionBy("cui_microbe", "cui_disease").orderBy("pmid", "seq"))).withColumn("_t", line)
    first = F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", "_t"))))
    return ranked.groupBy("cui_microbe", "cui_disease").agg(F.array_join(F.transform(first, lambda x: x["_t"]), " ||| \n").alias("evidence"), F.count(F.lit(1)).alias("n"))
