"""Counts, rankings and series for dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_nodes(strengths: DataFrame) -> DataFrame:
    """Microbes and diseases with a strength edge."""
    m = strengths.agg(F.count_distinct("cui_microbe").alias("n")).select(F.lit("Microbe").alias("label"), "n")
    return m.unionByName(strengths.agg(F.count_distinct("cui_disease").alias("n")).select(F.lit("Disease").alias("label"), "n"))


def count_papers(evidence: DataFrame) -> DataFrame:
    return evidence.agg(F.count_distinct("pmid").alias("n_papers"))


def count_relationships(evidence: DataFrame) -> DataFrame:
    return evidence.agg(F.count_if(F.col("rel_type") == "positive").alias("n_positive"), F.count_if(F.col("rel_type") == "negative").alias("n_negative"), F.count(F.lit(1)).alias("n_total"))


def top_nodes(edges: DataFrame, key: str, nodes: DataFrame, positive: Column, n: int) -> DataFrame:
    """(cui, name, total, positive, negative) of the n nodes with most edges; counted by cui, as names repeat; ties by cui.

    Edges are aggregated before the names are joined, so the join sees one row per node.
    """
    counts = edges.groupBy(F.col(key).alias("cui")).agg(F.count(F.lit(1)).alias("total"), F.count_if(positive).alias("positive"), F.count_if(~positive).alias("negative"))
    return counts.join(nodes.select("cui", "name"), "cui").orderBy(F.desc("total"), "cui").limit(n)


def per_year(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("year").agg(F.count(F.lit(1)).alias("n_relations"))


def papers_per_year(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("year").agg(F.count_distinct("pmid").alias("n_papers"))


def popularity(evidence: DataFrame, key: str, cui: int) -> DataFrame:
    """Distinct papers per year that mention a node."""
    return papers_per_year(evidence.where(F.col(key) == cui))


def fill_years(series: DataFrame, value: str) -> DataFrame:
    """A yearly series with every year from its first to its last, 0 where it had none."""
    span = series.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL")
    years = span.select(F.explode(F.sequence("a", "b")).alias("year"))
    return years.join(series, "year", "left").select("year", F.coalesce(F.col(value), F.lit(0)).alias(value))


def top_papers(evidence: DataFrame, n: int = 10) -> DataFrame:
    """Most mentioned papers, ties by pmid."""
    return evidence.groupBy("pmid").agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "pmid").limit(n)


def papers_by_journal(evidence: DataFrame, n: int = 10) -> DataFrame:
    """Papers per journal, each paper in the journal of its first mention; top n, ties by journal."""
    first = evidence.groupBy("pmid").agg(F.min_by("journal", "seq").alias("journal"))
    return first.groupBy("journal").agg(F.count(F.lit(1)).alias("papers")).orderBy(F.desc("papers"), "journal").limit(n)


def rank_pairs(strengths: DataFrame, microbes: DataFrame, diseases: DataFrame, measure: str, n: int, strongest: bool = True) -> DataFrame:
    """The n strongest pairs by a measure (the most negative ones if not ``strongest``) with names and rank.

    The limit comes before the joins with names, so two joins of n rows remain; ties by microbe and disease.
    """
    x = F.col(measure)
    top = strengths.orderBy(x.desc() if strongest else x.asc(), "cui_microbe", "cui_disease").limit(n)
    ranked = top.withColumn("ranking", F.row_number().over(Window.orderBy(x.desc() if strongest else x.asc(), "cui_microbe", "cui_disease")))
    ranked = ranked.join(microbes.select(F.col("cui").alias("cui_microbe"), F.col("name").alias("microbe")), "cui_microbe")
    ranked = ranked.join(diseases.select(F.col("cui").alias("cui_disease"), F.col("name").alias("disease")), "cui_disease")
    return ranked.select("ranking", "cui_microbe", "microbe", "cui_disease", "disease", x.alias("strength"))


def linked_nodes(strengths: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """Nodes with a strength edge, with the option label 'Name (cui)', sorted by name."""
    linked = nodes.join(strengths.select(F.col(key).alias("cui")).distinct(), "cui", "left_semi")
    return linked.select("cui", "name", option_label(F.col("name"), F.col("cui").cast("string")).alias("option")).orderBy("name", "cui")


def capitalise(c: Column) -> Column:
    """First letter upper, the rest lower (not initcap, which does so for every word)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def option_label(name: Column, cui: Column) -> Column:
    return F.concat(capitalise(name), F.lit(" ("), cui, F.lit(")"))


def parse_option(option: Column) -> Column:
    """The cui of an option label."""
    return F.regexp_extract(option, r"\(([^()]*)\)$", 1)


def sign_counts_per_pair(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Negative and positive papers of every given pair, 0 where there are none; each side is aggregated before the outer join."""
    pair = ["cui_microbe", "cui_disease"]
    counts = evidence.groupBy(*pair).agg(F.count_if(F.col("rel_type") == "negative").alias("n_negative"), F.count_if(F.col("rel_type") == "positive").alias("n_positive"))
    return pairs.join(counts, pair, "left").select(*pair, F.coalesce("n_negative", F.lit(0)).alias("n_negative"), F.coalesce("n_positive", F.lit(0)).alias("n_positive"))
