"""Point and neighbourhood queries over the graph's tables; values are bound, never formatted into text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import placed


def node_by_property(nodes: DataFrame, prop: str, value) -> DataFrame:
    """First node, by cui, whose property equals a value."""
    return nodes.where(F.col(prop) == F.lit(value)).orderBy("cui").limit(1)


def nodes_by_cui(microbes: DataFrame, diseases: DataFrame, cuis: Iterable[int]) -> DataFrame:
    """Nodes of either label with one of the cuis."""
    both = microbes.select(F.lit("Microbe").alias("label"), "cui", "name").unionByName(diseases.select(F.lit("Disease").alias("label"), "cui", "name"))
    return both.where(F.col("cui").isin(list(cuis)))


def pair_relations(evidence: DataFrame, microbe: int, disease: int) -> DataFrame:
    """Evidence of a pair, negative ones first."""
    pair = evidence.where((F.col("cui_microbe") == microbe) & (F.col("cui_disease") == disease))
    columns = ["rel_type", "pmid", "seq", "year", "journal", "impact_factor", "quartile"]
    return pair.where(F.col("rel_type") == "negative").select(*columns).unionByName(pair.where(F.col("rel_type") == "positive").select(*columns))


def pair_evidence_any_order(evidence: DataFrame, a: int, b: int) -> DataFrame:
    """Evidence of two cuis whichever of them is the microbe."""
    forward = (F.col("cui_microbe") == a) & (F.col("cui_disease") == b)
    return evidence.where(forward | ((F.col("cui_microbe") == b) & (F.col("cui_disease") == a))).select("cui_microbe", "cui_disease", F.upper("rel_type").alias("direction"), "pmid", "seq")


def pair_strength(strengths: DataFrame, microbe: int, disease: int) -> DataFrame:
    return strengths.where((F.col("cui_microbe") == microbe) & (F.col("cui_disease") == disease))


def node_relations(strengths: DataFrame, key: str, cui: int, positive: bool, other: str, others: DataFrame) -> DataFrame:
    """Strength edges of a node by sign; zero counts as positive."""
    x = F.col("strength_raw")
    mine = strengths.where((F.col(key) == cui) & ((x >= 0) if positive else (x < 0)))
    return mine.join(others.select(F.col("cui").alias(other), "name"), other).select(other, "name", "strength_raw", "strength_if", "strength_ifq")


def related_publications(evidence: DataFrame, key: str, cui: int) -> DataFrame:
    return evidence.where(F.col(key) == cui).select("pmid", "year", "journal", "rel_type").distinct()


def publications_by_year(evidence: DataFrame, key: str, cui: int) -> DataFrame:
    """The same in the order of years, each year's numbered by pmid."""
    place = F.row_number().over(Window.partitionBy("year").orderBy("pmid", "rel_type"))
    return related_publications(evidence, key, cui).withColumn("place", place).orderBy("year", "place")


def one_hop(strengths: DataFrame, parents: DataFrame, cui: str, n: int = 50) -> DataFrame:
    """Neighbourhood over strength and parent edges in their own direction, relation as text; at most n, in order of the edge."""
    s = strengths.select(F.concat(F.lit("p"), F.col("cui_microbe").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("cui_disease").cast("string")).alias("target"), F.col("strength_raw").cast("string").alias("relation"))
    both = s.unionByName(parents.select(F.col("parent").alias("source"), F.col("child").alias("target"), F.lit("PARENT").alias("relation")))
    return both.where((F.col("source") == cui) | (F.col("target") == cui)).orderBy("source", "target", "relation").limit(n)


def node_presence(microbes: DataFrame, diseases: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of (cui_microbe, cui_disease): whether each end is a node."""
    m = microbes.select(F.col("cui").alias("cui_microbe"), F.lit(True).alias("m")).distinct()
    d = diseases.select(F.col("cui").alias("cui_disease"), F.lit(True).alias("d")).distinct()
    out = pairs.join(m, "cui_microbe", "left").join(d, "cui_disease", "left")
    return out.select("cui_microbe", "cui_disease", F.coalesce("m", F.lit(False)).alias("has_microbe"), F.coalesce("d", F.lit(False)).alias("has_disease"))


def degrees(edges: DataFrame, undirected: Iterable[str]) -> DataFrame:
    """(node, degree) over (src, dst, type); edges of the ``undirected`` types count at both ends, others at their source."""
    out = edges.select(F.col("src").alias("node")).unionAll(edges.where(F.col("type").isin(list(undirected))).select(F.col("dst").alias("node")))
    return out.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def both_orientations(parents: DataFrame) -> DataFrame:
    """An undirected match over edges between nodes of one label gives each edge twice, once from either end."""
    return parents.select(F.col("child").alias("a"), F.col("parent").alias("b")).unionAll(parents.select(F.col("parent").alias("a"), F.col("child").alias("b")))


def surrogate_ids(nodes: DataFrame, key: str) -> DataFrame:
    """(key, id) with ids from 0 in the order of an integer key, numbered in parallel."""
    keys = nodes.where(F.col(key).isNotNull()).select(key).distinct()
    return placed(keys, [key], "id").select(key, "id")


def map_ids(edges: DataFrame, key: str, ids: DataFrame, out: str) -> DataFrame:
    """A key replaced by its id; a key without one becomes null."""
    return edges.join(ids.select(F.col(ids.columns[0]).alias(key), F.col("id").alias(out)), key, "left").drop(key)
