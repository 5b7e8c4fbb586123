"""The write path of the graph: relations found in papers become nodes, lineages, evidence and strengths."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .strength import refresh_strengths
from .upserts import insert_new, upsert_evidence, upsert_nodes, upsert_parents


@dataclass(frozen=True)
class Graph:
    microbes: DataFrame  # cui, name
    diseases: DataFrame  # cui, name
    parents: DataFrame  # child, parent
    evidence: DataFrame  # cui_microbe, cui_disease, pmid, seq, rel_type, impact_factor, quartile
    strengths: DataFrame  # cui_microbe, cui_disease and the measures


def impact_factors(papers: DataFrame, journals: DataFrame) -> DataFrame:
    """Papers (pmid, issn, ...) with impact_factor, that of their journal (issn, factor as text); null where it is unknown or empty."""
    factor = F.nullif(F.btrim("factor"), F.lit("")).try_cast("double")
    known = journals.where(F.col("issn").isNotNull()).groupBy("issn").agg(F.min(factor).alias("impact_factor"))
    return papers.join(known, "issn", "left")


def insert_relations(graph: Graph, relations: DataFrame, journals: DataFrame, lineages: DataFrame) -> Graph:
    """``graph`` with relations (cui_microbe, microbe, cui_disease, disease, pmid, issn, seq, rel_type, quartile) inserted.

    Relations na and relate never enter. Nodes and their lineages (child, parent, seq) are created where absent; a pair has one edge per
    paper, the first; strengths are computed anew for the pairs that gained an edge and stay as they are for all others.
    """
    real = impact_factors(relations.where(~F.col("rel_type").isin("na", "relate")), journals)
    microbes = upsert_nodes(graph.microbes, real.select(F.col("cui_microbe").alias("cui"), F.col("microbe").alias("name"), "pmid", "seq"), ["pmid", "seq"])
    diseases = upsert_nodes(graph.diseases, real.select(F.col("cui_disease").alias("cui"), F.col("disease").alias("name"), "pmid", "seq"), ["pmid", "seq"])
    parents = upsert_parents(graph.parents, lineages, ["seq"])
    key = ["cui_microbe", "cui_disease", "pmid"]
    fresh = insert_new(graph.evidence, real, key, ["seq", "rel_type"])
    evidence = upsert_evidence(graph.evidence, real, ["seq", "rel_type"])
    return replace(graph, microbes=microbes, diseases=diseases, parents=parents, evidence=evidence, strengths=refresh_strengths(graph.strengths, evidence, fresh))


def without_types(edges: DataFrame, *types: str) -> DataFrame:
    """Edges (src, dst, type, ...) but those of the types, which need not be there."""
    return edges.where(~F.col("type").isin(*types)) if types else edges
