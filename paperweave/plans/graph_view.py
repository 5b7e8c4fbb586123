"""The property graph that the driver's tables stand for.

Papers are orders, microbes parts, diseases nations (through a line's supplier); a line item is a mention of a pair in a paper, its
return flag the relation (A positive, R negative, N none). Impact factor and quartile are missing on some lines, so that the
defaults matter. The microbe hierarchy is part, brand, type, the disease hierarchy nation, region, root.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table


class GraphView:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def microbes(self) -> DataFrame:
        return self._t("part").select(F.col("p_partkey").alias("cui"), F.col("p_name").alias("name"), F.col("p_type").alias("rank"), F.col("p_brand").alias("family"))

    @cached_property
    def diseases(self) -> DataFrame:
        return self._t("nation").select(F.col("n_nationkey").cast("long").alias("cui"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))

    @cached_property
    def mentions(self) -> DataFrame:
        """One row per mention of a pair in a paper, relation na included."""
        lines = self._t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
        papers = self._t("orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
        places = self._t("supplier").select("s_suppkey", "s_nationkey")
        joined = lines.join(papers, F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        return joined.select(
            F.col("l_partkey").alias("cui_microbe"),
            F.col("s_nationkey").cast("long").alias("cui_disease"),
            F.col("l_orderkey").alias("pmid"),
            F.col("l_linenumber").alias("seq"),
            F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("na").alias("rel_type"),
            F.year("o_orderdate").alias("year"),
            F.col("o_orderpriority").alias("journal"),
            F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 10000).alias("impact_factor"),
            F.when(F.col("l_linenumber") != 6, F.concat(F.lit("Q"), (F.col("l_orderkey") % 4 + 1).cast("string"))).alias("quartile"),
        )

    @cached_property
    def evidence(self) -> DataFrame:
        """Mentions that enter the graph."""
        return self.mentions.where(F.col("rel_type").isin("positive", "negative"))

    @cached_property
    def strengths(self) -> DataFrame:
        from ..operators.strength import edge_strengths

        return edge_strengths(self.evidence)

    @cached_property
    def microbe_parents(self) -> DataFrame:
        """(child, parent) of part to brand to type, distinct; brands have several types."""
        p = self._t("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("p"), F.concat(F.lit("b"), "p_brand").alias("b"), F.concat(F.lit("t"), "p_type").alias("t"))
        return p.select(F.col("p").alias("child"), F.col("b").alias("parent")).unionByName(p.select(F.col("b").alias("child"), F.col("t").alias("parent"))).distinct()

    @cached_property
    def disease_parents(self) -> DataFrame:
        n = self._t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
        return n.unionByName(n.select(F.col("parent").alias("child"), F.lit("root").alias("parent")).distinct())


#: The same in SQL: common table expressions to put behind WITH.
MENTIONS = """mentions AS (
  SELECT l_partkey AS cui_microbe, CAST(s_nationkey AS BIGINT) AS cui_disease, l_orderkey AS pmid, l_linenumber AS seq,
         CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'na' END AS rel_type,
         CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS journal,
         CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 10000 END AS impact_factor,
         CASE WHEN l_linenumber <> 6 THEN 'Q' || CAST(l_orderkey % 4 + 1 AS VARCHAR) END AS quartile
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""
EVIDENCE = MENTIONS + ",\nevidence AS (SELECT * FROM mentions WHERE rel_type <> 'na')"
STRENGTHS = (
    EVIDENCE
    + """,
strengths AS (
  SELECT cui_microbe, cui_disease, CAST(sum(s) AS BIGINT) AS strength_raw,
         round(sum(s * CASE WHEN impact_factor IS NULL THEN 3.5 ELSE log10(impact_factor) END), 3) + 0.0 AS strength_if,
         round(sum(s * log10(coalesce(impact_factor, 3.5) / coalesce(CAST(substr(quartile, 2, 1) AS INTEGER), 2))), 3) + 0.0 AS strength_ifq
  FROM (SELECT *, CASE rel_type WHEN 'positive' THEN 1 ELSE -1 END AS s FROM evidence) GROUP BY ALL)"""
).replace("GROUP BY ALL", "GROUP BY cui_microbe, cui_disease")
MICROBES = "microbes AS (SELECT p_partkey AS cui, p_name AS name, p_type AS rank, p_brand AS family FROM part)"
DISEASES = "diseases AS (SELECT CAST(n_nationkey AS BIGINT) AS cui, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation)"
MICROBE_PARENTS = """microbe_parents AS (
  SELECT 'p' || p_partkey AS child, 'b' || p_brand AS parent FROM part UNION SELECT 'b' || p_brand, 't' || p_type FROM part)"""
DISEASE_PARENTS = """disease_parents AS (
  SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'r' || n_regionkey, 'root' FROM nation)"""
