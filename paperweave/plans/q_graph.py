"""Queries over the graph: strengths, dashboards, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboards as D
from ..operators import lookups as L
from ..operators import strength as S
from .graph_view import DISEASE_PARENTS, DISEASES, EVIDENCE, MENTIONS, MICROBE_PARENTS, MICROBES, STRENGTHS, GraphView
from .registry import query

STRENGTH_WITH = f"WITH {STRENGTHS}"
NAMED = f"WITH {STRENGTHS}, {MICROBES}, {DISEASES}"


@query(f"{STRENGTH_WITH} SELECT * FROM strengths")
def edge_strength_all_pairs(spark, sf_dir):
    return GraphView(spark, sf_dir).strengths


def _ranked(measure: str, strongest: bool) -> None:
    name = f"rank_{'positive' if strongest else 'negative'}_{measure}"
    way = "DESC" if strongest else "ASC"
    sql = f"""{NAMED} SELECT CAST(row_number() OVER (ORDER BY {measure} {way}, cui_microbe, cui_disease) AS INTEGER) AS ranking, cui_microbe, m.name AS microbe, cui_disease, d.name AS disease, {measure} AS strength
    FROM (SELECT * FROM strengths ORDER BY {measure} {way}, cui_microbe, cui_disease LIMIT 20) s JOIN microbes m ON m.cui = cui_microbe JOIN diseases d ON d.cui = cui_disease"""

    def run(spark, sf_dir):
        g = GraphView(spark, sf_dir)
        return D.rank_pairs(g.strengths, g.microbes, g.diseases, measure, 20, strongest)

    query(sql, name)(run)


for _m in S.MEASURES:
    _ranked(_m, True)
    _ranked(_m, False)


@query(f"{STRENGTH_WITH} SELECT 'Microbe' AS label, count(DISTINCT cui_microbe) AS n FROM strengths UNION ALL SELECT 'Disease', count(DISTINCT cui_disease) FROM strengths")
def count_nodes(spark, sf_dir):
    return D.count_nodes(GraphView(spark, sf_dir).strengths)


@query(f"WITH {EVIDENCE} SELECT count(DISTINCT pmid) AS n_papers FROM evidence")
def count_papers(spark, sf_dir):
    return D.count_papers(GraphView(spark, sf_dir).evidence)


@query(f"WITH {EVIDENCE} SELECT count(*) FILTER (rel_type = 'positive') AS n_positive, count(*) FILTER (rel_type = 'negative') AS n_negative, count(*) AS n_total FROM evidence")
def count_relationships(spark, sf_dir):
    return D.count_relationships(GraphView(spark, sf_dir).evidence)


def _top(label: str, references: bool) -> None:
    key = f"cui_{label}"
    source = "evidence" if references else "strengths"
    pos = "rel_type = 'positive'" if references else "strength_raw >= 0"
    sql = f"""{NAMED} SELECT cui, name, count(*) AS total, count(*) FILTER ({pos}) AS positive, count(*) FILTER (NOT ({pos})) AS negative
    FROM {source} JOIN {label}s ON cui = {key} GROUP BY cui, name ORDER BY total DESC, cui LIMIT 20"""

    def run(spark, sf_dir):
        g = GraphView(spark, sf_dir)
        edges = g.evidence if references else g.strengths
        return D.top_nodes(edges, key, g.microbes if label == "microbe" else g.diseases, F.expr(pos), 20)

    query(sql, f"{label}_{'references' if references else 'connections'}")(run)


for _l in ("microbe", "disease"):
    _top(_l, False)
    _top(_l, True)


@query(f"WITH {EVIDENCE} SELECT year, count(*) AS n_relations FROM evidence GROUP BY year")
def relations_by_year(spark, sf_dir):
    return D.per_year(GraphView(spark, sf_dir).evidence)


@query(f"WITH {EVIDENCE} SELECT year, count(DISTINCT pmid) AS n_papers FROM evidence GROUP BY year")
def papers_by_year(spark, sf_dir):
    return D.papers_per_year(GraphView(spark, sf_dir).evidence)


@query(f"WITH {EVIDENCE} SELECT year, count(DISTINCT pmid) AS n_papers FROM evidence WHERE cui_disease = 5 GROUP BY year")
def node_popularity_by_year(spark, sf_dir):
    return D.popularity(GraphView(spark, sf_dir).evidence, "cui_disease", 5)


@query(
    f"""WITH {EVIDENCE}, s AS (SELECT year, count(DISTINCT pmid) AS n_papers FROM evidence WHERE cui_microbe = 7 GROUP BY year),
    y AS (SELECT CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM s) SELECT y.year, coalesce(n_papers, 0) AS n_papers FROM y LEFT JOIN s USING (year)"""
)
def year_gap_fill(spark, sf_dir):
    return D.fill_years(D.popularity(GraphView(spark, sf_dir).evidence, "cui_microbe", 7), "n_papers")


@query(f"WITH {EVIDENCE} SELECT pmid, count(*) AS mentions FROM evidence GROUP BY pmid ORDER BY mentions DESC, pmid LIMIT 10")
def top_papers(spark, sf_dir):
    return D.top_papers(GraphView(spark, sf_dir).evidence)


@query(
    f"""WITH {EVIDENCE}, f AS (SELECT pmid, min(journal) AS journal FROM evidence GROUP BY pmid)
    SELECT journal, count(*) AS papers FROM f GROUP BY journal ORDER BY papers DESC, journal LIMIT 10"""
)
def papers_by_journal(spark, sf_dir):
    return D.papers_by_journal(GraphView(spark, sf_dir).evidence)


@query(f"WITH {MICROBES} SELECT * FROM microbes WHERE name = 'red widget' ORDER BY cui LIMIT 1")
def node_by_property_microbe(spark, sf_dir):
    return L.node_by_property(GraphView(spark, sf_dir).microbes, "name", "red widget")


@query(f"WITH {DISEASES} SELECT * FROM diseases WHERE region = 2 ORDER BY cui LIMIT 1")
def node_by_property_disease(spark, sf_dir):
    return L.node_by_property(GraphView(spark, sf_dir).diseases, "region", 2)


@query(f"WITH {MICROBES}, {DISEASES} SELECT 'Microbe' AS label, cui, name FROM microbes WHERE cui IN (3, 17) UNION ALL SELECT 'Disease', cui, name FROM diseases WHERE cui IN (3, 17)")
def nodes_by_cui(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    return L.nodes_by_cui(g.microbes, g.diseases, [3, 17])


@query(f"WITH {EVIDENCE} SELECT rel_type, pmid, seq, year, journal, impact_factor, quartile FROM evidence WHERE cui_microbe = 7 AND cui_disease = 5")
def pair_relations(spark, sf_dir):
    return L.pair_relations(GraphView(spark, sf_dir).evidence, 7, 5)


@query(f"WITH {EVIDENCE} SELECT cui_microbe, cui_disease, upper(rel_type) AS direction, pmid, seq FROM evidence WHERE (cui_microbe = 7 AND cui_disease = 5) OR (cui_microbe = 5 AND cui_disease = 7)")
def pair_evidence_any_order(spark, sf_dir):
    return L.pair_evidence_any_order(GraphView(spark, sf_dir).evidence, 5, 7)


@query(f"{STRENGTH_WITH} SELECT * FROM strengths WHERE cui_microbe = 7 AND cui_disease = 5")
def pair_strength(spark, sf_dir):
    return L.pair_strength(GraphView(spark, sf_dir).strengths, 7, 5)


def _relations(label: str, positive: bool) -> None:
    key, other = (("cui_microbe", "cui_disease") if label == "microbe" else ("cui_disease", "cui_microbe"))
    others = "diseases" if label == "microbe" else "microbes"
    sql = f"{NAMED} SELECT {other}, name, strength_raw, strength_if, strength_ifq FROM strengths JOIN {others} ON cui = {other} WHERE {key} = 7 AND strength_raw {'>=' if positive else '<'} 0"

    def run(spark, sf_dir):
        g = GraphView(spark, sf_dir)
        return L.node_relations(g.strengths, key, 7, positive, other, g.diseases if label == "microbe" else g.microbes)

    query(sql, f"{label}_relations_{'positive' if positive else 'negative'}")(run)


for _l in ("microbe", "disease"):
    _relations(_l, True)
    _relations(_l, False)


@query(f"WITH {EVIDENCE} SELECT DISTINCT pmid, year, journal, rel_type FROM evidence WHERE cui_microbe = 7")
def related_publications_microbe(spark, sf_dir):
    return L.related_publications(GraphView(spark, sf_dir).evidence, "cui_microbe", 7)


@query(f"WITH {EVIDENCE} SELECT DISTINCT pmid, year, journal, rel_type FROM evidence WHERE cui_disease = 7")
def related_publications_disease(spark, sf_dir):
    return L.related_publications(GraphView(spark, sf_dir).evidence, "cui_disease", 7)


def _linked(label: str) -> None:
    sql = f"""{NAMED} SELECT cui, name, upper(substr(name, 1, 1)) || lower(substr(name, 2)) || ' (' || CAST(cui AS VARCHAR) || ')' AS option
    FROM {label}s WHERE cui IN (SELECT cui_{label} FROM strengths)"""

    def run(spark, sf_dir):
        g = GraphView(spark, sf_dir)
        return D.linked_nodes(g.strengths, f"cui_{label}", g.microbes if label == "microbe" else g.diseases)

    query(sql, f"linked_node_list_{label}")(run)


_linked("microbe")
_linked("disease")


@query(f"WITH {DISEASES} SELECT cui, name || ' (' || cui || ')' AS option, CAST(cui AS VARCHAR) AS parsed FROM (SELECT cui, upper(substr(name, 1, 1)) || lower(substr(name, 2)) AS name FROM diseases)")
def option_labels(spark, sf_dir):
    d = GraphView(spark, sf_dir).diseases.select("cui", D.option_label(F.col("name"), F.col("cui").cast("string")).alias("option"))
    return d.withColumn("parsed", D.parse_option(F.col("option")))


@query(
    f"""WITH {MENTIONS}, p AS (SELECT DISTINCT cui_microbe, cui_disease FROM mentions)
    SELECT p.cui_microbe, p.cui_disease, count(*) FILTER (rel_type = 'negative') AS n_negative, count(*) FILTER (rel_type = 'positive') AS n_positive
    FROM p LEFT JOIN mentions USING (cui_microbe, cui_disease) GROUP BY p.cui_microbe, p.cui_disease"""
)
def pos_neg_counts_left_join(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    return D.sign_counts_per_pair(g.mentions.select("cui_microbe", "cui_disease").distinct(), g.evidence)


@query(f"WITH {MICROBE_PARENTS} SELECT child AS a, parent AS b FROM microbe_parents UNION ALL SELECT parent, child FROM microbe_parents")
def parents_both_orientations(spark, sf_dir):
    return L.both_orientations(GraphView(spark, sf_dir).microbe_parents)


_IDS = "ids AS (SELECT cui, row_number() OVER (ORDER BY cui) - 1 AS id FROM {0}s)"


@query(f"WITH {MICROBES}, {_IDS.format('microbe')} SELECT * FROM ids")
def surrogate_ids(spark, sf_dir):
    return L.surrogate_ids(GraphView(spark, sf_dir).microbes, "cui")


@query(
    f"""{NAMED}, mi AS (SELECT cui, row_number() OVER (ORDER BY cui) - 1 AS id FROM microbes), di AS (SELECT cui, row_number() OVER (ORDER BY cui) - 1 AS id FROM diseases WHERE cui <> 3)
    SELECT mi.id AS id_microbe, di.id AS id_disease, strength_raw, strength_if FROM strengths LEFT JOIN mi ON mi.cui = cui_microbe LEFT JOIN di ON di.cui = cui_disease"""
)
def id_mapped_edges(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    m, d = L.surrogate_ids(g.microbes, "cui"), L.surrogate_ids(g.diseases.where("cui <> 3"), "cui")
    edges = L.map_ids(L.map_ids(g.strengths, "cui_microbe", m, "id_microbe"), "cui_disease", d, "id_disease")
    return edges.select("id_microbe", "id_disease", "strength_raw", "strength_if")


_HOPS = """e AS (SELECT 'p' || cui_microbe AS source, 'n' || cui_disease AS target, CAST(strength_raw AS VARCHAR) AS relation FROM strengths
UNION ALL SELECT parent, child, 'PARENT' FROM {0})"""


@query(f"{STRENGTH_WITH}, {MICROBE_PARENTS}, {_HOPS.format('microbe_parents')} SELECT * FROM e WHERE source = 'p7' OR target = 'p7' ORDER BY source, target, relation LIMIT 50")
def one_hop_microbe(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    return L.one_hop(g.strengths, g.microbe_parents, "p7")


@query(f"{STRENGTH_WITH}, {DISEASE_PARENTS}, {_HOPS.format('disease_parents')} SELECT * FROM e WHERE source = 'n5' OR target = 'n5' ORDER BY source, target, relation LIMIT 50")
def one_hop_disease(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    return L.one_hop(g.strengths, g.disease_parents, "n5")


@query(f"WITH {MICROBES}, {DISEASES}, p AS (SELECT DISTINCT l_partkey % 3000 AS cui_microbe, l_suppkey % 30 AS cui_disease FROM lineitem) SELECT cui_microbe, cui_disease, cui_microbe IN (SELECT cui FROM microbes) AS has_microbe, cui_disease IN (SELECT cui FROM diseases) AS has_disease FROM p")
def node_presence(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_partkey") % 3000).alias("cui_microbe"), (F.col("l_suppkey") % 30).alias("cui_disease")).distinct()
    return L.node_presence(g.microbes, g.diseases, pairs)


_SPLIT = """split AS (SELECT CAST(cui_microbe AS VARCHAR) AS src, CAST(cui_disease AS VARCHAR) AS dst, CASE WHEN strength_raw > 0 THEN 'STRENGTH_POSITIVE' ELSE 'STRENGTH_NEGATIVE' END AS type,
CAST(abs(strength_raw) AS DOUBLE) AS strength FROM strengths WHERE strength_raw <> 0 UNION ALL SELECT parent, child, 'PARENT', 1.0 FROM microbe_parents)"""


@query(f"{STRENGTH_WITH}, {MICROBE_PARENTS}, {_SPLIT} SELECT * FROM split")
def sign_split_edges(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    return S.sign_split_edges(g.strengths, g.microbe_parents)


@query(f"{STRENGTH_WITH}, {MICROBE_PARENTS}, {_SPLIT} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM split UNION ALL SELECT dst FROM split WHERE type <> 'PARENT') GROUP BY node")
def degree(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    return L.degrees(S.sign_split_edges(g.strengths, g.microbe_parents), ["STRENGTH_POSITIVE", "STRENGTH_NEGATIVE"])


@query(f"{STRENGTH_WITH} SELECT *, CASE WHEN strength_if >= 1.5 THEN 'positive' ELSE 'negative' END AS kind FROM strengths WHERE strength_if >= 1.5 OR strength_if < -1.5")
def threshold_split(spark, sf_dir):
    return S.split_by_threshold(GraphView(spark, sf_dir).strengths, "strength_if", 1.5)


@query(f"{STRENGTH_WITH} SELECT * FROM strengths")
def strength_incremental_refresh(spark, sf_dir):
    """Strengths of all but the newest papers, then refreshed for the pairs that these touch."""
    g = GraphView(spark, sf_dir)
    old = S.edge_strengths(g.evidence.where("year < 2001"))
    return S.refresh_strengths(old, g.evidence, g.evidence.where("year >= 2001"))
