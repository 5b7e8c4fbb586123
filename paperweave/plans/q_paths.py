"""Queries on upserts, hierarchies, paths, predictions and other sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as O
from ..operators import paths as P
from ..operators import predictions as R
from ..operators import upserts as U
from .graph_view import DISEASE_PARENTS, DISEASES, EVIDENCE, MICROBE_PARENTS, MICROBES, STRENGTHS, GraphView
from .registry import query, table

# ---- upserts ------------------------------------------------------------------------------------------------------------------


@query(
    """WITH old AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey),
    new AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey)
    SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)"""
)
def insert_first_writer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return U.insert_new(U.first_by(o.where("v % 2 = 0"), ["k"], ["v"]), o.where("v % 2 = 1"), ["k"], ["v"])


@query(
    """WITH o AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey AS v FROM orders), old AS (SELECT DISTINCT k FROM o WHERE v % 2 = 0),
    n AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS r FROM o WHERE v % 2 = 1)
    SELECT k, v, CASE WHEN k IS NULL THEN 'null key' WHEN k IN (SELECT k FROM old WHERE k IS NOT NULL) THEN 'present' ELSE 'repeated' END AS reason
    FROM n WHERE k IS NULL OR k IN (SELECT k FROM old WHERE k IS NOT NULL) OR r > 1"""
)
def rejected_rows(spark, sf_dir):
    k = F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey"))
    o = table(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_orderkey").alias("v"))
    return U.rejected(o.where("v % 2 = 0"), o.where("v % 2 = 1"), ["k"], ["v"])


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def anti_join_pending(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lost = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return U.pending(o, "o_custkey", o.where("o_orderstatus = 'F'"), lost)


@query(f"WITH {EVIDENCE}, f AS (SELECT cui_microbe, cui_disease, pmid, min(seq * 10 + CASE rel_type WHEN 'negative' THEN 0 ELSE 1 END) AS s FROM evidence GROUP BY ALL) SELECT cui_microbe, cui_disease, pmid, CAST(s // 10 AS INTEGER) AS seq, CASE s % 10 WHEN 0 THEN 'negative' ELSE 'positive' END AS rel_type FROM f")
def edge_dedupe_per_paper(spark, sf_dir):
    e = GraphView(spark, sf_dir).evidence.select("cui_microbe", "cui_disease", "pmid", "seq", "rel_type")
    return U.upsert_evidence(e.limit(0), e, ["seq", "rel_type"])


@query("WITH p AS (SELECT p_partkey % 40 AS a, p_size % 40 AS b, p_partkey AS s FROM part), e AS (SELECT a, b, s FROM p WHERE a <> b) SELECT a AS child, b AS parent FROM e QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY s) = 1")
def parent_edges_dedup(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("child"), (F.col("p_size") % 40).alias("parent"), F.col("p_partkey").alias("s"))
    return U.upsert_parents(p.limit(0).drop("s"), p, ["s"])


@query("WITH p AS (SELECT p_partkey AS cui, p_name AS name FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey // 2 AS cui, p_brand AS name, p_partkey AS s FROM part) SELECT * FROM p UNION ALL SELECT cui, name FROM n WHERE cui NOT IN (SELECT cui FROM p) QUALIFY row_number() OVER (PARTITION BY cui ORDER BY s) = 1")
def node_upsert(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("cui"), F.col("p_name").alias("name"))
    new = p.select(F.expr("p_partkey div 2").alias("cui"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("s"))
    return U.upsert_nodes(old, new, ["s"])


# ---- hierarchies --------------------------------------------------------------------------------------------------------------

_ALL_PARENTS = f"{MICROBE_PARENTS}, parents AS (SELECT * FROM microbe_parents UNION ALL SELECT * FROM disease_parents)"


@query(
    f"""WITH RECURSIVE {DISEASE_PARENTS}, {MICROBE_PARENTS}, parents AS (SELECT * FROM microbe_parents UNION ALL SELECT * FROM disease_parents),
    f AS (SELECT child, min(parent) AS nx FROM parents GROUP BY child),
    l(node, line, step, ancestor) AS (SELECT child, parent, 1, parent FROM parents UNION ALL SELECT node, line, step + 1, nx FROM l JOIN f ON f.child = ancestor WHERE step < 50) SELECT * FROM l"""
)
def lineage_first_parent(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    return P.lineages(g.microbe_parents.unionByName(g.disease_parents))


@query(
    f"""WITH RECURSIVE {DISEASE_PARENTS}, {MICROBE_PARENTS}, parents AS (SELECT * FROM microbe_parents UNION ALL SELECT * FROM disease_parents),
    f AS (SELECT parent AS at, min(child) AS nx FROM parents GROUP BY parent),
    l(node, line, step, ancestor) AS (SELECT parent, child, 1, child FROM parents UNION ALL SELECT node, line, step + 1, nx FROM l JOIN f ON f.at = ancestor WHERE step < 50) SELECT * FROM l"""
)
def lineage_first_child(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    return P.descents(g.microbe_parents.unionByName(g.disease_parents))


@query(
    f"""WITH {DISEASE_PARENTS}, {_ALL_PARENTS}, e AS (SELECT child AS x, parent AS y, child, parent FROM parents UNION ALL SELECT parent, child, child, parent FROM parents)
    SELECT DISTINCT o.x AS node, t.y AS relative FROM e o JOIN e t ON o.y = t.x AND NOT (o.child = t.child AND o.parent = t.parent)"""
)
def two_hop_relatives(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    return P.two_hop_relatives(g.microbe_parents.unionByName(g.disease_parents))


@query(f"WITH {DISEASE_PARENTS}, l AS (SELECT a.child AS node, a.child AS n0, a.parent AS n1, b.parent AS n2 FROM disease_parents a JOIN disease_parents b ON a.parent = b.child) SELECT DISTINCT n0 AS child, n1 AS parent FROM l UNION SELECT n1, n2 FROM l")
def lineage_edges(spark, sf_dir):
    d = GraphView(spark, sf_dir).disease_parents
    lines = P.lineages(d)
    start = lines.select("node", "line", F.lit(0).alias("step"), F.col("node").alias("ancestor")).distinct()
    return U.lineage_edges(lines.unionByName(start), ["node", "line"], "step", "ancestor")


# ---- paths --------------------------------------------------------------------------------------------------------------------

_EDGES = f"{MICROBE_PARENTS}, u AS (SELECT child AS a, parent AS b FROM microbe_parents UNION SELECT parent, child FROM microbe_parents)"
_DIST = "r(node, hops) AS (SELECT '{0}', 0 UNION SELECT b, hops + 1 FROM r JOIN u ON a = node WHERE hops < 15), dist AS (SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY node)"


def _tree(spark, sf_dir):
    return GraphView(spark, sf_dir).microbe_parents.select(F.col("child").alias("a"), F.col("parent").alias("b"))


@query(f"WITH RECURSIVE {_EDGES}, {_DIST.format('p1')} SELECT * FROM dist")
def bfs_distance(spark, sf_dir):
    return P.distances(P.undirected(_tree(spark, sf_dir)), spark.createDataFrame([("p1",)], "node string"))


@query(
    f"""WITH RECURSIVE {STRENGTHS}, u AS (SELECT 'p' || cui_microbe AS a, 'n' || cui_disease AS b FROM strengths WHERE strength_raw <> 0 UNION SELECT 'n' || cui_disease, 'p' || cui_microbe FROM strengths WHERE strength_raw <> 0),
    {_DIST.format('n5')} SELECT * FROM dist"""
)
def bfs_distance_strong_edges(spark, sf_dir):
    s = GraphView(spark, sf_dir).strengths.where("strength_raw <> 0")
    e = s.select(F.concat(F.lit("p"), F.col("cui_microbe").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("cui_disease").cast("string")).alias("b"))
    return P.distances(P.undirected(e), spark.createDataFrame([("n5",)], "node string"))


@query(
    f"""WITH RECURSIVE {_EDGES}, {_DIST.format('p1')}, p(node, step) AS (SELECT node, hops FROM dist WHERE node = 'p8' UNION ALL
    SELECT (SELECT min(u.a) FROM u JOIN dist x ON x.node = u.a AND x.hops = p.step - 1 WHERE u.b = p.node), p.step - 1 FROM p WHERE p.step > 0) SELECT step, node FROM p"""
)
def shortest_path_hops(spark, sf_dir):
    return P.shortest_path(P.undirected(_tree(spark, sf_dir)), "p1", "p8")


@query()
def shortest_path_edges(spark, sf_dir):
    t = _tree(spark, sf_dir)
    path = P.shortest_path(P.undirected(t), "p1", "p8")
    return P.hop_edges(path, t.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit("PARENT").alias("type"), F.lit(1.0).alias("strength")))


_ALT = f"""{_EDGES}, e AS (SELECT a, b, least(a, b) || chr(9) || greatest(a, b) AS k FROM u WHERE a NOT LIKE 'p%' OR a = 'p1'),
w(node, n, path, used) AS (SELECT 'p1', 0, ['p1'], CAST([] AS VARCHAR[]) UNION ALL SELECT b, n + 1, list_append(path, b), list_append(used, k) FROM w JOIN e ON a = node WHERE n < 5 AND NOT list_contains(used, k) AND (b NOT LIKE 'p%')),
f AS (SELECT path, row_number() OVER (ORDER BY len(path), array_to_string(path, chr(9))) AS path_no FROM w WHERE node = 'tPROMO')"""


@query(f"WITH RECURSIVE {_ALT} SELECT CAST(path_no AS INTEGER) AS path_no, CAST(i - 1 AS INTEGER) AS step, path[i] AS node FROM f, unnest(range(1, len(path) + 1)) t(i) WHERE path_no <= 5")
def alternative_paths(spark, sf_dir):
    return P.alternative_paths(_tree(spark, sf_dir), "p1", "tPROMO")


# ---- predictions --------------------------------------------------------------------------------------------------------------

_PREDS = """preds AS (SELECT l_partkey AS src, CASE WHEN l_linenumber = 2 THEN 'Disease' ELSE 'Microbe' END AS src_label, l_suppkey % 25 AS dst, CASE WHEN l_linenumber = 2 THEN 'Microbe' ELSE 'Disease' END AS dst_label,
CASE l_linestatus WHEN 'O' THEN 'POSITIVE' ELSE 'NEGATIVE' END AS type, (l_orderkey * 7 + l_linenumber) % 100 / 100.0 AS pred_strength FROM lineitem)"""
_PREDS = _PREDS.replace("% 100 / 100.0", "% 100 / CAST(100 AS DOUBLE)")
_CLEAN = f"{_PREDS}, clean AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY src, dst, type) AS n FROM preds WHERE src_label = 'Microbe' AND dst_label = 'Disease') WHERE n = 1 AND pred_strength >= 0.5)"


def _predictions(spark, sf_dir):
    back = F.col("l_linenumber") == 2
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"),
        F.when(back, "Disease").otherwise("Microbe").alias("src_label"),
        (F.col("l_suppkey") % 25).alias("dst"),
        F.when(back, "Microbe").otherwise("Disease").alias("dst_label"),
        F.when(F.col("l_linestatus") == "O", "POSITIVE").otherwise("NEGATIVE").alias("type"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 100 / F.lit(100.0)).alias("pred_strength"),
    )


@query(f"WITH {_CLEAN} SELECT src, src_label, dst, dst_label, type, pred_strength FROM clean")
def prediction_cleanup(spark, sf_dir):
    return R.clean_predictions(_predictions(spark, sf_dir))


@query(
    f"""WITH {_CLEAN}, {MICROBES}, {DISEASES}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY type ORDER BY pred_strength DESC, src, dst) AS INTEGER) AS ranking FROM clean WHERE dst = 5)
    SELECT src, dst, type, pred_strength, ranking, m.name AS microbe, d.name AS disease FROM t JOIN microbes m ON m.cui = src JOIN diseases d ON d.cui = dst WHERE ranking <= 10"""
)
def top_predicted_links(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    top = R.top_predictions(R.clean_predictions(_predictions(spark, sf_dir)), "dst", 5)
    return R.named(top, g.microbes, g.diseases).select("src", "dst", "type", "pred_strength", "ranking", "microbe", "disease")


# ---- other sources ------------------------------------------------------------------------------------------------------------

_WORDS = {"O": "positive", "F": "negative"}
_EXT = """ext AS (SELECT CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_partkey % 2200 END AS b_cui, l_suppkey % 27 AS d_cui,
CASE WHEN l_returnflag = 'N' AND l_linenumber < 3 THEN 'na' WHEN l_linestatus = 'O' THEN 'positive' ELSE 'negative' END AS relation, l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS seq FROM lineitem)"""


def _external(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    word = F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") < 3), "unclear").otherwise(F.col("l_linestatus"))
    return l.select(
        F.when(F.col("l_orderkey") % 17 != 0, F.col("l_partkey") % 2200).alias("b_cui"),
        (F.col("l_suppkey") % 27).alias("d_cui"),
        O.normalise_association(word, _WORDS).alias("relation"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("seq"),
    )


@query(f"WITH {_EXT} SELECT * FROM ext")
def association_normalise(spark, sf_dir):
    return _external(spark, sf_dir)


@query(
    f"""WITH {_EXT}, c AS (SELECT b_cui, d_cui, relation, count(*) AS n FROM ext WHERE b_cui IS NOT NULL AND d_cui IS NOT NULL GROUP BY ALL),
    r AS (SELECT b_cui, d_cui, relation FROM c QUALIFY row_number() OVER (PARTITION BY b_cui, d_cui ORDER BY n DESC, relation) = 1),
    l AS (SELECT b_cui, d_cui, max(seq) AS seq FROM ext GROUP BY b_cui, d_cui) SELECT b_cui, d_cui, relation, seq FROM r JOIN l USING (b_cui, d_cui)"""
)
def external_majority(spark, sf_dir):
    return O.resolve_duplicates(_external(spark, sf_dir))


@query(f"WITH {_EXT} SELECT count(DISTINCT b_cui) AS n_bacteria, count(DISTINCT d_cui) AS n_diseases, count(*) AS n_rows FROM ext")
def external_statistics(spark, sf_dir):
    return O.source_statistics(_external(spark, sf_dir))


_FIRST = f"""{STRENGTHS}, {_EXT}, st AS (SELECT *, CASE WHEN b_cui IS NULL OR d_cui IS NULL THEN 'null key' WHEN row_number() OVER (PARTITION BY b_cui, d_cui ORDER BY seq, relation) > 1 THEN 'repeated' ELSE 'first' END AS status FROM ext),
fr AS (SELECT * FROM st WHERE status = 'first'),
mb AS (SELECT p_brand, cui_microbe, cui_disease, strength_raw, strength_if FROM strengths JOIN part ON p_partkey = cui_microbe QUALIFY row_number() OVER (PARTITION BY p_brand, cui_disease ORDER BY cui_microbe) <= 2),
d2 AS (SELECT CAST(a.n_nationkey AS BIGINT) AS node, CAST(b.n_nationkey AS BIGINT) AS relative FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
ex AS (SELECT b_cui, d_cui, b_cui AS b_out, d_cui AS d_out, strength_raw, strength_if FROM fr JOIN strengths ON b_cui = cui_microbe AND d_cui = cui_disease),
op AS (SELECT b_cui, d_cui FROM fr WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.b_cui = fr.b_cui AND ex.d_cui = fr.d_cui)),
nr AS (SELECT b_cui, d_cui, mb.cui_microbe AS b_out, d2.relative AS d_out, strength_raw, strength_if FROM op JOIN part ON p_partkey = b_cui JOIN d2 ON d2.node = d_cui JOIN mb ON mb.p_brand = part.p_brand AND mb.cui_disease = d2.relative AND mb.cui_microbe <> b_cui
       QUALIFY row_number() OVER (PARTITION BY b_cui, d_cui ORDER BY mb.cui_microbe, d2.relative) = 1),
fd AS (SELECT * FROM ex UNION ALL SELECT * FROM nr),
cmp AS (SELECT fr.b_cui, fr.d_cui, relation, seq, b_out, d_out, strength_raw, strength_if,
  CASE WHEN strength_raw IS NULL THEN NULL WHEN strength_raw = 0 THEN 'unsure' WHEN (strength_raw > 0 AND relation = 'positive') OR (strength_raw < 0 AND relation = 'negative') THEN 'coincide' ELSE 'wrong' END AS agreement,
  CASE WHEN strength_if IS NULL OR (strength_if <> 0 AND relation = 'na') THEN NULL WHEN strength_if = 0 THEN 'unsure' WHEN (strength_if > 0 AND relation = 'positive') OR (strength_if < 0 AND relation = 'negative') THEN 'coincide' ELSE 'wrong' END AS agreement_if
  FROM fr LEFT JOIN fd ON fd.b_cui = fr.b_cui AND fd.d_cui = fr.d_cui)"""


def _compared(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    ext = _external(spark, sf_dir)
    rows = ext.withColumn("seq", F.struct("seq", "relation"))
    cui = lambda c: F.substring(c, 2, 20).try_cast("long")
    steps = P.adjacent(g.microbe_parents).where("node LIKE 'p%'").select(cui("node").alias("node"), "via")
    d = P.two_hop_relatives(g.disease_parents.where("child LIKE 'n%'")).where("node LIKE 'n%' AND relative LIKE 'n%'").select(cui("node").alias("node"), cui("relative").alias("relative"))
    return ext, rows, O.compare(rows, g.strengths, steps, d).withColumn("seq", F.col("seq")["seq"]), g


@query(f"WITH {_FIRST} SELECT * FROM cmp")
def external_compare(spark, sf_dir):
    return _compared(spark, sf_dir)[2].select("b_cui", "d_cui", "relation", "seq", "b_out", "d_out", "strength_raw", "strength_if", "agreement", "agreement_if")


_PCT = lambda a, b: f"round(100 * {a} / nullif({b}, 0), 2)"


@query(
    f"""WITH {_FIRST}, c AS (SELECT count(*) FILTER (relation IN ('positive', 'negative')) AS total, count(agreement) AS existing, count(*) FILTER (agreement = 'coincide') AS coincide, count(*) FILTER (agreement = 'unsure') AS unsure,
    count(*) FILTER (agreement_if = 'coincide') AS coincide_if, count(*) FILTER (agreement_if = 'unsure') AS unsure_if FROM cmp)
    SELECT c.*, {_PCT('existing', 'total')} AS existing_percent, {_PCT('coincide', 'existing')} AS coincide_percent, {_PCT('unsure', 'existing')} AS unsure_percent, {_PCT('coincide_if', 'existing')} AS coincide_if_percent, {_PCT('unsure_if', 'existing')} AS unsure_if_percent,
    (SELECT count(*) FROM st WHERE status = 'null key') AS not_considered, (SELECT count(*) FROM st WHERE status = 'repeated') AS repeated,
    (SELECT {_PCT('count(p_partkey)', 'count(*)')} FROM (SELECT DISTINCT b_cui FROM ext WHERE b_cui IS NOT NULL) LEFT JOIN part ON p_partkey = b_cui) AS bacteria_percent,
    (SELECT {_PCT('count(n_nationkey)', 'count(*)')} FROM (SELECT DISTINCT d_cui FROM ext) LEFT JOIN nation ON n_nationkey = d_cui) AS disease_percent FROM c"""
)
def external_summary(spark, sf_dir):
    _, rows, compared, g = _compared(spark, sf_dir)
    return O.summary(rows, compared, g.microbes, g.diseases)


@query(
    f"""WITH {EVIDENCE}, r AS (SELECT cui_microbe, cui_disease, pmid, seq, row_number() OVER (PARTITION BY cui_microbe, cui_disease ORDER BY pmid, seq) AS r FROM evidence WHERE rel_type = 'positive')
    SELECT cui_microbe, cui_disease, string_agg('[' || pmid || '] ' || seq, ' ||| ' || chr(10) ORDER BY r) FILTER (r <= 10) AS evidence, count(*) AS n FROM r GROUP BY cui_microbe, cui_disease"""
)
def evidence_digest(spark, sf_dir):
    return O.evidence_digest(GraphView(spark, sf_dir).evidence, True)


@query(
    f"""WITH {STRENGTHS}, s AS (SELECT cui_microbe, cui_disease, CAST(sign(strength_raw) AS DOUBLE) AS sign FROM strengths), x AS (SELECT DISTINCT p_partkey AS cui_microbe, p_size % 25 AS cui_disease FROM part)
    SELECT DISTINCT s.* FROM s JOIN x USING (cui_microbe, cui_disease)"""
)
def external_intersection(spark, sf_dir):
    s = GraphView(spark, sf_dir).strengths.select("cui_microbe", "cui_disease", F.signum("strength_raw").alias("sign"))
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cui_microbe"), (F.col("p_size") % 25).cast("long").alias("cui_disease")).distinct()
    return s.join(x, ["cui_microbe", "cui_disease"], "left_semi").distinct()
