"""Queries on the graph's write path, node properties, mixed paths, collections and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dictionary as Y
from ..functions import entities as N
from ..functions import models as M
from ..operators import folds as K
from ..operators import insertion as I
from ..operators import knowledge_base as B
from ..operators import lookups as L
from ..operators import paths as P
from ..operators import properties as R
from ..operators import upserts as U
from ..operators import vectors as V
from ..operators.strength import edge_strengths
from ..sources import files as S
from .graph_view import DISEASE_PARENTS, EVIDENCE, MENTIONS, MICROBE_PARENTS, STRENGTHS, GraphView
from .lineage import cut, shared_path
from .registry import query, table

# ---- insertion ----------------------------------------------------------------------------------------------------------------

_JOURNALS = "journals AS (SELECT c_custkey AS issn, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_acctbal > 0 THEN CAST(c_custkey % 97 + 1 AS VARCHAR) END AS factor FROM customer)"
_FACTOR = "TRY_CAST(nullif(factor, '') AS DOUBLE)"


def _journals(spark, sf_dir):
    factor = F.when(F.col("c_custkey") % 11 == 0, "").when(F.col("c_acctbal") > 0, (F.col("c_custkey") % 97 + 1).cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("issn"), factor.alias("factor"))


@query(f"WITH {_JOURNALS} SELECT o_orderkey AS pmid, {_FACTOR} AS impact_factor FROM orders LEFT JOIN journals ON o_custkey = issn")
def impact_factor_lookup(spark, sf_dir):
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pmid"), F.col("o_custkey").alias("issn"))
    return I.impact_factors(papers, _journals(spark, sf_dir)).select("pmid", "impact_factor")


_ONE = "QUALIFY row_number() OVER (PARTITION BY cui_microbe, cui_disease, pmid ORDER BY seq, rel_type) = 1"
_INSERTED = f"""{MENTIONS}, {_JOURNALS},
evidence AS (SELECT cui_microbe, cui_disease, pmid, seq, rel_type, impact_factor, quartile FROM (SELECT * FROM mentions WHERE rel_type <> 'na' AND pmid % 2 = 0 {_ONE})
UNION ALL SELECT cui_microbe, cui_disease, pmid, seq, rel_type, {_FACTOR}, quartile FROM (SELECT * FROM mentions WHERE rel_type <> 'na' AND pmid % 2 = 1 {_ONE}) JOIN orders ON o_orderkey = pmid LEFT JOIN journals ON issn = o_custkey)"""


def _inserted(spark, sf_dir):
    g = GraphView(spark, sf_dir)
    columns = ["cui_microbe", "cui_disease", "pmid", "seq", "rel_type", "impact_factor", "quartile"]
    old = U.first_by(g.evidence.where("pmid % 2 = 0").select(*columns), columns[:3], ["seq", "rel_type"])
    nodes = lambda c, frame: old.select(F.col(c).alias("cui")).distinct().join(frame.select("cui", "name"), "cui")
    graph = I.Graph(nodes("cui_microbe", g.microbes), nodes("cui_disease", g.diseases), g.disease_parents.limit(0), old, edge_strengths(old))
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pmid"), F.col("o_custkey").alias("issn"))
    m = g.microbes.select(F.col("cui").alias("cui_microbe"), F.col("name").alias("microbe"))
    d = g.diseases.select(F.col("cui").alias("cui_disease"), F.col("name").alias("disease"))
    new = g.mentions.where("pmid % 2 = 1").drop("impact_factor", "year", "journal").join(papers, "pmid").join(m, "cui_microbe").join(d, "cui_disease")
    return I.insert_relations(graph, new, _journals(spark, sf_dir), g.disease_parents.withColumn("seq", F.col("child")))


@query(f"WITH {_INSERTED}{STRENGTHS[len(EVIDENCE):]} SELECT * FROM strengths")
def relation_insertion(spark, sf_dir):
    return _inserted(spark, sf_dir).strengths


@query(f"WITH {_INSERTED} SELECT 'evidence' AS part, count(*) AS n FROM evidence UNION ALL SELECT 'microbes', count(DISTINCT cui_microbe) FROM evidence UNION ALL SELECT 'diseases', count(DISTINCT cui_disease) FROM evidence UNION ALL SELECT 'parents', (SELECT count(*) FROM (SELECT DISTINCT n_nationkey, n_regionkey FROM nation)) + (SELECT count(DISTINCT n_regionkey) FROM nation)")
def relation_insertion_sizes(spark, sf_dir):
    g, out = _inserted(spark, sf_dir), None
    for part in ("evidence", "microbes", "diseases", "parents"):
        one = getattr(g, part).agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n")).select("part", "n")
        out = one if out is None else out.unionByName(one)
    return out


_LINKED = f"{STRENGTHS}, {DISEASE_PARENTS}"
_SIGNED = """signed AS (SELECT CAST(cui_microbe AS VARCHAR) AS src, CAST(cui_disease AS VARCHAR) AS dst, CASE WHEN strength_raw > 0 THEN 'STRENGTH_POSITIVE' ELSE 'STRENGTH_NEGATIVE' END AS type FROM strengths WHERE strength_raw <> 0
UNION ALL SELECT parent, child, 'PARENT' FROM disease_parents)"""


@query(f"WITH {_LINKED}, {_SIGNED} SELECT * FROM signed WHERE type <> 'STRENGTH_NEGATIVE'")
def drop_relations(spark, sf_dir):
    from ..operators.strength import sign_split_edges

    g = GraphView(spark, sf_dir)
    return I.without_types(sign_split_edges(g.strengths, g.disease_parents), "STRENGTH_NEGATIVE", "NOT_THERE").select("src", "dst", "type")


@query("SELECT count(*) AS n FROM documents")
def count_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVIDENCE}, p AS (SELECT DISTINCT pmid, year, journal, rel_type FROM evidence WHERE cui_disease = 5) SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY pmid, rel_type) AS INTEGER) AS place FROM p")
def publications_by_year(spark, sf_dir):
    return L.publications_by_year(GraphView(spark, sf_dir).evidence, "cui_disease", 5)


# ---- lineages and paths -------------------------------------------------------------------------------------------------------

_TAXA = f"{MICROBE_PARENTS}, taxa AS (SELECT child, parent FROM microbe_parents WHERE length(child) % 5 <> 0)"


@query(
    f"""WITH RECURSIVE {_TAXA}, f AS (SELECT child, min(parent) AS nx FROM taxa GROUP BY child),
    l(node, line, step, ancestor) AS (SELECT child, parent, 1, parent FROM taxa UNION ALL SELECT node, line, step + 1, nx FROM l JOIN f ON f.child = ancestor WHERE step < 50)
    SELECT node, line, step, ancestor, CASE left(ancestor, 1) WHEN 'b' THEN 'genus' WHEN 't' THEN 'family' END AS rank FROM l"""
)
def ranked_lineage(spark, sf_dir):
    taxa = GraphView(spark, sf_dir).microbe_parents.withColumn("tax_id", F.when(F.char_length("child") % 5 != 0, F.col("child")))
    first = F.substring("node", 1, 1)
    ranks = taxa.select(F.explode(F.array("child", "parent")).alias("node")).distinct().select("node", F.when(first == "b", "genus").when(first == "t", "family").alias("rank"))
    return P.ranked_lineages(taxa, ranks)


@query(f"WITH {MICROBE_PARENTS}, c AS (SELECT DISTINCT child, parent FROM microbe_parents) SELECT a.child, a.parent FROM c a UNION SELECT b.child, b.parent FROM c a JOIN (SELECT child, min(parent) AS parent FROM c GROUP BY child) b ON b.child = a.parent")
def microbe_lineage_edges(spark, sf_dir):
    taxa = GraphView(spark, sf_dir).microbe_parents
    lines = P.lineages(taxa)
    start = lines.select("node", "line", F.lit(0).alias("step"), F.col("node").alias("ancestor")).distinct()
    return U.lineage_edges(lines.unionByName(start), ["node", "line"], "step", "ancestor")


_ANY = f"""{STRENGTHS}, {MICROBE_PARENTS}, {DISEASE_PARENTS},
e AS (SELECT 'p' || cui_microbe AS a, 'n' || cui_disease AS b FROM strengths UNION SELECT child, parent FROM microbe_parents UNION SELECT child, parent FROM disease_parents),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""
_MIXED = f"""{STRENGTHS}, {MICROBE_PARENTS}, {DISEASE_PARENTS}, s AS (SELECT 'p' || cui_microbe AS a, 'n' || cui_disease AS b FROM strengths WHERE strength_raw <> 0),
u AS (SELECT a, b FROM s UNION SELECT b, a FROM s UNION SELECT parent, child FROM microbe_parents UNION SELECT parent, child FROM disease_parents)"""
_WALK = """r(node, hops) AS (SELECT '{0}', 0 UNION SELECT b, hops + 1 FROM (SELECT DISTINCT node, hops FROM r) JOIN u ON a = node WHERE hops < {2}), dist AS (SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY node),
p(node, step) AS (SELECT node, hops FROM dist WHERE node = '{1}' UNION ALL SELECT (SELECT min(u.a) FROM u JOIN dist x ON x.node = u.a AND x.hops = p.step - 1 WHERE u.b = p.node), p.step - 1 FROM p WHERE p.step > 0)"""


def _edges(spark, sf_dir, nonzero: bool):
    g = GraphView(spark, sf_dir)
    s = g.strengths.where("strength_raw != 0") if nonzero else g.strengths
    pairs = s.select(F.concat(F.lit("p"), F.col("cui_microbe").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("cui_disease").cast("string")).alias("b"))
    return cut(pairs), cut(g.microbe_parents.unionByName(g.disease_parents))


def _path_any(spark, sf_dir):
    pairs, parents = _edges(spark, sf_dir, False)
    return P.shortest_path(P.undirected(pairs.unionByName(parents.toDF("a", "b"))), "p1", "root"), pairs, parents


@query(f"WITH RECURSIVE {_ANY}, {_WALK.format('p1', 'root', 4)} SELECT step, node FROM p")
def shortest_path_any_edge(spark, sf_dir):
    return _path_any(spark, sf_dir)[0]


@query(
    f"""WITH RECURSIVE {_ANY}, {_WALK.format('p1', 'root', 4)}, h AS (SELECT step, node AS a, lead(node) OVER (ORDER BY step) AS b FROM p),
    t AS (SELECT a AS src, b AS dst, 'STRENGTH' AS type FROM (SELECT 'p' || cui_microbe AS a, 'n' || cui_disease AS b FROM strengths) UNION ALL SELECT parent, child, 'PARENT' FROM microbe_parents UNION ALL SELECT parent, child, 'PARENT' FROM disease_parents)
    SELECT step, src, dst, type FROM h JOIN t ON (a = src AND b = dst) OR (a = dst AND b = src)"""
)
def path_edges_any(spark, sf_dir):
    path, pairs, parents = _path_any(spark, sf_dir)
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("STRENGTH").alias("type")).unionByName(parents.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit("PARENT").alias("type")))
    return P.hop_edges(path, edges.withColumn("strength", F.lit(None).cast("double"))).drop("strength")


@query(f"WITH RECURSIVE {_MIXED}, {_WALK.format('root', 'p8', 4)} SELECT step, node FROM p")
def shortest_path_mixed(spark, sf_dir):
    """Strengths in both directions, zero ones absent, parents downwards only; without weights a path costs its hops."""
    pairs, parents = _edges(spark, sf_dir, True)
    down = parents.select(F.col("parent").alias("a"), F.col("child").alias("b"))
    return P.shortest_path(P.undirected(pairs).unionByName(down).distinct(), "root", "p8")


# ---- properties ---------------------------------------------------------------------------------------------------------------


def _properties(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("cui"), F.col("embedding")[0].cast("double").alias("fast-rp `1`"), F.col("label").alias("cluster"))


@query("SELECT vec_id AS cui, CAST(embedding[1] AS DOUBLE) AS value FROM embeddings")
def property_projection(spark, sf_dir):
    return R.property_of(_properties(spark, sf_dir), "cui", "fast-rp `1`", "value")


@query("SELECT vec_id AS cui, label AS cluster FROM embeddings")
def drop_properties(spark, sf_dir):
    return R.without_property(_properties(spark, sf_dir), "fast-rp `1`", "not there")


@query("SELECT p_partkey AS cui, p_name AS name, CAST(embedding[1] AS DOUBLE) AS embedding FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def embedding_writeback(spark, sf_dir):
    nodes = GraphView(spark, sf_dir).microbes.select("cui", "name", F.lit(0.0).alias("embedding"))
    return R.write_property(nodes, "cui", R.property_of(_properties(spark, sf_dir), "cui", "fast-rp `1`", "value"), "embedding")


@query("SELECT coalesce(a.vec_id, b.vec_id) AS cui, a.x, b.cluster FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings WHERE vec_id % 3 <> 0) a FULL JOIN (SELECT vec_id, label AS cluster FROM embeddings WHERE vec_id % 2 = 0) b ON a.vec_id = b.vec_id")
def embedding_cluster_alignment(spark, sf_dir):
    p = _properties(spark, sf_dir)
    return R.aligned(R.property_of(p.where("cui % 3 <> 0"), "cui", "fast-rp `1`", "x"), p.where("cui % 2 = 0").select("cui", "cluster"), "cui")


@query("SELECT l_partkey AS id_microbe, l_suppkey AS id_disease, l_quantity AS strength FROM lineitem")
def reshaped_columns(spark, sf_dir):
    return R.reshaped(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "Unnamed: 0"), {"l_partkey": "id_microbe", "l_suppkey": "id_disease", "l_quantity": "strength"})


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def string_columns(spark, sf_dir):
    return R.as_strings(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


_OFFSET = "m AS (SELECT cui_microbe, dense_rank() OVER (ORDER BY cui_microbe) - 1 AS src FROM (SELECT DISTINCT cui_microbe FROM strengths)), d AS (SELECT cui_disease, dense_rank() OVER (ORDER BY cui_disease) - 1 + (SELECT count(*) FROM m) AS dst FROM (SELECT DISTINCT cui_disease FROM strengths))"


@query(f"WITH {STRENGTHS}, {_OFFSET} SELECT src, dst FROM strengths JOIN m USING (cui_microbe) JOIN d USING (cui_disease)")
def homogeneous_ids(spark, sf_dir):
    return R.homogeneous(GraphView(spark, sf_dir).strengths, "cui_microbe", "cui_disease")


@query(
    f"""WITH {STRENGTHS}, {DISEASE_PARENTS}, s AS (SELECT CASE WHEN strength_raw > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS type, 'p' || cui_microbe AS src, 'n' || cui_disease AS dst FROM strengths WHERE strength_raw <> 0
    UNION ALL SELECT 'PARENT', parent, child FROM disease_parents), n AS (SELECT DISTINCT unnest([src, dst]) AS node FROM s), i AS (SELECT node, row_number() OVER (PARTITION BY left(node, 1) ORDER BY node) - 1 AS id FROM n)
    SELECT type, a.id AS src, b.id AS dst FROM s JOIN i a ON a.node = src JOIN i b ON b.node = dst"""
)
def heterogeneous_graph(spark, sf_dir):
    from pyspark.sql import Window

    g = GraphView(spark, sf_dir)
    s = g.strengths.select(F.concat(F.lit("p"), F.col("cui_microbe").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("cui_disease").cast("string")).alias("dst"), "strength_raw")
    tables = {"POSITIVE": s.where("strength_raw > 0"), "NEGATIVE": s.where("strength_raw < 0"), "PARENT": g.disease_parents.select(F.col("parent").alias("src"), F.col("child").alias("dst"))}
    ends = None
    for t in tables.values():
        one = t.select(F.explode(F.array("src", "dst")).alias("node"))
        ends = one if ends is None else ends.unionByName(one)
    ids = ends.distinct().select("node", (F.row_number().over(Window.partitionBy(F.substring("node", 1, 1)).orderBy("node")) - 1).cast("long").alias("id"))
    return R.typed_edges(tables, ids)


_DRAW = "(length(a) * 7919 + length(b) * 104729 + ascii(right(a, 1)) * 31 + ascii(right(b, 1)) * 17) % 1009"
_HOP = "h{1} AS (SELECT CAST({1} AS INTEGER) AS hop, a, b FROM few JOIN (SELECT DISTINCT b AS node FROM h{0}) ON node = a WHERE r <= 5)"


@query(
    f"""WITH {STRENGTHS}, u AS (SELECT 'p' || cui_microbe AS a, 'n' || cui_disease AS b FROM strengths UNION SELECT 'n' || cui_disease, 'p' || cui_microbe FROM strengths),
    few AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY {_DRAW}, b) AS r FROM u), h0 AS (SELECT 'n5' AS b), {_HOP.format(0, 1)}, {_HOP.format(1, 2)}, {_HOP.format(2, 3)}, {_HOP.format(3, 4)}
    SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4"""
)
def neighbour_sampling(spark, sf_dir):
    pairs, _ = _edges(spark, sf_dir, False)
    return R.sampled_neighbours(P.undirected(pairs), spark.createDataFrame([("n5",)], "node string"), [5, 5, 5, 5], F.expr(_DRAW))


@query(f"WITH {STRENGTHS}, {_OFFSET}, x AS (SELECT DISTINCT p_partkey AS cui_microbe, p_size % 25 AS cui_disease FROM part) SELECT DISTINCT src AS id_microbe, dst AS id_disease, CAST(sign(strength_raw) AS DOUBLE) AS sign FROM strengths JOIN x USING (cui_microbe, cui_disease) JOIN m USING (cui_microbe) JOIN d USING (cui_disease)".replace(" + (SELECT count(*) FROM m)", ""))
def external_intersection_ids(spark, sf_dir):
    s = GraphView(spark, sf_dir).strengths
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cui_microbe"), (F.col("p_size") % 25).cast("long").alias("cui_disease"))
    both = s.join(x, ["cui_microbe", "cui_disease"], "left_semi").select("cui_microbe", "cui_disease", F.signum("strength_raw").alias("sign")).distinct()
    return L.map_ids(L.map_ids(both, "cui_microbe", L.surrogate_ids(s, "cui_microbe"), "id_microbe"), "cui_disease", L.surrogate_ids(s, "cui_disease"), "id_disease")


# ---- entities -----------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1) WHERE 1 - l_discount > 0.95 AND l_partkey % 3 = 0")
def similar_bacteria(spark, sf_dir):
    """Of lines with the same number the one that stands first in the table's files counts; lines without a number come last."""
    place = F.struct(F.col("l_linenumber").isNull(), "l_linenumber", "_metadata.file_path", "_metadata.row_index").alias("place")
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", place, (1 - F.col("l_discount")).alias("similarity"), F.when(F.col("l_partkey") % 3 == 0, N.BACTERIA_TYPE).otherwise("T047").alias("tui"))
    return N.similar_first(c, "l_orderkey", "place", 0.95).select("l_orderkey", "l_partkey")


@query("SELECT p_partkey, " + "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(N.TYPE_NAMES.values())) + " ELSE 'None' END AS name FROM part")
def type_names(spark, sf_dir):
    kinds = F.get(F.array(*[F.lit(t) for t in N.TYPE_NAMES]), (F.col("p_partkey") % 12).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", N.type_name(kinds).alias("name"))


_NEAR = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT a.vec_id AS cui, b.vec_id AS candidate FROM embeddings a LEFT JOIN embeddings b ON b.vec_id // 4 = a.vec_id // 3 AND a.vec_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_NEAR}, 9) DESC, b.vec_id) = 1")
def closest_candidate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    candidates = e.select(F.floor(F.col("vec_id") / 4).alias("family"), F.col("vec_id").alias("candidate"), F.col("embedding").alias("theirs"))
    own = e.select(F.col("vec_id").alias("cui"), F.when(F.col("vec_id") % 5 != 0, F.floor(F.col("vec_id") / 3)).alias("family"), "embedding")
    far = -F.round(V.cosine(F.col("embedding"), F.col("theirs")), 9)
    return N.closest_candidate(own.join(candidates, "family", "left"), "cui", "candidate", far)


_LONG = "coalesce(text, '') || chr(10) || 'We saw ' || CASE doc_id % 3 WHEN 0 THEN 'tumour necrosis factor (TNF)' WHEN 1 THEN 'the other kind (TNF)' ELSE 'nothing' END || ' rise; TNF and IBD fell in inflammatory bowel disease (IBD), and TNFR is none'"
_WORD = r"regexp_replace({0}, '(^|[^\w-]){1}($|[^\w-])', '\1{2}\2', 'g')"


@query(
    f"""WITH t AS (SELECT doc_id, {_LONG} AS t FROM documents),
    x AS (SELECT doc_id, {_WORD.format("t", "IBD", "inflammatory bowel disease")} AS u FROM t)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_WORD.format("u", "TNF", "tumour necrosis factor")} ELSE u END AS text FROM x"""
)
def abbreviation_expansion(spark, sf_dir):
    """Texts, each with a sentence that defines abbreviations or does not."""
    return table(spark, sf_dir, "documents").select("doc_id", Y.expand_abbreviations(F.expr(_LONG)).alias("text"))


@query()
def abbreviations_of_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Y.expand_abbreviations(F.col("text")).alias("text"))


def _names(spark, sf_dir):
    """Names of parts, and all two and three words that follow each other in a benchmark item."""
    words = table(spark, sf_dir, "benchmark").select(F.filter(F.regexp_extract_all("text", F.lit(Y.PATTERN), F.lit(0)), lambda w: ~w.isin(*Y.ENDS)).alias("w"))
    out = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit("bacteria").alias("kind"))
    for n, kind in ((2, "bacteria"), (3, "disease")):
        some = words.where(F.size("w") >= n).select(F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"), "w")
        out = out.unionByName(some.select(F.array_join(F.slice("w", F.col("i"), n), " ").alias("name"), F.lit(kind).alias("kind")))
    return out.distinct()


@query(
    rf"""WITH b AS (SELECT list_filter(regexp_extract_all(text, '{Y.PATTERN}'), lambda x: x NOT IN ('.', '!', '?', '*', chr(10))) AS w FROM benchmark),
    n AS (SELECT DISTINCT p_name AS name, 'bacteria' AS kind, 2 AS n FROM part UNION SELECT array_to_string(w[i : i + 1], ' '), 'bacteria', 2 FROM b, unnest(range(1, len(w))) t(i) WHERE len(w) > 1
      UNION SELECT array_to_string(w[i : i + 2], ' '), 'disease', 3 FROM b, unnest(range(1, len(w) - 1)) t(i) WHERE len(w) > 2),
    d AS (SELECT doc_id, regexp_extract_all(text, '{Y.PATTERN}') AS w FROM documents),
    t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
    p AS (SELECT doc_id, w, w IN ('.', '!', '?', '*', chr(10)) AS e, i, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, sum(CASE WHEN w IN ('.', '!', '?', '*', chr(10)) THEN 1 ELSE 0 END) OVER o AS ends FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    g AS (SELECT doc_id, CAST(i - 1 - ends AS INTEGER) AS first, w || ' ' || w2 || CASE WHEN k = 3 THEN ' ' || w3 ELSE '' END AS g, k FROM p, range(2, 4) r(k) WHERE NOT e)
    SELECT doc_id, name, kind, first FROM g JOIN n ON g = name AND n = k"""
)
def dictionary_spans(spark, sf_dir):
    return Y.find_names(table(spark, sf_dir, "documents"), "doc_id", "text", _names(spark, sf_dir)).select("doc_id", "name", "kind", "first")


@query()
def dictionary_pairs(spark, sf_dir):
    """What is left of all names in the documents once longer ones have driven out those that they overlap, by document and kind."""
    found = Y.find_names(table(spark, sf_dir, "documents"), "doc_id", "text", _names(spark, sf_dir))
    return Y.without_overlaps(found, "doc_id", "disease").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


_HITS = """list_reduce(list_prepend(CAST([] AS VARCHAR[]), l), lambda acc, x: CASE
WHEN x[2] IS NOT NULL THEN list_append(acc, x[1] || ' ' || x[2]) WHEN x[3] = 'last' OR len(acc) = 0 OR NOT contains(acc[-1], x[1]) THEN list_append(acc, x[1]) ELSE acc END)"""


@query(
    f"""WITH w AS (SELECT doc_id, string_split(translate(text, '().,;', ''), ' ') AS w FROM documents),
    p AS (SELECT doc_id, w, list_filter(w, lambda x: length(x) = 5) AS p FROM w),
    e AS (SELECT doc_id, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN length(w[i]) = 5 THEN [w[i], CASE WHEN i < len(w) AND length(w[i + 1]) = 5 THEN w[i + 1] END, CASE WHEN i = len(w) THEN 'last' ELSE '' END] END), lambda x: x IS NOT NULL) AS l FROM p)
    SELECT doc_id, array_to_string(list_sort(list_distinct({_HITS})), '|') AS hits FROM e"""
)
def predicted_words(spark, sf_dir):
    from ..functions.text import clean_words

    d = table(spark, sf_dir, "documents").select("doc_id", clean_words(F.col("text")).alias("words"))
    d = d.withColumn("predicted", F.array_distinct(F.filter("words", lambda w: F.char_length(w) == 5)))
    return d.select("doc_id", F.array_join(F.array_sort(N.merged_words(F.col("words"), F.col("predicted"))), "|").alias("hits"))


# ---- collections and files ----------------------------------------------------------------------------------------------------


@query("SELECT lower(p_name) AS document, p_name AS name, CAST(p_partkey AS VARCHAR) AS cui, 16 AS dim FROM part")
def collection_add(spark, sf_dir):
    """Two halves added to a collection that is made, and one of another name that is deleted again."""
    store = B.Collections(spark, shared_path(spark, "collections"))
    store.create("microbes")
    rows = B.entries(GraphView(spark, sf_dir).microbes, "name", "cui", M.embedding_model(M.stub_embedding))
    for part in (0, 1):
        store.add("microbes", rows.where(F.col("metadata.cui").cast("long") % 2 == part))
    store.create("passing")
    store.delete("passing")
    assert store.names() == ["microbes"]
    return store.get("microbes").select("document", "metadata.name", "metadata.cui", F.size("embedding").alias("dim"))


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS id, text AS document, CAST(doc_id AS VARCHAR) AS doc_id, CAST(doc_id % 5 AS VARCHAR) AS fold FROM documents WHERE doc_id % 5 <> 2")
def collection_without_fold(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("fold"), "text")
    return B.fold_entries(d, "fold", 2, "text", "doc_id").select("id", "document", "metadata.doc_id", "metadata.fold")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def csv_roundtrip(spark, sf_dir):
    path = shared_path(spark, "table") + ".csv"
    S.write_table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return S.read_table(spark, path, "s_suppkey bigint, s_name string, s_nationkey int")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part")
def id_map_roundtrip(spark, sf_dir):
    path = shared_path(spark, "ids")
    S.write_id_map(L.surrogate_ids(table(spark, sf_dir, "part"), "p_partkey"), path, "p_partkey")
    return S.read_id_map(spark, path)


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'phi' WHEN 1 THEN 'orca' ELSE 'claude' END || '_gold_k' || (s_suppkey % 5) || '_shots' || (s_suppkey % 2 * 5) || CASE WHEN s_suppkey % 2 = 0 THEN '_ALT' ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN '_COT' ELSE '' END || CASE WHEN s_suppkey % 7 = 0 THEN '_CONF' ELSE '' END AS run FROM supplier")
def run_names(spark, sf_dir):
    k = F.col("s_suppkey")
    model = F.when(k % 3 == 0, "phi").when(k % 3 == 1, "orca").otherwise("claude")
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.run_names(model, F.lit("gold"), k % 5, k % 2 * 5, k % 2 == 0, k % 3 == 0, k % 7 == 0).alias("run"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0")
def resumed_rows(spark, sf_dir):
    """Rows that an interrupted run still has to do."""
    store = S.RunStore(spark, shared_path(spark, "runs"), S.run_name("phi", "gold", 0), "doc_id long, answer string")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    store.append(d.where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("answer")))
    return store.pending(d, "doc_id")


@query(f"WITH {STRENGTHS} SELECT cui_disease, sum(strength_raw) AS total FROM strengths GROUP BY cui_disease".replace("sum(strength_raw)", "CAST(sum(strength_raw) AS BIGINT)"))
def memoised_result(spark, sf_dir):
    memo = S.Memo(spark, shared_path(spark, "memo"))
    build = lambda: GraphView(spark, sf_dir).strengths.groupBy("cui_disease").agg(F.sum("strength_raw").alias("total"))
    memo.get("totals", {"sf": sf_dir}, build)
    return memo.get("totals", {"sf": sf_dir}, lambda: build().limit(0))
