"""Queries on vectors, embeddings, streams, sources and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import models as M
from ..operators import folds as K
from ..operators import graph_ml as G
from ..operators import graph_network as N
from ..operators import vectors as V
from ..operators.graph_attention import attention_layer, random_weights
from ..operators.layout import neighbour_layout
from ..sources import literature as S
from ..sources.run_sink import publish, read_run
from ..streaming import pulls as T
from .graph_view import STRENGTHS, GraphView
from .lineage import cut, shared_path
from .registry import query, table

_SIM = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))"


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0"), e


def _knn_sql(condition: str, k: int, asked: str = " WHERE q.vec_id % 50 = 0") -> str:
    return f"""SELECT q.vec_id AS query, r.vec_id AS neighbour, round({_SIM}, 6) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, r.vec_id) AS INTEGER) AS ranking
    FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id AND {condition}{asked} QUALIFY ranking <= {k}"""


@query(_knn_sql("true", 10, asked=""))
def knn_cosine(spark, sf_dir):
    """The ten nearest of every vector."""
    e = table(spark, sf_dir, "embeddings")
    return V.nearest(e, e, 10).withColumn("similarity", F.round("similarity", 6))


@query(_knn_sql("q.label = r.label", 10))
def knn_within_label(spark, sf_dir):
    return V.nearest(*_vectors(spark, sf_dir), 10, label="label").withColumn("similarity", F.round("similarity", 6))


@query(_knn_sql("true", 1))
def nearest_name(spark, sf_dir):
    return V.nearest(*_vectors(spark, sf_dir), 1).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH a AS ({_knn_sql('true', 3)}), b AS ({_knn_sql('r.label = (q.label + 1) % 10', 3)}), u AS (SELECT query, neighbour, ranking, 0 AS turn FROM a UNION ALL SELECT query, neighbour, ranking, 1 FROM b)
    SELECT query, neighbour, turn, CAST(row_number() OVER (PARTITION BY query ORDER BY ranking, turn) AS INTEGER) AS place FROM u"""
)
def combined_retrieval(spark, sf_dir):
    q, e = _vectors(spark, sf_dir)
    other = V.nearest(q.withColumn("label", (F.col("label") + 1) % 10), e, 3, label="label")
    return V.interleave(V.nearest(q, e, 3), other, 6)


@query()
def mmr_rerank(spark, sf_dir):
    q, e = _vectors(spark, sf_dir)
    near = V.nearest(q, e, 50).join(e.select(F.col("vec_id").alias("neighbour"), "embedding"), "neighbour")
    return V.mmr(near.select("query", "neighbour", "similarity", "embedding"), 5)


@query(
    f"""WITH n AS ({_knn_sql('true', 50)}), s AS (SELECT query, neighbour, ranking, (neighbour * 7919 + query) % 101 AS score FROM n)
    SELECT query, neighbour, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, ranking) AS INTEGER) AS place FROM s QUALIFY place <= 5"""
)
def two_stage_rerank(spark, sf_dir):
    near = V.nearest(*_vectors(spark, sf_dir), 50)
    return V.rerank(near, (F.col("neighbour") * 7919 + F.col("query")) % 101, 5).select("query", "neighbour", "score", "place")


@query()
def lsh_knn(spark, sf_dir):
    return V.lsh_nearest(*_vectors(spark, sf_dir), 10)


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity, round(1 / (1 + exp(-list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS link FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_of_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    j = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    a, b = F.col("a.embedding"), F.col("b.embedding")
    return j.select("a.vec_id", F.round(V.cosine(a, b), 6).alias("similarity"), F.round(G.inner_product_decoder(a, b), 6).alias("link"))


# ---- learning -----------------------------------------------------------------------------------------------------------------


@query()
def kmeans_clusters(spark, sf_dir):
    return G.kmeans(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4)


@query()
def pca_2d(spark, sf_dir):
    return G.project_2d(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def neighbour_map(spark, sf_dir):
    """The map of all vectors that keeps ten neighbours of each, published as one run with its parameters and read back."""
    place = lambda e, **params: publish(neighbour_layout(e, "vec_id", "embedding", **params), shared_path(spark, "maps"), "map", params)
    return read_run(spark, place(table(spark, sf_dir, "embeddings"), k=10, min_dist=0.1, seed=42), "map")


@query("SELECT CASE WHEN label = 9 THEN 'failed to converge' ELSE CAST(label AS VARCHAR) END AS cluster, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS mean FROM embeddings GROUP BY 1")
def cluster_table(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.when(F.col("label") != 9, F.col("label")).alias("c"), F.col("embedding")[0].cast("double").alias("x"))
    return G.cluster_table(e, "c", "x")


def _weighted(spark, sf_dir):
    s = GraphView(spark, sf_dir).strengths.where("strength_raw <> 0").select("cui_microbe", "cui_disease", "strength_raw")
    one = cut(s).select(F.concat(F.lit("p"), F.col("cui_microbe").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("cui_disease").cast("string")).alias("b"), F.abs("strength_raw").cast("double").alias("weight"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


@query()
def fastrp_embedding(spark, sf_dir):
    return G.fastrp(_weighted(spark, sf_dir))


@query()
def walk_word2vec(spark, sf_dir):
    return G.walk_embeddings(G.random_walks(_weighted(spark, sf_dir)))


@query()
def metapath_word2vec(spark, sf_dir):
    e = _weighted(spark, sf_dir).select("a", "b", F.when(F.col("a").startswith("p"), "to_disease").otherwise("to_microbe").alias("type"))
    g = GraphView(spark, sf_dir)
    for parents, child, up, down in ((g.disease_parents, "n%", "to_parent", "to_child"), (g.microbe_parents, "p%", "to_taxon", "to_species")):
        pairs = parents.where(F.col("child").like(child))
        e = e.unionByName(pairs.select(F.col("child").alias("a"), F.col("parent").alias("b"), F.lit(up).alias("type")))
        e = e.unionByName(pairs.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.lit(down).alias("type")))
    return G.walk_embeddings(G.random_walks(e, metapath=["to_disease", "to_parent", "to_child", "to_microbe", "to_taxon", "to_species"]))


@query()
def neighbour_mean(spark, sf_dir):
    e = _weighted(spark, sf_dir)
    degree = e.groupBy(F.col("a").alias("node")).agg(F.array(F.count(F.lit(1)).cast("double")).alias("features"))
    return G.neighbour_mean(e, degree)


@query()
def link_prediction(spark, sf_dir):
    """For each sign a model of its own, judged on pairs held out, and the ten likeliest partners of each microbe among pairs that the
    graph does not have and no model was trained on."""
    g = GraphView(spark, sf_dir)
    emb = cut(G.fastrp(_weighted(spark, sf_dir)))
    pairs = cut(g.strengths.select("cui_microbe", "cui_disease", "strength_raw")).select(F.concat(F.lit("p"), F.col("cui_microbe").cast("string")).alias("m"), F.concat(F.lit("n"), F.col("cui_disease").cast("string")).alias("d"), "strength_raw")
    out = None
    for kind, x in (("POSITIVE", pairs.where("strength_raw > 0")), ("NEGATIVE", pairs.where("strength_raw < 0"))):
        found = G.predict_unseen(x.select("m", "d"), pairs.select("m", "d"), emb).withColumn("type", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {STRENGTHS} SELECT cui_microbe, cui_disease, CAST(sign(strength_raw) AS INTEGER) AS regressor, CASE WHEN strength_raw > 0 THEN 2 WHEN strength_raw < 0 THEN 1 ELSE 0 END AS ternary, CASE WHEN strength_raw <> 0 THEN 1 ELSE 0 END AS existence FROM strengths")
def edge_labels(spark, sf_dir):
    s, x = GraphView(spark, sf_dir).strengths, F.col("strength_raw")
    return s.select("cui_microbe", "cui_disease", *[G.edge_labels(x, k).alias(k) for k in ("regressor", "ternary", "existence")])


# ---- graph networks -----------------------------------------------------------------------------------------------------------

_RELATIONS = [("mentions", "microbe", "disease"), ("mentioned", "disease", "microbe"), ("family", "family", "microbe"), ("member", "microbe", "family"), ("region", "region", "disease")]


def _typed_graph(spark, sf_dir):
    """Nodes (node, kind, x) with the logarithm of their degree and draws of their name as features, and edges (type, src, dst)."""
    g = GraphView(spark, sf_dir)
    p, n = (lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))), (lambda c: F.concat(F.lit("n"), F.col(c).cast("string")))
    s = cut(g.strengths.select("cui_microbe", "cui_disease")).select(p("cui_microbe").alias("m"), n("cui_disease").alias("d"))
    of, up = g.microbes.select(p("cui").alias("m"), F.concat(F.lit("b"), "family").alias("f")), g.diseases.select(n("cui").alias("d"), F.concat(F.lit("r"), F.col("region").cast("string")).alias("r"))
    edge = lambda t, rows, a, b: rows.select(F.lit(t).alias("type"), F.col(a).alias("src"), F.col(b).alias("dst")).distinct()
    edges = edge("mentions", s, "m", "d").unionByName(edge("mentioned", s, "d", "m")).unionByName(edge("family", of, "f", "m")).unionByName(edge("member", of, "m", "f")).unionByName(edge("region", up, "r", "d"))
    kinds = of.select(F.col("m").alias("node"), F.lit("microbe").alias("kind")).unionByName(of.select("f", F.lit("family")).toDF("node", "kind")).unionByName(up.select("d", F.lit("disease")).toDF("node", "kind")).unionByName(up.select("r", F.lit("region")).toDF("node", "kind")).distinct()
    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.log1p(F.count(F.lit(1))).alias("degree"))
    draws = [F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1001)) / 500 - 1 for i in range(3)]
    return kinds.join(degree, "node", "left").select("node", "kind", F.array(F.coalesce("degree", F.lit(0.0)), *draws).alias("x")), edges


def _signed_pairs(spark, sf_dir):
    """(l, r, y, split): pairs with a strength, and whether it is positive."""
    s = GraphView(spark, sf_dir).strengths.where("strength_raw <> 0")
    rows = s.select(F.concat(F.lit("p"), F.col("cui_microbe").cast("string")).alias("l"), F.concat(F.lit("n"), F.col("cui_disease").cast("string")).alias("r"), (F.col("strength_raw") > 0).cast("double").alias("y"))
    return K.hash_split(rows, ["l", "r"], {"train": 0.7, "validation": 0.15, "test": 0.15}, 0)


def _trained(spark, sf_dir):
    nodes, edges = _typed_graph(spark, sf_dir)
    nodes, edges, pairs = cut(nodes), cut(edges), cut(_signed_pairs(spark, sf_dir))
    net = N.Network(_RELATIONS, 4)
    training = N.Training(net, shared_path(spark, "training"), ("microbe", "disease"))
    return nodes, edges, pairs, training, N.blocks(net, nodes, edges, pairs, ("microbe", "disease"))


@query()
def hetero_network_training(spark, sf_dir):
    """Epoch by epoch, losses and accuracy of a network over typed edges that tells positive pairs from negative ones."""
    _, _, _, training, rows = _trained(spark, sf_dir)
    training.run(rows)
    return training.log(spark)


@query()
def hetero_network_predictions(spark, sf_dir):
    """Every pair with the probability that it is positive, its split and whether the network is right."""
    nodes, edges, pairs, training, rows = _trained(spark, sf_dir)
    net = training.run(rows)
    found = N.scores(net, pairs, N.embeddings(net, nodes, edges))
    return found.select("l", "r", "split", F.col("y").cast("int").alias("label"), F.round("score", 6).alias("probability"), ((F.col("score") >= 0.5) == (F.col("y") == 1)).alias("right"))


@query()
def graphsage_embedding(spark, sf_dir):
    """Embeddings of all nodes from their degree, learnt so that linked nodes agree more than drawn ones."""
    both = _weighted(spark, sf_dir)
    edges = cut(both.select(F.lit("to").alias("type"), F.col("a").alias("src"), F.col("b").alias("dst")))
    nodes = edges.groupBy(F.col("dst").alias("node")).agg(F.array(F.log1p(F.count(F.lit(1)))).alias("x")).withColumn("kind", F.lit("node"))
    linked = edges.where("src < dst").select(F.col("src").alias("l"), F.col("dst").alias("r"))
    drawn = K.negative_pairs(linked, "l", "r").select("l", "r", F.lit(0.0).alias("y"))
    pairs = K.hash_split(linked.withColumn("y", F.lit(1.0)).unionByName(drawn), ["l", "r"], {"train": 0.8, "validation": 0.2}, 0)
    net = N.Network([("to", "node", "node")], 1, decoder="inner", activation="sigmoid")
    N.Training(net, shared_path(spark, "training"), ("node", "node")).run(N.blocks(net, nodes, edges, pairs, ("node", "node")))
    return N.embeddings(net, nodes, edges).select("node", "embedding")


@query()
def attention_embedding(spark, sf_dir):
    """One layer of attention over typed neighbourhoods, with drawn weights."""
    nodes, edges = _typed_graph(spark, sf_dir)
    return attention_layer(cut(nodes), cut(edges), _RELATIONS, random_weights(_RELATIONS, 4, heads=2, size=4))


# ---- streams and sources ------------------------------------------------------------------------------------------------------


@query("SELECT CAST(d AS DATE) AS start, CAST(d + INTERVAL 1 MONTH AS DATE) AS \"end\" FROM generate_series(DATE '1999-11-01', DATE '2001-03-01', INTERVAL 1 MONTH) t(d)")
def month_windows(spark, sf_dir):
    return T.month_windows(spark, "1999-11-01", "2001-03-15")


@query(
    """WITH w AS (SELECT CAST(d AS DATE) AS s, CAST(d + INTERVAL 1 MONTH AS DATE) AS e FROM generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH) t(d))
    SELECT s AS start, count(*) AS n FROM orders JOIN w ON CAST(o_orderdate AS DATE) BETWEEN s AND e GROUP BY s"""
)
def monthly_pulls(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return T.in_windows(o, T.month_windows(spark, "1995-01-01", "2001-08-01"), "o_orderdate").groupBy("start").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_daily_batch(spark, sf_dir):
    return T.daily_counts(table(spark, sf_dir, "events"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 HOUR AS DATE) FROM events) GROUP BY 1, 2")
def events_daily_stream(spark, sf_dir):
    """The stream, run to its end; days that the watermark has not passed stay open and are not in it."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    name = f"daily_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = T.event_stream(spark, f"{sf_dir}/*events.parquet", schema)
    run = T.daily_counts_stream(events).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


_ARTICLES = "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderpriority AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS publication_date FROM orders WHERE trim(o_orderpriority) <> '' AND o_orderdate IS NOT NULL AND o_orderkey IS NOT NULL"


def _months(spark, sf_dir, last=None):
    """Windows from the first month with orders to the last one, or to that of ``last``."""
    first, end = table(spark, sf_dir, "orders").agg(*[f(F.col("o_orderdate").cast("date").cast("string")) for f in (F.min, F.max)]).first()
    return T.month_windows(spark, f"{first[:7]}-01", last or end), first, end


def _service(spark, sf_dir):
    """What the client answers from: the orders in the folder that all executors share, as clients open files without Spark. They lie in
    order of their dates in small row groups, so a window's client opens few."""
    path = shared_path(spark, "service")
    order = ["o_orderdate", "o_orderkey"]
    table(spark, sf_dir, "orders").repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", 4 << 20).parquet(path)
    return path


@query(_ARTICLES)
def literature_pull(spark, sf_dir):
    """All articles, a window a partition, from a client that answers from the table of orders."""
    windows, _, _ = _months(spark, sf_dir)
    return S.pull(spark, windows, "paperweave.sources.literature:table_client", source=_service(spark, sf_dir)).select("_id", "title", "publication_date")


@query(_ARTICLES)
def literature_stream(spark, sf_dir):
    """The same as a stream that is stopped half-way and goes on from its checkpoint with the months that are left."""
    _, first, end = _months(spark, sf_dir)
    target, checkpoint = shared_path(spark, "articles"), shared_path(spark, "pulls")
    service = _service(spark, sf_dir)
    middle = f"{(int(first[:4]) + int(end[:4])) // 2}-06-01"
    for last in (max(first, min(middle, end)), end):
        windows, _, _ = _months(spark, sf_dir, last)
        stream = S.pull_stream(spark, windows, "paperweave.sources.literature:table_client", source=service)
        T.append_once(stream, target, ["_id"], ["publication_date"], checkpoint)
    return spark.read.parquet(target).select("_id", "title", "publication_date")


@query("SELECT CAST(doc_id AS VARCHAR) AS _id, source AS journal FROM documents WHERE doc_id % 5 <> 0 AND trim(text) <> ''")
def article_validation(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("_id"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).otherwise(" ").alias("title"), F.lit("2020").alias("publication_date"), F.col("text").alias("abstract"), F.col("source").alias("journal"))
    return S.valid_articles(rows).select("_id", "journal")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'worthless')")
def literature_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(S.matches(F.col("text"), ["License", "worthless"])).select("doc_id")


@query("SELECT doc_id, ['positive', 'negative', 'na'][CAST('0x' || substr(md5(text), 1, 2) AS INTEGER) % 3 + 1] AS label FROM documents")
def published_run(spark, sf_dir):
    """Labels of all documents, published by their tasks and one commit, and read back by the index."""
    rows = table(spark, sf_dir, "documents").select("doc_id", M.scalar_model(M.stub_classifier)("text").alias("label"))
    return read_run(spark, publish(rows, shared_path(spark, "runs"), "labels", {"model": "stub", "table": "documents"}), "labels")


@query("SELECT doc_id, ['positive', 'negative', 'na'][CAST('0x' || substr(md5(text), 1, 2) AS INTEGER) % 3 + 1] AS label FROM documents")
def model_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.scalar_model(M.stub_classifier)("text").alias("label"))


@query()
def model_embeddings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", M.embedding_model(M.stub_embedding)("p_name").alias("embedding"))


@query("SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq FROM events")
def event_sequence(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.row_number().over(w).alias("seq"))
