"""Queries on votes, reports, folds and balances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import folds as K
from ..operators import votes as V
from .graph_view import EVIDENCE, STRENGTHS, GraphView
from .registry import query, table

#: Seven arithmetic votes per document: unanimous for two of every four, split for the others.
_CODE = "(doc_id * 31 + i * (doc_id % 4)) % 3"
_VOTES = f"""v AS (SELECT doc_id, i, {_CODE} AS c FROM documents, unnest(range(7)) t(i)),
n AS (SELECT doc_id, CAST(count(*) FILTER (c = 0) AS INTEGER) AS positive, CAST(count(*) FILTER (c = 1) AS INTEGER) AS negative, CAST(count(*) FILTER (c = 2) AS INTEGER) AS na FROM v GROUP BY doc_id),
w AS (SELECT *, CASE WHEN positive >= negative AND positive >= na THEN 'positive' WHEN negative >= na THEN 'negative' ELSE 'na' END AS winner,
round(CASE WHEN positive > 0 THEN -(positive / 7.0) * ln(positive / 7.0) ELSE 0.0 END + CASE WHEN negative > 0 THEN -(negative / 7.0) * ln(negative / 7.0) ELSE 0.0 END
+ CASE WHEN na > 0 THEN -(na / 7.0) * ln(na / 7.0) ELSE 0.0 END, 9) + 0.0 AS entropy FROM n)"""


def _votes(spark, sf_dir):
    labels = F.array(*[F.lit(x) for x in V.LABELS])
    votes = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.get(labels, ((F.col("doc_id") * 31 + i * (F.col("doc_id") % 4)) % 3).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", votes.alias("votes")).withColumn("counts", V.tally(F.col("votes")))


@query(f"WITH {_VOTES} SELECT doc_id, positive, negative, na, winner FROM w")
def vote_tally(spark, sf_dir):
    return _votes(spark, sf_dir).select("doc_id", "counts.*", V.winner(F.col("counts")).alias("winner"))


@query(f"WITH {_VOTES} SELECT doc_id, entropy FROM w")
def vote_entropy(spark, sf_dir):
    return _votes(spark, sf_dir).select("doc_id", (F.round(V.vote_entropy(F.col("counts")), 9) + F.lit(0.0)).alias("entropy"))


@query(f"WITH {_VOTES} SELECT doc_id, CASE WHEN entropy = 0 THEN winner ELSE 'na' END AS label FROM w")
def certainty_gate(spark, sf_dir):
    return _votes(spark, sf_dir).select("doc_id", V.certain(F.col("counts")).alias("label"))


_STAGES = """s AS (SELECT doc_id, i, ['positive', 'negative', 'na'][(doc_id * (i + 1) + doc_id // 3 * i) % 3 + 1] AS x FROM documents, unnest(range(4)) t(i)),
c AS (SELECT doc_id, x, count(*) AS k, min(i) AS f FROM s GROUP BY doc_id, x),
b AS (SELECT *, max(k) OVER (PARTITION BY doc_id) AS m FROM c)"""


@query(f"WITH {_STAGES} SELECT doc_id, CASE WHEN bool_or(x = 'na') THEN 'na' ELSE arg_min(x, f) END AS label FROM b WHERE k = m GROUP BY doc_id")
def stage_final_selection(spark, sf_dir):
    labels = F.array(*[F.lit(x) for x in V.LABELS])
    code = lambda i: ((F.col("doc_id") * (i + 1) + F.floor(F.col("doc_id") / 3) * i) % 3).cast("int")
    stages = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(labels, code(i)))
    return table(spark, sf_dir, "documents").select("doc_id", V.final_selection(stages).alias("label"))


_MENTION = """mention AS (SELECT o_custkey AS custkey, p_type AS kind, n_regionkey AS region, CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'na' END AS rel_type, l_orderkey AS pmid, l_linenumber AS seq
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def _mentions(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("na")
    return j.select(F.col("o_custkey").alias("custkey"), F.col("p_type").alias("kind"), F.col("n_regionkey").alias("region"), kind.alias("rel_type"), F.col("l_orderkey").alias("pmid"), F.col("l_linenumber").alias("seq"))


@query(
    f"""WITH {_MENTION}, c AS (SELECT custkey, kind, region, rel_type, count(*) AS votes, min(pmid * 100 + seq) AS f,
    (SELECT string_agg(e, ' ||| ' ORDER BY e) FROM (SELECT DISTINCT unnest(list(pmid || ':' || seq)) AS e)) AS evidence FROM mention WHERE rel_type <> 'na' GROUP BY custkey, kind, region, rel_type)
    SELECT custkey, kind, region, rel_type AS relation, votes, evidence FROM c QUALIFY row_number() OVER (PARTITION BY custkey, kind, region ORDER BY votes DESC, f, rel_type) = 1"""
)
def paper_vote(spark, sf_dir):
    e = F.concat(F.col("pmid").cast("string"), F.lit(":"), F.col("seq").cast("string"))
    return V.paper_votes(_mentions(spark, sf_dir), ["custkey", "kind", "region"], ["pmid", "seq"], e)


@query("SELECT regexp_extract(k, '^[^_]*') AS paper, count(*) AS n, min(k) AS first FROM (SELECT (doc_id // 3) || '_n' || (doc_id % 3) AS k FROM documents) GROUP BY 1")
def group_sentence_ids(spark, sf_dir):
    k = F.concat(F.floor(F.col("doc_id") / 3).cast("string"), F.lit("_n"), (F.col("doc_id") % 3).cast("string"))
    return table(spark, sf_dir, "documents").select(k.alias("k")).groupBy(F.split_part("k", F.lit("_"), F.lit(1)).alias("paper")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))


# ---- reports ------------------------------------------------------------------------------------------------------------------

_RULE = "CASE WHEN n_chars % 3 = 0 THEN 'positive' WHEN n_chars % 3 = 1 THEN 'negative' ELSE 'na' END"
_TRUTH = "CASE WHEN doc_id % 5 < 2 THEN 'positive' WHEN doc_id % 5 < 4 THEN 'negative' ELSE 'relate' END"
_PRED = f"pred AS (SELECT doc_id, {_TRUTH} AS truth, {_RULE} AS prediction FROM documents)"


def _report(source: str) -> str:
    return f"""k AS (SELECT DISTINCT truth AS class FROM {source} UNION SELECT DISTINCT prediction FROM {source}),
    c AS (SELECT class, (SELECT count(*) FROM {source} WHERE truth = class) AS support, (SELECT count(*) FROM {source} WHERE prediction = class) AS predicted,
          (SELECT count(*) FROM {source} WHERE truth = class AND prediction = class) AS hit FROM k),
    r AS (SELECT class, support, hit, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS r FROM c),
    f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM r),
    o AS (SELECT class, p, r, f, support FROM f UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f
    UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM f UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM f)
    SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM o"""


def _predictions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_TRUTH).alias("truth"), F.expr(_RULE).alias("prediction"))


@query(f"WITH {_PRED}, {_report('pred')}")
def classification_report(spark, sf_dir):
    return E.classification_report(_predictions(spark, sf_dir))


@query(f"WITH {_PRED} SELECT truth, count(*) FILTER (prediction = 'positive') AS p_positive, count(*) FILTER (prediction = 'negative') AS p_negative, count(*) FILTER (prediction = 'na') AS p_na FROM pred GROUP BY truth")
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(_predictions(spark, sf_dir), ["positive", "negative", "na"])


@query(f"WITH {_VOTES}, {_PRED}, sure AS (SELECT pred.* FROM pred JOIN w USING (doc_id) WHERE entropy <= 0.9), {_report('sure')}")
def report_certain(spark, sf_dir):
    j = _predictions(spark, sf_dir).join(_votes(spark, sf_dir), "doc_id")
    return E.classification_report(E.certain_only(j, V.vote_entropy(F.col("counts")), 0.9))


@query("WITH l AS (SELECT doc_id, toxic AS truth, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id)), x AS (SELECT CAST(truth AS VARCHAR) AS truth, CAST(prediction AS VARCHAR) AS prediction FROM l), " + _report("x"))
def binary_metrics(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return E.classification_report(j.select(F.col("toxic").alias("truth"), F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("prediction")))


_MEMBERS = "m AS (SELECT doc_id, [(doc_id % 4), (doc_id // 2) % 4, (doc_id // 3) % 4] AS v, [doc_id % 2, doc_id % 3, doc_id % 5] AS h FROM documents)"
_MV = "array(doc_id % 4, (doc_id div 2) % 4, (doc_id div 3) % 4)"


@query(f"WITH {_MEMBERS} SELECT doc_id, v[1] AS label FROM m WHERE v[1] = v[2] AND v[2] = v[3]")
def agreement_subset(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_MV).alias("v"))
    return d.where(E.all_agree(F.col("v"))).select("doc_id", F.col("v")[0].alias("label"))


@query(f"WITH {_MEMBERS} SELECT doc_id FROM m WHERE v[1] = v[2] AND v[2] = v[3] AND CAST(h[1] = 0 AS INTEGER) + CAST(h[2] = 0 AS INTEGER) + CAST(h[3] = 0 AS INTEGER) = 2")
def agreement_two_certain(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_MV).alias("v"), F.expr("array(doc_id % 2, doc_id % 3, doc_id % 5)").alias("h"))
    return d.where(E.agree_and_two_certain(F.col("v"), F.col("h"), 0)).select("doc_id")


@query(
    f"""WITH {_MEMBERS}, e AS (SELECT doc_id, v, unnest(v) AS x FROM m), c AS (SELECT doc_id, any_value(v) AS v, x, count(*) AS n FROM e GROUP BY doc_id, x),
    b AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS t FROM c),
    k AS (SELECT doc_id, any_value(v) AS v, list(x) AS best FROM b WHERE n = t GROUP BY doc_id)
    SELECT doc_id, CASE WHEN len(best) = 1 THEN best[1] WHEN list_contains(best, 2) THEN 2 WHEN list_contains(best, 3) THEN 3 ELSE v[1] END AS vote,
    CASE WHEN v[1] = v[2] AND v[2] = v[3] THEN v[1] ELSE -1 END AS agreed,
    CASE WHEN list_contains(best, 1) THEN 1 WHEN list_contains(best, 0) THEN 0 WHEN list_contains(best, 3) THEN 3 ELSE 2 END AS preferred FROM k"""
)
def ensemble_vote(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_MV).alias("v"))
    v = F.col("v")
    return d.select("doc_id", V.ensemble_vote(v).alias("vote"), V.ensemble_agreement(v).cast("long").alias("agreed"), V.preferred_vote(v, [1, 0, 3, 2]).alias("preferred"))


_SOFT = " + ".join(f"exp(CAST(embedding[{1 + 3 * m} + j] AS DOUBLE)) / (exp(CAST(embedding[{1 + 3 * m}] AS DOUBLE)) + exp(CAST(embedding[{2 + 3 * m}] AS DOUBLE)) + exp(CAST(embedding[{3 + 3 * m}] AS DOUBLE)))" for m in range(3))


@query(f"WITH s AS (SELECT vec_id, j, {_SOFT} AS p FROM embeddings, unnest(range(3)) t(j)) SELECT vec_id, CAST(arg_max(j, p) AS INTEGER) AS label FROM s GROUP BY vec_id")
def ensemble_softmax(spark, sf_dir):
    logits = F.array(*[F.transform(F.slice("embedding", 1 + 3 * m, 3), lambda x: x.cast("double")) for m in range(3)])
    return table(spark, sf_dir, "embeddings").select("vec_id", V.ensemble_softmax(logits).alias("label"))


@query("SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def class_counts(spark, sf_dir):
    return E.class_counts(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("WITH c AS (SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY l_returnflag) SELECT class, n, round((1 / n) / sum(1 / n) OVER (), 9) AS weight FROM c")
def class_weights(spark, sf_dir):
    return E.class_weights(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("WITH c AS (SELECT quality AS class, count(*) AS n FROM labels GROUP BY quality) SELECT class, n, (SELECT max(n) FROM c WHERE class = 1) - n AS needed FROM c")
def balance_needed(spark, sf_dir):
    return E.needed_to_balance(table(spark, sf_dir, "labels"), "quality", 1)


@query("SELECT o_orderpriority AS model, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS deviation, round(sum(o_totalprice), 6) AS total FROM (SELECT o_orderpriority, o_orderkey % 5 AS fold, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL) GROUP BY o_orderpriority")
def fold_mean_std(spark, sf_dir):
    folds = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 5).alias("fold")).agg(F.max("o_totalprice").alias("v"))
    return E.over_folds(folds, "model", "v")


@query("SELECT round(100 * avg(CAST(toxic = quality AS INTEGER)), 1) AS percent FROM labels")
def percent_equal(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(E.percent_equal(F.col("toxic"), F.col("quality")).alias("percent"))


# ---- folds --------------------------------------------------------------------------------------------------------------------

_I = "i AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels)"
_FOLD = "least(i // (n // 5), CASE WHEN -((-n) // (n // 5)) > 5 THEN CAST(ceil(n / (n // 5)) AS BIGINT) - 2 ELSE CAST(ceil(n / (n // 5)) AS BIGINT) - 1 END)"
_FOLD = "least(i // (n // 5), CASE WHEN CAST(ceil(n / (n // 5)) AS BIGINT) > 5 THEN CAST(ceil(n / (n // 5)) AS BIGINT) - 2 ELSE CAST(ceil(n / (n // 5)) AS BIGINT) - 1 END)"


@query(f"WITH {_I} SELECT doc_id, CAST({_FOLD} AS BIGINT) AS fold FROM i")
def fold_chunks(spark, sf_dir):
    return K.chunk_folds(table(spark, sf_dir, "labels"), ["doc_id"], 5).select("doc_id", "fold")


@query(f"WITH {_I} SELECT doc_id, i // (n // 5) AS fold FROM i")
def fold_chunks_unmerged(spark, sf_dir):
    return K.chunk_folds(table(spark, sf_dir, "labels"), ["doc_id"], 5, False).select("doc_id", "fold")


@query(
    """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels WHERE quality <> 1),
    of AS (SELECT doc_id, least(i // greatest(n // 5, 1), 4) AS fold FROM o),
    h AS (SELECT f, greatest(60 - (SELECT count(*) FROM of WHERE fold = f), 0) AS room FROM unnest(range(5)) t(f)),
    b AS (SELECT f, sum(room) OVER (ORDER BY f) - room AS a, CASE WHEN f = 4 THEN 1000000000 ELSE sum(room) OVER (ORDER BY f) END AS e FROM h),
    p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels WHERE quality = 1)
    SELECT doc_id, CAST(fold AS BIGINT) AS fold FROM of UNION ALL SELECT doc_id, CAST(f AS BIGINT) FROM p JOIN b ON i >= a AND i < e"""
)
def fold_stratified(spark, sf_dir):
    return K.stratified_folds(table(spark, sf_dir, "labels"), "quality", ["doc_id"], 5, 1, 60).select("doc_id", "fold")


@query(f"WITH {_I}, f AS (SELECT doc_id, {_FOLD} AS fold FROM i) SELECT doc_id, CASE fold WHEN 3 THEN 'test' WHEN 4 THEN 'validation' ELSE 'train' END AS role FROM f")
def fold_roles(spark, sf_dir):
    f = K.chunk_folds(table(spark, sf_dir, "labels"), ["doc_id"], 5)
    return f.select("doc_id", K.rotated_role(F.col("fold"), 3, 5).alias("role"))


@query(
    f"""WITH {STRENGTHS}, i AS (SELECT cui_microbe, cui_disease, row_number() OVER (ORDER BY cui_microbe, cui_disease) AS i, count(*) OVER () AS n FROM strengths)
    SELECT cui_microbe, cui_disease, CASE WHEN i <= 100 THEN 'test' WHEN i <= 100 + floor((n - 100) * 0.8) THEN 'train' ELSE 'validation' END AS split FROM i"""
)
def split_first_n(spark, sf_dir):
    return K.first_n_split(GraphView(spark, sf_dir).strengths, ["cui_microbe", "cui_disease"], 100).select("cui_microbe", "cui_disease", "split")


@query(
    f"""WITH {STRENGTHS}, x AS (SELECT DISTINCT p_partkey AS cui_microbe, p_size % 25 AS cui_disease FROM part)
    SELECT cui_microbe, cui_disease, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.cui_microbe = s.cui_microbe AND x.cui_disease = s.cui_disease) THEN 'test' ELSE 'train' END AS split FROM strengths s"""
)
def split_external(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cui_microbe"), (F.col("p_size") % 25).cast("long").alias("cui_disease"))
    return K.external_split(GraphView(spark, sf_dir).strengths.select("cui_microbe", "cui_disease"), x, ["cui_microbe", "cui_disease"])


@query()
def negative_sampling(spark, sf_dir):
    return K.negative_pairs(GraphView(spark, sf_dir).strengths, "cui_microbe", "cui_disease")


@query()
def random_edge_split(spark, sf_dir):
    g = GraphView(spark, sf_dir).strengths.select("cui_microbe", "cui_disease")
    return K.hash_split(g, ["cui_microbe", "cui_disease"], {"train": 0.7, "validation": 0.15, "test": 0.15}, 12)


@query(f"WITH {EVIDENCE} SELECT pmid, cui_microbe, cui_disease, seq FROM evidence QUALIFY row_number() OVER (PARTITION BY pmid, cui_microbe, cui_disease ORDER BY seq) = 1")
def first_mention(spark, sf_dir):
    from ..operators.upserts import first_by

    e = GraphView(spark, sf_dir).evidence
    return first_by(e, ["pmid", "cui_microbe", "cui_disease"], ["seq"]).select("pmid", "cui_microbe", "cui_disease", "seq")
