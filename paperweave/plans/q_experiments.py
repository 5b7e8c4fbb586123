"""Queries on classes, samples, augmentation, prompts, evaluation runs and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions import endpoints as H
from ..functions import models as M
from ..functions import text as X
from ..operators import augment as A
from ..operators import evaluation as E
from ..operators import experiments as T
from ..operators import folds as K
from ..operators import generation as W
from ..operators import vectors as V
from .graph_view import STRENGTHS, GraphView
from .lineage import shared_path
from .registry import query, table

_CLASS = "CASE doc_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'relate' ELSE 'na' END"
_CLASSES = ["positive", "negative", "relate", "na"]


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_CLASS).alias("label"), "text")


# ---- classes and samples ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_CLASS} AS class FROM documents")
def class_split(spark, sf_dir):
    out = None
    for name, rows in A.by_class(_labelled(spark, sf_dir), "label", _CLASSES).items():
        one = rows.select("doc_id", F.lit(name).alias("class"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT doc_id, replace({_CLASS}, 'relate', 'na') AS three, CASE WHEN doc_id % 4 = 3 THEN 'relate' ELSE {_CLASS} END AS other FROM documents")
def label_remap(spark, sf_dir):
    label = F.col("label")
    return _labelled(spark, sf_dir).select("doc_id", A.three_classes(label).alias("three"), A.three_classes(label, "relate").alias("other"))


_MIX = "(vec_id * 7919) % 100003"


@query(f"SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_MIX}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE r <= floor(n * CASE WHEN n > 30 THEN CAST(0.05 AS DOUBLE) WHEN n > 1 THEN CAST(0.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END + CAST(0.5 AS DOUBLE))")
def cluster_sample(spark, sf_dir):
    return A.sample_per_group(table(spark, sf_dir, "embeddings"), "label", [F.expr(_MIX), F.col("vec_id")]).select("vec_id", "label")


@query(f"SELECT label, arg_min(vec_id, {_MIX} * 100000 + vec_id) AS vec_id FROM embeddings GROUP BY label")
def one_row_sample(spark, sf_dir):
    return A.one_per_group(table(spark, sf_dir, "embeddings"), "label", "vec_id", F.struct(F.expr(_MIX), F.col("vec_id")))


@query(f"WITH {STRENGTHS}, t AS (SELECT cui_microbe, cui_disease, strength_raw, row_number() OVER (ORDER BY strength_raw DESC, cui_microbe, cui_disease) AS r FROM strengths QUALIFY r <= 10) SELECT cui_microbe, cui_disease, strength_raw, CAST(row_number() OVER (ORDER BY r DESC) AS INTEGER) AS shown FROM t")
def top_reversed(spark, sf_dir):
    s = GraphView(spark, sf_dir).strengths.select("cui_microbe", "cui_disease", "strength_raw")
    return T.last_reversed(s, [F.desc("strength_raw"), F.asc("cui_microbe"), F.asc("cui_disease")], 10)


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:5], ' ') AS first FROM documents")
def first_of_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " ", -1), 1, 5), " ").alias("first"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda x: translate(x, chr(39) || chr(34), '')), '|') AS parts FROM documents")
def quote_stripping_lists(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.strip_quotes_all(F.split("text", " ", -1)), "|").alias("parts"))


@query("SELECT CAST(doc_id // 3 AS VARCHAR) AS paper, string_agg((doc_id // 3) || '_n' || (doc_id % 3), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1")
def sentence_ids_by_paper(spark, sf_dir):
    k = F.concat(F.floor(F.col("doc_id") / 3).cast("string"), F.lit("_n"), (F.col("doc_id") % 3).cast("string"))
    ids = table(spark, sf_dir, "documents").select(k.alias("k")).withColumn("paper", F.substring_index("k", "_", 1))
    return ids.groupBy("paper").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("ids"))


# ---- augmentation -------------------------------------------------------------------------------------------------------------

_REL = "rel AS (SELECT p_partkey AS id, p_name || ' and ' || p_type || ' ' || p_partkey AS text, p_name AS microbe, p_type AS disease, CASE p_partkey % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'na' END AS label FROM part)"


def _relations(spark, sf_dir):
    label = F.when(F.col("p_partkey") % 3 == 0, "positive").when(F.col("p_partkey") % 3 == 1, "negative").otherwise("na")
    text = F.concat("p_name", F.lit(" and "), "p_type", F.lit(" "), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), F.col("p_name").alias("microbe"), F.col("p_type").alias("disease"), label.alias("label"))


@query(
    f"""WITH {_REL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM rel)
    SELECT a.id, a.label, replace(replace(a.text, a.disease, b.disease), a.microbe, b.microbe) AS text FROM r a JOIN r b ON a.label = b.label AND b.i = (a.i + 1) % a.n"""
)
def entity_shuffling(spark, sf_dir):
    return A.shuffled_entities(_relations(spark, sf_dir), "label", ["id"]).select("id", "label", "text")


@query()
def rephrased_rows(spark, sf_dir):
    r = _relations(spark, sf_dir)
    return r.select("id", "text", A.rephrased(A.stub_rephrase)("text", F.lit("and"), "disease").alias("rephrased"))


_UNEVEN = "CASE WHEN p_size % 10 < 6 THEN 'positive' WHEN p_size % 10 < 9 THEN 'negative' ELSE 'na' END"


@query(
    f"""WITH rel AS (SELECT p_name AS microbe, p_type AS disease, {_UNEVEN} AS label FROM part WHERE p_partkey % 5 <> 3),
    c AS (SELECT label, count(*) AS n FROM rel GROUP BY 1),
    slots AS (SELECT label, n, unnest(range((SELECT n FROM c WHERE label = 'positive') - n)) AS slot FROM c),
    mm AS (SELECT microbe, row_number() OVER (ORDER BY microbe) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT microbe FROM rel)),
    dd AS (SELECT disease, row_number() OVER (ORDER BY disease) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT disease FROM rel)),
    t AS (SELECT s.*, a, microbe, disease, microbe || CASE WHEN (length(microbe) + length(disease)) % 4 = 0 OR ((length(microbe) + length(disease)) % 3 = 0 AND a % 2 = 1) THEN '' ELSE ' is seen with ' || disease END AS answer
      FROM slots s, unnest(range(1, 7)) u(a), mm, dd WHERE mm.i = (slot * 7919 + (a - 1) // 2 * 104729) % mm.k AND dd.i = (slot * 15485863 + (a - 1) // 2 * 32452843) % dd.k)
    SELECT label, slot, CAST(a AS INTEGER) AS attempts, microbe, disease, least(3, greatest(n - 5, 0)) AS shots, CASE WHEN good THEN answer END AS text
    FROM (SELECT *, contains(lower(answer), lower(disease)) AS good, row_number() OVER (PARTITION BY label, slot ORDER BY good DESC, CASE WHEN good THEN a ELSE -a END) AS r FROM t) WHERE r = 1"""
)
def class_filling(spark, sf_dir):
    """Sentences for as many rows as each class lacks, told by examples from outside a held-out fold, in rounds over what is still open."""
    rows = table(spark, sf_dir, "part").where("p_partkey % 5 <> 3")
    text = F.concat("p_name", F.lit(" and "), "p_type")
    rel = rows.select(text.alias("text"), F.col("p_name").alias("microbe"), F.col("p_type").alias("disease"), F.expr(_UNEVEN).alias("label"))
    return W.fill_classes(rel, E.needed_to_balance(rel, "label", "positive"), W.stub_writer, shared_path(spark, "sentences"), shots=3)


@query("SELECT doc_id, text, doc_id % 5 AS fold FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 <> 3")
def augmentation_fold_intersection(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return A.fold_augmentations(d.where("doc_id % 2 = 0").select("doc_id", "text"), d.select("doc_id", (F.col("doc_id") % 5).alias("fold")), "doc_id", 3)


# ---- prompts and models -------------------------------------------------------------------------------------------------------


@query(f"WITH {_REL} SELECT id, text || ' [SEP] ' || microbe || '?' AS input, CASE label WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 ELSE 3 END AS class FROM rel")
def model_inputs(spark, sf_dir):
    return _relations(spark, sf_dir).select("id", T.model_input(F.col("text"), F.concat("microbe", F.lit("?"))).alias("input"), T.class_id(F.col("label")).alias("class"))


_SIM = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))"
_KNN = f"n AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, r.vec_id) AS ranking FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 QUALIFY ranking <= 3)"
_EXAMPLE = "CASE vec_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'relate' ELSE 'na' END"


@query(f"WITH {_KNN} SELECT query, 'system>Answer.|' || string_agg('user>Is it ' || neighbour || '?|assistant>' || replace({_EXAMPLE.replace('vec_id', 'neighbour')}, 'relate', 'na'), '|' ORDER BY ranking) AS chat FROM n GROUP BY query")
def few_shot_dialogue(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    examples = e.select("vec_id", F.concat(F.lit("Is it "), F.col("vec_id").cast("string"), F.lit("?")).alias("question"), F.expr(_EXAMPLE).alias("label"))
    m = T.few_shot(V.nearest(e.where("vec_id % 50 = 0"), e, 3), examples, "vec_id", 3, "Answer.")
    return m.select("query", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(">"), x["content"])), "|").alias("chat"))


_PROMPT = "text || ' What relation is there between ' || microbe || ' and ' || disease || '?'"
_MD5 = "['positive', 'negative', 'na'][CAST('0x' || substr(md5({0}), 1, 2) AS INTEGER) % 3 + 1]"


def _evaluated(spark, sf_dir):
    r = _relations(spark, sf_dir).withColumnRenamed("text", "evidence")
    return T.evaluate(r, M.scalar_model(M.stub_classifier), T.question(r), "id")


@query(f"WITH {_REL} SELECT id, {_PROMPT} AS prompt, {_MD5.format(_PROMPT)} AS answer, {_MD5.format(_PROMPT)} AS prediction, label FROM rel")
def evaluation_run(spark, sf_dir):
    return _evaluated(spark, sf_dir)


@query(f"WITH {_REL}, e AS (SELECT {_MD5.format(_PROMPT)} AS a, label, CASE WHEN id % 2 = 0 THEN label ELSE 'na' END AS other FROM rel WHERE label <> CASE WHEN id % 2 = 0 THEN 'positive' ELSE 'na' END) SELECT round(100 * avg(CASE WHEN a = label THEN CAST(1 AS DOUBLE) ELSE 0 END), 1) AS label, round(100 * avg(CASE WHEN a = other THEN CAST(1 AS DOUBLE) ELSE 0 END), 1) AS other FROM e")
def third_party_verification(spark, sf_dir):
    """Rows on which two sources disagree are put to a third one, whose answers are held against both."""
    asked = _evaluated(spark, sf_dir).withColumn("other", F.when(F.col("id") % 2 == 0, F.col("label")).otherwise("na"))
    wrong = asked.where(F.col("label") != F.when(F.col("id") % 2 == 0, "positive").otherwise("na"))
    return T.verified(wrong, ("positive", "negative", "na"), "label", "other")


@query(f"WITH {_REL} SELECT id, text || ' Is the relation ' || label || ' or na, or is there none?' AS three, text || ' Is the relation ' || label || ' or na?' AS two FROM rel")
def verification_prompts(spark, sf_dir):
    ask = lambda n: T.verification_prompt(F.col("text"), F.col("label"), F.lit("na"), n)
    return _relations(spark, sf_dir).select("id", ask(3).alias("three"), ask(2).alias("two"))


@query("SELECT conv_id, turn, '{\"inputs\":\"' || conv_id || '-' || turn || '\",\"parameters\":{\"temperature\":0.7,\"max_new_tokens\":20}}' AS body, CASE turn % 3 WHEN 2 THEN NULL ELSE 'answer ' || turn END AS answer FROM conversations")
def endpoint_codec(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    prompt = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    one = F.concat(F.lit('{"generated_text":"answer '), F.col("turn").cast("string"), F.lit('"}'))
    response = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("["), one, F.lit("]"))).when(F.col("turn") % 3 == 1, one).otherwise("no json")
    return c.select("conv_id", "turn", H.request(prompt, {"temperature": 0.7, "max_new_tokens": 20}).alias("body"), H.generated(response).alias("answer"))


@query("SELECT event_id, round(0.7 + CAST(0.01 AS DOUBLE) * greatest(event_id % 12 + 1 - 5, 0), 6) AS temperature FROM events")
def retry_temperature(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", H.temperature(F.col("event_id") % 12 + 1).alias("temperature"))


@query()
def insistent_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.insistent(H.stub_hesitant, ("positive", "negative", "na"))("text").alias("label"))


@query()
def definition_embeddings(spark, sf_dir):
    text = F.concat_ws(" is ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", M.embedding_model(M.stub_embedding, 50)(text).alias("embedding"))


def _marked(kind: str, open_: str, close: str, words: str) -> None:
    line = f"replace('{open_}', '{{role}}', role) || text || '{close}'".replace("\n", "' || chr(10) || '")
    tail = f"'{open_.replace('{role}', 'assistant')}'".replace("\n", "' || chr(10) || '")

    def run(spark, sf_dir):
        from .q_text import _chats

        return _chats(spark, sf_dir).select("conv_id", C.prompt_for(words, F.col("messages")).alias("prompt"))

    query(f"SELECT conv_id, string_agg({line}, '' ORDER BY turn) || {tail} AS prompt FROM conversations GROUP BY conv_id", f"chat_prompt_{kind}")(run)


_marked("llama3", "<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>", "llama3")
_marked("zephyr", "<|{role}|>\n", "</s>\n", "zephyr-7b")
_marked("stablelm", "<|{role}|>\n", "<|endoftext|>\n", "stablelm-zero")


# ---- reports and training -----------------------------------------------------------------------------------------------------

_ENSEMBLE = "SELECT doc_id, doc_id % 3 AS truth, CASE WHEN doc_id % 4 = 1 THEN -1 ELSE (doc_id * 7 // 5) % 3 END AS prediction FROM documents"


@query(f"SELECT truth, count(*) FILTER (prediction = 0) AS p_0, count(*) FILTER (prediction = 1) AS p_1, count(*) FILTER (prediction = 2) AS p_2 FROM ({_ENSEMBLE}) WHERE prediction <> -1 GROUP BY truth")
def ensemble_test(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select((k % 3).alias("truth"), F.when(k % 4 == 1, -1).otherwise(F.floor(k * 7 / 5) % 3).alias("prediction"))
    return E.confusion_matrix(T.chosen_only(rows, "prediction"), [0, 1, 2])


@query("SELECT lang AS model, round(sum(n_chars) / 1100, 6) AS ratio FROM documents GROUP BY lang")
def model_support_ratio(spark, sf_dir):
    return T.support_ratio(table(spark, sf_dir, "documents"), "lang", "n_chars").withColumnRenamed("lang", "model")


@query()
def epoch_training(spark, sf_dir):
    """Log of training on embeddings whether a label is even."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") % 2).alias("y"))
    rows = K.hash_split(e, ["vec_id"], {"train": 0.8, "validation": 0.2}, 0)
    _, log = T.train_epochs(rows, "x", "y", "split")
    return spark.createDataFrame([tuple(r.values()) for r in log], "epoch int, train_loss double, val_loss double, val_accuracy double")
