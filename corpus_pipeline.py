"""From raw documents to a clean, mixed and sharded training corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All but the last
return the columns of documents. Rows keep all their columns; whatever a stage adds for itself has private names.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweave.llm.decontaminate import decontaminate
from paperweave.llm.frames import numbered, pick
from paperweave.llm.jaccard_join import jaccard_components
from paperweave.llm.mixing import count_words, sample
from paperweave.llm.scratch import Scratch
from paperweave.llm.sharding import shard_documents
from paperweave.llm.toxicity import THRESHOLD, score_rows, train

#: Near duplicates: five words and a similarity of 0.8.
NEAR_WORDS, NEAR_LEAST = 5, Fraction(4, 5)


def _place(names: list[str], name: str) -> str:
    return f"_c{names.index(name)}"


def _restored(wide: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``numbered`` alone, with the names they had."""
    return wide.select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``numbered`` with one more column, _row: a key of each row's own, which doc_id need not be. It is written, so that it stays."""
    wide, names = numbered(docs)
    return Scratch(docs.sparkSession).write("keyed", wide.withColumn("_row", F.monotonically_increasing_id())), names


def _texts(wide: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, text) for the operators, with the row's key as doc_id."""
    return wide.select(F.col("_row").alias("doc_id"), F.col(_place(names, "text")).alias("text"))


def _written(frame: DataFrame) -> DataFrame:
    """A written table that is joined by shuffling, whatever its size."""
    return Scratch(frame.sparkSession).write("written", frame).hint("merge")


def _without(wide: DataFrame, names: list[str], rows: DataFrame) -> DataFrame:
    """The rows whose key is not among rows (one column)."""
    gone = _written(rows.toDF("_gone"))
    return _restored(wide.join(gone, F.col("_row") == F.col("_gone"), "left_anti"), names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose restored text scores below the threshold; all rows where the labels teach nothing that tells texts apart.

    A row is judged by its text alone, whatever its doc_id: null and empty texts score as texts without any feature do, long ones are
    read whole, repeated rows go or stay together. Labels are joined by doc_id, null ones teach nothing. No documents give none.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.weights:
        return docs
    wide, names = numbered(docs)
    return _restored(score_rows(wide, model, _place(names, "text"), "_score").where(F.col("_score") < THRESHOLD), names)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id; rows that share it all stay. Rows without any words stay.

    Rows are told apart by a key of their own. A null doc_id is never the smallest, so such rows go where another of the group has an
    id, and all stay where none has. Texts of any length are compared whole; null and empty ones are nobody's duplicate.
    """
    wide, names = _keyed(docs)
    found = jaccard_components(_texts(wide, names), NEAR_WORDS, NEAR_LEAST).where(F.col("n_shingles") > 0)
    found = Scratch(spark).write("found", found.select(F.col("doc_id").alias("_of"), F.col("component_id").alias("_group")))
    several = _written(found.where("_of != _group").select("_group").distinct())
    members = found.join(several, "_group", "left_semi")
    members = wide.select("_row", F.col(_place(names, "doc_id")).cast("long").alias("_id")).join(members, F.col("_row") == F.col("_of"))
    members = Scratch(spark).write("members", members.select("_row", "_id", "_group"))
    smallest = _written(members.groupBy("_group").agg(F.min("_id").alias("_least")))
    return _without(wide, names, members.join(smallest, "_group").where(~F.col("_id").eqNullSafe(F.col("_least"))).select("_row"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs.

    Each row goes for its own text, whatever its doc_id; null and empty texts have no window and stay, texts of any length are read
    whole. An empty benchmark drops nothing.
    """
    wide, names = _keyed(docs)
    found = decontaminate(_texts(wide, names), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(wide, names, found.where("contaminated").select("doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target weight asks for, 0 to 3 times.

    A null source is one of its own. Null and empty texts have size 0 and are drawn at their source's rate, like others; a source of
    such texts alone gives none. Rows alike in doc_id, source and size share out what they are drawn in the order of their texts.
    """
    wide, names = numbered(docs)
    ident, source, text = (_place(names, c) for c in ("doc_id", "source", "text"))
    key = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("size"))
    drawn = sample(count_words(pick(docs, "doc_id", "source", "text")))
    # rows alike in id, source and size share out their draws by place
    drawn = drawn.groupBy(key.alias("_k")).agg(F.sort_array(F.collect_list("copies")).alias("_copies"))
    sized = count_words(wide.withColumn("_text", F.col(text)), "_text", "_size")
    sized = sized.withColumn("_k", F.xxhash64(F.col(ident), F.col(source), F.col("_size")))
    placed = sized.withColumn("_i", F.row_number().over(Window.partitionBy("_k").orderBy(text)))
    each = placed.join(drawn, "_k").withColumn("_n", F.get("_copies", F.col("_i") - 1)).where("_n > 0")
    return _restored(each.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))), names)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: 40 shards by a hierarchical weighted hash tree.

    doc_id decides, so rows that share one, or have none, share a shard and take a slot each. A null text has size 16 and CRC 0.
    """
    return shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: The first stage is a learnt score, which SQL can't express; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the folder that executors share; what a stage made besides goes."""
    scratch, last = Scratch(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with Scratch.passing():
            docs = scratch.write(name, stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
