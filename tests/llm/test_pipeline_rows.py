"""Every stage on rows with null, repeated and clashing ids, against plain versions: a row goes for what it says itself and stays otherwise."""

from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from paperweave.llm.sharding import even_tree
from paperweave.llm.toxicity import THRESHOLD, Scorer, train

from .common import words
from .test_decontaminate import brute as hits
from .test_jaccard_join import brute as components
from .test_mixing import targets
from .test_sharding import descended

LONG = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(60))
DOCS = [(None, "here is the leak now"), (None, "clean words"), (1, "a leak again"), (1, "other clean words"), (2, LONG), (3, LONG + " z"), (3, OTHER), (None, LONG), (None, None), (4, ""), (None, OTHER + " t")]


@pytest.fixture()
def corpus(spark, tmp_path):
    spark.createDataFrame([(1, "leak")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.createDataFrame(DOCS, "doc_id long, text string"), str(tmp_path)


def left(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_pipeline_drops_contaminated_rows_alone(spark, corpus):
    assert left(P.drop_contaminated(spark, *corpus)) == sorted((r for r in DOCS if "leak" not in (r[1] or "")), key=repr)


def test_pipeline_drops_near_duplicate_rows_alone(spark, corpus):
    gone = [(3, LONG + " z"), (None, LONG), (None, OTHER + " t")]
    assert left(P.keep_one_of_near_duplicates(spark, *corpus)) == sorted((r for r in DOCS if r not in gone), key=repr)


def test_pipeline_finds_nothing_toxic_without_labels(spark, corpus):
    assert left(P.drop_toxic(spark, *corpus)) == sorted(DOCS, key=repr)


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


BAD = [(None, "idiot and moron here"), (None, "a quiet river"), (1, "you idiot moron"), (1, "the quiet garden"), (2, None), (2, ""), (None, "idiot and moron here")]


@pytest.fixture()
def taught(spark, tmp_path):
    rows = [(100 + i, "the idiot moron said" if i % 5 == 0 else f"the {chr(97 + i % 26)}{chr(97 + i // 26)}q") for i in range(90)]
    spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.createDataFrame(rows + BAD, "doc_id long, text string"), str(tmp_path), rows + BAD


def test_toxic_rows_go_by_their_own_score(spark, taught):
    docs, folder, rows = taught
    scorer = Scorer(train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    want = Counter(r for r in rows if scorer.score(r[1]) < THRESHOLD)
    assert rows_of(P.drop_toxic(spark, docs, folder)) == want
    assert {r for r in BAD if "idiot" not in (r[1] or "")} <= set(want) and not any("idiot" in (r[1] or "") for r in want)


def test_contaminated_rows_of_any_id(spark, corpus):
    docs, folder = corpus
    gone = {r[0] for r in hits([(i, t) for i, (_, t) in enumerate(DOCS)], [(1, "leak")]) if r[-1]}
    assert rows_of(P.drop_contaminated(spark, docs, folder)) == Counter(r for i, r in enumerate(DOCS) if i not in gone)


def test_near_duplicates_of_any_id(spark, corpus):
    docs, folder = corpus
    group = {i: c for i, n, c in components([(i, t) for i, (_, t) in enumerate(DOCS)], P.NEAR_WORDS, Fraction(4, 5)) if n}
    least = {}
    for i, c in group.items():
        if DOCS[i][0] is not None:
            least[c] = min(least.get(c, DOCS[i][0]), DOCS[i][0])
    size = Counter(group.values())
    want = [r for i, r in enumerate(DOCS) if i not in group or size[group[i]] == 1 or (r[0] == least.get(group[i]))]
    assert rows_of(P.keep_one_of_near_duplicates(spark, docs, folder)) == Counter(want)


def test_mixture_repeats_rows_of_any_id(spark, corpus):
    rows = [(i, s, t) for (i, t), s in zip(DOCS * 3, ["a", "b", None] * len(DOCS), strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = rows_of(P.mix(spark, docs, corpus[1]))
    assert set(got) <= set(rows) and all(n <= 3 * Counter(rows)[r] for r, n in got.items())
    sizes, taken = {}, {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    for (_, s, t), n in got.items():
        taken[s] = taken.get(s, 0) + n * len(words(t))
    assert all(abs(taken.get(s, 0) - x) <= 2 * 61 for s, x in targets(sizes).items())


def test_shards_of_any_id(spark, corpus):
    got = P.shard(spark, *corpus).collect()
    assert Counter((r.doc_id, r["size"], r.shard) for r in got) == Counter((i, len((t or "").encode()) + 16, descended(i, even_tree(40))) for i, t in DOCS)


def test_stages_on_clashing_columns(spark, corpus):
    """Columns that stages might add for themselves pass through unharmed."""
    docs, folder = corpus
    extra = [F.lit("a").alias("source"), F.lit("r").alias("_row"), F.lit(1).alias("_gone"), F.lit(True).alias("contaminated"), F.lit(2).alias("_n"), F.lit("other").alias("TEXT")]
    wide = docs.select("doc_id", "text", *extra)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns and {tuple(r[2:]) for r in out.collect()} == {("a", "r", 1, True, 2, "other")}


def test_run_leaves_only_its_last_table(spark, corpus, tmp_path, monkeypatch):
    from paperweave.llm import scratch

    docs, folder = corpus
    docs.withColumn("source", F.lit("a")).write.parquet(f"{folder}/documents.parquet")
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(scratch, "shared_folder", lambda spark: str(shared))
    assert P.run(spark, folder).count() > 0
    left = [p for p in shared.glob("*/*")]
    assert [p.name.rstrip("0123456789") for p in left] == ["source_mixing-"]
