from collections import Counter

import pytest

import corpus_pipeline as P
from paperweave.llm.jaccard_join import jaccard_components

from .common import ROWS, frame
from .test_decontaminate import brute as hits
from .test_jaccard_join import brute as components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "this is it"), (2, "naïve")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame(spark).write.parquet(f"{d}/documents.parquet")
    return d


def test_stages_keep_columns_and_take_awkward_rows(spark, folder):
    docs = frame(spark)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema == docs.schema
        assert stage(spark, frame(spark, []), folder).count() == 0
    assert P.STAGES[-1][1](spark, docs, folder).count() == len(ROWS)
    assert "shard" in P.run(spark, folder).columns


def test_near_duplicates_leave_one_of_each_group(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = sorted(r.doc_id for r in P.keep_one_of_near_duplicates(spark, docs, folder).select("doc_id").collect())
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = components(texts, P.NEAR_WORDS, P.NEAR_LEAST)
    assert kept == sorted(i for i, n, c in want if n == 0 or i == c)
    assert jaccard_components(docs, P.NEAR_WORDS, P.NEAR_LEAST).count() == len(texts)


def test_contaminated_rows_go(spark, folder):
    left = {r.doc_id for r in P.drop_contaminated(spark, frame(spark).where("doc_id IS NOT NULL"), folder).collect()}
    bad = {r[0] for r in hits([(r[0], r[1]) for r in ROWS if r[0] is not None], [(1, "this is it"), (2, "naïve")]) if r[-1]}
    assert bad and left == {r[0] for r in ROWS if r[0] is not None} - bad


def test_mixture_is_what_the_operator_says(spark, sf):
    from paperweave.llm.mixing import mix_sources

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = Counter(r.doc_id for r in P.mix(spark, docs, sf).select("doc_id").collect())
    assert n == Counter({r.doc_id: r.copies for r in mix_sources(docs).collect() if r.copies})
