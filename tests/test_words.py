"""Words of tokens."""

import __spark_entry__ as entry


def test_words_stay_with_their_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "Ab cdef. Second one"), (2, "abcd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = entry.queries()["token_to_word"](spark, str(tmp_path))
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()
    assert ("abcd", 2) in {(r.text, r.prediction) for r in words.collect()}


def test_words_of_documents_with_one_number_are_told_together(spark, tmp_path):
    spark.createDataFrame([(1, "ab cd"), (1, "ef"), (None, "gh"), (None, "ij"), (2, "kl")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.seq, r.word, "".join(sorted(r.text))) for r in entry.queries()["token_to_word"](spark, str(tmp_path)).collect())
    assert got == [("1", 0, 1, "abef"), ("1", 0, 2, "cd"), ("2", 0, 1, "kl"), ("None", 0, 1, "ghij")]
