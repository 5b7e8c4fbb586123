"""Semantics that decide results, on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from paperweave.functions import chat as C
from paperweave.functions import entities as N
from paperweave.functions import text as X
from paperweave.operators import compare as O
from paperweave.operators import dashboards as D
from paperweave.operators import evaluation as E
from paperweave.operators import folds as K
from paperweave.operators import lookups as L
from paperweave.operators import paths as P
from paperweave.operators import predictions as R
from paperweave.operators import strength as S
from paperweave.operators import upserts as U
from paperweave.operators import vectors as V
from paperweave.operators import votes as W


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]))
    return row.select(column.alias("x")).first().x


EVIDENCE = "cui_microbe long, cui_disease long, rel_type string, impact_factor double, quartile string"


def test_strength_defaults_and_signs(spark):
    rows = [(1, 1, "positive", 10.0, "Q1"), (1, 1, "negative", None, "Q2"), (2, 1, "positive", None, None), (2, 1, "negative", 100.0, "NA")]
    got = {r.cui_microbe: r for r in S.edge_strengths(spark.createDataFrame(rows, EVIDENCE)).collect()}
    assert (got[1].strength_raw, got[1].strength_if) == (0, pytest.approx(1 - 3.5))
    assert got[1].strength_ifq == pytest.approx(round(1 - 0.24303804868629444, 3))
    assert (got[2].strength_raw, got[2].strength_if) == (0, pytest.approx(1.5))
    assert got[2].strength_ifq == pytest.approx(round(0.24303804868629444 - 1.6989700043360187, 3))


def test_factor_of_zero_is_not_skipped(spark):
    got = S.edge_strengths(spark.createDataFrame([(1, 1, "positive", 0.0, "Q1")], EVIDENCE)).first()
    assert got.strength_if == float("-inf")


def test_threshold_is_lopsided(spark):
    rows = spark.createDataFrame([(x,) for x in (-2.0, -1.0, 0.0, 1.0, 2.0)], "m double")
    kinds = lambda t: {r.m: r.kind for r in S.split_by_threshold(rows, "m", t).collect()}
    assert kinds(0) == {-2.0: "negative", -1.0: "negative", 1.0: "positive", 2.0: "positive"}
    assert kinds(1) == {-2.0: "negative", 1.0: "positive", 2.0: "positive"}


def test_zero_strength_is_positive_in_lists_and_absent_from_signed_edges(spark):
    s = spark.createDataFrame([(1, 7, 0, 0.0, 0.0), (1, 8, -1, 0.0, 0.0)], "cui_microbe long, cui_disease long, strength_raw long, strength_if double, strength_ifq double")
    names = spark.createDataFrame([(7, "a"), (8, "b")], "cui long, name string")
    assert [r.name for r in L.node_relations(s, "cui_microbe", 1, True, "cui_disease", names).collect()] == ["a"]
    parents = spark.createDataFrame([], "child string, parent string")
    assert [r.type for r in S.sign_split_edges(s, parents).collect()] == ["STRENGTH_NEGATIVE"]


def test_sentences(spark):
    assert one(spark, X.sentences(F.col("t")), t="PH of 7.5 is-low! x. A*b|c\nno end") == ["ph of 7_5 is low", "b c", "no end"]
    assert one(spark, X.sentences(F.col("t")), t=" . \n ") == []


@pytest.mark.parametrize(("n", "sizes"), [(100, [100]), (101, [100, 31]), (170, [100, 100, 30]), (171, [100, 100, 31])])
def test_windows(spark, n, sizes):
    got = one(spark, X.word_windows(F.col("t")), t=" ".join(str(i) for i in range(n)))
    assert [len(x.split()) for x in got] == sizes and {w for x in got for w in x.split()} == {str(i) for i in range(n)}


def test_paper_body_loses_its_last_character_without_references(spark):
    assert one(spark, X.paper_body(F.col("t")), t="head abstract body") == "abstract bod"
    assert one(spark, X.paper_body(F.col("t")), t="abstract a references b references c") == "abstract a references b "


def test_spans_and_overlaps(spark):
    assert tuple(one(spark, X.span_of(F.col("t"), F.lit("bc")), t="abcd")) == (1, 2)
    assert one(spark, X.span_of(F.col("t"), F.lit("zz")), t="abcd") is None
    rows = [("gut flora disease", ["flora disease"], ["flora"]), ("ab cd", ["ab"], ["cd"]), ("same", ["same"], ["same"]), ("abc", ["ab"], ["bc"]), ("x", ["x"], ["missing"])]
    got = N.resolve_overlaps(spark.createDataFrame(rows, "sentence string, diseases array<string>, bacterias array<string>")).collect()
    assert {r.sentence for r in got} == {"ab cd", "abc"}


def test_votes(spark):
    t = lambda v: one(spark, W.winner(W.tally(F.col("v"))), v=v)
    assert t(["na"] * 4 + ["positive"] * 3) == "na" and t(["na"] * 3 + ["positive"] * 3 + ["negative"]) == "positive"
    assert one(spark, W.certain(W.tally(F.col("v"))), v=["negative"] * 7) == "negative"
    assert one(spark, W.certain(W.tally(F.col("v"))), v=["negative"] * 6 + ["na"]) == "na"
    assert str(one(spark, W.vote_entropy(W.tally(F.col("v"))), v=["na"] * 7)) == "0.0"
    assert one(spark, W.final_selection(F.col("v")), v=["positive", "na", "negative"]) == "na"
    assert one(spark, W.final_selection(F.col("v")), v=["negative", "positive"]) == "negative"
    assert one(spark, W.ensemble_vote(F.col("v")), v=[0, 1, 2]) == 2 and one(spark, W.ensemble_vote(F.col("v")), v=[0, 1, 3]) == 3


def test_paper_vote_ties_go_to_the_first_seen(spark):
    rows = [(1, "negative", 1), (1, "positive", 2), (1, "na", 0), (2, "positive", 5), (2, "positive", 6), (2, "negative", 1)]
    got = {r.paper: (r.relation, r.evidence) for r in W.paper_votes(spark.createDataFrame(rows, "paper long, rel_type string, seq long"), ["paper"], ["seq"], F.col("seq").cast("string")).collect()}
    assert got == {1: ("negative", "1"), 2: ("positive", "5 ||| 6")}


def test_first_writer_wins(spark):
    schema = "cui_microbe long, cui_disease long, pmid long, rel_type string, seq long"
    new = spark.createDataFrame([(1, 1, 9, "positive", 2), (1, 1, 9, "negative", 1), (None, 1, 9, "negative", 1)], schema)
    old = spark.createDataFrame([(1, 1, 8, "positive", 1)], schema)
    got = U.upsert_evidence(old, new, ["seq"])
    assert sorted((r.pmid, r.rel_type) for r in got.collect()) == [(8, "positive"), (9, "negative")]
    assert U.upsert_evidence(got, new, ["seq"]).count() == 2


def test_parents_have_no_loops_and_one_direction(spark):
    rows = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("a", "a", 3), ("b", "c", 4)], "child string, parent string, s long")
    assert sorted(map(tuple, U.upsert_parents(rows.limit(0).drop("s"), rows, ["s"]).collect())) == [("a", "b"), ("b", "c")]


def test_walks_end_in_cycles_and_loops(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("x", "z")], "child string, parent string")
    got = [tuple(r) for r in P.lineages(p).collect()]
    assert sorted(x for x in got if x[0] == "a") == [("a", "b", 1, "b"), ("a", "b", 2, "c")]
    assert sorted(x for x in got if x[0] == "x") == [("x", "y", 1, "y"), ("x", "z", 1, "z")]
    assert {tuple(r) for r in P.two_hop_relatives(p).collect()} >= {("y", "z"), ("a", "c")}


def test_paths(spark):
    e = P.undirected(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("q", "r")], "a string, b string"))
    assert {r.node: r.hops for r in P.distances(e, spark.createDataFrame([("a",)], "node string")).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 3}
    assert [r.node for r in P.shortest_path(e, "a", "e").orderBy("step").collect()] == ["a", "b", "c", "e"]
    assert P.shortest_path(e, "a", "q").count() == 0
    paths = {}
    for r in P.alternative_paths(e, "a", "c").orderBy("path_no", "step").collect():
        paths.setdefault(r.path_no, []).append(r.node)
    assert paths[1] == ["a", "b", "c"] and paths[2] == ["a", "d", "c"] and len(paths) == 2


def test_predictions_lose_all_copies_of_a_pair(spark):
    rows = [(1, "Microbe", 2, "Disease", "P", 0.9), (1, "Microbe", 2, "Disease", "P", 0.8), (1, "Microbe", 3, "Disease", "P", 0.5), (4, "Disease", 5, "Microbe", "P", 0.9), (6, "Microbe", 7, "Disease", "P", 0.4)]
    got = R.clean_predictions(spark.createDataFrame(rows, "src long, src_label string, dst long, dst_label string, type string, pred_strength double"))
    assert [(r.src, r.dst) for r in got.collect()] == [(1, 3)]


@pytest.mark.parametrize("n", [7, 12, 23, 26, 100])
def test_chunks(spark, n):
    rows = spark.range(n)
    size = n // 5
    chunks = [list(range(i, min(i + size, n))) for i in range(0, n, size)]
    got = {r.id: r.fold for r in K.chunk_folds(rows, ["id"], 5, False).collect()}
    assert got == {i: f for f, c in enumerate(chunks) for i in c}
    if len(chunks) > 5:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    got = {r.id: r.fold for r in K.chunk_folds(rows, ["id"], 5).collect()}
    assert got == {i: f for f, c in enumerate(chunks) for i in c}


def test_negative_pairs_are_new(spark):
    pairs = spark.createDataFrame([(i, i % 4) for i in range(40)], "a long, b long")
    got = K.negative_pairs(pairs, "a", "b", 0.5).collect()
    assert len(got) == 20 and not {(r.a, r.b) for r in got} & {(i, i % 4) for i in range(40)}


def test_report_without_predictions_or_truth(spark):
    got = {r["class"]: r for r in E.classification_report(spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b")], "truth string, prediction string")).collect()}
    assert (got["a"].precision, got["a"].recall, got["b"].recall, got["c"].precision) == (1.0, 0.5, 0.0, 0.0)
    assert got["accuracy"].f1 == pytest.approx(1 / 3, abs=1e-6) and got["macro avg"].support == 3


def test_duplicates_of_other_sources(spark):
    rows = [(1, 1, "positive", 1, "x"), (1, 1, "negative", 2, "y"), (1, 1, "negative", 3, "z"), (1, None, "positive", 4, "n"), (2, 2, "positive", 5, "p"), (2, 2, "negative", 6, "q")]
    got = {r.b_cui: (r.relation, r.note) for r in O.resolve_duplicates(spark.createDataFrame(rows, "b_cui long, d_cui long, relation string, seq long, note string")).collect()}
    assert got == {1: ("negative", "z"), 2: ("negative", "q")}


def test_coincidence(spark):
    f = lambda s, r: one(spark, O.coincidence(F.col("s"), F.col("r")), s=s, r=r)
    assert (f(0, "positive"), f(2, "positive"), f(2, "na"), f(-1, "positive")) == ("unsure", "coincide", "wrong", "wrong")
    assert one(spark, O.coincidence_weighted(F.col("s"), F.col("r")), s=2.0, r="na") is None


def test_answers_and_prompts(spark):
    assert one(spark, C.answer_label(F.col("t")), t="positive, not negative") == "negative"
    assert one(spark, C.answer_label(F.col("t")), t="Positive") == "na"
    assert one(spark, C.concluded_label(F.col("t")), t="Positive. Therefore, the correct answer is 'na'.") == "na"
    assert one(spark, C.concluded_label(F.col("t")), t="therefore the correct relation: none") == ""
    assert one(spark, C.concluded_label(F.col("t")), t="positive") is None
    assert one(spark, C.first_line(F.col("t")), t="\n  yes \nno") == "yes"
    m = F.array(C.message("system", F.lit("s")), C.message("user", F.lit("u")), C.message("assistant", F.lit("a")))
    assert one(spark, C.prompt_for("claude-x", m)) == "Human: s\nu \nAssistant: a \nAssistant:"
    assert one(spark, C.prompt_for("other", m)) == "s \nu \nCompletion: a \nCompletion: "
    assert one(spark, C.prompt_for("phi-2", m)) == "Output: s \nInstruct: u \nOutput: a \nOutput:"
    assert one(spark, C.instruct_prompt(m)) == "[INST] s\nu [/INST]a</s>"


def test_years_are_filled(spark):
    got = D.fill_years(spark.createDataFrame([(2000, 1), (2003, 2)], "year int, n long"), "n").orderBy("year").collect()
    assert [(r.year, r.n) for r in got] == [(2000, 1), (2001, 0), (2002, 0), (2003, 2)]
    assert D.fill_years(spark.createDataFrame([], "year int, n long"), "n").count() == 0


def test_block_search_is_bounded_and_leaves_k_a_task():
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    draw = np.random.default_rng(1)
    v, ids = draw.normal(size=(12000, 8)), np.arange(12000)
    v[6000:6400] = v[:400]  # copies, so that ties go by key
    batch = lambda at: pa.record_batch([pa.array(ids[at]), pa.array(list(v[at])), pa.array(ids[at] % 3)], ["vec_id", "embedding", "label"])
    for label in (None, "label"):
        search = V._block_search(pa.Table.from_batches([batch(slice(0, 2000))]), 5, "vec_id", "embedding", label, True)
        pieces = [batch(slice(0, 6000)), batch(slice(6000, 12000))]
        tracemalloc.start()
        got = pa.Table.from_batches(search(iter(pieces)))
        assert tracemalloc.get_traced_memory()[1] < 100 << 20  # 2000 queries times 6000 rows alone are 96 MB, and there were four of them
        tracemalloc.stop()
        assert got.num_rows == 2000 * 5
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        for query in (0, 7, 399, 1999):
            s = u @ u[query]
            want = [i for i in np.lexsort((ids, -s.round(12))) if i != query and (not label or i % 3 == query % 3)][:5]
            rows = got.filter(pc.equal(got["query"], query)).to_pylist()
            assert [r["neighbour"] for r in sorted(rows, key=lambda r: (-round(r["similarity"], 12), r["neighbour"]))] == want


def test_nearest_settles_ties_by_key(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)] + [(9, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = V.nearest(rows.where("vec_id = 3"), rows.repartition(3), 3).orderBy("ranking").collect()
    assert [r.neighbour for r in got] == [0, 1, 2]


def test_mmr_prefers_difference(spark):
    rows = [(1, 10, 0.9, [1.0, 0.1]), (1, 11, 0.89, [1.0, 0.11]), (1, 12, 0.5, [0.0, 1.0])]
    got = V.mmr(spark.createDataFrame(rows, "query long, neighbour long, similarity double, embedding array<double>"), 2).collect()
    assert [r.neighbour for r in got] == [10, 12]
