"""Inputs are made once however often they are read."""

from paperweave.operators import folds as K
from paperweave.operators import paths as P


def counted(spark, rows, schema):
    """A frame, and how many of its rows have been made so far."""
    made = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, schema).mapInArrow(passed, schema), made


def test_edges_of_a_path_are_made_once(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(5)]
    edges, made = counted(spark, rows, "a string, b string")
    assert [r.node for r in P.shortest_path(edges, "n0", "n4").orderBy("step").collect()] == [f"n{i}" for i in range(5)]
    assert made.value == len(rows)


def test_ends_of_negative_pairs_are_made_once(spark):
    rows = [(i, i * 7 % 50) for i in range(200)]
    pairs, made = counted(spark, rows, "a long, b long")
    got = [(r.a, r.b, r.strength) for r in K.negative_pairs(pairs, "a", "b").collect()]
    assert made.value == len(rows)
    assert len(got) == len(set(got)) == 200 and not {x[:2] for x in got} & set(rows) and {x[2] for x in got} == {0}
