"""Places within groups, one of which may be almost all rows, and lists in order."""

from collections import defaultdict

from pyspark.sql import functions as F

from paperweave.operators import dashboards as D
from paperweave.operators import folds as K


def test_places_within_groups_of_any_size(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 100 == 0, F.lit(None)).when(F.col("id") % 100 == 1, F.lit("small")).otherwise("hot").alias("g"), (F.col("id") * 7919 % 101).alias("o"))
    want, sizes = {}, defaultdict(list)
    for r in rows.collect():
        sizes[r.g].append((r.o, r.id))
    for g, all_ in sizes.items():
        want.update({i: (g, at, len(all_)) for at, (_, i) in enumerate(sorted(all_))})
    got = K.placed_within(rows, "g", ["o", "id"])
    assert sorted(got.columns) == ["_i", "_n", "g", "id", "o"]
    assert {r.id: (r.g, r._i, r._n) for r in got.collect()} == want
    assert K.placed_within(rows.limit(0), "g", ["id"]).count() == 0


def test_linked_nodes_are_sorted(spark):
    nodes = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "c")], "cui long, name string")
    strengths = spark.createDataFrame([(3,), (1,), (2,)], "m long")
    assert [r.cui for r in D.linked_nodes(strengths, "m", nodes).collect()] == [2, 1, 3]
