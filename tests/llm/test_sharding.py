import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from paperweave.llm.sharding import even_tree, grown, place, shard_documents

from .common import ROWS, Int, frame, uniform


def test_slots_are_gapless_and_growth_moves_into_the_new_shard_only(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    got = shard_documents(docs).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 20000 and set(sizes) == set(range(40))
    assert max(sizes.values()) < 1.25 * 500 and min(sizes.values()) > 0.75 * 500
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    moved = [r for r in got if r.grown_shard != r.shard]
    assert moved and all(r.grown_shard == 40 for r in moved) and 0.6 * 20000 / 41 < len(moved) < 1.4 * 20000 / 41
    assert all(r.law == "key" for r in got)


def test_weights_and_movement_between_trees(spark):
    rows = spark.range(30000)
    tree = [[[1.0, 1.0], [2.0]], [[4.0]]]
    n = Counter(r.s for r in place(rows, "id", "s", tree).collect())
    for s, w in enumerate((1, 1, 2, 4)):
        assert abs(n[s] / 30000 - w / 8) < 0.02
    heavier = [[[1.0, 1.0], [2.0]], [[8.0]]]
    both = place(place(rows, "id", "s", tree), "id", "t", heavier).where("s <> t").select("t").distinct().collect()
    assert [r.t for r in both] == [3]


def test_rows(spark):
    got = shard_documents(frame(spark)).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ROWS), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert shard_documents(frame(spark, [])).count() == 0


def test_trees():
    assert sum(len(k) for r in even_tree(40) for k in r) == 40 and sum(len(k) for r in even_tree(3) for k in r) == 3
    assert grown(even_tree(40))[:-1] == even_tree(40)


def descended(key, tree, seed=0):
    """The shard of a key, drawn level by level."""

    def drawn(weights, *path):
        return min(range(len(weights)), key=lambda j: (-math.log(uniform(key, *path, Int(j))) / weights[j], j))

    region = drawn([sum(map(sum, r)) for r in tree], Int(seed), "region")
    rack = drawn([sum(k) for k in tree[region]], Int(seed), "rack", Int(region))
    shard = drawn(tree[region][rack], Int(seed), "shard", Int(region), Int(rack))
    return sum(len(k) for r in tree[:region] for k in r) + sum(map(len, tree[region][:rack])) + shard


def test_shards_equal_the_draws_carried_out(spark):
    ids = [*range(300), -5, 2**62, None]
    docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    tree = even_tree(40)
    got = {r.doc_id: (r.shard, r.grown_shard) for r in shard_documents(docs).collect()}
    assert got == {i: (descended(i, tree), descended(i, grown(tree))) for i in ids}
    uneven = [[[1.0, 3.0], [2.0]], [[4.0], [0.5, 0.5, 0.5]]]
    assert all(r.s == descended(r.id, uneven, 7) for r in place(spark.range(500), "id", "s", uneven, 7).collect())
