import math
import random

import pytest

from paperweave.llm.mixing import HASH_PARTS, SIZE_STEPS, mix_sources, source_targets

from .common import ROWS, Int, frame, uniform, words, xxhash64


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, total, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    left = total
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_the_rule_carried_out(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 10, 500, 10_000]) for i in range(9)} | {None: 50, "É": 7}
    got = {x.source: x.target for x in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_takings_come_near_the_targets(spark):
    r = random.Random(9)
    docs = [(i, r.choice(["a", "b", "c", "d", None]), " ".join("w" for _ in range(r.choice([1, 5, 40, 300])))) for i in range(4000)]
    frame_ = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = mix_sources(frame_).collect()
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want, by = targets(sizes), {i: s for i, s, _ in docs}
    taken = dict.fromkeys(sizes, 0)
    for x in got:
        assert x.source_size == sizes[by[x.doc_id]] and x.target == pytest.approx(want[by[x.doc_id]]) and x.taken in [x["size"] * c for c in range(4)]
        taken[by[x.doc_id]] += x.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(600, 0.02 * want[s]), (s, taken[s], want[s])
    again = mix_sources(frame_.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_awkward_rows(spark):
    got = mix_sources(frame(spark)).collect()
    assert sorted(((x.doc_id, x["size"]) for x in got), key=repr) == sorted(((x[0], len(words(x[1]))) for x in ROWS), key=repr)
    assert mix_sources(frame(spark, [])).count() == 0


def drawn(docs, seed):
    """Copies of (doc_id, source, size), source by source: prefix sums of the expected copies, moved by the source's offset."""
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    target, out = targets(sizes), []

    def place(d):
        h = xxhash64(Int(seed), d[0], d[2])
        h -= (h >> 63) << 64
        return math.floor(math.log(d[2] + 1) / math.log(2) * SIZE_STEPS) * HASH_PARTS + h % HASH_PARTS, h, d[0]

    for s in sizes:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        u = uniform(Int(seed), "offset", s)
        for i, (ident, _, n) in enumerate(sorted((d for d in docs if d[1] == s), key=place), 1):
            out.append((ident, n, min(3, math.floor(rate * i + u) - math.floor(rate * (i - 1) + u)) * n))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 3])
def test_takings_equal_the_sampling_carried_out(spark, seed):
    r = random.Random(seed)
    docs = [(i, r.choice(["a", "b", "é", None]), r.choice([0, 2, 9, 40, 41, 300])) for i in range(500)]
    table = spark.createDataFrame([(i, s, "w " * n) for i, s, n in docs], "doc_id long, source string, text string")
    assert sorted((x.doc_id, x["size"], x.taken) for x in mix_sources(table, seed).collect()) == drawn(docs, seed)


def test_no_source_misses_its_target_by_more_than_two_of_its_largest_documents(spark):
    r = random.Random(12)
    docs = [(i, f"s{i % 20}", int(r.paretovariate(0.9) * 20) % 6000) for i in range(1000)]
    table = spark.createDataFrame([(i, s, "w " * n) for i, s, n in docs], "doc_id long, source string, text string")
    want, taken = {}, {}
    by = {i: s for i, s, _ in docs}
    for x in mix_sources(table).collect():
        want[by[x.doc_id]] = x.target
        taken[by[x.doc_id]] = taken.get(by[x.doc_id], 0) + x.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 2 * max(n for _, t, n in docs if t == s), (s, taken[s], want[s])
