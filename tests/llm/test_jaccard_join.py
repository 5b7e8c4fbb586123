import random
from fractions import Fraction

import numpy as np
import pytest

from paperweave.llm.jaccard_join import CELL, COARSE, FINE, SMALL, Similarity, _finer, alike_wide, jaccard_components, parities, set_key, signatures
from paperweave.llm.scratch import Scratch

from .common import ROWS, frame, lower, plain, rows, words


def brute(texts, k, least):
    sets = []
    for _, t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * least.denominator >= least.numerator * len(sets[i] | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    group = {}
    for i, (ident, _) in enumerate(texts):
        if ident is not None:
            group[top(i)] = min(group.get(top(i), ident), ident)
    return sorted(((ident, len(s), (group.get(top(i)) if s else ident)) for i, ((ident, _), s) in enumerate(zip(texts, sets, strict=True))), key=repr)


def made(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    out, base = [], []
    for i in range(n):
        if base and r.random() < 0.6:
            w = list(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                p = r.randrange(len(w))
                w[p : p + 1] = r.choice([[], [r.choice(vocabulary)], [w[p], r.choice(vocabulary)]])
                w = w or ["x"]
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 12, 30, 80, 200]))]
            if r.random() < 0.5:
                w = w + passage
        base.append(w)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("seed", "k", "least"), [(1, 3, Fraction(9, 10)), (2, 5, Fraction(4, 5)), (3, 1, Fraction(4, 5))])
def test_components_equal_brute_force(spark, seed, k, least):
    texts = made(seed)
    assert rows(jaccard_components(plain(spark, texts), k, least)) == brute(texts, k, least)


def test_awkward_rows(spark):
    texts = [(r[0], r[1]) for r in ROWS]
    assert rows(jaccard_components(frame(spark))) == brute(texts, 3, Fraction(9, 10))
    assert jaccard_components(frame(spark, [])).count() == 0


def test_chain_and_copies(spark):
    """A chain whose ends are unlike, with many copies of one link."""
    w = [f"t{i}" for i in range(200)]
    texts = [(i, " ".join(w[i * 4 : i * 4 + 120])) for i in range(18)] + [(100 + i, " ".join(w[:120])) for i in range(40)]
    assert rows(jaccard_components(plain(spark, texts), 3, Fraction(9, 10))) == brute(texts, 3, Fraction(9, 10))


@pytest.mark.parametrize("cell", [2, 5])
def test_fragments_of_many_sets_are_compared_cell_by_cell(spark, monkeypatch, cell):
    from paperweave.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "CELL", cell)
    texts = made(4, 60)
    assert rows(jaccard_components(plain(spark, texts), 3, Fraction(4, 5))) == brute(texts, 3, Fraction(4, 5))


def test_near_copies_are_compared_with_few_others(spark, monkeypatch):
    """A group of near copies: a pair or so for each set, not one for each cell that it is in."""
    from paperweave.llm import jaccard_join

    r, compared, links = random.Random(3), [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda pairs, *more: compared.append(pairs.count()) or links(pairs, *more))
    w = [f"t{i}" for i in range(300)]
    texts = []
    for i in range(150):
        x = list(w)
        for _ in range(r.choice((2, 4))):
            x[r.randrange(300)] = f"u{i}"
        texts.append((i, " ".join(x)))
    assert rows(jaccard_components(plain(spark, texts), 5, Fraction(4, 5))) == brute(texts, 5, Fraction(4, 5))
    assert 0 < sum(compared) < 2 * len(texts)


def test_unlike_variants_of_a_text_are_hardly_compared(spark, monkeypatch):
    """Variants that share cells and are all a little too unlike to link: their pairs, which grow with the square of the group, are not formed."""
    from paperweave.llm import jaccard_join

    r, compared, links = random.Random(8), [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda pairs, *more: compared.append(pairs.count()) or links(pairs, *more))
    w = [f"t{i}" for i in range(300)]
    texts = []
    for i in range(150):
        x = list(w)
        for p in r.sample(range(5, 295), 4):
            x[p] = f"u{i}"
        texts.append((i, " ".join(x)))
    texts.append((150, texts[7][1] + " and more"))
    assert rows(jaccard_components(plain(spark, texts), 5, Fraction(4, 5))) == brute(texts, 5, Fraction(4, 5))
    assert 0 < compared[-1] < len(texts) and sum(compared) < 4 * len(texts)


@pytest.mark.parametrize("least", [Fraction(9, 10), Fraction(4, 5)])
@pytest.mark.parametrize("most", [COARSE, FINE])
def test_sketches_differ_in_no_more_than_their_sets(least, most):
    """In every size, of sets of unlike sizes too; where nothing bounds a sketch's width, in nearly as many bits."""
    r, sim = np.random.default_rng(11), Similarity(least)
    for n in [1, 2, 9, 60, 127, 130, 300, 500, 1100, 9000]:
        for gone, more in [(0, 0), (1, 0), (0, n), (n // 8, n // 8), (n // 2, n // 9), (n, n)]:
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.r_[a[gone:], r.integers(0, 1 << 63, more, dtype=np.uint64)])
            x = alike_wide([parities(s, sim, most).tobytes() for s in (a, b)])
            apart, differ = int(np.bitwise_count(x[0] ^ x[1]).sum()), len(np.setxor1d(a, b))
            assert apart <= differ and (apart - differ) % 2 == 0
            if 60 <= n <= 500 and most == FINE and differ <= n // 3:
                assert apart > 0.85 * differ - 4


@pytest.mark.parametrize("least", [Fraction(9, 10), Fraction(4, 5)])
def test_similar_sets_share_the_fragments_they_need(least):
    """At the limit of what may differ, in every size: both sets' keys have at least the needs of both in common, in the larger's class."""
    r, sim = np.random.default_rng(5), Similarity(least)
    for n in [3, 8, 40, 100, 127, 128, 200, 300, 700, 1500]:
        for extra in {0, (sim.largest(n) - n) // 2, sim.largest(n) - n}:
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            swap = max(0, (sim.differ(n, n + extra) - extra) // 2)
            b = np.unique(np.r_[a[swap:], r.integers(0, 1 << 63, swap + extra, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
            assert sim.similar(n - swap, len(a) + len(b))
            (x, need_x), (y, need_y) = signatures(a, sim), signatures(b, sim)
            c = len(b).bit_length() - 1
            c += 32 if c < SMALL else 0
            x, need_x, y, need_y = x[x & 63 == c], need_x[x & 63 == c], y[y & 63 == c], need_y[y & 63 == c]
            assert len(x) and len(y) and len(np.intersect1d(x, y)) >= max(need_x[0], need_y[0])


def test_uneven_hashes_lose_no_link():
    """All n-grams in one fragment: sets at the limit of what may differ still share what they need."""
    r, sim = np.random.default_rng(7), Similarity(Fraction(9, 10))
    for n in (130, 400, 1000):
        a = np.unique(r.integers(0, 1 << 20, 2 * n, dtype=np.uint64))[:n]
        gone = sim.differ(n, n) // 2
        b = np.unique(np.r_[a[gone:], r.integers(1 << 20, 1 << 21, gone, dtype=np.uint64)])
        assert sim.similar(len(np.intersect1d(a, b)), len(a) + len(b))
        (x, need_x), (y, need_y) = signatures(a, sim), signatures(b, sim)
        c = len(b).bit_length() - 1 + 32
        x, need_x, y, need_y = x[x & 63 == c], need_x[x & 63 == c], y[y & 63 == c], need_y[y & 63 == c]
        assert len(np.intersect1d(x, y)) >= max(need_x[0], need_y[0]) > 1


def test_sets_are_told_by_both_keys():
    sets = [np.array(x, np.uint64) for x in ([1, 2], [1, 3], [2, 3], [1, 2, 3], [])]
    assert len({set_key(s)[0] for s in sets}) == len({set_key(s)[1] for s in sets}) == 5
    assert set_key(sets[0])[0] != set_key(sets[0])[1]


def test_a_fragment_of_many_unlike_sets_is_no_cell(spark):
    """Sets that share one fragment and little else meet few others; sets that share two more still meet."""
    n = 6000
    rest = lambda i: [7, *(1000 * (i // 2) + j for j in range(1, 4))]  # noqa: E731  pairs of sets have all in common
    kept = [(s, i, 50, b"", 9, p + 1, 3, max(0, p)) for i in range(n) for p, s in enumerate(rest(i))]
    kept = spark.createDataFrame(kept, "sig long, key long, n int, sizes binary, class int, place int, need int, extra int").where("extra <= 2")
    rows = kept.where("extra = 0").drop("extra").selectExpr("sig", "key", "n", "key AS label", "sizes", "class", "place", "need")
    assert rows.count() == n > CELL
    out = _finer(rows, kept, Scratch(spark))
    cells = [r["count"] for r in out.groupBy("sig").count().collect()]
    assert max(cells) == 2 and sum(c * c for c in cells) < 10 * n
    low = rows.selectExpr("sig", "key", "n", "label", "sizes", "class", "place", "1 AS need")
    assert _finer(low, kept, Scratch(spark)).where("sig = 7").count() == n


def test_links_through_documents_without_id(spark):
    w = [f"t{i}" for i in range(100)]
    texts = [(5, " ".join(w)), (None, " ".join(w[2:] + ["a", "b"])), (9, " ".join(w[4:] + ["a", "b", "c", "d"]))]
    assert rows(jaccard_components(plain(spark, texts))) == brute(texts, 3, Fraction(9, 10))


def test_bounds():
    sim = Similarity(Fraction(9, 10))
    assert sim.differ(100, 100) == 10 and sim.largest(9) == 10 and sim.largest(8) == 8
    assert sim.similar(90, 190) and not sim.similar(89, 189)


@pytest.mark.parametrize("at_once", [1, 1000])
def test_components_of_chains_and_stars(spark, at_once):
    from paperweave.llm.components import connected
    from paperweave.llm.scratch import Scratch

    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 20)] + [(110, 15), (300, 299)]
    got = connected(spark.createDataFrame(links, "a long, b long"), Scratch(spark), at_once)
    want = {x: 0 for x in [*range(21), *range(100, 120)]} | {299: 299, 300: 299}
    assert {r.node: r.label for r in got.collect()} == want
