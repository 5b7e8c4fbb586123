"""Periodic runs against trying every period, and the digests against a plain collapse."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from paperweave.llm import periodic_runs as P

from .common import ROWS, frame, plain, words


def brute(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i - s + q), q)
            i = max(i, s + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def row_of(doc_id, text, repeated):
    w = words(text)
    if repeated and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def sample(r):
    w = [r.randrange(r.choice([1, 2, 3, 6, 30])) for _ in range(r.randrange(r.choice([8, 60, 250])))]
    for _ in range(r.randrange(4)):
        if w:
            i, p = r.randrange(len(w)), r.randrange(1, max(2, len(w) // 4))
            for j in range(i, min(len(w), i + r.randrange(9 * p))):
                w[j] = w[i + (j - i) % p]
    return w


@pytest.mark.parametrize("seed", range(8))
def test_every_run_is_found(seed):
    r = random.Random(seed)
    for _ in range(150):
        w = sample(r)
        assert P.runs_of_words(w) == brute(w)


def test_known_runs():
    assert P.runs_of_words([1] * 5) == [] and P.runs_of_words([1] * 6) == [(0, 6, 1)]
    assert P.runs_of_words([1, 2] * 4) == [(0, 8, 2)] and P.runs_of_words([1, 2] * 3 + [1]) == []
    assert P.runs_of_words([9] + [1, 2, 3] * 4 + [1, 8]) == [(1, 13, 3)]
    # a run within the period of another one
    assert P.runs_of_words(([1] * 6 + [2]) * 4) == brute(([1] * 6 + [2]) * 4)


def test_long_runs_take_few_steps():
    assert P.runs_of_words([1] * 200_000) == [(0, 200_000, 1)]
    r = random.Random(1)
    w = [r.randrange(10**9) for _ in range(20_000)] * 5
    assert P.runs_of_words([-1, *w, -2]) == [(1, 100_000, 20_000)]


def test_texts_are_refined_together(spark):
    r = random.Random(3)
    texts = [(i, " \t".join(f"w{x}" for x in sample(r))) for i in range(300)]
    got = P.periodic_runs(plain(spark, texts).repartition(3), repeated=True).collect()
    assert sorted(map(tuple, got)) == sorted(row_of(i, t, True) for i, t in texts)
    # what repeats in one text and the next is no run
    got = P.periodic_runs(plain(spark, [(i, "a b") for i in range(20)]).coalesce(1)).collect()
    assert all(g.n_runs == 0 for g in got)


@pytest.mark.parametrize("repeated", [False, True])
def test_rows(spark, repeated):
    got = P.periodic_runs(frame(spark), repeated).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((row_of(r[0], r[1], repeated) for r in ROWS), key=repr)
    assert P.periodic_runs(frame(spark, []), repeated).count() == 0


def test_texts_and_runs_come_too(spark):
    got = P.periodic_runs(plain(spark, [(1, "x  a b a b\na b a b y"), (2, "  one   two ")]), texts=True).orderBy("doc_id").collect()
    assert [(r.start, r.length, r.period) for r in got[0].runs] == [(1, 8, 2)]
    assert [r.collapsed for r in got] == ["x a b y", "one two"]


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(P, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    import pyarrow as pa

    assert P._same_words(np.frombuffer(b"aab", np.uint8), np.array([0, 1]), np.array([1, 2]), np.zeros(2, int))
    assert not P._same_words(np.frombuffer(b"aab", np.uint8), np.array([0, 2]), np.array([1, 3]), np.zeros(2, int))
    assert not P._same_words(np.frombuffer(b"aab", np.uint8), np.array([0, 1]), np.array([1, 3]), np.zeros(2, int))
    text = "a b a b a b a b c d e f g"
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([5], pa.int64()), "text": [text]})
    out = list(P.scan([batch], False))[0].to_pylist()[0]
    assert (out["start"], out["length"], out["period"]) == (0, 8, 2)
