import hashlib
import random
import re

import pytest

from paperweave.llm.decontaminate import decontaminate

from .common import ROWS, frame, lower, plain

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts, items):
    b = [(i, WORD.findall(lower(t))) for i, t in items]
    windows = {}
    for i, w in b:
        for p in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[p : p + 10]), set()).add(str(i))
    out = []
    for ident, t in texts:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for win, names in windows.items():
            n = len(win)
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) == win:
                    hit.update(range(p, p + n))
                    found |= names
        out.append((ident, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def made(seed):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(v) for _ in range(r.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(30)] + [(99, "the " * 14), (7, None), (3, "again an item")]
    texts = []
    for i in range(60):
        parts = [" ".join(r.choice(v) for _ in range(r.choice([0, 5, 30])))]
        if r.random() < 0.7:
            w = (r.choice(items)[1] or "").split()
            parts.append(", ".join(w[r.choice([0, 0, 1]) : len(w) - r.choice([0, 0, 1])]).upper())
        parts.append(r.choice(["", "the the the " * 6, "Tail."]))
        texts.append((i, " ".join(parts)))
    return texts, items


@pytest.mark.parametrize(("seed", "block"), [(1, 2_000_000), (2, 40)])
def test_equals_brute_force(spark, seed, block):
    texts, items = made(seed)
    got = decontaminate(plain(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_words=block).drop("items")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(texts, items)


def test_awkward_rows(spark):
    items = [(1, "this is it"), (2, "ÄÖ ü"), (None, "single")]
    got = decontaminate(frame(spark), spark.createDataFrame(items, "item_id long, text string")).drop("items")
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(r[0], r[1]) for r in ROWS], items[:2])
    none = decontaminate(frame(spark), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(ROWS)
    assert decontaminate(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_no_more_than_a_block_is_held(monkeypatch, spark):
    """A benchmark of many blocks is read item by item, and only one block is probed for at a time."""
    from paperweave.llm import decontaminate as D

    texts, items = made(3)
    seen, probes = [], D.probes
    monkeypatch.setattr(D, "probes", lambda block, *a: seen.append(len(block.words.hashes)) or probes(block, *a))
    given = iter(items)
    first = next(D.item_blocks(given, 10, 30))
    assert 30 <= len(first.words.hashes) < 30 + 25 and next(given, None) is not None
    got = decontaminate(plain(spark, texts[:20]), spark.createDataFrame(items, "item_id long, text string"), block_words=60).drop("items")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(texts[:20], items)
    assert len(seen) > 2 and max(seen) < 60 + 25


def test_windows_whose_hashes_collide_are_told_apart(monkeypatch):
    """With a word's length for its hash, only the comparison of bytes can be right; words longer than a step of it included."""
    import numpy as np

    from paperweave.llm import decontaminate as D

    monkeypatch.setattr(D, "word_hashes", lambda data, starts, ends: (ends - starts).astype(D.U))
    monkeypatch.setattr(D, "COMPARED", 7)
    texts, items = made(4)
    items += [(200, "x" * 50), (201, "x" * 49 + "y"), (202, "mmm nnn")]
    texts += [(100, "a " + "X" * 50 + " b"), (101, "nnn mmm nnn nn")]
    block = next(D.item_blocks(items, 10, 1 << 30))
    rarity = {}
    for k in sorted(set(np.minimum(block.size, 5).tolist())):
        known = np.unique(D._grams(block.words.hashes, k)[0])
        rarity[k] = known, np.zeros(len(known), np.int64)
    probe = D.probes(block, rarity, 5)
    for ident, text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        w, rows = D.words_of(raw, np.array([0, len(raw)]))
        start, win = D.window_hits(w, np.array([0, len(w.hashes)]), rows, probe)
        hit = {p for s, n in zip(start.tolist(), block.size[win].tolist(), strict=True) for p in range(s, s + n)}
        assert (len(hit), len({str(block.ids[i]) for i in block.item[win].tolist()})) == brute([(ident, text)], items)[0][2:4]
