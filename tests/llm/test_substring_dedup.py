import random
from collections import Counter

import pytest

from paperweave.llm.substring_dedup import remove_repeats

from .common import ROWS, frame, plain, words


def brute(texts, window):
    held = Counter()
    split = [words(t) for _, t in texts]
    for w in split:
        for p in range(len(w) - window + 1):
            held[tuple(w[p : p + window])] += 1
    out = []
    for (ident, _), w in zip(texts, split, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if held[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        out.append((ident, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "window"), [(1, 35), (2, 10), (3, 7)])
def test_equals_brute_force(spark, seed, window):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(50)]
    passages = [[r.choice(v) for _ in range(r.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(6)]
    texts = []
    for i in range(70):
        w = []
        for _ in range(r.randrange(4)):
            w += [r.choice(v) for _ in range(r.randrange(60))] + r.choice(passages)
        texts.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    texts += [(100, "a " * 60), (101, "a " * (window - 1)), (102, texts[0][1]), (103, texts[0][1]), (104, "b c " * window)]
    assert sorted(map(tuple, remove_repeats(plain(spark, texts), window).collect()), key=repr) == brute(texts, window)


def test_awkward_rows(spark):
    texts = [(r[0], r[1]) for r in ROWS]
    assert sorted(map(tuple, remove_repeats(frame(spark)).collect()), key=repr) == brute(texts, 35)
    assert remove_repeats(frame(spark, [])).count() == 0
