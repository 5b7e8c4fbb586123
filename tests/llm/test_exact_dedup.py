import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from paperweave.llm.exact_dedup import PatriciaTrie, exact_dedup

from .common import ROWS, frame, lower, plain


def brute(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(lower(t), []).append(i)
    out, kept = [], set()
    for i, t in texts:
        ids = groups[lower(t)]
        best = max((x for x in ids if x is not None), default=None)
        stays = i == best and (lower(t), i) not in kept
        kept |= {(lower(t), i)} if stays else set()
        out.append((i, best, len(ids), stays, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    r = random.Random(5)
    base = [f"Text {i} " * r.randrange(1, 9) for i in range(25)] + ["É", "é", "", None]
    texts = [(i, (lambda t: t and r.choice([t, t.upper().replace("É", "É"), t.lower() if t.isascii() else t]))(r.choice(base))) for i in range(150)]
    assert sorted(map(tuple, exact_dedup(plain(spark, texts)).collect()), key=repr) == brute(texts)


def test_awkward_rows(spark):
    assert sorted(map(tuple, exact_dedup(frame(spark)).collect()), key=repr) == brute([(r[0], r[1]) for r in ROWS])
    assert exact_dedup(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=40), st.integers(200, 4000))
def test_trie_holds_what_a_map_holds(keys, limit):
    trie, want = PatriciaTrie(lambda a, b: a + b, limit), {}
    for k in keys:
        trie.insert(k, 1)
        want[k] = want.get(k, 0) + 1
    assert dict(trie.items()) == want


def test_trie_spills_below_its_limit():
    trie = PatriciaTrie(lambda a, b: max(a, b), 20_000)
    keys = [hashlib.sha256(str(i).encode()).digest() * 20 for i in range(300)]
    for i, k in enumerate(keys * 2):
        trie.insert(k, i)
        assert trie.bytes <= 45_000
    assert trie.spilled and dict(trie.items()) == {k: i + 300 for i, k in enumerate(keys)}
