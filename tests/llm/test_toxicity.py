import random

import numpy as np
import pytest

from paperweave.llm import toxicity as T

from .common import ROWS, frame


def corpus(n=400, seed=1):
    r = random.Random(seed)
    v = ["stone", "river", "quiet", "walker", "garden", "the", "and", "with", "morning", "stupor", "idol"]
    bad = ["idiot", "moron", "stupid"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [r.choice(v) for _ in range(40)] + (r.sample(bad, 2) if toxic else [])
        r.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows_are_told_apart(spark, tables):
    got = T.score_toxicity(*tables).collect()
    wrong = [r for r in got if r.predicted != int(r.doc_id % 5 == 0)]
    assert len(got) == 400 and not wrong
    assert all(r.held_out == T.held_out(r.doc_id) for r in got) and any(r.held_out for r in got)


def test_disguised_words_score_like_plain_ones(spark, tables):
    model = T.train(*tables)
    scorer = T.Scorer(model)
    plain = scorer.score("the quiet river idiot moron")
    assert plain > 0.3 > scorer.score("the quiet river garden")
    for x in ("the quiet river 1d10t m0r0n", "the quiet river i d i o t m o r o n", "the quiet river i.d.i.o.t m-o-r-o-n", "the quiet river idiiiiot morooon", "the quiet river IDIOT, Moron!"):
        assert scorer.score(x) == pytest.approx(plain, abs=0.25) and scorer.score(x) > 0.3, x


def test_viterbi_takes_the_only_path_of_plain_words(spark, tables):
    model = T.language_model(T.letter_counts(tables[0]))
    for w in ("stone", "ölfarbe", "walker"):
        assert T.viterbi(w, model) == w
    counts = T.letter_counts(tables[0])
    assert counts.sum() > sum(len(d[1]) for d in corpus()[0])


def test_awkward_rows(spark, tables):
    labels = tables[1]
    got = T.score_toxicity(frame(spark), labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert T.score_toxicity(frame(spark, []), labels).count() == 0
    assert T.score_toxicity(frame(spark), labels.limit(0)).count() == len(ROWS)


def test_logistic_fit_separates():
    w, b = T.fit_logistic([(1, [0]), (1, [0, 1]), (0, [1]), (0, [])] * 20, 2)
    assert w[0] > 2 and b < 0 and abs(w[1]) < w[0] and np.isfinite(w).all()


def cheapest(observed, model):
    """Every path through the lattice, tried one by one."""
    best = None

    def walk(i, a, b, cost, out):
        nonlocal best
        if i == len(observed):
            cost += model[a, b, 0]
            if best is None or cost < best[0] - 1e-12:
                best = cost, {"".join(out)}
            elif abs(cost - best[0]) <= 1e-12:
                best[1].add("".join(out))
            return
        for e, extra in T.emissions(observed[i], observed[i - 1] if i else ""):
            if e:
                k = 0 if e == " " else T.letter_class(e)
                walk(i + 1, b, k, cost + extra + model[a, b, k], [*out, e])
            else:
                walk(i + 1, a, b, cost + extra, out)

    walk(0, 0, 0, 0.0, [])
    return best[1]


def test_viterbi_equals_trying_every_path(tables):
    model = T.language_model(T.letter_counts(tables[0]))
    r = random.Random(4)
    for _ in range(150):
        text = "".join(r.choice("stoneidm1034!@$*. ooé") for _ in range(r.randrange(1, 9)))
        assert T.viterbi(text, model) in cheapest(text, model), text


def test_long_disguise_is_one_word(tables):
    """A disguised word is found wherever it stands in a token of any length."""
    restorer = T.Restorer(T.language_model(T.letter_counts(tables[0])))
    for before in range(55, 70):
        assert "idiot" in restorer.words("garden" * (before // 6) + "." * (before % 6) + "-" + "1d10t" + "-river")
    assert "idiot" in " ".join(restorer.restore(" ".join("river" * 12 + "x") + " i d i o t").split())


def test_logistic_fit_is_the_minimum():
    """No step in any direction makes the penalised loss smaller."""
    r = random.Random(6)
    rows = [(int(r.random() < 0.4), sorted(r.sample(range(4), r.randrange(4)))) for _ in range(60)]
    w, b = T.fit_logistic(rows, 4)

    def loss(v):
        z = [v[4] + sum(v[i] for i in ids) for _, ids in rows]
        return sum(np.log1p(np.exp(x)) - y * x for x, (y, _) in zip(z, rows, strict=True)) + 0.15 * sum(x * x for x in v[:4])

    best = [*w, b]
    for i in range(5):
        for step in (-0.05, 0.05):
            near = list(best)
            near[i] += step
            assert loss(near) >= loss(best) - 1e-6


@pytest.mark.parametrize("settle", [1, 7, 64])
def test_settling_paths_changes_nothing(tables, settle):
    model = T.language_model(T.letter_counts(tables[0]))
    r = random.Random(settle)
    for text in ("".join(r.choice("stoneidm1034!@$*. ooé") for _ in range(400)), " ".join(r.choice("stoneidm10") for _ in range(400)), "1" * 300, "i d 1 0 t " * 60):
        assert T.viterbi(text, model, settle) == T.viterbi(text, model, 10**9)


def test_paths_held_do_not_grow_with_the_text(tables):
    model, held = T.language_model(T.letter_counts(tables[0])), []

    def settled(states, out, real=T._settled):
        left = real(states, out)
        held.append(max(len(T._emitted(path)) for _, path in left.values()))
        return left

    old, T._settled = T._settled, settled
    try:
        T.viterbi(" ".join("idiotmoronstupid1d10t" * 300), model)
    finally:
        T._settled = old
    assert len(held) > 20 and max(held) < 256


def test_repeated_ids_teach_once(spark, monkeypatch):
    """Rows that share a doc_id teach one of their texts, so no more rows than fit_rows come to the driver, whatever repeats."""
    met, fit = [], T.fit_logistic
    monkeypatch.setattr(T, "fit_logistic", lambda rows, n: met.append(len(rows)) or fit(rows, n))
    docs = spark.createDataFrame([(i % 80, f"bad{i % 2} words number{i}") for i in range(320)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    for most in (40, 100):
        T.train(docs, labels, most)
    assert len(met) == 2 and met[0] == 40 and met[1] < 80
