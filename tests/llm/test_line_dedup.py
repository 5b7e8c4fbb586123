import random

from paperweave.llm.line_dedup import LineRuns, dedup_lines
from paperweave.llm.scratch import Scratch

from .common import ROWS, frame, lower, plain


def key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def brute(texts, min_docs=5):
    held = {}
    for n, (ident, t) in enumerate(texts):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(ident)
    common = {k: max(i for i in ids if i is not None) for k, ids in held.items() if len(ids) >= min_docs and any(i is not None for i in ids)}
    out = []
    for ident, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in common or (ident is not None and ident >= common[key(x)])]
        out.append((ident, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    r = random.Random(3)
    long = [f"Boilerplate number {i} that is long enough to be counted É" for i in range(6)]
    texts = []
    for i in range(80):
        lines = [r.choice(["  ", "\t", ""]) + (x.upper().replace("É", "É") if r.random() < 0.3 else x) + r.choice(["", " ", "\r"]) for x in r.sample(long, r.randrange(4))]
        lines += [f"own line {i}", "short", ""] * r.randrange(2) + [long[0]] * r.randrange(2)
        texts.append((i, "\n".join(lines)))
    got = sorted(map(tuple, dedup_lines(plain(spark, texts)).collect()), key=repr)
    assert got == brute(texts)


def test_awkward_rows(spark):
    texts = [(r[0], r[1]) for r in ROWS] + [(20 + i, "x" * 45 + "\n" + str(i)) for i in range(5)]
    got = sorted(map(tuple, dedup_lines(plain(spark, texts)).collect()), key=repr)
    assert got == brute(texts)
    assert dedup_lines(frame(spark)).count() == len(ROWS)
    assert dedup_lines(frame(spark, [])).count() == 0


def test_runs_hold_every_line_once_after_compaction(spark):
    runs = LineRuns(Scratch(spark), fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(b * 10 + i, i % 3, b % 2) for i in range(6)], "doc_id long, h1 long, h2 long"))
    got = sorted(map(tuple, runs.lines().select("h1", "h2", "docs", "last").collect()))
    want = {}
    for b in range(5):
        for i in range(6):
            n, last = want.get((i % 3, b % 2), (0, -1))
            want[i % 3, b % 2] = n + 1, max(last, b * 10 + i)
    assert got == sorted((*k, *v) for k, v in want.items())
    assert sum(len(level) for level in runs.levels) < 5


def test_a_line_is_in_one_run_only(spark):
    """What a batch's anti-join leaves out counts as a holder; without the join lines would stand in several runs."""
    runs = LineRuns(Scratch(spark), fanout=10, buckets=3)
    for b in range(4):
        runs.add(spark.createDataFrame([(b * 100 + i, i, 0) for i in range(b, b + 6)], "doc_id long, h1 long, h2 long"))
    held = [sorted(r.h1 for r in run.collect()) for run in runs.levels[0]]
    assert held == [[0, 1, 2, 3, 4, 5], [6], [7], [8]]
    assert [sorted(r.h1 for r in t.collect()) for t in runs.holders] == [[1, 2, 3, 4, 5], [2, 3, 4, 5, 6], [3, 4, 5, 6, 7]]
    plan = runs._unseen(runs.levels[0][1], runs.levels[0][0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted((r.h1, r.docs, r.last) for r in runs.lines().collect())[5] == (5, 4, 305)


def test_result_depends_on_the_anti_join(spark, monkeypatch):
    texts = [(i, "x" * 45) for i in range(12)]
    want = brute(texts)
    assert sorted(map(tuple, dedup_lines(plain(spark, texts)).collect()), key=repr) == want
    monkeypatch.setattr(LineRuns, "_fresh", lambda self, rows: rows)
    assert sorted(map(tuple, dedup_lines(plain(spark, texts)).collect()), key=repr) != want


def test_text_with_many_dropped_lines(spark):
    lines = [f"line {i} " + "y" * 40 for i in range(3000)]
    texts = [(i, "\n".join(lines[i:])) for i in range(6)]
    assert sorted(map(tuple, dedup_lines(plain(spark, texts)).collect()), key=repr) == brute(texts)
