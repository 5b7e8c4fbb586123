import json

import pytest

from paperweave.operators import generation as W

EXAMPLES = "text string, microbe string, disease string, label string"


def rows(n, label):
    return [(f"{label} text {i}", f"m{i % 7}", f"d{i % 5}", label) for i in range(n)]


def needed(spark, **lack):
    return spark.createDataFrame(list(lack.items()), "class string, needed long")


def told(prompt, warmth):
    """Both names, and the prompt itself for the test to read."""
    last = json.loads(prompt)[-1]["content"]
    microbe, rest = last.split("Microbe: ", 1)[1].split(". Disease: ", 1)
    return f"{microbe} {rest.split('. Relation', 1)[0]} {warmth} {prompt}"


def silent(prompt, warmth):
    return None if "Microbe: m1" in json.loads(prompt)[-1]["content"] else told(prompt, warmth)


def broken(prompt, warmth):
    raise AssertionError("asked")


def test_as_many_rows_as_each_class_lacks(spark, tmp_path):
    examples = spark.createDataFrame(rows(30, "positive") + rows(12, "negative") + rows(6, "na"), EXAMPLES)
    got = W.fill_classes(examples, needed(spark, positive=0, negative=18, na=5000, other=2), told, str(tmp_path / "r"), shots=3).collect()
    assert {c: sum(r.label == c for r in got) for c in ("positive", "negative", "na", "other")} == {"positive": 0, "negative": 18, "na": 5000, "other": 2}
    assert len({(r.label, r.slot) for r in got}) == len(got)
    for r in got:
        turns = json.loads(r.text.split(" ", 3)[3])
        assert r.attempts == 1 and r.text.startswith(f"{r.microbe} {r.disease} 0.8 ")
        assert r.shots == {"negative": 3, "na": 1, "other": 0}[r.label] == (len(turns) - 2) / 2
        shown = [t["content"] for t in turns if t["role"] == "assistant"]
        assert len(set(shown)) == r.shots and all(s.startswith(f"{r.label} text") for s in shown)


def test_only_open_rows_are_asked_again_and_a_run_goes_on(spark, tmp_path):
    examples = spark.createDataFrame(rows(30, "a"), EXAMPLES)
    folder = str(tmp_path / "r")
    got = W.fill_classes(examples, needed(spark, a=40), silent, folder, shots=2, attempts=4).collect()
    assert len(got) == 40
    for r in got:
        tried = [W.STEPS["microbe"][0] * r.slot + (a - 1) // 2 * W.STEPS["microbe"][1] for a in range(1, 5)]
        good = next((a for a, x in enumerate(tried, 1) if x % 7 != 1), None)
        assert (r.attempts, r.text is None) == ((good, False) if good else (4, True))
        if good:
            assert f"m{tried[good - 1] % 7}" == r.microbe
    again = spark.read.parquet(f"{folder}/attempt-002")
    assert again.count() == sum((7919 * s) % 7 == 1 for s in range(40))  # those whose first answer was void
    assert "must name" not in str(again.where("text IS NOT NULL").collect())
    # all attempts are there, so nobody is asked
    assert sorted(W.fill_classes(examples, needed(spark, a=40), broken, folder, shots=2, attempts=4).collect(), key=str) == sorted(got, key=str)
    # an attempt that was not finished is made anew
    (tmp_path / "r" / "attempt-003" / "_SUCCESS").unlink()
    assert sorted(W.fill_classes(examples, needed(spark, a=40), silent, folder, shots=2, attempts=4).collect(), key=str) == sorted(got, key=str)


@pytest.mark.parametrize("given", [[], [(None, "m", None, "a"), ("t", None, None, None)]])
def test_nothing_to_draw_from(spark, tmp_path, given):
    got = W.fill_classes(spark.createDataFrame(given, EXAMPLES), needed(spark, a=3, b=-1), told, str(tmp_path / "r"), attempts=2).collect()
    assert [(r.label, r.text, r.attempts, r.shots) for r in got] == [("a", None, 2, 0)] * 3


def test_temperature_rises_after_five_attempts():
    assert [W.heat(a) for a in (1, 5, 6, 8)] == [0.8, 0.8, 0.81, 0.83]
