"""Names against trying every place, overlaps against every pair, abbreviations by hand."""

import random

import pytest
from pyspark.sql import functions as F

from paperweave.functions import dictionary as D


def brute(text, names):
    out, spans, run = [], [], 0
    for m in D.TOKEN.finditer(text or ""):
        if m[0] in D.ENDS:
            run += 1
        else:
            spans.append((m[0], run, m.start(), m.end()))
    for name, kind in names:
        w = D.words_of(name)
        for i in range(len(spans) - len(w) + 1):
            part = spans[i : i + len(w)]
            if w and [p[0] for p in part] == w and part[0][1] == part[-1][1]:
                out.append((name, kind, i, part[0][2], part[-1][3]))
    return out


@pytest.mark.parametrize("block", [1000, 4])
def test_names_are_found(spark, block):
    r = random.Random(1)
    words = ["a", "b", "ab", "é", "c"]
    names = list({(" ".join(r.choice(words) for _ in range(r.randrange(1, 5))), r.choice(["x", "y"])) for _ in range(40)}) + [("", "x"), (None, "y")]
    texts = [(i, "".join(r.choice(words) + r.choice([" ", " ", "  ", ", ", ". ", "\n", " ("]) for _ in range(r.randrange(60)))) for i in range(40)] + [(None, "a b"), (50, None), (51, "")]
    got = D.find_names(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame(names, "name string, kind string"), block).collect()
    want = [(i, *f) for i, t in texts for f in brute(t, [n for n in names if n[0]])]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 100


def test_overlaps(spark):
    r = random.Random(2)
    rows = [(i % 3, f"n{j}", r.choice("db"), j, s := r.randrange(900), s + r.randrange(1, 300)) for i in range(3) for j in range(40)]
    got = D.without_overlaps(spark.createDataFrame(rows, "id long, name string, kind string, first int, start int, end int"), "id", "d").collect()

    def loses(a, b):
        return a[0] == b[0] and a[2] != b[2] and max(a[4], b[4]) < min(a[5], b[5]) and (a[5] - a[4] < b[5] - b[4] or (a[5] - a[4] == b[5] - b[4] and a[2] == "d"))

    assert sorted(map(tuple, got)) == sorted(a for a in rows if not any(loses(a, b) for b in rows))


@pytest.mark.parametrize(
    "text, want",
    [
        ("aortic stenosis (AS) in CASES of BASEL, AS and AS-like", "aortic stenosis (aortic stenosis) in CASES of BASEL, aortic stenosis and AS-like"),
        ("the microbial dysbiosis index (MBI) rose; MBI fell", None),
        ("a body mass index of children (BMI) and BMI", None),
        ("body mass index (BMI). BMIs differ", "body mass index (body mass index). body mass indexs differ"),
        ("short chain fatty acids (SCFAs): SCFA, SCFAs", "short chain fatty acids (short chain fatty acids): short chain fatty acids, short chain fatty acids"),
        ("interleukin 6 (IL6) and IL60", "interleukin 6 (interleukin 6) and IL60"),
        ("call (555) now", "call (555) now"),
        ("nothing fits (XQZ) XQZ", "nothing fits (XQZ) XQZ"),
        ("(AB) AB", "(AB) AB"),
        ("", ""),
        (None, None),
    ],
)
def test_abbreviations(text, want):
    got = D.expanded(text)
    if want is None and text:
        short = text[text.index("(") + 1 : text.index(")")]
        if short == "MBI":
            assert got == "the microbial dysbiosis index (microbial dysbiosis index) rose; microbial dysbiosis index fell"
        else:
            assert got == "a body mass index of children (body mass index of children) and body mass index of children"
    else:
        assert got == want


def test_a_long_form_lies_in_one_line():
    text = "as thanan.khedf\nWe saw the other kind (TNF) rise; TNF fell"
    assert D.expanded(text) == text
    assert D.expanded("x\ntumour necrosis factor\n(TNF); TNF") == "x\ntumour necrosis factor\n(tumour necrosis factor); tumour necrosis factor"


def test_the_first_character_begins_a_word():
    assert D.long_form("AB", "cat b") is None
    assert D.long_form("HIV", "human immunodeficiency virus") == "human immunodeficiency virus"
    assert D.long_form("A", "") is None


def test_column(spark):
    rows = [("Tumour Necrosis Factor (TNF) and TNF",), (None,), ("plain",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(D.expand_abbreviations(F.col("t"))).collect()]
    assert got == ["Tumour Necrosis Factor (Tumour Necrosis Factor) and Tumour Necrosis Factor", None, "plain"]
