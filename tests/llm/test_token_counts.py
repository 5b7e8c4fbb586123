import random
import unicodedata

import pytest
from tokenizers import Tokenizer

from paperweave.llm import token_counts as C
from paperweave.llm.queries import vocabulary

from .common import ROWS, frame


@pytest.fixture(scope="module")
def encoder():
    return C.Encoder(vocabulary())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def count(library, text):
    return len(library.encode(text, add_special_tokens=False))


def test_both_encoders_agree_on_every_plain_character(encoder, library):
    around = ["a{0}b", " {0} ", "{0}{0}1", "1{0}", "x {0}", "{0} x", "'{0}s", "  {0}  {0}", "\n{0}\t", "don't{0}ll"]
    for cp in range(0x280):
        for form in around:
            t = form.format(chr(cp))
            assert encoder.count_plain(t) == count(library, t), (hex(cp), form)
    assert max(chr(0x27F).encode()) <= C.PLAIN_BYTE < max(chr(0x280).encode()) + 1


def test_special_strings(encoder, library):
    for t in ("a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext", " <|endoftext|> x"):
        assert encoder.count_plain(t) == count(library, t)


@pytest.mark.parametrize("chunk", [40, 200, 1000])
def test_spliced_counts_equal_whole_ones(encoder, library, chunk):
    r = random.Random(chunk)
    pieces = ["the river", " ", "  ", "\n\n", "é", "naïve", "12345", "'s", "don't", "???", "🙂", "漢字かな", "<|endoftext|>", "x" * 90, "=" * 70, "\t", "ab cd ef", unicodedata.normalize("NFD", "é")]
    for _ in range(12):
        text = "".join(r.choice(pieces) + r.choice([" ", " ", ""]) for _ in range(400))
        assert C.count_long(text, encoder.spans, encoder.marks, chunk, 16) == count(library, text)


def test_text_without_any_stable_place(encoder, library):
    for text in ("a" * 3000, "漢" * 700, " " * 900 + "x"):
        assert C.count_long(text, encoder.spans, encoder.marks, 100, 10) == count(library, text)


def test_rows(spark, library):
    got = sorted(map(tuple, C.count_tokens(frame(spark), vocabulary(), chunk=500, overlap=20).collect()), key=repr)
    want = []
    for r in ROWS:
        n = count(library, r[1] or "")
        want.append((r[0], len((r[1] or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    assert C.count_tokens(frame(spark, []), vocabulary()).count() == 0


def test_plain_spans_are_the_librarys(encoder):
    for t in ("Don't stop, 12 naïve cafés <|endoftext|> ß\n\n  end", "plain ascii only", "é", ""):
        assert [tuple(x) for x in encoder.plain_spans(t).tolist()] == encoder.spans(t)


def test_stable_places_split_anew_whatever_stands_before(library):
    """At a stable place the count of the whole is the sum of the parts' counts."""
    r = random.Random(9)
    pieces = ["river", "12", " ", "  ", "\n", "\t ", "é", "'s", "'", "!?", "…", "漢", "。", "ー", "١٢", "Ⅷ", "²", "\u00a0", "\u3000", "🙂", "\x1f", "\x85", "ʼ", "̈", "<|endoftext|>", "don't", "'ll"]
    for _ in range(300):
        text = "".join(r.choice(pieces) for _ in range(12))
        stable = C.stable_cuts(text, ("<|endoftext|>",))
        for i in range(1, len(text)):
            if stable(i):
                assert count(library, text[:i]) + count(library, text[i:]) == count(library, text), (text, i)


@pytest.mark.parametrize("text", ["漢字かな交じり文。" * 2000, "ไทย" * 6000, "a" * 20_000, "=" * 20_000, "ab1" * 7000])
def test_long_texts_without_blanks(encoder, library, text):
    sent = []

    def spans(t):
        sent.append(len(t))
        return encoder.spans(t)

    assert C.count_long(text, spans, encoder.marks) == count(library, text)
    assert sum(sent) <= 3 * len(text)
