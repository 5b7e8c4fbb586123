"""Text preparation: sentences, windows, slices, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\x0b\x0c\n"


def protect_decimals(c: Column) -> Column:
    """1.5 becomes 1_5, so that its point does not end a sentence."""
    return F.regexp_replace(c, r"([0-9]+)\.([0-9]+)", "$1_$2")


def drop_short_parentheses(c: Column) -> Column:
    """Parentheses around one to three characters go."""
    return F.regexp_replace(c, r"\([^)]{1,3}\)", "")


def span_of(text: Column, part: Column) -> Column:
    """Start and inclusive end of the first occurrence, from 0; null where there is none."""
    at = F.position(part, text)
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at + F.char_length(part) - 2).alias("end")))


def sentences(text: Column) -> Column:
    """Lower-cased sentences of the whole text, in order.

    Decimals are protected first; then . ! ? * and line ends cut. Sentences are stripped, those of one character or none go, and
    - / | become blanks.
    """
    parts = F.split(protect_decimals(F.lower(text)), r"[.!?*\n]", -1)
    kept = F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(BLANKS))), lambda s: F.char_length(s) > 1)
    return F.transform(kept, lambda s: F.translate(s, "-/|", "   "))


def explode_sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, sentence), seq from 0; a row without sentences keeps one placeholder, seq null and sentence empty."""
    each = docs.select(key, F.posexplode_outer(sentences(F.col(text))).alias("seq", "sentence"))
    return each.withColumn("sentence", F.coalesce("sentence", F.lit("")))


def word_windows(sentence: Column, limit: int = 100, stride: int = 70) -> Column:
    """A sentence of more than ``limit`` words as overlapping windows of that many, the last ones maybe shorter; others whole."""
    words = F.split(sentence, " ", -1)
    n = F.size(words)
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(stride)), lambda i: F.array_join(F.slice(words, i + 1, F.lit(limit)), " "))
    return F.when(n > limit, cut).otherwise(F.array(sentence))


def within_length(sentence: Column, words: int = 500, chars: int = 5000) -> Column:
    return (F.size(F.split(sentence, " ", -1)) < words) & (F.char_length(sentence) < chars)


def clean_words(c: Column) -> Column:
    """Words between blanks, without ( ) . , ;."""
    return F.split(F.translate(c, "().,;", ""), " ", -1)


ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_to_text(html: Column) -> Column:
    """Lower-cased visible text: scripts, styles, comments and tags become blanks, entities characters, runs of blanks one."""
    c = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(F.lower(c), r"[ \t\r\n]+", " "), F.lit(" "))


def paper_body(text: Column) -> Column:
    """From the first 'abstract' (or the start) to the last 'references'; without the latter the last character is cut off."""
    first = F.position(F.lit("abstract"), text)
    start = F.when(first > 0, first).otherwise(1)
    back = F.position(F.reverse(F.lit("references")), F.reverse(text))
    n = F.char_length(text)
    end = F.when(back > 0, n - back - F.lit(8)).otherwise(n)
    return F.substring(text, start, F.greatest(end - start, F.lit(0)))


def strip_quotes(c: Column) -> Column:
    return F.translate(c, "'\"", "")


def strip_quotes_all(parts: Column) -> Column:
    return F.transform(parts, strip_quotes)


def enumeration_free(c: Column) -> Column:
    """Without the first marker such as '3.' that no word follows, wherever it occurs, and stripped."""
    mark = F.regexp_extract(c, r"([0-9]+\.)(?:[^0-9A-Za-z_]|$)", 1)
    return F.btrim(F.when(mark != "", F.replace(c, mark, F.lit(""))).otherwise(c), F.lit(BLANKS))
