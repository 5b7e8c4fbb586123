"""Names of several words found in texts by an automaton over words.

A dictionary is dealt into blocks of bounded size by a hash of its names. A block becomes one automaton: a trie of words with a fallback
from each state to the longest suffix that is a state too, so a text is read once whatever the names are and all of them that end
at a word are known there. Names do not go on across the end of a sentence.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names in a block at most; one block at a time is on the driver and in the tasks.
BLOCK = 50_000
#: Words, and the characters that end a sentence; other signs and blanks stand between words.
PATTERN = r"[^\x20\x09-\x0D().,;!?*]+|[.!?*\n]"
TOKEN = re.compile(PATTERN)
ENDS = frozenset(".!?*\n")


def words_of(text: str) -> list[str]:
    return [t for t in TOKEN.findall(text or "") if t not in ENDS]


class Automaton:
    """All names (tuples of words) that end at each word of a sequence."""

    def __init__(self, names: list[tuple[str, ...]]):
        self.next: list[dict[str, int]] = [{}]
        self.found: list[list[int]] = [[]]
        self.size = [len(n) for n in names]
        for i, name in enumerate(names):
            at = 0
            for w in name:
                if w not in self.next[at]:
                    self.next[at][w] = len(self.next)
                    self.next.append({})
                    self.found.append([])
                at = self.next[at][w]
            if name:
                self.found[at].append(i)
        self.back = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for w, to in self.next[at].items():
                back = self.back[at]
                while back and w not in self.next[back]:
                    back = self.back[back]
                self.back[to] = self.next[back].get(w, 0)
                self.found[to] = self.found[to] + self.found[self.back[to]]
                queue.append(to)

    def scan(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(name, number of its first word in the text, first character, character after the last) of each occurrence."""
        at, starts = 0, []
        for m in TOKEN.finditer(text):
            w = m[0]
            if w in ENDS:
                at = 0
                continue
            starts.append(m.start())
            while at and w not in self.next[at]:
                at = self.back[at]
            at = self.next[at].get(w, 0)
            for i in self.found[at]:
                first = len(starts) - self.size[i]
                yield i, first, starts[first], m.end()


def find_names(texts: DataFrame, key: str, text: str, names: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, name, kind, first, start, end) of every occurrence of ``names`` (name, kind) in ``texts``.

    first is the number of the name's first word in the text, start and end are characters, the end exclusive. Names may overlap and
    contain each other. Null and empty texts and names give nothing; a name of two kinds is found for both.
    """
    kind = texts.schema[key].dataType.simpleString()
    names = names.select("name", "kind").where("name IS NOT NULL").distinct()
    blocks = max(1, -(-names.count() // block))
    out = None
    for b in range(blocks):
        part = names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b) if blocks > 1 else names
        rows = part.collect()  # a block
        listed = [(tuple(words_of(r.name)), r.name, r.kind) for r in rows]

        def scan(batches: Iterator[pa.RecordBatch], listed=listed) -> Iterator[pa.RecordBatch]:
            automaton = Automaton([n for n, _, _ in listed])
            for batch in batches:
                found = [(k, listed[i][1], listed[i][2], first, start, end) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for i, first, start, end in automaton.scan(t)]
                cols = list(zip(*found, strict=True)) or [()] * 6
                types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [key, "name", "kind", "first", "start", "end"])

        one = texts.select(key, text).mapInArrow(scan, f"{key} {kind}, name string, kind string, first int, start int, end int")
        out = one if out is None else out.unionByName(one)
    return out


def without_overlaps(found: DataFrame, key: str, weaker: str) -> DataFrame:
    """Of occurrences of different kinds that share a character the longer ones; where both are as long, not those of the kind ``weaker``.

    Occurrences are dealt by the stretches of 256 characters that they touch, so that a long text's meet only near ones.
    """
    span = F.explode(F.sequence(F.floor(F.col("start") / 256), F.floor((F.col("end") - 1) / 256))).alias("_at")
    near = found.select("*", span)
    a, b = near.alias("a"), near.alias("b")
    length = lambda t: F.col(f"{t}.end") - F.col(f"{t}.start")
    meets = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._at") == F.col("b._at")) & (F.col("a.kind") != F.col("b.kind"))
    shares = (F.greatest("a.start", "b.start") < F.least("a.end", "b.end")) & ((length("a") < length("b")) | ((length("a") == length("b")) & (F.col("a.kind") == weaker)))
    kept = a.join(b, meets & shares, "left_anti").select("a.*")
    # an occurrence that touches two stretches has to be kept in both
    columns = [c for c in found.columns]
    whole = kept.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return whole.where(F.col("_n") == F.floor((F.col("end") - 1) / 256) - F.floor(F.col("start") / 256) + 1).select(*columns)


# ---- abbreviations ----------------------------------------------------------------------------------------------------------

_PLACE = re.compile(r"\(\s*([^()\s]{2,10})\s*\)")


def long_form(short: str, before: str) -> str | None:
    """The words at the end of ``before`` that ``short`` stands for: each of its letters and digits is found in them from right to left, the
    first one at the beginning of a word. At most five words more than it has characters are looked at, and at most twice as many, none
    before a line break, which ends a sentence."""
    before = before.rstrip()
    before = before[before.rfind("\n") + 1 :]
    words = list(re.finditer(r"\S+", before))[-min(len(short) + 5, 2 * len(short)) :]
    if not words:
        return None
    start, text = words[0].start(), before.lower()
    at = len(text) - 1
    for i in range(len(short) - 1, -1, -1):
        c = short[i].lower()
        if not c.isalnum():
            continue
        while at >= start and (text[at] != c or (i == 0 and at > start and text[at - 1].isalnum())):
            at -= 1
        if at < start:
            return None
        at -= 1
    while at >= start and not text[at].isspace():  # to the beginning of the word, which may have a sign before its first letter
        at -= 1
    found = before[at + 1 :].strip()
    return found if len(found) > len(short) and short not in found.split() else None


def definitions(text: str) -> dict[str, str]:
    """The long form of each short form that a text defines in brackets; the first definition holds. A plural's s is no letter of it."""
    out: dict[str, str] = {}
    for m in _PLACE.finditer(text):
        short = m[1]
        if not (short[0].isalnum() and any(c.isalpha() for c in short)):
            continue
        base = short[:-1] if short.endswith("s") and len(short) > 2 and short[:-1].upper() == short[:-1] else short
        if base not in out and (found := long_form(base, text[: m.start()])):
            out[base] = found
    return out


def expanded(text: str | None) -> str | None:
    """The text with each short form that it defines replaced where it stands as a word of its own, in the plural too."""
    known = definitions(text) if text and "(" in text else {}
    if not known:
        return text
    one = "|".join(re.escape(s) for s in sorted(known, key=len, reverse=True))

    def put(m: re.Match) -> str:
        long = known[m[1]]
        return long + "s" if m[2] and not long.endswith("s") else long

    return re.sub(rf"(?<![\w-])({one})(s?)(?![\w-])", put, text)


def expand_abbreviations(text: Column) -> Column:
    """Every abbreviation that a text defines, written out; texts without one as they are."""
    return F.udf(expanded, "string", useArrow=True)(text)
