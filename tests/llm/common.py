"""Plain versions of what the operators compute, and rows that are awkward."""

import re
import struct

import xxhash

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT2 string, size int, shard string"

SAME = "One two three four five six seven eight nine ten eleven twelve " * 4
ROWS = [
    (1, "Hello World, this is it", "en", "a", 5, "x", 1, "s"),
    (2, "hello world, this is it", "en", "b", 5, "x", 1, "s"),
    (3, None, "en", None, 5, None, 1, "s"),
    (4, "", None, "a", None, "x", None, None),
    (5, " \t\n ", "en", "c", 5, "x", 1, "s"),
    (6, SAME, "en", "a", 5, "x", 1, "s"),
    (7, SAME, "en", "a", 5, "x", 1, "s"),
    (7, SAME, "en", "a", 5, "x", 1, "s"),
    (None, "no id at all\nÄÖ ü ß é\n" + "x" * 45, "de", "b", 5, "x", 1, "s"),
    (None, None, None, None, None, None, None, None),
    (10, SAME + "and a tail", "en", "d", 5, "x", 1, "s"),
    (11, "A" * 45 + "\n" + "B" * 10, "en", "d", 5, "x", 1, "s"),
    (12, "word " * 30000, "en", "d", 5, "x", 1, "s"),
    (13, "single", "en", "d", 5, "x", 1, "s"),
    (14, "İstanbul K É 🙂 naïve", "en", "d", 5, "x", 1, "s"),
]


def lower(text):
    return (text or "").translate(UPPER)


def words(text):
    return BLANK_WORD.findall(text or "")


def frame(spark, rows=ROWS, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def plain(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


class Int(int):
    """A 32-bit integer."""


def xxhash64(*values):
    """Spark's hash of columns: each value's hash seeds the next one's, and nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            body = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, Int) else "<q", v)
            h = xxhash.xxh64_intdigest(body, seed=h)
    return h


def uniform(*values):
    return ((xxhash64(*values) >> 11) + 0.5) / 2.0**53
