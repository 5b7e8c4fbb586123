"""Toxicity by noisy-channel deobfuscation.

A token that may hide something (digits or symbols among letters, letters drawn out, letters spaced apart) becomes a lattice: every
observed character may stand for itself, for the letters it resembles, for a repetition of its predecessor, for a gap between words or
for nothing. Viterbi decoding under a trigram character model, counted over all documents, restores the likeliest letters. All other
tokens have one path, themselves. A logistic model over words and word beginnings scores the restored text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import pick
from .scratch import Scratch, small_batches
from .textops import runs

#: Letters that a character may stand for.
LOOKALIKES = {"*": "aeiou", "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
NOISE = "*.-_~^'`´·,;:/\\#%&=\"<>[]{})?"
#: Costs in nats of the channel: a resemblance, a repetition, a dropped symbol, a dropped digit, a dropped blank, a kept gap.
RESEMBLES, REPEATS, DROPS, DROPS_DIGIT, JOINS, GAP = 0.7, 1.2, 0.9, 9.0, 0.4, 0.7
LETTERS = 28  # classes: gap, a to z, any other letter
OTHER = 27
#: Characters after which decoded paths are compared and what they share is settled.
SETTLE = 256

_SUSPECT = re.compile(r"([^\W\d_])\1\1|[^\W\d_][0-9@$!|+(€£*.\-_~^'`´·/\\#%&=]+[^\W\d_]|[0-9@$!|+(€£][^\W\d_]{2,}|[^\W\d_]{2,}[0-9@$|+€£](?![0-9@$|+€£])")
_PIECES = re.compile(r"[^\W\d_]+")
_SEPARATE = re.compile(r"(?:[\w@$!|+€£][*.\-_~^'`´·,;:/\\#%&=]+){2,}[\w@$!|+€£]")
_EDGE = ".,;:!?\"'()[]{}<>*#%&$-_~^=/\\|+"
#: Lengths of word beginnings that are features beside the whole word.
PREFIXES = (3, 4, 5, 6)
#: Labelled rows that the classifier is fitted on at most, drawn by a hash of doc_id.
FIT_ROWS = 20_000
#: Standard errors by which a feature's rates must differ between the classes; all features that do are kept.
LEAST_SCORE = 3.5
THRESHOLD = 0.3


def letter_class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


# ---- the character model ----------------------------------------------------------------------------------------------------

_CLASS = np.zeros(256, np.int64)
_CLASS[0x61:0x7B] = np.arange(1, 27)
_CLASS[0x41:0x5B] = np.arange(1, 27)
_CLASS[0xC0:] = OTHER


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Trigrams of letter classes over the whole texts of all documents; 28^3 counts at most, whatever the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for _, data, at in runs(batch):
                keep = (data < 0x80) | (data >= 0xC0)  # one byte a character
                keep[at[:-1][at[:-1] < len(data)]] = True
                c = np.concatenate([[0, 0], _CLASS[data[keep]], [0]])
                total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], ["gram", "n"])

    out = np.zeros(LETTERS**3, np.int64)
    for r in docs.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.gram] = r.n
    return out.reshape(LETTERS, LETTERS, LETTERS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), interpolated with the bigram and the unigram model."""
    tri, bi, uni = counts.astype(float), counts.sum(0).astype(float), counts.sum((0, 1)).astype(float) + 1
    p1 = uni / uni.sum()
    p2 = (bi + 2 * p1) / (bi.sum(1, keepdims=True) + 2)
    p3 = (tri + 2 * p2[None]) / (tri.sum(2, keepdims=True) + 2)
    return -np.log(p3)


def emissions(c: str, last: str) -> list[tuple[str, float]]:
    """What an observed character, after another, may stand for, nothing being '', and at what cost."""
    if c.isalpha():
        return [(c, 0.0), ("", REPEATS)] if c == last else [(c, 0.0)]
    if c.isspace():
        return [(" ", 0.0), ("", JOINS)]
    return [*((x, RESEMBLES) for x in LOOKALIKES.get(c, "")), ("", DROPS_DIGIT if c.isdigit() else DROPS), (" ", GAP)]


def viterbi(observed: str, model: np.ndarray, settle: int = SETTLE) -> str:
    """The likeliest letters and gaps behind ``observed`` (lower case).

    Where all paths meet in one state what lies behind it is settled, and after every ``settle`` characters so is what they have in
    common; so the paths held are about as long as a stretch in doubt, however long the text is.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # last two classes: cost, path
    last, out = "", []
    for i, c in enumerate(observed, 1):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        emits = emissions(c, last)
        for (a, b), (cost, path) in states.items():
            for e, extra in emits:
                if not e:
                    key, total, way = (a, b), cost + extra, path
                else:
                    k = 0 if e == " " else letter_class(e)
                    key, total, way = (b, k), cost + extra + model[a, b, k], (e, path)
                if key not in new or total < new[key][0]:
                    new[key] = total, way
        if len(new) == 1:
            ((key, (cost, path)),) = new.items()
            out += reversed(_emitted(path))
            new = {key: (cost, None)}
        elif i % settle == 0:
            new = _settled(new, out)
        states, last = new, c
    out += reversed(_emitted(min(((cost + model[a, b, 0], way) for (a, b), (cost, way) in states.items()), key=lambda x: x[0])[1]))
    return "".join(out)


def _settled(states: dict[tuple[int, int], tuple[float, tuple | None]], out: list[str]) -> dict[tuple[int, int], tuple[float, tuple | None]]:
    """The states without what all their paths begin with, which goes to ``out``."""
    steps = []
    for _, path in states.values():
        nodes = []
        while path is not None:
            nodes.append(path)
            path = path[1]
        steps.append(nodes[::-1])
    same = 0
    while all(len(x) > same and x[same] is steps[0][same] for x in steps):
        same += 1
    out += [x[0] for x in steps[0][:same]]
    left = {}
    for (key, (cost, _)), nodes in zip(states.items(), steps, strict=True):
        path = None
        for x in nodes[same:]:
            path = (x[0], path)
        left[key] = cost, path
    return left


def _emitted(path: tuple | None) -> list[str]:
    """Letters of a path, the last first."""
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return out


class Restorer:
    """Restored words of texts; what a token becomes is remembered, up to ``memory`` tokens."""

    def __init__(self, model: np.ndarray, memory: int = 50_000):
        self.model, self.memory, self.known = model, memory, {}

    def token(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            core = token.strip(_EDGE)
            if len(token) > 1 and token[0] in "$@!|+" and token[1:2].isalnum():
                core = token[0] + core
            if _SEPARATE.fullmatch(core):  # single characters apart are one word
                core = "".join(c for c in core if c.isalnum() or c in "@$!|+€£")
            found = tuple(_PIECES.findall(viterbi(core, self.model))) if _SUSPECT.search(core) or any(c in LOOKALIKES for c in core) and any(c.isalpha() for c in core) else tuple(_PIECES.findall(core))
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[token] = found
        return found

    def spaced(self, tokens: list[str]) -> Iterator[str]:
        """Words restored from runs of three or more single characters."""
        run: list[str] = []
        for t in [*tokens, "  "]:
            if len(t) == 1 and (t.isalnum() or t in LOOKALIKES):
                run.append(t)
            else:
                if len(run) >= 3 and len(set(run)) > 1:
                    yield from _PIECES.findall(viterbi(" ".join(run), self.model))
                    yield from _PIECES.findall(viterbi("".join(run), self.model))
                run = []

    def words(self, text: str) -> set[str]:
        tokens = text.lower().split()
        each = set(tokens)
        out: set[str] = set()
        for t in each:
            out.update(self.token(t))
        if sum(len(t) == 1 for t in each) >= 3:
            out.update(self.spaced(tokens))
        return out

    def restore(self, text: str) -> str:
        """The restored text, word by word."""
        tokens = text.lower().split()
        return " ".join([w for t in tokens for w in self.token(t)] + list(self.spaced(tokens)))


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


# ---- the classifier ---------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    letters: np.ndarray
    weights: dict[str, float]
    bias: float


def held_out(doc_id: object) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def fit_logistic(rows: list[tuple[int, list[int]]], n: int, l2: float = 0.3, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias over sparse binary features: Newton steps, each solved by conjugate gradients."""
    y = np.array([r[0] for r in rows], float)
    cols = np.concatenate([np.array(r[1], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    ridge = np.r_[np.full(n, l2), 1e-6]

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(owner, v[cols], len(rows)) + v[n]

    def back(g: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(cols, g[owner], n), g.sum()]

    w = np.zeros(n + 1)
    w[n] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        grad, s = back(p - y) + ridge * w, np.maximum(p * (1 - p), 1e-4)
        step, r = np.zeros(n + 1), -grad
        d, rr = r.copy(), float(r @ r)
        for _ in range(60):
            if rr < 1e-10:
                break
            h = back(s * forward(d)) + ridge * d
            a = rr / float(d @ h)
            step, r = step + a * d, r - a * h
            rr, old = float(r @ r), rr
            d = r + rr / old * d
        w = w + step
        if float(np.abs(step).max()) < 1e-4:
            break
    return w[:n], float(w[n])


#: Tasks that the labelled rows are dealt to.
TAUGHT_PARTS = 16


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The character model of all documents, and a classifier of at most ``fit_rows`` labelled rows that are not held out.

    The rows are those with the smallest hash of doc_id; of rows that share one, that with the smallest hash of the text. Rows without a
    label, or whose doc_ids disagree on it, teach nothing. Each of these texts is decoded once, into a table of its features; what comes to
    the driver is theirs alone, and the features that tell the classes apart.
    """
    spark = small_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    letters = language_model(letter_counts(docs))
    known = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 != 2).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("top"))
    known = known.where("toxic = top").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # fit_rows ids at most, and one row of each
    taught = docs.join(F.broadcast(known), "doc_id").repartition(TAUGHT_PARTS, "doc_id")
    taught = taught.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text")
    sent = spark.sparkContext.broadcast(letters)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for batch in batches:
            found = [sorted({f for w in restorer.words(text.as_py() or "") for f in features(w)}) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["y", "found"])

    scratch = Scratch(spark)
    decoded = scratch.write("taught", taught.mapInArrow(decode, "y int, found array<string>"))
    sums = decoded.select("y", F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("y").cast("long").alias("t"), F.sum(1 - F.col("y")).cast("long").alias("c"))
    n1, n0 = decoded.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n1, n0 = n1 or 0, n0 or 0
    if not n1 or not n0:
        scratch.clear()
        return Model(letters, {}, math.log((n1 + 0.5) / (n0 + 0.5)))
    # how far the feature's rate among toxic rows departs from that among clean ones, in standard errors
    p = (F.col("t") + F.col("c") + 1.0) / (n1 + n0 + 2.0)
    score = (F.col("t") / n1 - F.col("c") / n0) / F.sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n0))
    telling = sums.where("t + c >= 2").withColumn("score", F.abs(score)).where(F.col("score") >= LEAST_SCORE)
    chosen = [r[0] for r in telling.orderBy("feature").select("feature").collect()]
    place = {f: i for i, f in enumerate(chosen)}
    sent_place = spark.sparkContext.broadcast(place)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent_place.value
        for batch in batches:
            ids = [[at[f] for f in found if f in at] for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["y", "ids"])

    rows = [(r.y, r.ids) for r in decoded.mapInArrow(encode, "y int, ids array<int>").orderBy("ids", "y").toLocalIterator()]
    scratch.clear()
    w, b = fit_logistic(rows, len(chosen))
    return Model(letters, {f: float(x) for f, x in zip(chosen, w, strict=True) if x}, b)


class Scorer:
    def __init__(self, model: Model, memory: int = 50_000):
        # tokens are remembered with their features, so the restorer need not remember them too
        self.restorer, self.model, self.memory = Restorer(model.letters, 1), model, memory
        self.known: dict[str, tuple[str, ...]] = {}

    def _of(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            w = self.model.weights
            found = tuple({f for x in self.restorer.token(token) for f in features(x) if f in w})
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[token] = found
        return found

    def score(self, text: str | None) -> float:
        tokens = (text or "").lower().split()
        each, w, on = set(tokens), self.model.weights, set()
        for t in each:
            if f := self._of(t):
                on.update(f)
        if sum(len(t) == 1 for t in each) >= 3:
            on.update(f for x in self.restorer.spaced(tokens) for f in features(x) if f in w)
        z = self.model.bias + math.fsum(w[f] for f in on)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def score_rows(docs: DataFrame, model: Model, text: str, out: str) -> DataFrame:
    """``docs`` with one more column, ``out``: the score of the column ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            i = batch.schema.get_field_index(text)
            s = [scorer.score(t.as_py()) for t in batch.column(i)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(score, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Labels (doc_id, toxic) teach only where crc32 of the doc_id as text is not 2 modulo 4; held_out tells the others. The score
    depends on the text alone; null and empty texts get the score of a text without any feature. A null doc_id is never held out.
    Repeated rows score alike. Other columns are not read. Without labels of both kinds every row scores the label rate. An empty
    table gives no rows.
    """
    model = train(docs, labels, fit_rows)
    base = pick(docs, "doc_id", "text")
    scored = score_rows(base, model, "text", "score")
    out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
