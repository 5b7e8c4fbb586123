"""Benchmark decontamination by a prefix-filtered set join.

A benchmark window is a set of shingles that a contaminated text must contain whole, so one of them, the prefix, is necessary: the
rarest by the corpus's own counts. Documents are probed for prefix shingles only; a hit at word p of a shingle with offset o can only
be a window at p - o, which must lie within the text; there the window's words are compared one by one, by their hashes and then byte
by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick
from .scratch import Scratch, small_batches
from .textops import LOWER, NOT_ALNUM, U, row_slices, runs, shingles, word_bounds, word_hashes

WINDOW = 10
#: Words of a shingle whose rarity orders the windows.
SHINGLE = 5
#: Words of benchmark items that one broadcast block holds, and bytes of words; a larger benchmark is joined block by block.
BLOCK_WORDS = 2_000_000
BLOCK_BYTES = 32 << 20
#: Bytes that one step of a comparison holds, a longer word aside.
COMPARED = 1 << 20


def alnum_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, rows = word_bounds(low, at, NOT_ALNUM)
    return low, starts, ends, rows


@dataclass
class Words:
    """Words in lower case: their hashes, and the bytes that each covers of ``data``."""

    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of rows of text, and each word's row."""
    low, starts, ends, rows = alnum_words(data, at)
    return Words(word_hashes(low, starts, ends), low, starts, ends), rows


def equal_bytes(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i of a is word j of b, pair by pair."""
    n = a.ends[i] - a.starts[i]
    same = n == b.ends[j] - b.starts[j]
    todo = np.flatnonzero(same)
    total = np.cumsum(n[todo])
    at = 0
    while at < len(todo):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COMPARED, "right")))
        some = todo[at:end]
        size = n[some]
        owner = np.repeat(np.arange(len(some)), size)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        differ = a.data[a.starts[i[some]][owner] + step] != b.data[b.starts[j[some]][owner] + step]
        same[some[owner[differ]]] = False
        at = end
    return same


@dataclass
class Block:
    """Windows of some items. ``words``: the items' words one after another; window w is ``size[w]`` words from ``first[w]``."""

    words: Words
    first: np.ndarray
    size: np.ndarray
    item: np.ndarray  # place among ids
    ids: list


def item_blocks(items: Iterable[tuple[object, str | None]], window: int, block_words: int) -> Iterator[Block]:
    """Blocks of items with words, each made when it is asked for."""
    todo, held, size = [], 0, 0
    for ident, text in items:
        raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
        w, _ = words_of(raw, np.array([0, len(raw)]))
        if len(w.hashes):
            todo.append((ident, w))
            held += len(w.hashes)
            size += len(w.data)
        if held >= block_words or size >= BLOCK_BYTES:
            yield _block(todo, window)
            todo, held, size = [], 0, 0
    if todo:
        yield _block(todo, window)


def _block(items: list[tuple[object, Words]], window: int) -> Block:
    first, size, item, starts, ends = [], [], [], [], []
    base = byte = 0
    for i, (_, w) in enumerate(items):
        n = max(1, len(w.hashes) - window + 1)
        first.append(base + np.arange(n))
        size.append(np.full(n, min(window, len(w.hashes))))
        item.append(np.full(n, i))
        starts.append(w.starts + byte)
        ends.append(w.ends + byte)
        base += len(w.hashes)
        byte += len(w.data)
    words = Words(np.concatenate([w.hashes for _, w in items]), np.concatenate([w.data for _, w in items]), np.concatenate(starts), np.concatenate(ends))
    return Block(words, np.concatenate(first), np.concatenate(size), np.concatenate(item), [i for i, _ in items])


def _grams(words: np.ndarray, k: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and where they start; with rows, none crosses from one row to the next."""
    h = shingles(words, k)
    at = np.arange(len(h))
    if rows is not None and len(h):
        at = at[rows[: len(h)] == rows[k - 1 :]]
    return h[at], at


def rarities(docs: DataFrame, block: Block, shingle: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By shingle length: the block's shingles and how often each occurs in all of ``docs``. As many rows as the block has."""
    wanted = {k: np.unique(_grams(block.words.hashes, k)[0]) for k in sorted({int(min(shingle, n)) for n in np.unique(block.size)})}
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {k: np.zeros(len(v), np.int64) for k, v in sent.value.items()}
        for batch in batches:
            for _, data, at in runs(batch):
                w, rows = words_of(data, at)
                for k, v in sent.value.items():
                    h = _grams(w.hashes, k, rows)[0]
                    i = np.minimum(np.searchsorted(v, h), len(v) - 1)
                    i = i[v[i] == h]
                    found[k] += np.bincount(i, minlength=len(v))
        for k, n in found.items():
            i = np.flatnonzero(n)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i), pa.array(n[i])], ["k", "i", "n"])

    counts = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}
    for r in docs.mapInArrow(count, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.k][r.i] = r.n
    sent.unpersist()
    return {k: (wanted[k], counts[k]) for k in wanted}


@dataclass
class Probe:
    """What a block is probed with, by shingle length: sorted prefix shingles, and for each the windows it is the prefix of."""

    block: Block
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # shingle, window, offset in the window, length bound


def probes(block: Block, rarity: dict[int, tuple[np.ndarray, np.ndarray]], shingle: int) -> Probe:
    out = {}
    for k, (known, n) in rarity.items():
        w = np.flatnonzero(np.minimum(block.size, shingle) == k)
        if not len(w):
            continue
        h = shingles(block.words.hashes, k)
        best, offset = np.full(len(w), np.iinfo(np.int64).max), np.zeros(len(w), np.int64)
        for o in range(int(block.size[w].max()) - k + 1):
            ok = o + k <= block.size[w]
            c = np.where(ok, n[np.searchsorted(known, h[np.minimum(block.first[w] + o, len(h) - 1)])], np.iinfo(np.int64).max)
            offset, best = np.where(c < best, o, offset), np.minimum(c, best)
        prefix = h[block.first[w] + offset]
        order = np.argsort(prefix, kind="stable")
        out[k] = prefix[order], w[order], offset[order], block.size[w][order]
    return Probe(block, out)


def window_hits(words: Words, at: np.ndarray, rows: np.ndarray, probe: Probe) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which windows start, and the windows. ``at``: the rows' word offsets; ``rows``: each word's row."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    b = probe.block
    for k, (prefix, window, offset, size) in probe.by_length.items():
        h, p = _grams(words.hashes, k, rows)
        lo, hi = np.searchsorted(prefix, h, "left"), np.searchsorted(prefix, h, "right")
        hit = np.flatnonzero(hi > lo)
        # copies of one window in the benchmark share a prefix, so a shingle has as many candidates as the benchmark has windows with it
        while len(hit):
            j = lo[hit]
            start, w = p[hit] - offset[j], window[j]
            row = rows[p[hit]]
            ok = (start >= at[row]) & (start + size[j] <= at[row + 1])
            start, w, n = start[ok], w[ok], size[j][ok]
            for o in range(int(n.max()) if len(n) else 0):
                same = (o >= n) | (words.hashes[np.minimum(start + o, len(words.hashes) - 1)] == b.words.hashes[np.minimum(b.first[w] + o, len(b.words.hashes) - 1)])
                start, w, n = start[same], w[same], n[same]
            found.append(_exact(words, start, b, w, n))
            lo[hit] += 1
            hit = hit[lo[hit] < hi[hit]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _exact(words: Words, start: np.ndarray, b: Block, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the windows w found at start that hold the same bytes. A word that neighbouring windows share is compared once."""
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    here, there = start[owner] + step, b.first[w][owner] + step
    _, one, back = np.unique(here * len(b.words.hashes) + there, return_index=True, return_inverse=True)
    wrong = ~equal_bytes(words, here[one], b.words, there[one])[back.ravel()]
    keep = np.ones(len(n), bool)
    keep[owner[wrong]] = False
    return start[keep], w[keep]


_COLUMNS = "n_words long, spans array<struct<start: long, end: long, item: string>>"


def _scan(docs: DataFrame, probe: Probe, first_block: bool) -> DataFrame:
    """Adds or extends n_words and spans (word start, word end, item_id as text), with the text for the next block."""
    sent = docs.sparkSession.sparkContext.broadcast(probe)
    schema = "doc_id long, text string, " + _COLUMNS
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in runs(batch):
                w, rows = words_of(data, at)
                cut = row_slices(rows, part.num_rows)
                start, win = window_hits(w, cut, rows, sent.value)
                b = sent.value.block
                row = rows[start] if len(start) else start
                spans: list[list] = part.column(3).to_pylist() if not first_block else [[] for _ in range(part.num_rows)]
                for r, s, e, i in sorted(set(zip(row.tolist(), (start - cut[row]).tolist(), (start - cut[row] + b.size[win]).tolist(), b.item[win].tolist(), strict=True))):
                    spans[r].append({"start": s, "end": e, "item": str(b.ids[i])})
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(cut)), pa.array(spans, kind)], ["doc_id", "text", "n_words", "spans"])

    return docs.mapInArrow(scan, schema)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of (doc_id, text, n_words, spans), spans being word ranges that a window of an item covers, with the item_id as text.

    Items come from the cluster one by one and are joined in blocks of ``block_words`` words: no more than one block and a longest item
    stand on the driver, or in a broadcast, at once. With a block to follow, what a block has found is written first.
    """
    small_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    base, scratch = docs, Scratch(docs.sparkSession)
    items = pick(benchmark, "item_id", "text").where(F.col("item_id").isNotNull()).distinct().sort("item_id", "text")
    first, written = True, None
    for block in item_blocks(((r[0], r[1]) for r in items.toLocalIterator()), window, block_words):
        if not first:
            docs, old = scratch.write("found", docs), written
            written = docs
            if old is not None:
                scratch.drop(old)
        docs = _scan(docs, probes(block, rarities(base, block, shingle), shingle), first)
        first = False
    return _scan(docs, Probe(Block(Words(np.zeros(0, U), np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 2), *[np.zeros(0, np.int64)] * 3, []), {}), True) if first else docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated.

    Words are runs of digits, letters and anything beyond ASCII, A-Z lower-cased. A window is ``window`` consecutive words of a
    benchmark item (item_id, text), or the whole item where it has fewer; items without words have none. A word of a document is hit
    if any occurrence of a window covers it. A null or empty text has no words and is clean. Rows with one item_id are one item;
    items without an id are left out. Repeated rows of ``docs`` are scanned one by one; other columns are not read. An empty
    ``docs`` gives no rows, an empty ``benchmark`` clean rows.
    """
    found = contaminated_spans(docs, benchmark, window, shingle, block_words)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, items = [], []
            for spans in batch.column("spans").to_pylist():
                covered, end = 0, 0
                for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                    covered += max(0, s["end"] - max(end, s["start"]))
                    end = max(end, s["end"])
                hit.append(covered)
                items.append(sorted({s["item"] for s in spans}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(list(map(len, items)), pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"],
            )

    return found.mapInArrow(digest, schema)
