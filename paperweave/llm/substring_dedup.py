"""Substring deduplication by fixed-block anchors.

Every repeat of ``window`` words holds, in each of its places, a whole block of ``(window + 1) // 2`` words that stands at a multiple of
that length in its own text. These non-overlapping blocks are the index, and every rolling window of the same length probes it; a
block that another place repeats is an anchor. Index and probes are dealt by ranges of their hash, packed and sorted, so that neither a
filter nor a table has to stand anywhere as a whole. Anchors go back to their texts; around them alone whole windows are compared, and
the windows found repeated join to maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick
from .scratch import small_batches
from .textops import BLANK, U, mix, rolling, row_slices, runs, signed, word_bounds, word_hashes

WINDOW = 35
_SECOND = 0xC2B2AE3D27D4EB4F
#: Texts that a task remembers having seen, so that copies are sent once.
SEEN = 1_000_000
#: Hashes that a task packs at once; ranges of the hash for each shuffle partition.
PACKED, RANGES = 1 << 20, 16
_LAST = (1 << 31) - 1
_KNOWN, _INDEX, _PROBE = range(3)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of (t, ..., text): word hashes, word offsets of the rows and the rows' text hashes, by runs of rows whose text this task has not
    seen. The text may come at the end."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for i, t in enumerate(batch.column(0).to_pylist()):
            if t not in seen:
                seen.add(t)
                fresh.append(i)
        if len(seen) > SEEN:
            seen.clear()
        if len(fresh) < batch.num_rows:
            batch = batch.take(pa.array(fresh, pa.int64()))
        for part, data, at in runs(batch):
            starts, ends, rows = word_bounds(data, at, BLANK)
            w = word_hashes(data, starts, ends)
            yield w, row_slices(rows, part.num_rows), part.column(0).to_numpy()


def _starts(cut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows of k words that lie in one row, and their rows."""
    n = np.maximum(np.diff(cut) - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + cut[row], row


# ---- anchors ----------------------------------------------------------------------------------------------------------------


def _pack(x: np.ndarray) -> bytes:
    """Sorted 32-bit values byte by byte, the highest bytes last, which then compress to little."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _entries(h: np.ndarray, t: np.ndarray, at: np.ndarray) -> bytes:
    return _pack(h) + t.astype("<i8").tobytes() + at.astype("<i4").tobytes()


def _entries_of(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(body) // 16
    return _unpack(body[: 4 * n]), np.frombuffer(body[4 * n : 12 * n], "<i8"), np.frombuffer(body[12 * n :], "<i4")


def _apart(h: np.ndarray, t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of hash and place, each place once, and whether another place has the hash."""
    order = np.lexsort((at, t, h))
    h, t, at = h[order], t[order], at[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]) | (at[1:] != at[:-1])][: len(h)]
    h, t, at = h[new], t[new], at[new]
    same = np.r_[False, h[1:] == h[:-1]][: len(h)]
    return h, t, at, same | np.r_[same[1:], False][: len(h)]


def _split(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Range and the 32 bits that follow, of hashes."""
    return (h >> U(64 - bits)).astype(np.int64), ((h << U(bits)) >> U(32)).astype(np.uint32)


def _packed_rows(base: DataFrame, k: int, bits: int) -> DataFrame:
    """(range, kind, body): the blocks' hashes with their places, and the other rolling windows' hashes, of all texts.

    Blocks that a pack holds twice are known to be anchors at once, and one of them goes on for others to meet; so a passage in a third
    of all rows is sent once a pack.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            h, t, at, probes = (np.concatenate(x) for x in zip(*held, strict=True))
            h, t, at, twice = _apart(h, t, at)
            rows = []
            if twice.any():
                rows.append((int(h[0] >> U(64 - bits)), _KNOWN, _entries(np.zeros(int(twice.sum()), np.uint32), t[twice], at[twice])))
            one = np.r_[True, h[1:] != h[:-1]][: len(h)]
            where, rest = _split(h[one], bits)
            cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True]) if len(where) else np.zeros(1, np.int64)
            rows += [(int(where[i]), _INDEX, _entries(rest[i:j], t[one][i:j], at[one][i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            where, rest = _split(np.unique(probes), bits)
            cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True]) if len(where) else np.zeros(1, np.int64)
            rows += [(int(where[i]), _PROBE, _pack(rest[i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            for i in range(0, len(rows), 1024):
                c = list(zip(*rows[i : i + 1024], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary())], ["range", "kind", "body"])

        size = 0
        for w, cut, t in _texts(batches):
            at, row = _starts(cut, k)
            h, first = rolling(w, k)[at], (at - cut[row])
            own = first % k == 0
            held.append((h[own], t[row[own]], first[own].astype(np.int32), h[~own]))
            size += len(h)
            if size >= PACKED:
                yield from out()
                held.clear()
                size = 0
        if size:
            yield from out()

    return base.mapInArrow(scan, "range long, kind int, body binary")


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows sorted by range and kind: (t, at) of blocks that another place repeats. A range's index is held at a time."""
    here, pieces, index, met = None, [], None, None

    def places(t: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(t, np.int64)), pa.array(np.ascontiguousarray(at, np.int32))], ["t", "at"])

    def built() -> tuple:
        h, t, at, twice = _apart(*(np.concatenate(x) for x in zip(*pieces, strict=True)))
        return h, t, at, twice.copy()

    def ended() -> Iterator[pa.RecordBatch]:
        if pieces:
            h, t, at, hit = index if index is not None else built()
            if hit.any():
                yield places(t[hit], at[hit])

    for batch in batches:
        for where, kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if where != here:
                yield from ended()
                here, pieces, index = where, [], None
            body = body.as_py()
            if kind == _KNOWN:
                _, t, at = _entries_of(body)
                yield places(t, at)
            elif kind == _INDEX:
                pieces.append(_entries_of(body))
            elif pieces:
                if index is None:
                    index = built()
                probes = _unpack(body)
                i = np.searchsorted(probes, index[0])
                np.logical_or(index[3], probes[np.minimum(i, len(probes) - 1)] == index[0], out=index[3])
    yield from ended()


# ---- windows ----------------------------------------------------------------------------------------------------------------

#: A window's row has its hash in h, 31 further bits of it and the window's first word in more; a span known to repeat has the text's hash
#: in h, and its first and last window, with the sign, in more.
_SPANS = "h long, more long, t long"


def _window_rows(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of (t, ..., text, at) sorted by t, ``at`` being the text's anchors: windows around anchors.

    Those that a run of rows holds twice are known to repeat and leave as spans, and one of them goes on for the others to meet; so a
    passage in a third of all rows is sent once a run.
    """
    last = None
    for batch in batches:
        t = batch.column(0).to_numpy()
        fresh = np.r_[True, t[1:] != t[:-1]][: len(t)]
        if len(t):
            fresh[0] &= last is None or t[0] != last
            last = t[-1]
        batch = batch.filter(pa.array(fresh))
        for part, data, bounds in runs(batch):
            starts, ends, rows = word_bounds(data, bounds, BLANK)
            w, cut, t = word_hashes(data, starts, ends), row_slices(rows, part.num_rows), part.column(0).to_numpy()
            lists = part.column(part.schema.get_field_index("at"))
            n = np.diff(np.asarray(lists.offsets))
            hit = np.unique(lists.flatten().to_numpy().astype(np.int64) + np.repeat(cut[:-1], n))
            near = np.unique((hit[:, None] - np.arange(window - k + 1)[None]).ravel())
            # the row of the anchor is the row of the window: a window that begins in the row before is too long for it
            near = near[near >= 0]
            owner = np.searchsorted(cut, near, "right") - 1
            ok = near + window <= cut[np.minimum(owner + 1, len(cut) - 1)]
            near, owner = near[ok], owner[ok]
            if not len(near):
                continue
            h, x = rolling(w, window)[near], (rolling(w, window, _SECOND)[near] >> U(33)).astype(np.int64)
            order = np.lexsort((near, x, h))
            h, x, near, owner = h[order], x[order], near[order], owner[order]
            same = np.r_[False, (h[1:] == h[:-1]) & (x[1:] == x[:-1])]
            twice = same | np.r_[same[1:], False]
            one = ~same
            yield _rows(signed(h[one]), (x[one] << 32) | (near - cut[owner])[one], t[owner[one]])
            if twice.any():
                p, o = near[twice], owner[twice]
                i = np.argsort(p)
                p, o = p[i], o[i]
                new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1] + 1) | (o[1:] != o[:-1])])
                end = np.r_[new[1:] - 1, len(p) - 1]
                tt = t[o[new]]
                yield _rows(tt, -1 - (((p[new] - cut[o[new]]) << 32) | (p[end] - cut[o[end]])), tt)


def _rows(h: np.ndarray, more: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in (h, more, t)], ["h", "more", "t"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, more, t: (t, first, last) of window starts whose window stands in two places. Few rows are carried on: the
    first and the last of a window's rows tell whether there are two."""
    low = (1 << 32) - 1

    def out(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["t", "first", "last"])

    carry: list[np.ndarray] | None = None
    met = False  # whether the carried row's window has been met elsewhere
    for batch in batches:
        c = [batch.column(n).to_numpy() for n in ("h", "more", "t")]
        if not len(c[0]):
            continue
        spans = c[1] < 0
        if spans.any():
            x = -1 - c[1][spans]
            yield out(c[2][spans], x >> 32, x & low)
        c = [x[~spans] for x in c]
        if carry is not None:
            c = [np.r_[a, b] for a, b in zip(carry, c, strict=True)]
        if not len(c[0]):
            continue
        h, more, t = c
        copy = np.r_[False, (h[1:] == h[:-1]) & (more[1:] == more[:-1]) & (t[1:] == t[:-1])]
        h, more, t = (v[~copy] for v in (h, more, t))
        key = np.r_[False, (h[1:] == h[:-1]) & (more[1:] >> 32 == more[:-1] >> 32)]
        dup = key | np.r_[key[1:], False]
        if carry is not None and met:
            dup[0] = True
        real = dup.copy()
        real[-1] = False
        yield out(t[real], more[real] & low, more[real] & low)
        carry, met = [v[-1:] for v in (h, more, t)], bool(dup[-1])
    if carry is not None and met:
        yield out(carry[2], carry[1] & low, carry[1] & low)


def repeated_spans(base: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of (t, ..., text), t being the text's hash: (t, first, last) of window starts that stand elsewhere too."""
    k = (window + 1) // 2
    bits = (int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES - 1).bit_length()
    packed = _packed_rows(base.select("t", "text"), k, bits).repartition("range").sortWithinPartitions("range", "kind")
    anchors = packed.mapInArrow(_anchors, "t long, at int").groupBy(F.col("t").alias("s")).agg(F.collect_set("at").alias("at"))
    # the same join, on the same side dealt by t, as that which brings the spans back to the texts, so that texts move once
    around = base.join(anchors.hint("merge"), F.col("t") == F.col("s")).drop("s").sortWithinPartitions("t")
    found = around.mapInArrow(lambda batches: _window_rows(batches, window, k), _SPANS)
    dealt = found.repartition("h").sortWithinPartitions("h", "more", "t")
    return dealt.mapInArrow(_repeated, "t long, first int, last int")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_text.

    Words are runs without blanks, unchanged. A word goes if a window of ``window`` words over it stands elsewhere too, in another row
    or in its own at another place; all windows are judged on the input. Rows with equal texts repeat each other throughout. Texts
    shorter than a window, null and empty ones lose nothing. kept_text is the words that stay, joined by one space. Other columns are
    not read. An empty table gives no rows. Results depend on texts alone, so null or repeated doc_ids do no harm.
    """
    small_batches(docs.sparkSession)
    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.select(F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2"), "doc_id", "text")
    # copies are told apart by both hashes, so that no text goes because of another one that shares t by chance
    copies = base.groupBy("t", "t2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    none = F.lit(None).cast("int")
    spans = repeated_spans(base, window).withColumn("t2", F.lit(None).cast("long")).unionByName(copies.select("t", none.alias("first"), none.alias("last"), "t2"))
    span = F.when(F.col("first").isNotNull(), F.struct("first", "last"))
    spans = spans.groupBy(F.col("t").alias("s")).agg(F.collect_list(span).alias("spans"), F.collect_set("t2").alias("copies"))
    joined = base.join(spans.hint("merge"), F.col("t") == F.col("s"), "left").select("doc_id", "text", F.when(F.array_contains("copies", F.col("t2")), F.array(F.struct(F.lit(0).alias("first"), F.lit(_LAST).alias("last")))).otherwise(F.col("spans")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in runs(batch):
                starts, ends, rows = word_bounds(data, at, BLANK)
                to = row_slices(rows, part.num_rows)
                gone = np.zeros(len(starts) + 1, np.int32)
                lists = part.column(2)
                sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
                sizes = np.where(np.asarray(lists.is_null()), 0, sizes)
                flat = lists.flatten()
                owner = np.repeat(np.arange(part.num_rows), sizes)
                a = flat.field(0).to_numpy().astype(np.int64)
                b = flat.field(1).to_numpy().astype(np.int64)
                n = np.diff(to)[owner]
                ok = n >= window
                a, b, owner, n = a[ok], np.minimum(b, n - window)[ok], owner[ok], n[ok]
                np.add.at(gone, to[owner] + a, 1)
                np.add.at(gone, to[owner] + b + window, -1)
                stay = np.cumsum(gone[:-1]) == 0
                raw = data.tobytes()
                s, e = starts.tolist(), ends.tolist()
                kept = []
                for i in range(part.num_rows):
                    mine = np.flatnonzero(stay[to[i] : to[i + 1]]) + to[i]
                    kept.append(b" ".join([raw[s[j] : e[j]] for j in mine.tolist()]).decode("utf-8", "replace"))
                n_words = np.diff(to)
                n_removed = n_words - np.add.reduceat(np.r_[stay, False].astype(np.int64), to[:-1]) * (n_words > 0) if part.num_rows else n_words
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


