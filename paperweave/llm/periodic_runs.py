"""Periodic runs of words, found by refining classes of equal factors.

Positions of a text are in one class of level l when the l words that start there are equal. The classes of level l + 1 come from those of
level l by asking where the next position went when its class was last split; of a split class's parts all but the largest are asked
for, so a position is handled a logarithmic number of times (Crochemore 1981). The members of a class are linked in order. Neighbours whose
distance is the level's own length l are the two halves of a square, and consecutive squares of one length are a run.

Only runs of exponent ``POWER`` or more are asked for. Their positions have ``POWER - 1`` members in their class at every level up to the
period, within one stretch of such positions; a position whose class is smaller is dead, and a dead position's predecessor dies one level
later. So ordinary text is out of the game after a few levels. All texts of a run of rows are refined together, in arrays.

A document is handled whole inside a task; documents are dealt by Spark, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import pick
from .scratch import small_batches
from .textops import BLANK, runs, word_bounds, word_hashes

#: A run's length is at least so many periods, and at least so many words.
POWER, LEAST_WORDS = 4, 6
#: Texts are refined together up to about this many bytes.
TOGETHER_BYTES = 4 << 20


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers lo, lo+1, ... of each range, one after another."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(lo - (np.cumsum(size) - size), size)


class _Classes:
    """The partition of positions 0..n-1 into classes of equal factors, of growing length.

    ``order`` has the members of a class side by side, ``nxt`` and ``prv`` link them by position. Dead positions have class -1. ``due``
    has positions by the distance to their next member, ``limit`` bounds the distances that matter.
    """

    def __init__(self, cls: np.ndarray, limit: np.ndarray):
        n = len(cls)
        self.cls, self.limit = cls.astype(np.int64), limit
        self.order = np.argsort(self.cls, kind="stable")
        self.at = np.empty(n, np.int64)
        self.at[self.order] = np.arange(n)
        dead = int((self.cls < 0).sum())
        size = np.bincount(self.cls[self.cls >= 0], minlength=1)
        self.used = len(size)
        self.lo, self.size = np.zeros(n + self.used + 1, np.int64), np.zeros(n + self.used + 1, np.int64)
        self.lo[: self.used], self.size[: self.used] = dead + np.cumsum(size) - size, size
        self.nxt, self.prv = np.full(n, -1), np.full(n, -1)
        self.mark = np.zeros(n, bool)
        self.due: dict[int, list[np.ndarray]] = {}
        self.level = 1
        self.killed = self.order[:dead]
        self.alive = n - dead
        members = self.order[dead:]
        self._link(members, self.cls[members])
        self.asked = np.sort(members)

    def _link(self, members: np.ndarray, group: np.ndarray) -> None:
        """Members sorted by group and position become their groups' lists."""
        if not len(members):
            return
        same = group[1:] == group[:-1]
        self.nxt[members] = np.r_[np.where(same, members[1:], -1), -1]
        self.prv[members] = np.r_[-1, np.where(same, members[:-1], -1)]
        self._note(members)

    def _note(self, at: np.ndarray) -> None:
        """Distances to the next member as they are now."""
        d = self.nxt[at] - at
        ok = (d >= self.level) & (d <= self.limit[at])
        at, d = at[ok], d[ok]
        if not len(at):
            return
        o = np.argsort(d, kind="stable")
        at, d = at[o], d[o]
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1], True])
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            self.due.setdefault(int(d[i]), []).append(at[i:j])

    def _unlink(self, moved: np.ndarray) -> None:
        """Take members, sorted by class and position, out of their lists."""
        chained = self.nxt[moved[:-1]] == moved[1:]
        before, after = self.prv[moved[np.r_[True, ~chained]]], self.nxt[moved[np.r_[~chained, True]]]
        self.nxt[before[before >= 0]] = after[before >= 0]
        self.prv[after[after >= 0]] = before[after >= 0]
        self._note(before[before >= 0])

    def split(self, moved: np.ndarray, by: np.ndarray) -> None:
        """Part each class's moved positions (sorted by position) from the rest of it, by groups; group -1 dies.

        What is to be asked for at the next level is left in ``asked`` and ``killed``.
        """
        c = self.cls[moved]
        o = np.lexsort((by, c))
        moved, by, c = moved[o], by[o], c[o]
        first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (by[1:] != by[:-1])])
        size = np.diff(np.r_[first, len(moved)])
        parent, dies = c[first], (by[first] < 0) | (size < POWER - 1)
        # a class that moves whole keeps its largest group instead
        of = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        gone = np.add.reduceat(size, of)
        whole = gone == self.size[parent[of]]
        stays = np.zeros(len(first), bool)
        if whole.any():
            rank = np.where(dies, 0, size)
            best = np.maximum.reduceat(rank, of)
            nth = np.repeat(np.arange(len(of)), np.diff(np.r_[of, len(first)]))
            top = np.flatnonzero((rank == best[nth]) & whole[nth] & (rank > 0))
            stays[top[np.r_[True, nth[top[1:]] != nth[top[:-1]]]] if len(top) else top] = True
        left = np.repeat(~stays, size)
        if not left.all():
            moved, first, size, parent, dies = moved[left], np.r_[0, np.cumsum(size[~stays])[:-1]], size[~stays], parent[~stays], dies[~stays]
        self.asked = self.killed = np.zeros(0, np.int64)
        if not len(moved):
            return
        of = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        heads, gone = parent[of], np.add.reduceat(size, of)
        self._unlink(moved[np.lexsort((moved, np.repeat(parent, size)))])
        # the moved ones take the end of their class's stretch of ``order``
        end = self.lo[heads] + self.size[heads] - gone
        slots = _ranges(end, gone)
        self.mark[moved] = True
        there = self.order[slots]
        evicted = there[~self.mark[there]]
        free = self.at[moved[self.at[moved] < np.repeat(end, gone)]]
        self.order[free], self.at[evicted] = evicted, free
        self.order[slots], self.at[moved] = moved, slots
        self.mark[moved] = False
        self.size[heads] -= gone
        start = slots[first]
        fresh = ~dies
        ids = np.full(len(first), -1)
        ids[fresh] = self.used + np.arange(int(fresh.sum()))
        self.used += int(fresh.sum())
        if self.used + len(self.order) > len(self.lo):
            self.lo, self.size = (np.r_[x, np.zeros(len(x), np.int64)] for x in (self.lo, self.size))
        self.lo[ids[fresh]], self.size[ids[fresh]] = start[fresh], size[fresh]
        named = np.repeat(ids, size)
        self.cls[moved] = named
        self.killed = moved[named < 0]
        self.alive -= len(self.killed)
        self._link(moved[named >= 0], named[named >= 0])
        # of what is left of each class and its new parts, all but the largest are asked for
        kids, kin = np.r_[ids[fresh], heads], np.r_[parent[fresh], heads]
        big = self.size[kids]
        some = big > 0
        kids, kin, big = kids[some], kin[some], big[some]
        o = np.lexsort((big, kin))
        last = np.r_[kin[o][1:] != kin[o][:-1], True] if len(o) else np.zeros(0, bool)
        small = kids[o][~last]
        self.asked = np.sort(self.order[_ranges(self.lo[small], self.size[small])])

    def squares(self) -> np.ndarray:
        """Positions whose next member is as far as the level is long."""
        found = self.due.pop(self.level, None)
        if found is None:
            return np.zeros(0, np.int64)
        at = np.unique(np.concatenate(found))
        return at[(self.cls[at] >= 0) & (self.nxt[at] - at == self.level)]

    def refine(self) -> None:
        """From the classes of a level to those of the next.

        With nothing to ask for classes lose members by death alone, so all levels up to the next that has squares due are one step.
        """
        if not len(self.asked) and (far := min(self.due) - self.level) > 1:
            self.level += far
            ends = self.killed[self.killed > 0]
            ends = ends[self.cls[ends - 1] >= 0]
            first = np.maximum(ends - far, 0)
            before = np.unique(_ranges(first, ends - first))
            before = before[self.cls[before] >= 0]
            self.asked = self.killed = np.zeros(0, np.int64)
            if len(before):
                self.split(before, np.full(len(before), -1))
            return
        self.level += 1
        after = np.r_[self.asked, self.killed]
        before = np.sort(after[after > 0] - 1)
        before = before[self.cls[before] >= 0]
        if not len(before):
            self.asked = self.killed = np.zeros(0, np.int64)
            return
        self.split(before, self.cls[before + 1])

    def sweep(self) -> None:
        """Kill stretches of living positions too short for a run whose period is the level or more."""
        living = np.flatnonzero(self.cls >= 0)
        if not len(living):
            return
        cut = np.flatnonzero(np.r_[True, living[1:] != living[:-1] + 1, True])
        short = np.repeat(np.diff(cut) < (POWER - 1) * self.level + 1, np.diff(cut))
        if short.any():
            asked, killed = self.asked, self.killed
            self.split(living[short], np.full(int(short.sum()), -1))
            self.asked, self.killed = np.unique(np.r_[asked, self.asked]), np.r_[killed, self.killed]
            self.asked = self.asked[self.cls[self.asked] >= 0]


def _level_one(ids: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words that stand in parts: places of those that occur ``POWER`` times in stretches of such words of ``LEAST_WORDS`` or more,
    and the stretch of each. Stretches are narrowed until that changes little."""
    at = np.arange(len(ids))
    while len(at):
        o = np.lexsort((ids[at], part))
        new = np.flatnonzero(np.r_[True, (ids[at][o[1:]] != ids[at][o[:-1]]) | (part[o[1:]] != part[o[:-1]])])
        size = np.diff(np.r_[new, len(o)])
        often = np.empty(len(at), bool)
        often[o] = np.repeat(size >= POWER, size)
        near = np.r_[False, (at[1:] == at[:-1] + 1) & (part[1:] == part[:-1])]
        fresh = often & ~(near & np.r_[False, often[:-1]])
        stretch = np.cumsum(fresh)
        kept = often & (np.bincount(stretch[often], minlength=int(stretch[-1]) + 1)[stretch] >= LEAST_WORDS)
        if kept.all():
            return at, part
        fell = int((~kept).sum())
        at, part = at[kept], stretch[kept]
        if fell * 16 < len(at):
            break
    return at, part


def _same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bool:
    """Whether words with equal ids have equal bytes."""
    o = np.argsort(ids, kind="stable")
    starts, size = starts[o], ends[o] - starts[o]
    pairs = np.flatnonzero(ids[o][1:] == ids[o][:-1])
    if (size[pairs] != size[pairs + 1]).any():
        return False
    i, j = _ranges(starts[pairs], size[pairs]), _ranges(starts[pairs + 1], size[pairs])
    return bool((data[i] == data[j]).all())


def find_runs(ids: np.ndarray, at: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, length, period) of every run of words, sorted; ``at`` and ``part`` are what ``_level_one`` left of them."""
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    # stretches side by side, a dead position after each
    breaks = np.r_[False, (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])]
    stretch = np.cumsum(breaks)
    n = len(at) + int(stretch[-1]) + 1
    place = np.arange(len(at)) + stretch
    o = np.lexsort((ids[at], stretch))
    new = np.r_[True, (ids[at][o[1:]] != ids[at][o[:-1]]) | (stretch[o[1:]] != stretch[o[:-1]])]
    cls = np.full(n, -1)
    cls[place[o]] = np.cumsum(new) - 1
    limit = np.zeros(n, np.int64)
    limit[place] = (np.bincount(stretch) // POWER)[stretch]
    origin = np.zeros(n, np.int64)
    origin[place] = at
    classes = _Classes(cls, limit)
    out, swept, longest = [], classes.alive, int(limit.max())
    while classes.alive and classes.level <= longest:
        found, q = classes.squares(), classes.level
        if len(found):
            cut = np.flatnonzero(np.r_[True, found[1:] != found[:-1] + 1, True])
            length = np.diff(cut) - 1 + 2 * q
            ok = length >= max(LEAST_WORDS, POWER * q)
            out.append((origin[found[cut[:-1]][ok]], length[ok], np.full(int(ok.sum()), q)))
        if not len(classes.asked) and not classes.due:
            break
        classes.refine()
        if classes.alive * 4 < swept * 3:
            classes.sweep()
            swept = classes.alive
    if not out:
        return none, none, none
    start, length, period = (np.concatenate(x) for x in zip(*out, strict=True))
    o = np.lexsort((period, start))
    return start[o], length[o], period[o]


def repeat_tail(cut: np.ndarray, doc_ids: list) -> np.ndarray:
    """The word that stands at each place once the documents chosen by their doc_id repeat a piece of themselves to their end."""
    source = np.arange(int(cut[-1]))
    for i, d in enumerate(doc_ids):
        n = int(cut[i + 1] - cut[i])
        if d is None or not n:
            continue
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[cut[i] + a : cut[i + 1]] = cut[i] + a + np.arange(n - a) % p
    return source


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    raw = data.tobytes()
    return b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


_COLUMNS = "doc_id {0}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _rows(part: pa.RecordBatch, data: np.ndarray, at: np.ndarray, repeated: bool, texts: bool) -> pa.RecordBatch:
    starts, ends, row = word_bounds(data, at, BLANK)
    cut = np.searchsorted(row, np.arange(part.num_rows + 1))
    ids, doc_ids = word_hashes(data, starts, ends), part.column(0).to_pylist()
    source = repeat_tail(cut, doc_ids) if repeated else np.arange(len(ids))
    starts, ends, ids = starts[source], ends[source], ids[source]
    places, parts = _level_one(ids, row)
    if not _same_words(data, starts[places], ends[places], ids[places]):  # two words with one hash
        raw, known = data.tobytes(), {}
        ids = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
        places, parts = _level_one(ids, row)
    start, length, period = find_runs(ids, places, parts)
    of = np.searchsorted(start, cut)
    changed = np.zeros(len(ids) + 1, np.int64)  # +1 where words begin to be dropped, -1 where that ends
    np.add.at(changed, start + period, 1)
    np.add.at(changed, start + length, -1)
    dropped = np.cumsum(changed)[:-1] > 0
    # of a text that stays, blanks between words become one space and others go
    tail = word_bounds(data, at, BLANK)[1] if repeated else ends
    joints = tail[:-1][row[1:] == row[:-1]]
    keep = ~BLANK[data]
    keep[joints] = True
    squeezed = data.copy()
    squeezed[joints] = 0x20
    edge = np.r_[0, np.cumsum(keep)][at]
    squeezed = squeezed[keep].tobytes()
    out = []
    for i, d in enumerate(doc_ids):
        a, b = of[i], of[i + 1]
        lo, hi = cut[i], cut[i + 1]
        found = [(int(s - lo), int(n), int(q)) for s, n, q in zip(start[a:b], length[a:b], period[a:b], strict=True)]
        if found or (repeated and hi > lo and (source[lo:hi] != np.arange(lo, hi)).any()):
            kept = np.flatnonzero(~dropped[lo:hi]) + lo
            text = _joined(data[at[i] : at[i + 1]], starts[kept] - at[i], ends[kept] - at[i])
        else:
            text = squeezed[edge[i] : edge[i + 1]]
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        out.append(
            (d, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
            + ((found, text.decode("utf-8", "replace")) if texts else (None, None))
        )
    columns = list(zip(*out, strict=True))
    kinds = [part.schema.field(0).type, *[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.large_string()]
    columns[8] = [None if r is None else [dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in columns[8]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"])


def scan(batches: Iterator[pa.RecordBatch], repeated: bool, texts: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in runs(batch, limit=TOGETHER_BYTES):
            yield _rows(part, data, at, repeated, texts)


def periodic_runs(docs: DataFrame, repeated: bool = False, texts: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its runs and the digests of what is left when each run keeps its first period.

    Words are runs without blanks, as they are. A run is a stretch of words with smallest period q, at least six words and four periods
    long, that no neighbouring word extends. start, length, period and exponent_milli are the longest run's (the first, then that of the
    smallest period, among equals), null where there is none. With ``repeated`` the documents whose doc_id's CRC32 ends in 0 first repeat
    a piece of themselves, as the query of this operator asks; a null doc_id never does. With ``texts`` the runs and the collapsed text
    themselves come too. Null, empty and blank texts have no words and no run; texts of any length are read whole. Repeated rows and
    null ids each give a row. Other columns are not read. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    base = pick(docs, "doc_id", "text")
    schema = _COLUMNS.format(base.schema["doc_id"].dataType.simpleString())

    out = base.mapInArrow(lambda batches: scan(batches, repeated, texts), schema)
    return out if texts else out.drop("runs", "collapsed")


def runs_of_words(words: list) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one list of hashable words, on the driver; for small inputs."""
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    return [tuple(map(int, r)) for r in zip(*find_runs(ids, *_level_one(ids, np.zeros(len(ids), np.int64))), strict=True)]
