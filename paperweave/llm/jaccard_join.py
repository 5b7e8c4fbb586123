"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their hashes, and fragments are ranges of it. Two sets that are as similar as asked differ in
few n-grams, so all but few of the fragments that a set fills are the same in both. A set that shares fewer of its fragments with any
other set has no link and is left out. Of the others a fragment prefix suffices: with fragments in order of how many sets share them, the
rarest, as many as may differ and one more, hold one that both sets have. Sets that meet in such a fragment are candidates, so a passage
that many documents share brings nothing together unless it is nearly all they have. Candidates are compared fragment by fragment:
overlaps are counted apart and summed per pair.

Equal sets are one set throughout, told by 128 bits. A fragment with many sets is split into cells of bounded size. In the first rounds
each set is compared with one other at most, whatever number of cells it is in: the nearest, by sketches, of the cells' leaders, then of the
nearest in each cell, then of one drawn in each. Pairs between sets that are linked already are never formed; what remains between
different components is compared in full in the end, so groups of copies cost their size and no link between components is lost.
Sketches are parities: two differ in no more bits than the sets do in n-grams, and in nearly as many where they are wide enough, so hardly
any pair is formed but those that are similar, however many sets that are not share a cell.
By then a fragment that many sets share is no cell any more: two similar sets have as many fragments in
common as either needs, so prefixes longer by one hold the two rarest of them, and sets meet in a pair of fragments instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .frames import pick
from .scratch import Scratch
from .textops import BLANK, LOWER, U, mix, row_slices, runs, shingles, signed, word_bounds, word_hashes

#: Ranges of the n-gram order in which overlaps are counted apart.
FRAGMENTS = 8
#: Bits of a sketch at most, in the first round and in later ones; the places of both among a set's rows.
COARSE, FINE = 1024, 4096
COARSE_ROW, FINE_ROW = -2, -1
#: Up to this size, as a power of two, every n-gram is a fragment of its own.
SMALL = 7
#: Sets sharing a fragment beyond which their number is not counted further; sets in a cell, in which candidates are sought.
COMMON, CELL = 1024, 4096
#: Sets that a task remembers having sent.
SEEN = 1_000_000
#: Fragments beyond the prefix that are kept, to tell apart the sets of a fragment that many share.
EXTRA = 2
#: Rounds of comparing: with one other set each, chosen as told, and in the end with all sets that the sizes allow.
ROUNDS = (LEADER, NEAREST, DRAWN, ALL) = ("leader", "nearest", "drawn", "all")


def gram_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows, and each row's sorted distinct n-gram hashes; a text of fewer than k words is one n-gram."""
    for part, data, at in runs(batch):
        low = LOWER[data]
        starts, ends, rows = word_bounds(low, at, BLANK)
        w = word_hashes(low, starts, ends)
        cut = row_slices(rows, part.num_rows)
        h = shingles(w, k)
        out = []
        for i in range(part.num_rows):
            a, b = cut[i], cut[i + 1]
            if b - a >= k:
                out.append(np.unique(h[a : b - k + 1]))
            else:
                out.append(shingles(w[a:b], int(b - a)) if b > a else np.zeros(0, U))
        yield part, out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, of its size too."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (U(0), U(0xA0761D6478BD642F)):
            m = mix(s ^ salt)
            out.append(int(signed(mix(np.array([m.sum(dtype=U) ^ (np.bitwise_xor.reduce(mix(m + U(len(s)))) if len(s) else U(0))], U)))[0]))
    return out[0], out[1]


class Similarity:
    """Jaccard similarity of at least a ratio, and what it implies, in integers."""

    def __init__(self, least: Fraction):
        self.num, self.den = least.numerator, least.denominator
        #: of the sets' sizes together, at most this part differs: (1 - t) / (1 + t)
        self.part = Fraction(self.den - self.num, self.den + self.num)

    def differ(self, a: int, b: int) -> int:
        """How many elements one of two similar sets has and the other lacks, at most."""
        return (a + b) * self.part.numerator // self.part.denominator

    def largest(self, n: int) -> int:
        """The size of the largest set similar to one of n."""
        return n * self.den // self.num

    def spread(self, n: int) -> int:
        return self.differ(n, self.largest(n))

    def similar(self, common, total):
        """Whether ``common`` shared of sizes adding to ``total`` suffice."""
        return self.den * common >= self.num * (total - common)


def signatures(s: np.ndarray, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the set's fragments, for each class of sizes that a similar set of at least its own size may be in, and with each key
    how many of the class's keys any set similar to it in that class must have too.

    Sizes from 2^c to 2^(c+1) are a class with a number of fragments of its own, chosen so that far more are filled than may differ; c
    stands in the lowest 6 bits of the key. Two similar sets have a fragment in common if either fills more than may differ. Where hashes
    are so uneven that a set does not, it takes every n-gram as a fragment besides, as a class of its own; another such set does too.
    """
    n = len(s)
    keys, needs = [], []
    ratio = float(sim.part) * (1 + sim.den / sim.num)
    with np.errstate(over="ignore"):
        sums = np.r_[U(0), np.cumsum(mix(s), dtype=U)]

        def add(frag: np.ndarray, c: int, differ: int) -> bool:
            new = np.flatnonzero(np.r_[True, frag[1:] != frag[:-1]])
            end = np.r_[new[1:], n]
            key = mix(sums[end] - sums[new] + mix(frag[new] * U(64) + U(c)) + (end - new).astype(U))
            keys.append((key & ~U(63)) | U(c))
            needs.append(np.full(len(new), max(1, len(new) - differ)))
            return len(new) > differ

        for c in range(n.bit_length() - 1, sim.largest(n).bit_length()):
            differ = sim.differ(n, min(sim.largest(n), (2 << c) - 1))
            m = int(np.ceil((1 << c) * 2 * ratio / 0.75))
            if c < SMALL or not add(((s >> U(32)) * U(m)) >> U(32), c, differ):
                add(s, c + 32, differ)
    return np.concatenate(keys), np.concatenate(needs)


def parities(s: np.ndarray, sim: Similarity, most: int) -> np.ndarray:
    """For each of so many residues of the n-grams' hashes whether it is that of an odd number of them, as bits of 64-bit words.

    An n-gram that one of two sets lacks turns one bit, so two sketches differ in no more bits than the sets in n-grams. There are 4 to 8
    bits for each n-gram of the largest similar set, a power of two from 64 to ``most``. The halves' differences are the narrower sketch.
    """
    bits = min(most, max(64, 4 << sim.largest(len(s)).bit_length()))
    odd = np.bincount((mix(s) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def alike_wide(sketches: list[bytes]) -> np.ndarray:
    """A row for each sketch, all as wide as the narrowest."""
    least = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), least), U)
    for i, b in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(b, U).reshape(-1, least), axis=0)
    return out


# ---- scans ------------------------------------------------------------------------------------------------------------------


def _keys(sets: list[np.ndarray]) -> list[pa.Array]:
    found = [set_key(s) for s in sets]
    return [pa.array([k[i] for k in found], pa.int64()) for i in (0, 1)]


def _profiles(base: DataFrame, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in gram_sets(batch, k):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *_keys(sets), pa.array([len(s) for s in sets], pa.int32())], ["doc_id", "k1", "k2", "n"]
                )

    return base.mapInArrow(scan, "doc_id long, k1 long, k2 long, n int")


def _signature_rows(base: DataFrame, k: int, sim: Similarity) -> DataFrame:
    """(sig, k1, k2, info) of every set that another one may be similar to; info has the set's size above and the need below 32 bits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, sets in gram_sets(batch, k):
                sigs, ones, twos, infos = [], [], [], []
                for s in sets:
                    # nothing but an equal set is similar to one too small to differ
                    if not len(s) or sim.spread(len(s)) == 0:
                        continue
                    key = set_key(s)
                    if key not in seen:
                        seen.add(key)
                        sig, need = signatures(s, sim)
                        sigs.append(sig)
                        ones.append(np.full(len(sig), key[0]))
                        twos.append(np.full(len(sig), key[1]))
                        infos.append((len(s) << 32) | need)
                if len(seen) > SEEN:
                    seen.clear()
                if sigs:
                    columns = [pa.array(np.concatenate(c)) for c in (ones, twos, infos)]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), *columns], ["sig", "k1", "k2", "info"])

    return base.mapInArrow(scan, "sig long, k1 long, k2 long, info long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sig, k1, k2: those of signatures that two sets have, each once, with the number of sets, ``COMMON`` at most.
    Fewer rows than that are carried on."""
    names = ["sig", "k1", "k2", "info"]
    carry, hot = [np.zeros(0, np.int64)] * 4, None  # hot: a signature known to be common

    def rows(c: list[np.ndarray], df: np.ndarray, ok: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(x[ok]) for x in c], pa.array(df[ok].astype(np.int32))], [*names, "df"])

    def counted(sig: np.ndarray) -> tuple[np.ndarray, int]:
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.r_[first, len(sig)])
        df = np.minimum(np.repeat(size, size), COMMON)
        if hot is not None and sig[0] == hot:
            df[: size[0]] = COMMON
        return df, int(first[-1])

    for batch in batches:
        c = [np.r_[a, batch.column(n).to_numpy()] for a, n in zip(carry, names, strict=True)]
        if not len(c[0]):
            continue
        fresh = np.r_[True, (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])]
        c = [x[fresh] for x in c]
        df, last = counted(c[0])
        if df[-1] == COMMON:
            hot, last = c[0][-1], len(df) - 1
        yield rows(c, df, (np.arange(len(df)) < last) & (df > 1))
        carry = [x[last:] for x in c]
    if len(carry[0]):
        df, _ = counted(carry[0])
        yield rows(carry, df, df > 1)


def _prefixes(shared: DataFrame) -> DataFrame:
    """(sig, k1, k2, n, class, place, need, extra): of each set and class with enough shared signatures the rarest ones, one of which any
    similar set has as well, and ``EXTRA`` more; with extra up to e, two similar sets have 1 + e in common where either needs as many."""
    need = F.col("info").bitwiseAND((1 << 32) - 1)
    of = Window.partitionBy("k1", "k2", F.col("sig").bitwiseAND(63))
    ranked = shared.withColumn("need", need).withColumn("_all", F.count(F.lit(1)).over(of)).withColumn("place", F.row_number().over(of.orderBy("df", "sig")))
    extra = F.greatest(F.col("place") + F.col("need") - F.col("_all") - 1, F.lit(0)).cast("int").alias("extra")
    ranked = ranked.where(F.col("need") <= F.col("_all")).select("sig", "k1", "k2", F.shiftright("info", 32).cast("int").alias("n"), F.col("sig").bitwiseAND(63).alias("class"), "place", "need", extra)
    return ranked.where(F.col("extra") <= EXTRA)


# ---- comparing --------------------------------------------------------------------------------------------------------------


def _sets_of(base: DataFrame, wanted: DataFrame, k: int, sim: Similarity, scratch: Scratch) -> DataFrame:
    """(key, frag, grams) of the wanted sets (k1, k2, key, own), from one document each, a row for each fragment that the set fills, and
    one for each of its two sketches."""
    edges = np.array([(f << 64) // FRAGMENTS for f in range(1, FRAGMENTS)], U)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in gram_sets(batch, k):
                rows = []
                for s in sets:
                    parts = [*enumerate(np.split(s, np.searchsorted(s, edges))), (COARSE_ROW, parities(s, sim, COARSE)), (FINE_ROW, parities(s, sim, FINE))]
                    key = set_key(s)
                    rows.extend((*key, f, x.tobytes()) for f, x in parts if len(x))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["k1", "k2", "frag", "grams"])

    ids = wanted.select(F.col("own").alias("_own")).distinct()  # null where no document of a set has an id: those are all looked at
    found = base.join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_own")), "left_semi").mapInArrow(scan, "k1 long, k2 long, frag int, grams binary")
    return scratch.write("sets", found.join(wanted.select("k1", "k2", "key").hint("merge"), ["k1", "k2"]).select("key", "frag", "grams").dropDuplicates(["key", "frag"]))


def _finer(rows: DataFrame, kept: DataFrame, scratch: Scratch, cell: int | None = None) -> DataFrame:
    """``rows`` (sig, key, n, label, class, place, need) with signatures that more than ``cell`` sets of several labels share replaced.

    Instead a set has such a signature together with each of its later ones in a prefix longer by one, and so on for ``EXTRA`` times.
    Sets that need fewer signatures than are asked of them keep the signature itself, to meet among themselves.
    """
    cell = CELL if cell is None else cell
    out, columns = None, rows.columns
    for depth in range(1, EXTRA + 1):
        many = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where((F.col("_n") > cell) & (F.col("_lo") != F.col("_hi")))
        many = scratch.write("many", many.select(F.col("sig").alias("_s")))
        if not many.head(1):
            break
        hot = rows.join(many.hint("merge"), F.col("sig") == F.col("_s"), "left_semi")
        cold = rows.join(many.hint("merge"), F.col("sig") == F.col("_s"), "left_anti").unionByName(hot.where(F.col("need") <= depth))
        out = cold if out is None else out.unionByName(cold)
        later = kept.where(F.col("extra") <= depth).select(F.col("key").alias("_k"), F.col("class").alias("_c"), F.col("place").alias("_p"), F.col("sig").alias("_later"))
        both = hot.join(later.hint("merge"), (F.col("key") == F.col("_k")) & (F.col("class") == F.col("_c")) & (F.col("place") < F.col("_p")))
        rows = both.withColumn("sig", F.xxhash64("sig", "_later")).withColumn("place", F.col("_p")).select(*columns)
        rows = scratch.write("finer", rows)
    return rows if out is None else out.unionByName(rows)


def _cells(rows: DataFrame, full: bool) -> DataFrame:
    """Of (sig, key, n, label): the rows of signatures with more than one label, with the cell (sig, i, j) in which they are compared.

    Signatures of up to ``CELL`` sets are one cell. Those of more are dealt into blocks, each a cell of its own; with ``full`` every two
    blocks are a cell besides, in which sets of different blocks meet.
    """
    many = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo != _hi")
    rows = rows.join(many.select(F.col("sig").alias("_s"), F.ceil(F.col("_n") / CELL).cast("int").alias("_blocks")).hint("merge"), F.col("sig") == F.col("_s"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("key", "sig"), F.col("_blocks")).cast("int"))
    if full:
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    else:
        rows = rows.withColumn("j", F.col("i"))
    return rows.select("sig", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "key", "n", "label")


def _candidates(rows: DataFrame, sketches: DataFrame, sim: Similarity, how: str) -> DataFrame:
    """Of (sig, key, n, label): pairs (a, b, na, nb, apart) within a cell whose labels differ and whose sizes and sketches allow similarity.

    Sketches (key, sketch) differ in so many bits, apart, which bounds the sets' difference from below. In each cell a set is paired with
    the first leader that passes, or leads itself, with the ``NEAREST`` of the sets before it, with one ``DRAWN``, or with ``ALL`` of them.
    """

    def group(block: np.ndarray, key: np.ndarray, n: np.ndarray, label: np.ndarray, x: np.ndarray, apart: bool) -> Iterator[tuple]:
        n = n.astype(np.int64)  # sorted, so that sets too small for another lie before a place
        least = np.searchsorted(n * sim.den, n * sim.num, "left")
        lead = np.zeros(len(key), np.int64)
        leaders = 0
        for i in range(len(key)):
            before = lead[np.searchsorted(lead[:leaders], least[i]) : leaders] if how == LEADER else np.arange(least[i], i)
            j = before[(label[before] != label[i]) & ((block[before] != block[i]) | (not apart))]
            d = np.bitwise_count(x[j] ^ x[i]).sum(1, dtype=np.int64)
            passed = d <= (n[j] + n[i]) * sim.part.numerator // sim.part.denominator
            j, d = j[passed], d[passed]
            if how == LEADER and not len(j):
                lead[leaders] = i
                leaders += 1
            if how != ALL and len(j):
                one = 0 if how == LEADER else int(np.argmin(d if how == NEAREST else mix(key[j].view(U) ^ U(key[i].view(U)))))
                j, d = j[one : one + 1], d[one : one + 1]
            for m, e in zip(j.tolist(), d.tolist(), strict=True):
                p, q = (m, i) if key[m] < key[i] else (i, m)
                yield key[p], key[q], n[p], n[q], e

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*found, strict=True)) or [()] * 5
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.array(v, np.int64).astype(t)) for v, t in zip(c, kinds, strict=True)], ["a", "b", "na", "nb", "apart"])

    def cells(c: list) -> Iterator[pa.RecordBatch]:
        sig, lo, hi = c[:3]
        cut = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True])
        found: list[tuple] = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if (c[6][i:j] != c[6][i]).any():
                for one in group(*(y[i:j] for y in c[3:7]), alike_wide(c[7][i:j].tolist()), lo[i] != hi[i]):
                    found.append(one)
                    if len(found) >= 20_000:
                        yield batch_of(found)
                        found = []
        yield batch_of(found)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            c = [batch.column(y).to_numpy() for y in ("sig", "lo", "hi", "i", "key", "n", "label")]
            c.append(np.array([*batch.column("sketch").to_pylist(), None], object)[:-1])
            if held is not None:
                c = [np.r_[a, b] for a, b in zip(held, c, strict=True)]
            if not len(c[0]):
                continue
            same = (c[0] == c[0][-1]) & (c[1] == c[1][-1]) & (c[2] == c[2][-1])
            last = int(np.argmax(same))
            if last:
                yield from cells([y[:last] for y in c])
            held = [y[last:] for y in c]
        if held is not None:
            yield from cells(held)

    # by a hash of the cell: dealt by sig itself, a join below would stand in for the exchange and the sort, and may be replaced as it runs
    cells_of = _cells(rows, how == ALL).join(sketches.hint("merge"), "key").select("sig", "lo", "hi", "i", "key", "n", "label", "sketch")
    dealt = cells_of.repartition(F.xxhash64("sig", "lo", "hi")).sortWithinPartitions("sig", "lo", "hi", "n", "key")
    return dealt.mapInArrow(pair, "a long, b long, na int, nb int, apart int").distinct()


def _one_each(pairs: DataFrame) -> DataFrame:
    """Of the pairs of a set with sets before it, by size and key, over all cells: the one whose sketches are the least apart."""
    later = F.when(F.col("nb") >= F.col("na"), F.col("b")).otherwise(F.col("a"))  # a is the smaller key
    best = F.min_by(F.struct("a", "b", "na", "nb"), F.struct("apart", "a", "b"))
    return pairs.groupBy(later.alias("later")).agg(best.alias("pair")).select("pair.*")


def _split(rows: DataFrame) -> DataFrame:
    """The rows of signatures that sets of different labels share; labels only ever merge, so the others are done with."""
    many = rows.groupBy("sig").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo != _hi")
    return rows.join(many.select(F.col("sig").alias("_s")).hint("merge"), F.col("sig") == F.col("_s"), "left_semi")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by a, frag, with the row of a itself (b null) first: each b's overlap with a in the fragment."""
    own, of = np.zeros(0, U), None
    for batch in batches:
        a, b, n = [], [], []
        for x, y, f, g in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("frag").to_pylist(), batch.column("grams"), strict=True):
            s = np.frombuffer(g.as_py(), U)
            if y is None:
                own, of = s, (x, f)
            elif of == (x, f):  # else a has nothing in the fragment
                i = np.searchsorted(own, s)
                a.append(x)
                b.append(y)
                n.append(int((own[np.minimum(i, len(own) - 1)] == s).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "common"])


def _links(pairs: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """(a, b) of the pairs (a, b, na, nb) that are similar."""
    theirs = pairs.select("a", "b").join(sets.hint("merge"), F.col("b") == F.col("key")).select("a", "b", "frag", "grams")
    firsts = pairs.select("a").distinct().hint("merge")
    own = sets.join(firsts, F.col("key") == F.col("a"), "left_semi").select(F.col("key").alias("a"), F.lit(None).cast("long").alias("b"), "frag", "grams")
    both = theirs.unionByName(own).repartition(F.xxhash64("a", "frag"))
    dealt = both.sortWithinPartitions("a", "frag", F.col("b").asc_nulls_first())
    sums = dealt.mapInArrow(_overlaps, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
    return sums.join(pairs, ["a", "b"]).where(sim.similar(F.col("common"), F.col("na") + F.col("nb"))).select("a", "b")


def jaccard_components(docs: DataFrame, k: int = 3, least: Fraction | str | float = Fraction(9, 10)) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs without blanks, A-Z lower-cased; a row's set is its distinct k-word n-grams, or all its words as one n-gram where
    it has fewer. Rows link when their sets' Jaccard similarity is at least ``least``; component_id is the smallest doc_id that a row
    reaches. Null, empty and blank texts have the empty set and reach themselves only. A null doc_id is reached like others and is
    never the smallest unless there is no other. Repeated rows each give a row. Other columns are not read. An empty table gives none.
    """
    sim = Similarity(Fraction(str(least)) if isinstance(least, float) else Fraction(least))
    if 2 * sim.num <= sim.den:
        raise ValueError("sets that share no more than half of their n-grams have no fragment in common for sure")
    scratch = Scratch(docs.sparkSession)
    base = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    profiles = scratch.write("profiles", _profiles(base, k))
    firsts = profiles.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("own"))
    # a number for each set; written, so that it stays
    firsts = scratch.write("firsts", firsts.withColumn("key", F.monotonically_increasing_id()))
    dealt = _signature_rows(base, k, sim).repartition("sig").sortWithinPartitions("sig", "k1", "k2")
    shared = scratch.write("shared", dealt.mapInArrow(_shared, "sig long, k1 long, k2 long, info long, df int"))
    kept = _prefixes(shared).join(firsts.select("k1", "k2", "key").hint("merge"), ["k1", "k2"]).drop("k1", "k2")
    kept = scratch.write("prefixes", kept)
    scratch.drop(shared)
    rows = kept.where("extra = 0").drop("extra")
    wanted = firsts.join(rows.select("key").distinct().hint("merge"), "key", "left_semi")
    sets = _sets_of(base, wanted, k, sim, scratch)
    sketches = scratch.write("sketches", sets.where("frag < 0").withColumnRenamed("grams", "sketch"))
    labels, links, tried, spent = None, None, None, [kept, sets, sketches]
    # leaders settle most groups; what stays split is compared in the end with every set that its sizes allow
    for how in ROUNDS:
        if labels is None:
            named = rows.withColumn("label", F.col("key"))
        else:
            named = rows.join(labels.withColumnRenamed("node", "key").hint("merge"), "key", "left").withColumn("label", F.coalesce("label", "key"))
            named = scratch.write("split", _split(named))
            spent.append(named)
            rows = named.drop("label")
        narrow = sketches.where(F.col("frag") == (COARSE_ROW if how == LEADER else FINE_ROW)).drop("frag")
        pairs = _candidates(_finer(named, kept, scratch) if how == ALL else named, narrow, sim, how)
        # written: a pair is found in many cells, and the join below would else be done before they are made one
        pairs = scratch.write("pairs", pairs.drop("apart") if how == ALL else _one_each(pairs))
        spent.append(pairs)
        if tried is not None:
            pairs = scratch.write("untried", pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"))
            spent.append(pairs)
        if not pairs.head(1):
            continue
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        found = scratch.write("links", _links(pairs, sets.where("frag >= 0"), sim))
        spent.append(found)
        links = found if links is None else links.unionByName(found)
        labels = connected(links, scratch)
    scratch.drop(*spent)
    if labels is None:
        labels = firsts.select(F.col("key").alias("node"), F.col("key").alias("label")).limit(0)
    smallest = firsts.join(labels, F.col("key") == F.col("node"), "left").select("k1", "k2", "own", F.coalesce("label", "key").alias("label"))
    by_label = smallest.groupBy("label").agg(F.min("own").alias("component"))
    by_key = smallest.join(by_label, "label").select(F.col("k1").alias("of1"), F.col("k2").alias("of2"), "component")
    out = profiles.select("doc_id", "k1", "k2", "n").join(by_key, (F.col("k1") == F.col("of1")) & (F.col("k2") == F.col("of2")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
