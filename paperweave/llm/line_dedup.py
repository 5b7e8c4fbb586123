"""Line deduplication over levelled sorted runs; DataFrame functions only.

A run is a table of line hashes, bucketed and sorted by hash, with the number of documents that hold the line and the largest doc_id
among them. Each batch of documents is merge-anti-joined with the runs: lines that no run has become a run of their own, so that a
line is in one run only, and further holders of known lines go to a table beside. Runs of a level are compacted into one run of the next
level once there are ``fanout`` of them. Only hashes move; texts stay put until lines are cut out of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import lower_ascii, pick
from .scratch import Scratch

BLANKS = " \t\n\x0b\x0c\r"
MIN_POINTS, MIN_DOCS = 40, 5
#: Batches of documents at least; lines of a batch, and of a bucket of a run, at most; slots by which a text's dropped lines are looked up.
BATCHES, BATCH_LINES, BUCKET_LINES, SLOTS = 4, 200_000_000, 2_000_000, 256


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits, so that two lines of a corpus do not meet by chance."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_line_hashes(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, h1, h2): each long line of a row once."""
    keys = F.transform(text_lines(F.col("text")), line_key)
    hashes = F.array_distinct(F.transform(F.filter(keys, lambda k: F.char_length(k) >= min_points), key_hash))
    return pick(docs, "doc_id", "text").select("doc_id", F.explode(hashes).alias("h")).select("doc_id", "h.h1", "h.h2")


class LineRuns:
    """The runs of one corpus. ``add`` takes a batch of (doc_id, h1, h2); ``lines`` is the merged view.

    All tables have the same buckets, so that anti-joins deal no rows out again.
    """

    def __init__(self, scratch: Scratch, fanout: int = 3, buckets: int | None = None):
        self.scratch, self.fanout = scratch, fanout
        self.buckets = buckets or int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.holders: list[DataFrame] = []

    def _store(self, name: str, rows: DataFrame) -> DataFrame:
        return self.scratch.write_bucketed(name, rows.select("h1", "h2", "docs", "last"), self.buckets, "h1", "h2")

    def _runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """The batch's lines that no run has as a run, and its holders of other lines."""
        own = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
        if not self._runs():
            self.levels[0].append(self._store("run", own))
            return
        own = self._store("batch", own)
        fresh = self._store("run", self._fresh(own))
        self.holders.append(self._store("holders", self._unseen(own, fresh)))
        self.levels[0].append(fresh)
        self.scratch.drop(own)
        self._compact()

    def _fresh(self, rows: DataFrame) -> DataFrame:
        """The rows whose line no run has."""
        for run in self._runs():
            rows = self._unseen(rows, run)
        return rows

    @staticmethod
    def _unseen(rows: DataFrame, run: DataFrame) -> DataFrame:
        return rows.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._store("run", self._together(runs)))  # no line is in two of them
            self.scratch.drop(*runs)
            level += 1

    def _together(self, tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self.scratch.plain, tables))

    def lines(self) -> DataFrame:
        """(h1, h2, docs, last) of every line of every run, its further holders counted in."""
        known = self._together(self._runs())
        if not self.holders:
            return known
        more = self._together(self.holders).groupBy("h1", "h2").agg(F.sum("docs").alias("more"), F.max("last").alias("later"))
        both = known.join(more.hint("merge"), ["h1", "h2"], "left")
        return both.select("h1", "h2", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("last", "later").alias("last"))

    def clear(self) -> None:
        self.scratch.drop(*self._runs(), *self.holders)
        self.levels, self.holders = [[]], []


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped, kept_text.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of ``min_points`` code points or more that
    ``min_docs`` rows hold lose their lines but in the largest doc_id holding them (there all of them stay, repeats included). A null
    or empty text is one empty line. A null doc_id never is the largest unless all holders' are null. Rows repeating a doc_id count
    as documents of their own and lose the same lines. Other columns are not read. An empty table gives no rows.

    Documents come in ``batches`` by a hash of doc_id, more where a batch would have over ``BATCH_LINES`` lines.
    """
    scratch = Scratch(docs.sparkSession)
    lines = scratch.write("lines", long_line_hashes(docs, min_points))
    n = lines.count()
    batches = max(batches, -(-n // BATCH_LINES))
    parts = scratch.write("parts", lines.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "part")
    runs = LineRuns(scratch, fanout, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_LINES)))
    for b in range(batches):
        runs.add(parts.where(F.col("part") == b))
    common = scratch.write("common", runs.lines().where((F.col("docs") >= min_docs) & F.col("last").isNotNull()))
    runs.clear()
    drops = lines.join(common, ["h1", "h2"]).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
    # a map of sets by part of the hash, so that lines of a text that loses many are found without comparing them with each of these
    slots = drops.groupBy("doc_id", F.pmod("h1", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.collect_set(F.struct("h1", "h2")).alias("set"))
    drops = scratch.write("drops", slots.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "set"))).alias("gone")))
    scratch.drop(lines, parts, common)
    # the same join at every size; left to itself it is a broadcast on small tables only
    d = pick(docs, "doc_id", "text").alias("d").join(drops.hint("merge").alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")), "left")
    parts = text_lines(F.col("text"))

    def stays(line: Column) -> Column:
        key = line_key(line)
        held = F.element_at(F.col("gone"), F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int"))
        return ~((F.char_length(key) >= min_points) & F.coalesce(F.array_contains(held, key_hash(key)), F.lit(False)))

    d = d.select("d.doc_id", "text", "gone", F.size(parts).cast("long").alias("n_lines"))
    kept = F.when(F.col("gone").isNull(), F.split(F.lit(""), "\n")).otherwise(F.filter(parts, stays))
    d = d.select("doc_id", "text", "gone", "n_lines", kept.alias("kept"))
    return d.select(
        "doc_id",
        "n_lines",
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join("kept", "\n")).alias("kept_text"),
    )
