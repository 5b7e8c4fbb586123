"""Versioned dimension merge by attribute decomposition.

Changes of an entity set attributes at times. Each attribute, and deletion, becomes a timeline of its own: the times at which it is set, with
equal consecutive values coalesced. The ends of all timelines are united, and at each of them the timelines are combined as of that time.
Equal consecutive combined states are coalesced again, and what remains are the versions.

Nothing here needs an entity in one task. Rows are put in order by ranges of (entity, time), and each range is a part. Within a part a
window gives what came before; what came before the part is the last of what the entity's earlier parts ended with, one row a part and
entity, of which an entity has at most as many as there are parts. All steps are joins, groupings and windows; nothing is broadcast or
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick
from .scratch import Scratch

#: Parts for each shuffle partition, so that parts of one entity spread evenly.
PARTS = 2
ATTRIBUTES = ("source", "segment", "city", "balance_cents")
COLUMNS = ("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")


def micros(frame: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp, which is taken as UTC where it has no zone."""
    c = F.col(name)
    if frame.schema[name].dataType.typeName() == "timestamp":
        return F.unix_micros(c)
    whole = F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return whole * 1_000_000 + (F.expr(f"extract(SECOND FROM {name})") * 1_000_000).cast("long")


class Parts:
    """Rows in the order of key columns and then of order columns, in parts of about equal numbers of rows.

    Key columns must not be null. ``running`` adds, for each of some columns, its last non-null value before a row within the row's key.
    """

    def __init__(self, scratch: Scratch, frame: DataFrame, keys: list[str], order: list[str]):
        self.scratch, self.keys, self.order = scratch, keys, order
        n = PARTS * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # a written table: the parts are the same whoever reads it
        self.rows = scratch.write("placed", frame.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))

    def _ends(self, frame: DataFrame, columns: dict[str, str], back: bool = False) -> DataFrame:
        """(keys, _part, names of ``columns``): for each key and part the last non-null value in the key's earlier parts, or the first in
        its later ones. ``columns`` has the aggregate of a part by the column's name."""
        found = frame.groupBy(*self.keys, "_part").agg(*[F.expr(e).alias(c) for c, e in columns.items()])
        w = Window.partitionBy(*self.keys).orderBy(F.desc("_part") if back else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
        return found.select(*self.keys, "_part", *[F.last(c, True).over(w).alias(c) for c in columns])

    def within(self) -> Window:
        return Window.partitionBy(*self.keys, "_part").orderBy(*self.order)

    def before(self, frame: DataFrame, columns: list[str]) -> DataFrame:
        """The rows with columns _before_<c>: c's last non-null value in the rows before."""
        latest = {c: f"max_by({c}, struct({', '.join(self.order)})) FILTER (WHERE {c} IS NOT NULL)" for c in columns}
        came = self._ends(frame, latest).withColumnsRenamed({c: f"_came_{c}" for c in columns})
        w = self.within().rowsBetween(Window.unboundedPreceding, -1)
        out = frame.join(came.hint("merge"), [*self.keys, "_part"])
        return out.select(*frame.columns, *[F.coalesce(F.last(c, True).over(w), F.col(f"_came_{c}")).alias(f"_before_{c}") for c in columns])


def _kept(changes: DataFrame) -> DataFrame:
    """Of equal seq the largest change_id, then of equal times the largest seq. Whatever else ties, the largest values stay."""
    rest = ["op", *ATTRIBUTES]
    last = F.max(F.struct("change_id", "at", *rest)).alias("s")
    by_seq = changes.where("op IN ('D', 'I', 'U')").groupBy("_who", "_none", "seq").agg(last).select("_who", "_none", "seq", "s.*")
    last = F.max(F.struct("seq", "change_id", *rest)).alias("s")
    return by_seq.groupBy("_who", "_none", "at").agg(last).select("_who", "_none", "at", "s.seq", *[f"s.{c}" for c in rest])


def timelines(kept: DataFrame, scratch: Scratch) -> DataFrame:
    """(_who, _none, name, at, value): the coalesced timeline of deletion and of each attribute, values as text in ``value.v``.

    A deletion sets every attribute to null, an insert sets every attribute, an update those that it has.
    """
    gone = F.col("op") == "D"
    one = [F.struct(F.lit("is_deleted").alias("name"), F.struct(gone.cast("string").alias("v")).alias("value"))]
    for a in ATTRIBUTES:
        value = F.when(~gone, F.col(a).cast("string"))
        one.append(F.when((F.col("op") != "U") | value.isNotNull(), F.struct(F.lit(a).alias("name"), F.struct(value.alias("v")).alias("value"))))
    rows = kept.select("_who", "_none", "at", F.inline(F.filter(F.array(*one), lambda x: x.isNotNull())))
    parts = Parts(scratch, rows, ["_who", "_none", "name"], ["at"])
    rows = parts.before(parts.rows, ["value"])
    # nothing before is null for an attribute, and neither value for deletion
    same = F.when(F.col("_before_value").isNull(), (F.col("name") != "is_deleted") & F.col("value.v").isNull())
    same = same.otherwise(F.col("value.v").eqNullSafe(F.col("_before_value.v")))
    return rows.where(~same).select("_who", "_none", "name", "at", "value")


def merge_versions(changes: DataFrame, early_hours: int = 0, early_every: int = 3) -> DataFrame:
    """One row per version of each client in ``changes`` (change_id, client_id, seq, op, valid_at, source, segment, city, balance).

    Rows without valid_at do not count, identical rows count once. With ``early_hours`` the rows whose change_id's CRC32 divides by
    ``early_every`` are valid so many hours earlier. Of a client's rows of equal seq the one with the largest change_id stays, of those
    left at one time the one with the largest seq. D deletes, I sets all attributes, U those it does not leave null; rows with another op
    or none set nothing and take part in nothing but n_changes. Consecutive equal states are one version, which lasts until the next:
    version (from 1), valid_from and valid_to in seconds (end exclusive, null if open), is_deleted, source, segment, city, balance_cents,
    first_seq, n_changes (distinct change_ids, dropped ones too, valid within).

    Null clients are one client, null seqs are equal and below others, so are null change_ids, which do not count and are never early.
    Of rows alike in all that decides, the one with the largest op and attributes stays. A balance that is not finite counts as null.
    Extra columns are not read. An empty table gives none.
    """
    scratch = Scratch(changes.sparkSession)
    rows = pick(changes, *COLUMNS)
    at = micros(rows, "valid_at")
    if early_hours:
        early = F.col("change_id").isNotNull() & (F.crc32(F.col("change_id").cast("string").cast("binary")) % early_every == 0)
        at = at - F.when(F.coalesce(early, F.lit(False)), early_hours * 3_600_000_000).otherwise(0)
    cents = F.when(F.abs("balance") < 9e15, F.floor(F.lit(100) * F.col("balance") + F.lit(0.5)).cast("long"))
    rows = rows.where("valid_at IS NOT NULL").select(
        F.coalesce("client_id", F.lit(0)).alias("_who"), F.col("client_id").isNull().alias("_none"), "change_id", "seq", "op", at.alias("at"), "source", "segment", "city", cents.alias("balance_cents")
    )
    rows = rows.distinct()
    kept = scratch.write("kept", _kept(rows))

    lines = timelines(kept, scratch)
    # the ends of all timelines, each with what begins there; the change that stands there; and all changes, to be counted
    names = ["is_deleted", *ATTRIBUTES]
    ends = lines.groupBy("_who", "_none", "at").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in names])
    ends = ends.withColumn("kind", F.lit(0)).withColumn("id", F.lit(None).cast(changes.schema["change_id"].dataType))
    counted = rows.select("_who", "_none", "at", *[F.lit(None).cast("struct<v:string>").alias(c) for c in names], F.lit(1).alias("kind"), F.col("change_id").alias("id")).where("id IS NOT NULL").distinct()
    parts = Parts(scratch, ends.unionByName(counted), ["_who", "_none"], ["at", "kind", "id"])
    state = parts.before(parts.rows, names)
    # as of each end: what begins there, else what was before
    for c in names:
        state = state.withColumn(c, F.coalesce(c, f"_before_{c}"))
    unlike = F.lit(False)
    for c in names:
        unlike = unlike | ~F.col(f"{c}.v").eqNullSafe(F.col(f"_before_{c}.v"))
    begins = F.when((F.col("kind") == 0) & (F.col("_before_is_deleted").isNull() | unlike), F.col("at"))
    state = scratch.write("states", state.select("_who", "_none", "_part", "at", "kind", "id", *[F.when(F.col("kind") == 0, F.col(c)).alias(c) for c in names], begins.alias("begins")))

    # numbers, and ends of versions
    sums = state.where("begins IS NOT NULL").groupBy("_who", "_none", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("begins").alias("_first"))
    every = state.select("_who", "_none", "_part").distinct().join(sums.hint("merge"), ["_who", "_none", "_part"], "left")
    over = Window.partitionBy("_who", "_none").orderBy("_part")
    earlier, later = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    around = every.select("_who", "_none", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_done"), F.first("_first", True).over(later).alias("_next"))
    w = parts.within()
    here = state.join(around.hint("merge"), ["_who", "_none", "_part"])
    here = here.withColumn("version", (F.col("_done") + F.count("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))
    here = here.withColumn("until", F.coalesce(F.first("begins", True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("_next")))
    here = scratch.write("numbered", here.select("_who", "_none", "at", "kind", "id", *names, "begins", "version", "until"))

    within = here.where("kind = 1 AND version > 0").select("_who", "_none", "version", "id").distinct()
    n_changes = within.groupBy("_who", "_none", "version").agg(F.count(F.lit(1)).alias("n_changes"))
    first = here.where("begins IS NOT NULL").join(kept.select("_who", "_none", "at", "seq").hint("merge"), ["_who", "_none", "at"])
    out = first.join(n_changes.hint("merge"), ["_who", "_none", "version"], "left")
    seconds = lambda c: F.floor(F.col(c) / F.lit(1_000_000)).cast("long")
    return out.select(
        F.when(~F.col("_none"), F.col("_who")).alias("client_id"), "version", seconds("begins").alias("valid_from"), seconds("until").alias("valid_to"), F.col("is_deleted.v").cast("boolean").alias("is_deleted"),
        *[F.col(f"{c}.v").alias(c) for c in ATTRIBUTES[:3]], F.col("balance_cents.v").cast("long").alias("balance_cents"), F.col("seq").alias("first_seq"), F.coalesce("n_changes", F.lit(0).cast("long")).alias("n_changes"),
    )
