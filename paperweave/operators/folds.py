"""Cross-validation folds and splits; row order is a key's order or that of a seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Ranges for each shuffle partition, in which rows are ranked in parallel.
RANGES = 4


def placed(rows: DataFrame, order: list[str], out: str = "_i") -> DataFrame:
    """Adds each row's place, from 0, in the order of columns, nulls first.

    Rows are dealt into ranges of all these columns by a sample, so neither outlying nor frequent values put many of them into one; they
    are ranked within their range, and the ranges' counts are added up. No task sees all rows.
    """
    n = max(16, RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # as files, since another run would sample anew
    parts = cut(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    firsts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    firsts = firsts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    # at most as many rows as ranges
    return parts.withColumn("_r", rank).join(F.broadcast(firsts), "_p").withColumn(out, F.col("_first") + F.col("_r") - 1).drop("_p", "_r", "_first")


#: Parts that the rows of one group are dealt over when they meet their group's bounds.
SALTS = 16


def placed_within(rows: DataFrame, group: str, order: list[str], out: str = "_i", size: str = "_n") -> DataFrame:
    """Adds each row's place in its group, from 0, in the order of columns, and the group's size; null is a group too.

    Rows are placed once for all groups, so that many tasks share a large group; what a group begins with is subtracted.
    """
    every = placed(rows, [group, *order], "_all").withColumn("_s", F.pmod(F.col("_all"), F.lit(SALTS)))
    spans = every.groupBy(F.col(group).alias("_g")).agg(F.min("_all").alias("_first"), F.count(F.lit(1)).alias(size))
    spans = spans.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = every.join(spans, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t")))
    return met.withColumn(out, F.col("_all") - F.col("_first")).drop("_all", "_s", "_g", "_t", "_first")


def counted(rows: DataFrame, out: str = "_n") -> DataFrame:
    """Adds the number of rows."""
    return rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias(out))))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds a rank in a reproducible random order."""
    return placed(rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), ["_h", key], "rank").drop("_h")


def chunk_folds(rows: DataFrame, order: list[str], n: int, merge_last: bool = True) -> DataFrame:
    """Adds ``fold``: chunks of size N div n in an order that an integer column leads. With merge_last the last of more than n chunks
    joins the one before it.

    Only the very last chunk is merged, so few rows can leave more than n folds; fewer rows than folds is an error.
    """
    ranked = counted(placed(rows, order)).withColumn("_c", F.floor(F.col("_n") / n))
    chunks = F.ceil(F.col("_n") / F.col("_c"))
    fold = F.floor(F.col("_i") / F.col("_c"))
    if merge_last:
        fold = F.least(fold, F.when(chunks > n, chunks - 2).otherwise(chunks - 1))
    return ranked.withColumn("fold", fold.cast("long")).drop("_i", "_c", "_n")


def stratified_folds(rows: DataFrame, label: str, order: list[str], n: int, filler: object, size: int) -> DataFrame:
    """Adds ``fold``: every class but the filler is chunked over n folds; the filler tops each fold up to ``size``, the last takes the rest.

    An integer column leads the order.
    """
    others = placed_within(rows.where(F.col(label) != F.lit(filler)), label, order)
    per = F.greatest(F.floor(F.col("_n") / n), F.lit(1))
    others = others.withColumn("fold", F.least(F.floor(F.col("_i") / per), F.lit(n - 1)).cast("long")).drop("_i", "_n")
    have = others.groupBy("fold").agg(F.count(F.lit(1)).alias("have"))
    folds = rows.sparkSession.range(n).select(F.col("id").alias("fold")).join(have, "fold", "left").withColumn("room", F.greatest(F.lit(size) - F.coalesce("have", F.lit(0)), F.lit(0)))
    ends = folds.withColumn("end", F.sum("room").over(Window.orderBy("fold"))).withColumn("start", F.col("end") - F.col("room")).withColumn("end", F.when(F.col("fold") == n - 1, F.lit((1 << 62))).otherwise(F.col("end")))
    fill = placed(rows.where(F.col(label) == F.lit(filler)), order)
    # n rows of bounds
    fill = fill.join(F.broadcast(ends.select("fold", "start", "end")), (F.col("_i") >= F.col("start")) & (F.col("_i") < F.col("end"))).drop("_i", "start", "end")
    return others.unionByName(fill)


def rotated_role(fold: Column, k: int, n: int) -> Column:
    """Role of a fold in the k-th rotation: fold k tests, the next validates, the others train."""
    return F.when(fold == k % n, "test").when(fold == (k + 1) % n, "validation").otherwise("train")


def first_n_split(rows: DataFrame, order: list[str], n_test: int, train_part: float = 0.8) -> DataFrame:
    """Adds ``split``: the first rows, in an order that an integer column leads, test; the others train and validate in proportion."""
    ranked = counted(placed(rows, order))
    cut = F.lit(n_test) + F.floor((F.col("_n") - n_test) * train_part)
    return ranked.withColumn("split", F.when(F.col("_i") < n_test, "test").when(F.col("_i") < cut, "train").otherwise("validation")).drop("_i", "_n")


def external_split(pairs: DataFrame, external: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``split``: pairs that an external table has too are the test set."""
    known = external.select(*key).distinct().withColumn("_t", F.lit(True))
    return pairs.join(known, key, "left").withColumn("split", F.when(F.col("_t"), "test").otherwise("train")).drop("_t")


def hash_split(rows: DataFrame, key: list[str], parts: dict[str, float], seed: int) -> DataFrame:
    """Adds ``split``: a random split that only the key and the seed decide."""
    u = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11).cast("double") / float(1 << 53)
    out, edge = None, 0.0
    names = list(parts)
    for name in names[:-1]:
        edge += parts[name]
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return rows.withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[-1]))


def negative_pairs(pairs: DataFrame, a: str, b: str, ratio: float = 1.0, seed: int = 0, rounds: int = 3) -> DataFrame:
    """(a, b, strength 0): ends shuffled against each other and no existing pair, ``ratio`` times as many where that many are found.

    In each round both columns of ends are ranked without gaps in a hash order of their own, and ends of one rank make a new pair, so
    each round is a permutation of all ends.
    """
    ends = cut(pairs.select(a, b))

    def ranked(end: str, s: int) -> DataFrame:
        mixed = ends.select(end, F.xxhash64(F.col(a), F.col(b), F.lit(s)).alias("_h"))
        return placed(mixed, ["_h", end]).select(end, "_i")

    new = None
    for r in range(rounds):
        one = ranked(a, seed + 2 * r).join(ranked(b, seed + 2 * r + 1), "_i").select(a, b)
        new = one if new is None else new.unionByName(one)
    fresh = new.distinct().join(ends.distinct(), [a, b], "left_anti").withColumn("_h", F.xxhash64(F.col(a), F.col(b), F.lit(seed)))
    return placed(fresh, ["_h", a, b]).where(F.col("_i") < int(ends.count() * ratio)).select(a, b, F.lit(0).alias("strength"))
