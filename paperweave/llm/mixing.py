"""Mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies. Documents stand in order of size; the prefix sums of expected
copies, moved by one random offset per source, cross integers, and a document is taken once for each integer crossed. As neighbours
have like sizes, the words taken come near the target and not only the copies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import numbered, pick, uniform
from .scratch import small_batches
from .textops import BLANK, runs, word_bounds

WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most this many times its size.
MOST = 3.0
#: Documents of a source are ranked in parallel: by classes of size, 32 to a doubling, each cut by a hash.
SIZE_STEPS, HASH_PARTS = 32, 16


def count_words(docs: DataFrame, column: str = "text", out: str = "size") -> DataFrame:
    """``docs`` without ``column``, and its number of words ``[^\\x20\\x09-\\x0D]+``."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != column]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != column), T.StructField(out, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in runs(batch, column):
                rows = word_bounds(data, at, BLANK)[2]
                n = np.bincount(rows, minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], pa.array(n)], [*kept, out])

    return docs.mapInArrow(count, schema)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Of (source, source_size): with target, by weights that repeat over the sources in code-point order, null last.

    Targets share the whole size. None exceeds ``most`` times its source; the excess is shared again by weight until none does. In
    order of capacity over weight the capped sources come first, so one prefix sum finds where capping ends. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    t = sizes.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int"))).withColumn("cap", F.lit(most) * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    before = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.select("*", F.sum("source_size").over(every).alias("total"), F.sum("w").over(every).alias("w_all"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"))
    level = (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    t = t.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    last = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(every)["level"]
    return t.select("source", "source_size", F.when(last.isNull() | (F.col("cap") <= last * F.col("w")), F.col("cap")).otherwise(last * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, copies.

    size is the number of words (null or empty text: 0), taken is size times copies, and copies is 0 to ``most``. A null source is a
    source of its own and comes last. Sources without words have target 0 and give nothing. Ties in size stand in the order of a
    hash of doc_id; repeated rows are sampled one by one. Other columns are not read. An empty table gives no rows. Reruns with one
    seed agree; documents' order and partitions do not matter.
    """
    rows = count_words(pick(docs, "doc_id", "source", "text"))
    return sample(rows, seed, weights, most).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def sample(rows: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds source_size, target and copies to rows of (doc_id, source, size)."""
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    rows = rows.withColumn("_c", F.floor(F.log2(F.col("size") + 1) * SIZE_STEPS).cast("int") * HASH_PARTS + F.pmod("_h", F.lit(HASH_PARTS)).cast("int"))
    cells = rows.groupBy("source", "_c").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_s"))
    sources = source_targets(cells.groupBy("source").agg(F.sum("_s").alias("source_size")), weights, most)
    cells = cells.select("source", "_c", (F.sum("_n").over(Window.partitionBy("source").orderBy("_c")) - F.col("_n")).alias("_first"))
    cells = cells.alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "_c", "_first", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source", "_c").orderBy("_h", "doc_id"))
    j = rows.withColumn("_r", rank).alias("r").join(cells.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r._c") == F.col("k._c")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("_first") + F.col("_r")
    u = uniform(F.lit(seed), F.lit("offset"), F.col("r.source"))
    copies = (F.floor(rate * at + u) - F.floor(rate * (at - 1) + u)).cast("long")
    return j.select("r.doc_id", "r.source", "size", "source_size", "target", F.least(copies, F.lit(int(most)).cast("long")).alias("copies"))


