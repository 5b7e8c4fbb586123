"""Column access and expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(frame: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name, so extra columns differing in case or repeating a name do no harm."""
    at = {}
    for i, c in enumerate(frame.columns):
        at.setdefault(c, i)
    return frame.toDF(*[f"_c{i}" for i in range(len(frame.columns))]).select(*[F.col(f"_c{at[n]}").alias(n) for n in names])


def numbered(frame: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns under private names, and the names they had."""
    return frame.toDF(*[f"_c{i}" for i in range(len(frame.columns))]), frame.columns


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, nothing else; the slower translate() only where a text has more than ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, SMALL))


def uniform(*parts: Column) -> Column:
    """A draw in (0, 1) that the parts decide."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
