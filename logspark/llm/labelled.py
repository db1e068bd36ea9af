"""Labelled rows for fitting: the fold rule and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def held_out(id_col: str) -> Column:
    """Whether a row is kept from fitting."""
    return F.coalesce(fold(id_col) == 2, F.lit(False))


def bounded(rows: DataFrame, class_col: str, id_col: str, most: int) -> DataFrame:
    """About ``most`` rows of each class at most, by a hash of the id; all rows of smaller classes."""
    counts = {r[0]: r[1] for r in rows.groupBy(class_col).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(class_col) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1_000_000)) < share * 1_000_000)
