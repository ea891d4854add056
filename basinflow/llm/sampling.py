"""Bounded, repeatable samples of labelled rows and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def held_out(id_col: str, folds: int, remainder: int) -> Column:
    """True for ids of the given remainder; a null id is neither held out nor learned from."""
    return F.coalesce(fold(id_col, folds) == remainder, F.lit(False))


def bounded(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of the id: the same on every run."""
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(most)
