"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Of a million hash values.
SCALE = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text, mod 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def about(df: DataFrame, bound: int, count: int, key: Column) -> DataFrame:
    """About ``bound`` of the ``count`` rows (all, if they are no more), chosen by the hash of ``key``."""
    return df if count <= bound else df.where(F.pmod(F.xxhash64(key), F.lit(SCALE)) < F.lit(SCALE * bound / count))
