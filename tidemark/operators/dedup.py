"""Keep one row per key by an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the largest `order` per key. An aggregate, not a window: map-side combine
    keeps one row per key and task, so copies of a hot key never meet in one place."""
    return _pick(df, key, order, F.max_by)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the smallest `order` per key; nulls in the order count as smallest."""
    return _pick(df, key, order, F.min_by)


def _pick(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], by) -> DataFrame:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    best = df.groupBy(*key).agg(by(F.struct(*df.columns), F.struct(*cols)).alias("_row"))
    return best.select("_row.*")
