"""Top-k per group and per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, *, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows per group. The rank filter lets Spark keep k rows per group and task
    before the shuffle, so a hot group sends k rows per task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_contributions(df: DataFrame, *, key: Sequence[str], columns: Sequence[str], n: int = 5) -> DataFrame:
    """The n largest absolute non-zero values of a row with their column names, largest first;
    ties by column order. Sorted inside the row, so nothing is shuffled."""
    items = F.array(*[F.struct((-F.abs(F.col(c))).alias("o"), F.lit(i).alias("i"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("push"))
                      for i, c in enumerate(columns)])
    kept = F.filter(items, lambda s: s["push"].isNotNull() & (s["push"] != 0))
    ranked = F.slice(F.array_sort(kept), 1, n)
    return df.select(*key, F.posexplode(ranked).alias("pos", "s")).select(*key, (F.col("pos") + 1).alias("rank"), "s.feature", "s.push")


def rank_trials(trials: DataFrame, *, value: str, higher: bool, order: str) -> DataFrame:
    """Complete trials ranked by value, first registered on ties (a small table)."""
    col = F.col(value).desc() if higher else F.col(value).asc()
    done = trials.filter(F.col(value).isNotNull())
    return done.withColumn("rank", F.row_number().over(Window.orderBy(col, F.col(order).asc())))
