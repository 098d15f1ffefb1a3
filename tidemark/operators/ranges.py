"""Range joins and range aggregates through time buckets, plus two-level running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import DAY, time_bucket


def range_join(left: DataFrame, right: DataFrame, *, on: Sequence[str], lo: str, hi: str, right_ts: str,
               bucket: int, take: Sequence[str], how: str = "inner",
               lo_open: bool = True, hi_open: bool = False) -> DataFrame:
    """Pairs with lo < right_ts <= hi (bounds as flagged). A left row is copied once per bucket
    its range touches and meets only right rows of that bucket in an equi-join, so the cost is
    the pairs plus range / bucket copies; skewed buckets are split by adaptive execution."""
    on = list(on)
    cells = left.withColumn("_b", F.explode(F.sequence(time_bucket(F.col(lo), bucket), time_bucket(F.col(hi), bucket))))
    facts = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], F.col(right_ts).alias("_r_ts"),
                         *[F.col(c) for c in take], time_bucket(F.col(right_ts), bucket).alias("_r_b"))
    cond = [cells[c] == facts[f"_r_{c}"] for c in on] + [cells["_b"] == facts["_r_b"]]
    cond.append(facts["_r_ts"] > cells[lo] if lo_open else facts["_r_ts"] >= cells[lo])
    cond.append(facts["_r_ts"] < cells[hi] if hi_open else facts["_r_ts"] <= cells[hi])
    return cells.join(facts, cond, how).drop("_b", "_r_b", *[f"_r_{c}" for c in on])


def range_aggregate(left: DataFrame, right: DataFrame, *, key: Sequence[str], on: Sequence[str], lo: str, hi: str,
                    right_ts: str, bucket: int, take: Sequence[str], aggs: Sequence[Column],
                    lo_open: bool = True, hi_open: bool = False) -> DataFrame:
    """One row per left `key` that has at least one right row in its range. Aggregates may
    use `take`, `right_ts` (as ``_r_ts``) and the left columns `lo` and `hi`."""
    key = list(key)
    need = list(dict.fromkeys([*key, *on, lo, hi]))
    pairs = range_join(left.select(*need), right, on=on, lo=lo, hi=hi, right_ts=right_ts, bucket=bucket,
                       take=take, lo_open=lo_open, hi_open=hi_open)
    return pairs.groupBy(*key).agg(*aggs)


def running_totals(df: DataFrame, *, on: Sequence[str], order: Sequence[str], ts: str, totals: dict[str, Column],
                   bucket: int = DAY) -> DataFrame:
    """Cumulative sums per key in `order` (inclusive), without sending a key to one task: each
    time bucket is summed first, the bucket sums are prefixed, and rows are accumulated inside
    their bucket only."""
    on = list(on)
    raw = df.withColumn("_b", time_bucket(F.col(ts), bucket))
    for name, expr in totals.items():
        raw = raw.withColumn(f"_v_{name}", F.coalesce(expr.cast("double"), F.lit(0.0)))
    sums = raw.groupBy(*on, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    w = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias(f"_k_{c}") for c in on], F.col("_b").alias("_kb"),
                       *[F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0.0)).alias(f"_p_{n}") for n in totals])
    wb = Window.partitionBy(*on, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = raw.select("*", *[F.sum(f"_v_{n}").over(wb).alias(f"_c_{n}") for n in totals])
    cond = [inner[c].eqNullSafe(base[f"_k_{c}"]) for c in on] + [inner["_b"] == base["_kb"]]
    out = inner.join(base, cond)
    keep = [F.col(c) for c in df.columns]
    return out.select(*keep, *[(F.col(f"_p_{n}") + F.col(f"_c_{n}")).alias(n) for n in totals])


def sequence_number(df: DataFrame, *, on: Sequence[str], order: Sequence[str], ts: str, name: str = "seq",
                    bucket: int = DAY) -> DataFrame:
    """1-based position of each row within its key, two-level like `running_totals`."""
    out = running_totals(df, on=on, order=order, ts=ts, totals={name: F.lit(1)}, bucket=bucket)
    return out.withColumn(name, F.col(name).cast("bigint"))


def shifted(df: DataFrame, *, on: Sequence[str], seq: str, lags: Sequence[int], take: str, prefix: str) -> DataFrame:
    """`take` of the rows `lags` positions earlier, found by (key, position) equi-joins."""
    out = df
    for k in lags:
        other = df.select(*[F.col(c).alias(f"_k_{c}") for c in on], (F.col(seq) + k).alias("_k_seq"),
                          F.col(take).alias(f"{prefix}{k}"))
        cond = [out[c] == other[f"_k_{c}"] for c in on] + [out[seq] == other["_k_seq"]]
        out = out.join(other, cond, "left").drop("_k_seq", *[f"_k_{c}" for c in on])
    return out
