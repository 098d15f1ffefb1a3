"""Exact ranks, quantiles and positions of groups too large for one task.

Equal values collapse first. The distinct values of a group are then split at approximate
quantiles into ranges of similar size; counts are prefixed over the ranges and accumulated
inside each. The cut points only balance the work, the results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def cumulative_counts(df: DataFrame, *, by: Sequence[str], value: str, weight: str | None = None, ranges: int = RANGES) -> DataFrame:
    """Per group and distinct non-null value: `cnt` rows (or their `weight`), `before` = rows
    with smaller values, `total` rows of the group."""
    by = list(by)
    n = F.sum(weight) if weight else F.count("*")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("cnt"))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, probs, 1000).alias("_cuts"))
    cell = counts.join(cuts, by).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = cell.groupBy(*by, "_r").agg(F.sum("cnt").alias("_n"))
    w = Window.partitionBy(*by)
    base = sums.select(*by, "_r", F.coalesce(F.sum("_n").over(
        w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(w).alias("total"))
    wr = Window.partitionBy(*by, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = cell.withColumn("_cum", F.sum("cnt").over(wr))
    return inner.join(base, [*by, "_r"]).select(
        *by, value, "cnt", (F.col("_base") + F.col("_cum") - F.col("cnt")).alias("before"), "total")


def average_ranks(df: DataFrame, *, by: Sequence[str], value: str, name: str) -> DataFrame:
    """`df` plus the 1-based rank of `value` within its group, ties averaged."""
    ranks = cumulative_counts(df, by=by, value=value).select(
        *by, value, (F.col("before") + (F.col("cnt") + 1) / 2.0).alias(name))
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, *, by: Sequence[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """Rank correlation per group; null below three pairs or for a constant side. Equal pairs
    collapse first, and that one shuffled table serves both rankings and the final sums."""
    by = list(by)
    w = F.sum(weight) if weight else F.count("*")
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(w.alias("_w"))

    def ranks(value: str, name: str) -> DataFrame:
        c = cumulative_counts(pairs, by=by, value=value, weight="_w")
        return c.select(*by, value, (F.col("before") + (F.col("cnt") + 1) / 2.0).alias(name))
    r = pairs.join(ranks("_x", "_rx"), [*by, "_x"]).join(ranks("_y", "_ry"), [*by, "_y"])
    wt, rx, ry = F.col("_w"), F.col("_rx"), F.col("_ry")
    g = r.groupBy(*by).agg(F.sum("_w").alias("_n"), F.sum(wt * rx * ry).alias("_xy"), F.sum(wt * rx * rx).alias("_xx"), F.sum(wt * ry * ry).alias("_yy"))
    n = F.col("_n").cast("double")  # its cube passes 2^63 from two million pairs on
    centre = n * (n + 1) * (n + 1) / 4.0  # the mean of averaged ranks is (n + 1) / 2
    sx, sy = F.col("_xx") - centre, F.col("_yy") - centre
    usable = (n >= 3) & (sx > 0) & (sy > 0)
    return g.select(*by, F.when(usable, (F.col("_xy") - centre) / F.sqrt(F.when(usable, sx * sy))).alias("spearman_ic"))


def exact_quantiles(df: DataFrame, *, by: Sequence[str], value: str, probs: dict[str, float],
                    transform: Column | None = None) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of `probs`."""
    col = transform if transform is not None else F.col(value)
    c = cumulative_counts(df.select(*by, col.alias("_v")), by=by, value="_v")
    aggs = []
    for name, q in probs.items():
        at = F.lit(q) * (F.col("total") - 1)
        lo = F.floor(at)
        for tag, k in (("lo", lo), ("hi", F.least(lo + 1, F.col("total") - 1))):
            inside = (F.col("before") <= k) & (k < F.col("before") + F.col("cnt"))
            aggs.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{tag}_{name}"))
    g = c.groupBy(*by).agg(F.max("total").alias("n"), *aggs)
    out = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
            * (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)))).alias(n) for n, q in probs.items()]
    return g.select(*by, "n", *out)


def digest_index(df: DataFrame, *, by: Sequence[str], key: str, digits: int = 2) -> DataFrame:
    """`idx`, the 0-based position of each row in the order of md5(key), and `size`, the rows of
    its group. The first digits of the digest split a group evenly."""
    by = list(by)
    raw = df.withColumn("_md", F.md5(F.col(key).cast("string"))).withColumn("_r", F.substring("_md", 1, digits))
    w = Window.partitionBy(*by)
    base = raw.groupBy(*by, "_r").agg(F.count("*").alias("_n")).select(
        *by, "_r", F.coalesce(F.sum("_n").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_n").over(w).alias("size"))
    pos = F.row_number().over(Window.partitionBy(*by, "_r").orderBy("_md"))
    return raw.withColumn("_pos", pos).join(base, [*by, "_r"]).withColumn(
        "idx", F.col("_base") + F.col("_pos") - 1).drop("_md", "_r", "_base", "_pos")
