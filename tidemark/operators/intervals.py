"""Concurrency of overlapping closed intervals, without comparing intervals pairwise."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import DAY
from tidemark.operators.ranges import running_totals
from tidemark.session import cut


def open_counts(df: DataFrame, *, by: Sequence[str], entry: str, exit_: str, weight: str | None = None,
                bucket: int = DAY) -> DataFrame:
    """Per slice and boundary instant `ts`: n_open = #(entry <= ts) - #(exit < ts), and the
    same with `weight` summed as `exposure`. Rows collapse to distinct instants before the
    running sum, which is two-level (`running_totals`)."""
    w = F.col(weight) if weight else F.lit(1.0)
    ends = F.array(F.struct(F.col(entry).alias("ts"), F.lit(1.0).alias("up"), F.lit(0.0).alias("down"), w.alias("w_up"), F.lit(0.0).alias("w_down")),
                   F.struct(F.col(exit_).alias("ts"), F.lit(0.0).alias("up"), F.lit(1.0).alias("down"), F.lit(0.0).alias("w_up"), w.alias("w_down")))
    marks = (df.select(*by, F.explode(ends).alias("_e")).groupBy(*by, F.col("_e.ts").alias("ts"))
             .agg(*[F.sum(f"_e.{c}").alias(c) for c in ("up", "down", "w_up", "w_down")]))
    run = running_totals(marks, on=by, order=["ts"], ts="ts", bucket=bucket,
                         totals={"c_up": F.col("up"), "c_down": F.col("down"), "cw_up": F.col("w_up"), "cw_down": F.col("w_down")})
    return run.select(*by, "ts", (F.col("c_up") - F.col("c_down") + F.col("down")).cast("bigint").alias("n_open"),
                      (F.col("cw_up") - F.col("cw_down") + F.col("w_down")).alias("exposure"))


def row_blocks(rows: DataFrame, *, by: Sequence[str], ts: str, each: int, grain: int = 60) -> DataFrame:
    """`rows` with `blk`, the number of its block in its slice: blocks are ascending in `ts` and hold about `each` rows, however many rows a day has. Rows are
    counted per `grain` seconds; counts run over days first, then over the grains of a day, both of which the calendar bounds."""
    by = list(by)
    sec = F.unix_micros(ts)
    raw = rows.withColumns({"_day": F.floor(sec / F.lit(DAY * 1_000_000)).cast("int"), "_grain": F.floor(F.pmod(sec, F.lit(DAY * 1_000_000)) / F.lit(grain * 1_000_000)).cast("int")})
    counts = raw.groupBy(*by, "_day", "_grain").agg(F.count(F.lit(1)).alias("_n"))
    first = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = counts.groupBy(*by, "_day").agg(F.sum("_n").alias("_n")).select(*by, "_day", F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_day").orderBy("_grain").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(days, [*by, "_day"]).select(*by, "_day", "_grain", F.floor((F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))) / each).alias("blk"))
    return raw.join(placed, [*by, "_day", "_grain"]).drop("_day", "_grain")


#: Instants of a block, about.
BLOCK = 2048


def peaks(df: DataFrame, *, by: Sequence[str], key: str, entry: str, exit_: str, slices: dict[str, Column] | None = None, bucket: int = 60, block: int = BLOCK) -> DataFrame:
    """by, key and, for every name in `slices`, the largest n_open of that slice over the row's own [entry, exit]; null for rows outside of it. Slices may overlap:
    a row marks its two instants once, with a count per slice.

    Instants are cut into blocks by their number. In a block, running maxima from either end answer for intervals that leave it, and a sparse table
    for those inside. Whole blocks in between are two runs of a power of two of blocks, from a sparse table of block maxima that is itself a table."""
    by, slices = list(by), slices or {"peak": F.lit(True)}
    names = list(slices)
    flagged = df.select(*by, key, F.col(entry).alias("_in"), F.col(exit_).alias("_out"), *[F.coalesce(c, F.lit(False)).alias(f"_f_{n}") for n, c in slices.items()])
    ends = F.array(F.struct(F.col("_in").alias("ts"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("_out").alias("ts"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    marks = flagged.select(*by, *[f"_f_{n}" for n in names], F.explode(ends).alias("_e")).groupBy(*by, F.col("_e.ts").alias("ts")).agg(
        *[F.sum(F.when(F.col(f"_f_{n}"), F.col(f"_e.{d}")).otherwise(0)).alias(f"{d}_{n}") for n in names for d in ("up", "down")])
    marks = cut(row_blocks(marks, by=by, ts="ts", each=block, grain=bucket))  # read by the blocks' sums and by the blocks
    change = [(F.sum(f"up_{n}") - F.sum(f"down_{n}")).alias(f"_d_{n}") for n in names]
    before = Window.partitionBy(*by).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    base = marks.groupBy(*by, "blk").agg(*change).select(*by, "blk", *[F.coalesce(F.sum(f"_d_{n}").over(before), F.lit(0)).alias(f"base_{n}") for n in names])
    kinds = dict(df.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def ran(t: pa.Table) -> pa.Table:
        t = t.sort_by("ts")
        out = {c: t.column(c) for c in (*by, "blk", "ts")}
        for n in names:
            up, down = (np.cumsum(t.column(f"{d}_{n}").to_numpy()) for d in ("up", "down"))
            open_ = t.column(f"base_{n}").to_numpy() + up - down + t.column(f"down_{n}").to_numpy()
            out |= {f"open_{n}": open_, f"pre_{n}": np.maximum.accumulate(open_), f"suf_{n}": np.maximum.accumulate(open_[::-1])[::-1]}
        return pa.table(out)

    runs = cut(marks.join(base, [*by, "blk"]).groupBy(*by, "blk").applyInArrow(
        ran, f"{head}, blk long, ts timestamp, " + ", ".join(f"open_{n} long, pre_{n} long, suf_{n} long" for n in names)))
    level = runs.groupBy(*by, "blk").agg(*[F.max(f"open_{n}").alias(f"max_{n}") for n in names])
    table, k, most = level.withColumn("k", F.lit(0)), 0, runs.agg(F.max("blk")).first()[0] or 0
    while 2 << k <= most + 1:  # maxima of 2^k blocks from those of half as many
        later = level.select(*by, (F.col("blk") - (1 << k)).alias("blk"), *[F.col(f"max_{n}").alias(f"_m_{n}") for n in names])
        k += 1
        level = cut(level.join(later, [*by, "blk"], "left").select(*by, "blk", *[F.greatest(f"max_{n}", f"_m_{n}").alias(f"max_{n}") for n in names]))
        table = table.unionByName(level.withColumn("k", F.lit(k)))
    at_in = runs.select(*by, F.col("ts").alias("_in"), F.col("blk").alias("_b_in"), *[f"suf_{n}" for n in names])
    at_out = runs.select(*by, F.col("ts").alias("_out"), F.col("blk").alias("_b_out"), *[f"pre_{n}" for n in names])
    j = flagged.join(at_in, [*by, "_in"]).join(at_out, [*by, "_out"])
    gap = F.col("_b_out") - F.col("_b_in") - 1
    j = j.withColumn("_k", F.when(gap > 0, F.floor(F.log2(gap.cast("double"))).cast("int")))
    for side, start in (("a", F.col("_b_in") + 1), ("b", F.col("_b_out") - F.expr("shiftleft(CAST(1 AS BIGINT), _k)"))):
        part = table.select(*by, F.col("k").alias("_k"), F.col("blk").alias("_s"), *[F.col(f"max_{n}").alias(f"_{side}_{n}") for n in names])
        j = j.withColumn("_s", start).join(part, [*by, "_k", "_s"], "left").drop("_s")
    asked = flagged.select(*by, "_in", "_out").distinct().join(at_in.select(*by, "_in", F.col("_b_in").alias("blk")), [*by, "_in"])
    asked = asked.join(at_out.select(*by, "_out", F.col("_b_out").alias("_b")), [*by, "_out"]).filter("blk = _b")  # intervals inside a block
    both = runs.select(*by, "blk", "ts", *[f"open_{n}" for n in names]).unionByName(asked.select(*by, "blk", "_in", "_out"), allowMissingColumns=True)

    def inside(t: pa.Table) -> pa.Table:
        known = pc.is_valid(t.column("ts"))
        q, t = t.filter(pc.invert(known)), t.filter(known).sort_by("ts")
        when = t.column("ts").cast(pa.int64()).to_numpy()
        lo, hi = (np.searchsorted(when, q.column(c).cast(pa.int64()).to_numpy()) for c in ("_in", "_out"))
        size = np.frexp(hi - lo + 1)[1] - 1
        out = {c: q.column(c) for c in (*by, "_in", "_out")}
        for n in names:
            levels = [t.column(f"open_{n}").to_numpy()]
            while 2 ** len(levels) <= len(when):
                half = 2 ** (len(levels) - 1)
                levels.append(np.maximum(levels[-1][:-half], levels[-1][half:]))
            got = np.zeros(len(lo), np.int64)
            for k in np.unique(size):
                own = size == k
                got[own] = np.maximum(levels[k][lo[own]], levels[k][hi[own] + 1 - 2 ** int(k)])
            out[f"_q_{n}"] = got
        return pa.table(out)

    near = both.groupBy(*by, "blk").applyInArrow(inside, f"{head}, _in timestamp, _out timestamp, " + ", ".join(f"_q_{n} long" for n in names))
    j = j.join(near, [*by, "_in", "_out"], "left")
    found = [F.when(F.col(f"_f_{n}"), F.coalesce(f"_q_{n}", F.greatest(f"suf_{n}", f"pre_{n}", f"_a_{n}", f"_b_{n}"))).alias(n) for n in names]
    return j.select(*by, key, *found)


def peak_concurrency(df: DataFrame, *, by: Sequence[str], key: str, entry: str, exit_: str, bucket: int = 60, block: int = BLOCK) -> DataFrame:
    """`peak`: the largest n_open over each interval's own [entry, exit]. Rows are counted per `bucket` seconds, a divisor of the day."""
    return peaks(df, by=by, key=key, entry=entry, exit_=exit_, bucket=bucket, block=block)


def most_exposed(df: DataFrame, *, by: Sequence[str], entry: str, exit_: str, weights: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Per slice and column of `weights` (null: not held) the largest sum of open weights, at any instant."""
    by, names = list(by), list(weights)
    ends = F.array(*[F.struct(F.col(c).alias("ts"), *[(F.coalesce(F.col(n), F.lit(0.0)) * s).alias(f"{d}_{n}") for n in names for d, s in (("up", up), ("down", 1 - up))])
                     for c, up in ((entry, 1), (exit_, 0))])
    marks = df.select(*by, F.explode(ends).alias("_e")).select(*by, "_e.*").groupBy(*by, "ts").agg(*[F.sum(f"{d}_{n}").alias(f"{d}_{n}") for n in names for d in ("up", "down")])
    marks = cut(row_blocks(marks, by=by, ts="ts", each=block))
    before = Window.partitionBy(*by).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    base = marks.groupBy(*by, "blk").agg(*[(F.sum(f"up_{n}") - F.sum(f"down_{n}")).alias(f"_d_{n}") for n in names]).select(
        *by, "blk", *[F.coalesce(F.sum(f"_d_{n}").over(before), F.lit(0.0)).alias(f"base_{n}") for n in names])
    inside = Window.partitionBy(*by, "blk").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = marks.join(base, [*by, "blk"]).select(*by, *[(F.col(f"base_{n}") + F.sum(f"up_{n}").over(inside) - F.sum(f"down_{n}").over(inside) + F.col(f"down_{n}")).alias(n) for n in names])
    return run.groupBy(*by).agg(*[F.max(n).alias(n) for n in names])
