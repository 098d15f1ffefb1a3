"""As-of joins that do not depend on how rows spread over keys.

The left side is reduced to its distinct (key, instant) pairs before the shuffle, the
timeline is split into time buckets so that a hot key is many groups, and the row in force
at the start of a bucket comes from a table with one row per (key, bucket). Where the right
side sits on a regular grid, instants are snapped to it, which bounds a group by
2 x bucket / grid rows however many rows share a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
DAY = 24 * HOUR


def floor_to(ts: Column, seconds: int) -> Column:
    """Instant rounded down to a multiple of `seconds`."""
    step = int(seconds) * 1_000_000
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(step)))


def ceil_to(ts: Column, seconds: int) -> Column:
    step = int(seconds) * 1_000_000
    us = F.unix_micros(ts)
    return F.timestamp_micros(us + F.pmod(-us, F.lit(step)))


def time_bucket(ts: Column, seconds: int) -> Column:
    """Number of the time bucket `ts` falls into."""
    us = F.unix_micros(ts)
    step = int(seconds) * 1_000_000
    return ((us - F.pmod(us, F.lit(step))) / F.lit(step)).cast("bigint")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    take: Sequence[str],
    into: str = "hit",
    direction: str = "backward",
    strict: bool = False,
    tie: str | None = None,
    bucket: int = DAY,
    grid: int | None = None,
) -> DataFrame:
    """Left rows plus a struct `into` of the `take` columns of the right row in force.

    backward: the last right row with right_ts <= left_ts (``<`` when `strict`);
    forward: the first right row with right_ts >= left_ts (``>`` when `strict`).
    `tie` orders right rows that share an instant: the largest wins backward, the smallest
    forward. `grid` states that every right_ts is a multiple of that many seconds.
    """
    on = list(on)
    backward = direction == "backward"
    # snapping keeps the comparison exact because right instants are grid points
    if grid is None:
        slot = F.col(left_ts)
    elif backward != strict:
        slot = floor_to(F.col(left_ts), grid)
    else:
        slot = ceil_to(F.col(left_ts), grid)
    probed = left.withColumn("_slot", slot)
    probes = (probed.filter(F.col("_slot").isNotNull()).select(*on, F.col("_slot").alias("_ts")).distinct()
              .withColumn("_b", time_bucket(F.col("_ts"), bucket)))
    rows = (right.filter(F.col(right_ts).isNotNull())
            .select(*on, F.col(right_ts).alias("_ts"), F.struct(*take).alias("_hit"),
                    (F.col(tie) if tie else F.lit(0)).alias("_tie"))
            .withColumn("_b", time_bucket(F.col("_ts"), bucket)))

    # row in force at the edge of each bucket: one row per (key, bucket) goes through this window
    rank = F.struct("_ts", "_tie")
    pick = F.max_by("_hit", rank) if backward else F.min_by("_hit", rank)
    edges = (rows.groupBy(*on, "_b").agg(pick.alias("_last"))
             .unionByName(probes.select(*on, "_b").distinct(), allowMissingColumns=True)
             .groupBy(*on, "_b").agg(F.first("_last", ignorenulls=True).alias("_last")))
    w = Window.partitionBy(*on).orderBy(F.col("_b").asc() if backward else F.col("_b").desc())
    carry = edges.select(*on, "_b", F.last("_last", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1)).alias("_hit"))

    # order of the kinds at one instant decides <= against <
    row_kind, probe_kind = (1, 2) if not strict else (2, 1)
    timeline = (
        rows.withColumn("_kind", F.lit(row_kind))
        .unionByName(probes.withColumn("_kind", F.lit(probe_kind)), allowMissingColumns=True)
        .unionByName(carry.filter(F.col("_hit").isNotNull()).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    )
    # the carried row opens its bucket; time runs the other way for the forward direction
    us = F.unix_micros("_ts")
    opens = F.when(F.col("_kind") == 0, F.lit(0)).otherwise(F.lit(1))
    seq = [opens, us if backward else -us, F.col("_kind")]
    tie_order = F.col("_tie").asc() if backward else F.col("_tie").desc()
    wb = (Window.partitionBy(*on, "_b").orderBy(*seq, tie_order)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    solved = (timeline.withColumn("_hit", F.last("_hit", ignorenulls=True).over(wb))
              .filter(F.col("_kind") == probe_kind)
              .select(*[F.col(c).alias(f"_k_{c}") for c in on], F.col("_ts").alias("_k_ts"), F.col("_hit").alias(into)))
    cond = [probed[c] == solved[f"_k_{c}"] for c in on] + [probed["_slot"] == solved["_k_ts"]]
    return probed.join(solved, cond, "left").drop("_slot", "_k_ts", *[f"_k_{c}" for c in on])


def asof_lookup(left: DataFrame, right: DataFrame, *, left_ts: str, right_ts: str, take: Sequence[str],
                into: str = "hit", **kw) -> DataFrame:
    """As-of against one series without a key, such as a benchmark."""
    out = asof_join(left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1)), on=["_one"],
                    left_ts=left_ts, right_ts=right_ts, take=take, into=into, **kw)
    return out.drop("_one")


def asof_points(df: DataFrame, right: DataFrame, *, key: Sequence[str], on: Sequence[str], points: dict[str, Column],
                right_ts: str, take: Sequence[str], **kw) -> DataFrame:
    """One row per `key` with one column per named instant in `points`: a struct of the `take` columns in force then,
    plus `at`. All instants of a row share one as-of pass and one regrouping by `key`."""
    items = F.array(*[F.struct(F.lit(n).alias("_p"), c.alias("_at")) for n, c in points.items()])
    long = df.select(*key, *on, F.explode(items).alias("_x")).select(*key, *on, "_x.*")
    hit = asof_join(long, right, on=on, left_ts="_at", right_ts=right_ts, take=take, into="_h", **kw)
    packed = F.struct(F.col("_at").alias("at"), *[F.col(f"_h.{c}").alias(c) for c in take])
    return pack_points(hit, key=key, name="_p", value=packed, names=list(points))


def pack_points(hit: DataFrame, *, key: Sequence[str], name: str, value: Column, names: Sequence[str]) -> DataFrame:
    """Rows (key, name, value) to one row per key with a column per name. The few named rows of
    a key are collected once and picked apart, instead of one conditional aggregate per name."""
    g = hit.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(name), value))).alias("_m"))
    return g.select(*key, *[F.try_element_at("_m", F.lit(n)).alias(n) for n in names])


def asof_parts(df: DataFrame, parts: dict[str, tuple[DataFrame, dict]], *, key: Sequence[str]) -> DataFrame:
    """`df` plus one struct per entry of `parts` (name -> right side and `asof_join` arguments).
    Every lookup starts from `df` itself and is joined back on the unique `key`, so the plan
    grows with the number of lookups and not with their nesting."""
    out = df
    for name, (right, kw) in parts.items():
        need = list(dict.fromkeys([*key, *kw["on"], kw["left_ts"]]))
        hit = asof_join(df.select(*need), right, into=name, **kw).select(*key, name)
        out = out.join(hit, list(key), "left")
    return out
