"""Exchange calendar as a per-day dimension.

A session opens and closes within one UTC date, so "next open after ts" only needs the row of
ts's date: its own open if that is still ahead, else the next session's. The dimension holds
one row per calendar day, which bounds the broadcast by the years covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn


def day_dimension(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per day: its own session and the neighbouring ones."""
    joined = days.join(sessions, "d", "left")
    # both run as growing frames: the days ahead are the days before in descending order
    ahead = Window.orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    s = F.when(F.col("open_ts").isNotNull(), F.struct("d", "open_ts", "close_ts"))
    return joined.select(
        F.col("d").alias("cal_d"), "open_ts", "close_ts",
        F.last(s, ignorenulls=True).over(ahead).alias("nxt"),
        F.last(s, ignorenulls=True).over(behind).alias("prv"),
    )


def attach(df: DataFrame, calendar: DataFrame, ts: str, prefix: str = "") -> DataFrame:
    """`next_open`, `next_close`, `prev_close` and `is_open` of the instant `ts` (null for null; an
    instant outside the calendar is an error). Map-side join on the UTC date; sessions are [open, close)."""
    cal = F.broadcast(calendar)
    t = F.col(ts)
    out = df.join(cal, F.to_date(t) == F.col("cal_d"), "left")
    outside = F.raise_error(F.concat(F.lit("instant outside the calendar: "), t.cast("string"))).cast("timestamp")
    return out.select(
        *df.columns,
        F.when(t.isNotNull() & F.col("cal_d").isNull(), outside).when(F.col("open_ts") > t, F.col("open_ts")).otherwise(F.col("nxt.open_ts")).alias(f"{prefix}next_open"),
        F.when(F.col("close_ts") > t, F.col("close_ts")).otherwise(F.col("nxt.close_ts")).alias(f"{prefix}next_close"),
        F.when(F.col("close_ts") < t, F.col("close_ts")).otherwise(F.col("prv.close_ts")).alias(f"{prefix}prev_close"),
        F.when(F.col("cal_d").isNotNull(), F.coalesce((F.col("open_ts") <= t) & (t < F.col("close_ts")), F.lit(False)))
        .alias(f"{prefix}is_open"),
    )


def attach_ny_day(df: DataFrame, calendar: DataFrame, ts: str) -> DataFrame:
    """`is_session_day` and `holiday_adjacent` of the New York date of `ts`."""
    cal = F.broadcast(calendar)
    day = fn.ny_date(F.col(ts))
    out = df.join(cal, day == F.col("cal_d"), "left")
    own = (F.weekday("cal_d") < 5) & F.col("open_ts").isNull()
    gap = weekdays_between(F.col("prv.d"), F.col("cal_d")) + weekdays_between(F.col("cal_d"), F.col("nxt.d"))
    return out.select(
        *df.columns, F.when(F.col("cal_d").isNotNull(), F.col("open_ts").isNotNull()).alias("is_session_day"),
        F.when(F.col("prv.d").isNotNull() & F.col("nxt.d").isNotNull(),
               F.when(own | (gap > 0), 1.0).otherwise(0.0)).alias("holiday_adjacent"),
    )


def weekdays_between(a: Column, b: Column) -> Column:
    """Weekdays strictly between two dates, in closed form."""
    def upto(d: Column) -> Column:  # weekdays from a fixed Monday up to and including d
        n = F.datediff(d, F.lit("1990-01-01").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))
    return upto(F.date_sub(b, 1)) - upto(a)
