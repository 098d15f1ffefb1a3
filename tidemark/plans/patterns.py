"""Tests on a regular hourly grid of markets.

Values at computed instants (Friday 19:00, Sunday 17:00, ...) are found by equi-joins of the
grid with itself on (market, instant), never by positions in a collected series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.asof import DAY, asof_join

HOUR = 3600


def ffill_grid(bars: DataFrame, *, step: int = HOUR, bucket: int = 5 * DAY) -> DataFrame:
    """Every (market, hour) between the first and the last bar of all markets: close forward
    filled by an as-of lookup, volume zero where there is no bar."""
    span = bars.agg(F.min("t").alias("_a"), F.max("t").alias("_z"))  # one row
    every = F.sequence(F.col("_a"), F.col("_z"), F.make_dt_interval(secs=F.lit(float(step))))
    slots = bars.select("market").distinct().join(F.broadcast(span)).select("market", F.explode(every).alias("t"))
    hit = asof_join(slots, bars.withColumnRenamed("t", "bt"), on=["market"], left_ts="t", right_ts="bt",
                    take=["bt", "close", "volume"], into="b", grid=step, bucket=bucket)
    return hit.select("market", "t", F.col("b.close").alias("close"),
                      F.when(F.col("b.bt") == F.col("t"), F.col("b.volume")).otherwise(0.0).alias("volume"))


def with_returns(grid: DataFrame, step: int = HOUR) -> DataFrame:
    """`lc` = ln(close) and `r` = its change from the previous slot."""
    g = grid.withColumn("lc", F.when(F.col("close") > 0, F.log(F.when(F.col("close") > 0, F.col("close")))))
    prev = g.select("market", fn.plus_seconds(F.col("t"), step).alias("t"), F.col("lc").alias("_p"))
    return g.join(prev, ["market", "t"], "left").withColumn("r", F.col("lc") - F.col("_p")).drop("_p")


def shifted_value(grid: DataFrame, column: str, slots: int, name: str, step: int = HOUR) -> DataFrame:
    """`column` of the slot `slots` later, by (market, instant)."""
    later = grid.select("market", fn.plus_seconds(F.col("t"), -slots * step).alias("t"), F.col(column).alias(name))
    return grid.join(later, ["market", "t"], "left")


def forward_return(grid: DataFrame, slots: int, name: str) -> DataFrame:
    out = shifted_value(grid, "lc", slots, "_f")
    return out.withColumn(name, F.col("_f") - F.col("lc")).drop("_f")


def autocorrelation(grid: DataFrame, mask: Column, *, least: int) -> DataFrame:
    """corr(r, next r) per market over the masked hours that have both."""
    g = shifted_value(grid, "r", 1, "nx").filter(mask & F.col("r").isNotNull() & F.col("nx").isNotNull())
    return g.groupBy("market").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.corr("r", "nx")).alias("ac"))


def at_instants(grid: DataFrame, instants: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per (instants row, market) with `lc` at each named instant, for rows whose
    instants all lie in the grid. `instants` is one row per calendar day: broadcast."""
    span = grid.agg(F.min("t").alias("_a"), F.max("t").alias("_z"))  # one row
    inside = F.lit(True)
    for n in names:
        inside = inside & F.col(n).between(F.col("_a"), F.col("_z"))
    ok = instants.join(F.broadcast(span)).filter(inside).drop("_a", "_z")
    items = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("t")) for n in names])
    probe = ok.select("day", F.explode(items).alias("_i")).select("day", "_i.n", "_i.t")
    hit = grid.select("market", "t", "lc").join(F.broadcast(probe), "t")
    return hit.groupBy("day", "market").agg(*[F.max(F.when(F.col("n") == n, F.col("lc"))).alias(n) for n in names])


def ny_days(grid: DataFrame) -> DataFrame:
    """New York calendar days the grid touches."""
    span = grid.agg(fn.ny_date(F.min("t")).alias("a"), fn.ny_date(F.max("t")).alias("z"))
    return span.select(F.explode(F.sequence("a", "z")).alias("day"))


def _t_stat(col: str) -> Column:
    sd = F.stddev_samp(col)
    return F.when((F.count(col) > 2) & (sd > 0), F.avg(col) / F.when(sd > 0, sd) * F.sqrt(F.count(col)))


def in_view(t: str, since: Column | None) -> Column:
    """Instants at or after `since`; all without one. Returns are taken before, so the first hour in view has its own."""
    return F.lit(True) if since is None else F.col(t) >= since


def session_stats(grid: DataFrame, *, big: float, since: Column | None = None) -> DataFrame:
    """Hours, return, variance share, volume share and rate of big hours per session."""
    g = grid.filter(F.col("r").isNotNull() & in_view("t", since)).withColumn("session", fn.session_bucket(F.col("t")))
    per = g.groupBy("session").agg(F.count("*").alias("hours"), (F.sum("r") * 100).alias("sum_ret_pct"), F.sum(F.col("r") * F.col("r")).alias("_var"),
                                   F.sum("volume").alias("_vol"), F.count_if(F.abs("r") >= big).alias("big_hours"))
    all_ = Window.partitionBy()  # six sessions
    return per.select("session", "hours", "sum_ret_pct", (F.col("_var") / F.sum("_var").over(all_) * 100).alias("var_share_pct"),
                      (F.col("_vol") / F.sum("_vol").over(all_) * 100).alias("vol_share_pct"), "big_hours",
                      (F.col("big_hours") / F.col("hours") * 100).alias("big_rate_pct"))


def weekend_moves(grid: DataFrame, *, books: Column | None = None, since: Column | None = None) -> DataFrame:
    """Per book and Friday: equal-weight weekend move (Fri 19:00 to Sun 17:00 New York bar stamps) and the move from there to Monday 08:00, in
    percent. `books` names the books a market is in, as an array; without it all markets are one book."""
    d = F.col("day")
    inst = ny_days(grid).filter(F.weekday(d) == 4).select(
        "day", fn.local_to_utc(d, 19 * 60).alias("fri"), fn.local_to_utc(F.date_add(d, 2), 17 * 60).alias("sun"),
        fn.local_to_utc(F.date_add(d, 3), 8 * 60).alias("mon")).filter(in_view("fri", since))
    w = at_instants(grid, inst, ["fri", "sun", "mon"]).withColumn("book", F.explode(books) if books is not None else F.lit("all"))
    return w.groupBy("book", "day").agg((F.avg(F.col("sun") - F.col("fri")) * 100).alias("weekend"), (F.avg(F.col("mon") - F.col("sun")) * 100).alias("reopen"))


def weekend_summary(moves: DataFrame) -> DataFrame:
    """Per book; `moves`: book, weekend, reopen."""
    return moves.groupBy("book").agg(F.count("*").alias("n"), F.count_if(F.col("weekend") > 0).alias("up_weekend"), F.avg("weekend").alias("mean_weekend"),
                                     _t_stat("weekend").alias("t_weekend"), F.count_if(F.col("reopen") > 0).alias("up_reopen"), F.avg("reopen").alias("mean_reopen"),
                                     F.count_if(F.signum("weekend") == F.signum("reopen")).alias("same_sign"))


def night_control(grid: DataFrame, *, since: Column | None = None) -> DataFrame:
    """Weekday nights (not Friday) 19:00 to 03:00 New York, equal weight, in percent."""
    d = F.col("day")
    inst = ny_days(grid).filter(F.weekday(d) < 4).select("day", fn.local_to_utc(d, 19 * 60).alias("a"), fn.local_to_utc(F.date_add(d, 1), 3 * 60).alias("b")).filter(in_view("a", since))
    n = at_instants(grid, inst, ["a", "b"]).groupBy("day").agg((F.avg(F.col("b") - F.col("a")) * 100).alias("move"))
    return n.agg(F.count("move").alias("n"), F.count_if(F.col("move") > 0).alias("up"), F.avg("move").alias("mean_move"))


def follow_through(grid: DataFrame, masks: dict[str, Column], *, least: int = 50, since: Column | None = None) -> DataFrame:
    """Per mask: mean lag-1 autocorrelation over markets, and how often the hour after a
    two-sigma hour reverses, with its mean signed move in percent."""
    g = shifted_value(grid, "r", 1, "nx").filter(F.col("r").isNotNull() & F.col("nx").isNotNull() & in_view("t", since))
    tags = F.array(*[F.when(m, F.lit(k)) for k, m in masks.items()])
    g = g.withColumn("mask", F.explode(F.filter(tags, lambda v: v.isNotNull())))
    per = g.groupBy("mask", "market").agg(F.count("*").alias("_n"), F.corr("r", "nx").alias("_ac"), F.stddev_samp("r").alias("_sd"))
    per = per.filter(F.col("_n") >= least)
    big = g.join(per, ["mask", "market"]).filter(F.abs("r") >= F.col("_sd") * 2)
    signed = F.signum("r") * F.col("nx") * 100
    after = big.groupBy("mask").agg(F.count("*").alias("n_big"), (F.avg((signed < 0).cast("double")) * 100).alias("reversed_pct"), F.avg(signed).alias("mean_signed"))
    return per.groupBy("mask").agg(F.avg("_ac").alias("mean_ac"), F.count("*").alias("markets")).join(after, "mask", "left")


def overnight_sign(grid: DataFrame, *, big: float = 2.0, since: Column | None = None) -> DataFrame:
    """Does the day session (08:00 to 15:00 New York) keep the sign of the night before it
    (previous day's 15:00 to 08:00); also after a move of `big` percent."""
    d = F.col("day")
    days = ny_days(grid)
    first = days.agg(F.min("day").alias("_first"))
    inst = days.join(F.broadcast(first)).filter((F.weekday(d) < 5) & (F.weekday(d) > 0) & (d > F.col("_first"))).select(
        "day", fn.local_to_utc(F.date_sub(d, 1), 15 * 60).alias("a"), fn.local_to_utc(d, 8 * 60).alias("b"), fn.local_to_utc(d, 15 * 60).alias("c")).filter(in_view("a", since))
    m = at_instants(grid, inst, ["a", "b", "c"]).select(((F.col("b") - F.col("a")) * 100).alias("on"), ((F.col("c") - F.col("b")) * 100).alias("dy"))
    ok = m.filter(F.col("on").isNotNull() & F.col("dy").isNotNull() & (F.col("on") != 0))
    same, wide = F.signum("on") == F.signum("dy"), F.abs("on") >= big
    return ok.agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.count_if(wide).alias("n_big"), F.count_if(same & wide).alias("same_big"))


def funding_level(funding: DataFrame, *, since: Column | None = None) -> DataFrame:
    """Annualised mean funding in percent and the share of positive hours, per market."""
    return funding.filter(in_view("t", since)).groupBy("market").agg(F.count("funding_rate").alias("hours"), (F.avg("funding_rate") * 24 * 365 * 100).alias("annual_pct"),
                                         (F.avg((F.col("funding_rate") > 0).cast("double")) * 100).alias("positive_pct"))


def long_short(closes: DataFrame, *, top: int = 5, least: int = 10, since: Column | None = None) -> DataFrame:
    """Per day with at least `least` markets: mean next-day return of the day's best `top` less
    its worst `top`. `closes`: market, d, lc (one row per market and day)."""
    closes = closes.filter(in_view("d", since))
    days = closes.select("d").distinct()
    nxt = days.select("d", F.lead("d").over(Window.orderBy("d")).alias("next_d"), F.lag("d").over(Window.orderBy("d")).alias("prev_d"))  # calendar
    c = closes.join(F.broadcast(nxt), "d")
    prev = closes.select("market", F.col("d").alias("prev_d"), F.col("lc").alias("_p"))
    follow = closes.select("market", F.col("d").alias("next_d"), F.col("lc").alias("_n"))
    j = c.join(prev, ["market", "prev_d"], "left").join(follow, ["market", "next_d"], "left")
    j = j.withColumns({"r": (F.col("lc") - F.col("_p")) * 100, "nx": (F.col("_n") - F.col("lc")) * 100}).filter(F.col("r").isNotNull())
    w = Window.partitionBy("d")
    lo = F.row_number().over(w.orderBy("r", "market"))
    j = j.withColumns({"_lo": lo, "_k": F.count("*").over(w)}).filter((F.col("_k") >= least) & F.col("next_d").isNotNull())
    best = F.avg(F.when(F.col("_lo") > F.col("_k") - top, F.col("nx")))
    worst = F.avg(F.when(F.col("_lo") <= top, F.col("nx")))
    return j.groupBy("d").agg((best - worst).alias("spread"))


def premium_deciles(grid: DataFrame, funding: DataFrame, *, slots: int, least: int = 200, since: Column | None = None) -> DataFrame:
    """Per market with enough hours: mean forward return (percent) in the top and bottom premium
    decile, after the top 5 % of funding, and overall. Quantiles are per market over the hours
    of its grid, a bounded group."""
    g = forward_return(grid, slots, "fw").join(funding.select("market", "t", "funding_rate", "premium"), ["market", "t"])
    g = g.withColumn("fw", F.col("fw") * 100).filter(in_view("t", since) & F.col("fw").isNotNull() & F.col("premium").isNotNull() & F.col("funding_rate").isNotNull())
    q = g.groupBy("market").agg(F.count("*").alias("n"), F.expr("percentile(premium, array(0.1, 0.9))").alias("_q"), F.expr("percentile(funding_rate, 0.95)").alias("_f"))
    j = g.join(q.filter(F.col("n") >= least), "market")
    return j.groupBy("market").agg(
        F.max("n").alias("n"), F.avg(F.when(F.col("premium") >= F.col("_q")[1], F.col("fw"))).alias("after_rich"),
        F.avg(F.when(F.col("premium") <= F.col("_q")[0], F.col("fw"))).alias("after_cheap"),
        F.avg(F.when(F.col("funding_rate") >= F.col("_f"), F.col("fw"))).alias("after_funding"), F.avg("fw").alias("mean_fw"))
