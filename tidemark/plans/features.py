"""Point-in-time feature groups keyed by (event_id, decision_time).

A group is a function DataFrame -> DataFrame with declared keys and phase. Everything a row may
know is looked up at its anchor or decision instant; windowed means and sums come from running
totals looked up at the two ends of the window, so no group joins events with all their bars.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.asof import DAY, asof_join, asof_parts, asof_points
from tidemark.operators.ranges import range_aggregate, running_totals
from tidemark.plans import history as hs
from tidemark.session import cut
from tidemark.sources.calendar import attach, attach_ny_day

KEY = ["event_id", "decision_time"]


# ---- registry --------------------------------------------------------------------------------
@dataclass(frozen=True)
class Group:
    name: str
    keys: tuple[str, ...]
    phases: tuple[str, ...]
    build: Callable[..., DataFrame]
    not_point_in_time: tuple[str, ...] = ()


REGISTRY: dict[str, Group] = {}


def feature_group(name: str, keys: str, phases: tuple[str, ...] = ("pre", "post"), not_point_in_time: str = ""):
    """Declare a group; a key may belong to one group only."""
    names = tuple(keys.split())
    taken = {k: g.name for g in REGISTRY.values() for k in g.keys}
    clash = [k for k in names if k in taken]
    if clash:
        raise ValueError(f"keys {clash} already belong to {taken[clash[0]]}")

    def wrap(build):
        REGISTRY[name] = Group(name, names, phases, build, tuple(not_point_in_time.split()))
        return build
    return wrap


def non_point_in_time(spark: SparkSession) -> DataFrame:
    """Registered keys that are not known at the decision, per group and phase."""
    rows = [(g.name, p, len(g.not_point_in_time)) for g in REGISTRY.values() for p in g.phases if g.not_point_in_time]
    return spark.createDataFrame(rows, "feature_group string, phase string, keys int")


def columns_by_group(wide: DataFrame, prefix: str = "f_") -> DataFrame:
    """Columns and filled values per declared group; an undeclared column is an error."""
    owner = {k: g.name for g in REGISTRY.values() for k in g.keys}
    cols = [c for c in wide.columns if c.startswith(prefix)]
    unknown = [c for c in cols if c[len(prefix):] not in owner]
    if unknown:
        raise ValueError(f"columns of no declared group: {unknown}")
    counts = wide.agg(*[F.count(c).alias(c) for c in cols])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(owner[c[len(prefix):]]).alias("feature_group"), F.lit(c).alias("c"),
                                                      F.col(c).alias("n")) for c in cols])).alias("s")).select("s.*")
    return long.groupBy("feature_group").agg(F.count("c").alias("columns"), F.sum("n").alias("filled"))


# ---- column helpers --------------------------------------------------------------------------
def feature_columns(df: DataFrame, prefix: str = "f_", suffix: str = "__missing") -> DataFrame:
    return df.select(*[c for c in df.columns if c.startswith(prefix) and not c.endswith(suffix)])


def missing_companions(df: DataFrame, prefix: str = "f_", suffix: str = "__missing") -> DataFrame:
    """`<f>__missing` = 1.0 where the feature is null, else 0.0."""
    feats = [c for c in df.columns if c.startswith(prefix) and not c.endswith(suffix)]
    return df.withColumns({c + suffix: F.col(c).isNull().cast("double") for c in feats})


def with_missing_count(df: DataFrame, prefix: str = "f_", suffix: str = "__missing") -> DataFrame:
    flags = [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]
    total = F.lit(0.0)
    for c in flags:
        total = total + F.col(c)
    return df.withColumn("n_missing", total.cast("int"))


def same_day_counts(events: DataFrame) -> DataFrame:
    """Events on the New York date of each event, itself included. Counted first, then joined:
    a busy day is an aggregate and a broadcast-size row, not a window partition."""
    day = events.withColumn("_ny", fn.ny_date(F.col("t0")))
    n = day.groupBy("_ny").agg(F.count("*").alias("n_events_same_day"))
    return day.join(n, "_ny", "left").drop("_ny")


def choose_benchmark(events: DataFrame, perp_benchmark: DataFrame, reach: int) -> DataFrame:
    """'perp' when the event has a perp path and the perp benchmark goes back `reach` seconds."""
    first = perp_benchmark.agg(F.min("t").alias("_first"))  # one row
    ok = F.col("has_perp") & (F.col("_first") <= fn.plus_seconds(F.col("t0"), -reach))
    return events.join(F.broadcast(first)).withColumn("benchmark", F.when(ok, "perp").otherwise("equity")).drop("_first")


def decisions(events: DataFrame, offsets: dict[str, int], buffers: dict[str, int] | None = None) -> DataFrame:
    """One row per (event, decision) with `as_of` and the anchor of the pre groups,
    min(as_of, t0 - buffer). `offsets` are seconds after t0."""
    d = F.explode(F.array(*[F.struct(F.lit(k).alias("decision_time"), F.lit(v).alias("_s")) for k, v in offsets.items()]))
    out = events.filter(F.col("t0").isNotNull()).withColumn("_d", d).select(*events.columns, "_d.*")
    out = out.withColumn("as_of", fn.plus_seconds(F.col("t0"), F.col("_s"))).drop("_s")
    back = fn.plus_seconds(F.col("t0"), -fn.p0_buffer(F.col("t0_source"), buffers))
    return out.withColumn("anchor", F.least("as_of", back))


def bars_with_totals(bars: DataFrame, bucket: int) -> DataFrame:
    """Bars with running count, volume and squared volume per market."""
    return running_totals(bars, on=["market"], order=["t_end"], ts="t_end", bucket=bucket,
                          totals={"c_n": F.lit(1), "c_v": F.col("volume"), "c_v2": F.col("volume") * F.col("volume")})


def _between(lo: str, hi: str, col: str) -> Column:
    """Total of a running column over (lo, hi]."""
    z = F.lit(0.0)
    return F.coalesce(F.col(f"{hi}.{col}"), z) - F.coalesce(F.col(f"{lo}.{col}"), z)


def _mean_volume(lo: str, hi: str, least: int = 1) -> Column:
    n = _between(lo, hi, "c_n")
    return F.when(n >= least, _between(lo, hi, "c_v") / F.when(n >= least, n))


# ---- daily windows ---------------------------------------------------------------------------
def daily_with_session_end(daily: DataFrame, sessions: DataFrame) -> DataFrame:
    """`end_ts`: the session close of the bar's New York date when that is earlier than the
    next New York midnight."""
    midnight = fn.local_to_utc(F.date_add("d", 1), 0)
    s = F.broadcast(sessions.select(F.col("d"), "close_ts"))  # one row per session
    return daily.join(s, "d", "left").withColumn("end_ts", F.when(F.col("close_ts") < midnight, F.col("close_ts")).otherwise(midnight)).drop("close_ts")


def daily_windows(daily: DataFrame, *, on: str, order: str) -> DataFrame:
    """Returns, realised volatility, 52-week distances and volume ratio at every daily bar. A
    symbol has one row per session, so its window is bounded by the calendar."""
    w = Window.partitionBy(on).orderBy(order)
    c = F.col("close")
    out = daily.withColumn("_n", F.row_number().over(w)).withColumn("_r", fn.log_ret(c, F.lag("close", 1).over(w)))
    w20, w252 = w.rowsBetween(-19, 0), w.rowsBetween(-251, 0)
    w60, w5 = w.rowsBetween(-59, 0), w.rowsBetween(-4, 0)
    hi, lo = F.max("high").over(w252), F.min("low").over(w252)
    enough = F.col("_n") >= 200
    base = F.avg("volume").over(w60)
    cols = {f"ret_{n}d": fn.log_ret(c, F.lag("close", n).over(w)) for n in (1, 5, 20, 60)}
    cols["rvol_20d"] = F.when(F.count("_r").over(w20) == 20, F.stddev_samp("_r").over(w20))
    cols["dist_52w_high"] = F.when(enough, fn.log_ret(c, hi))
    cols["dist_52w_low"] = F.when(enough, fn.log_ret(c, lo))
    cols["dvol_5d_ratio"] = F.when((F.col("_n") >= 20) & (base > 0), F.avg("volume").over(w5) / F.when(base > 0, base))
    return out.withColumns(cols).drop("_n", "_r")


DAILY_KEYS = ("ret_1d", "ret_5d", "ret_20d", "ret_60d", "rvol_20d", "dist_52w_high", "dist_52w_low", "dvol_5d_ratio")


def daily_spec(windows: DataFrame, *, on: str, at: str, take: tuple[str, ...] = DAILY_KEYS) -> tuple[DataFrame, dict]:
    """Lookup of the daily row in force, for `asof_parts`."""
    return windows, dict(on=[on], left_ts=at, right_ts="end_ts", take=list(take), bucket=90 * DAY)


# ---- groups ----------------------------------------------------------------------------------
@feature_group("calendar", "amc bmo rth weekday friday hour_ny hours_to_next_open hours_to_next_close h24_closed holiday_adjacent "
               "days_since_last_event n_events_same_day")
def calendar_group(rows: DataFrame, calendar: DataFrame, events: DataFrame, *, horizon: int = DAY) -> DataFrame:
    """Clock and calendar facts of t0 plus the distance to the name's last settled event."""
    ev = rows.select(*KEY, "underlying", "t0", "as_of").withColumn("_h", fn.plus_seconds(F.col("t0"), horizon))
    ev = attach(attach_ny_day(attach(ev, calendar, "t0"), calendar, "t0"), calendar, "_h", "h_")
    same = events.groupBy(fn.ny_date(F.col("t0")).alias("_ny")).agg(F.count("*").alias("_same"))
    ev = ev.withColumn("_ny", fn.ny_date(F.col("t0"))).join(same, "_ny", "left")
    settled = events.select("underlying", fn.plus_seconds(F.col("t0"), horizon).alias("_settled"), F.col("t0").alias("last_t0")).groupBy(
        "underlying", "_settled").agg(F.max("last_t0").alias("last_t0"))
    last = asof_join(rows.select(*KEY, "underlying", "as_of"), settled, on=["underlying"], left_ts="as_of", right_ts="_settled", take=["last_t0"],
                     into="_last", bucket=DAY).select(*KEY, "_last")
    ev = ev.join(last, KEY, "left")
    t0 = F.col("t0")
    timing = fn.classify_timing(t0, F.col("is_open"), F.col("is_session_day"))
    wd = F.weekday(fn.ny_time(t0))
    return ev.select(
        *KEY, (timing == "AMC").cast("double").alias("amc"), (timing == "BMO").cast("double").alias("bmo"),
        (timing == "RTH").cast("double").alias("rth"), wd.cast("double").alias("weekday"), (wd == 4).cast("double").alias("friday"),
        fn.ny_hour(t0).alias("hour_ny"), (fn.seconds_between(F.col("next_open"), t0) / 3600).alias("hours_to_next_open"),
        (fn.seconds_between(F.col("next_close"), t0) / 3600).alias("hours_to_next_close"),
        (~F.col("h_is_open")).cast("double").alias("h24_closed"), "holiday_adjacent",
        (fn.seconds_between(t0, F.col("_last.last_t0")) / DAY).alias("days_since_last_event"),
        F.col("_same").cast("double").alias("n_events_same_day"))


@dataclass(frozen=True)
class FineRules:
    """Window lengths in seconds; defaults are the minute-bar values."""

    short: int = 1800
    long: int = 3600
    staleness: int = 300
    grid: int = 60
    bucket: int = DAY
    least_base: int = 12
    reaction: tuple[tuple[str, int], ...] = (("1m", 60), ("5m", 300), ("15m", 900), ("30m", 1800), ("60m", 3600))
    buffers: tuple[tuple[str, int], ...] = tuple(fn.P0_BUFFER_SECONDS.items())
    settle_lag: int = 60


HOURLY = FineRules(short=3 * 3600, long=6 * 3600, staleness=2 * 3600, grid=3600, bucket=5 * DAY,
                   reaction=(("1m", 900), ("5m", 3600), ("15m", 2 * 3600), ("30m", 3 * 3600), ("60m", 6 * 3600)),
                   buffers=(("sec_8k", 3 * 3600),))


def _drift(now: str, then: str) -> Column:
    ok = F.col(f"{then}.t_end") < F.col(f"{now}.t_end")
    return F.when(ok, fn.log_ret(F.col(f"{now}.close"), F.col(f"{then}.close")))


@feature_group("pre_price", "ret_1d ret_5d ret_20d ret_60d rvol_20d dist_52w_high dist_52w_low dvol_5d_ratio drift_60m drift_30m "
               "gap_since_close ext_vol_ratio vol_30m_ratio")
def pre_price_group(rows: DataFrame, bars: DataFrame, windows: DataFrame, calendar: DataFrame, rules: FineRules) -> DataFrame:
    """Daily-bar features at the anchor, drift and gap from fine bars, and volume ratios."""
    ev = attach(rows.select(*KEY, "market", "anchor"), calendar, "anchor")
    at, pc = F.col("anchor"), F.col("prev_close")
    points = {"x_now": at, "x_long": fn.plus_seconds(at, -rules.long), "x_short": fn.plus_seconds(at, -rules.short),
              "x_day": fn.plus_seconds(at, -DAY), "x_pc": pc, "x_pcd": fn.plus_seconds(pc, -DAY)}
    fine = asof_points(ev, bars_with_totals(bars, rules.bucket), key=KEY, on=["market"], points=points, right_ts="t_end",
                       take=["t_end", "close", "c_n", "c_v"], grid=rules.grid, bucket=rules.bucket)
    ratio = F.try_divide
    ext, ext_base = _mean_volume("x_pc", "x_now"), _mean_volume("x_pcd", "x_pc", rules.least_base)
    recent, base = _mean_volume("x_short", "x_now"), _mean_volume("x_day", "x_short", rules.least_base)
    fine = fine.select(*KEY, _drift("x_now", "x_long").alias("drift_60m"), _drift("x_now", "x_short").alias("drift_30m"),
                       _drift("x_now", "x_pc").alias("gap_since_close"), ratio(ext, ext_base).alias("ext_vol_ratio"),
                       ratio(recent, base).alias("vol_30m_ratio"))
    daily = asof_parts(rows.select(*KEY, "market", "anchor"), {"dly": daily_spec(windows, on="market", at="anchor")}, key=KEY)
    daily = daily.select(*KEY, *[F.col(f"dly.{k}").alias(k) for k in DAILY_KEYS])
    return daily.join(fine, KEY, "left")


@feature_group("history", "hist_n hist_r24_mean hist_r24_std hist_r24_skew hist_abs_r24_mean hist_up_rate hist_cont_rate hist_last1_r24 "
               "hist_last2_r24 hist_last3_r24 hist_last4_r24 hist_surprise_beta hist_eps_surprise_mean")
def history_group(events: DataFrame, rows: DataFrame, *, horizon: int = DAY) -> DataFrame:
    """The name's past that is settled at each decision; see `tidemark.plans.history`."""
    return hs.history_features(events, horizon=horizon, rows=rows)


@feature_group("market", "mkt_ret_1d mkt_ret_5d mkt_ret_20d mkt_rvol_20d vix_level vix_chg_5d sector_ret_1d sector_ret_5d mkt_drift_60m")
def market_group(rows: DataFrame, benchmark_windows: DataFrame, vix_windows: DataFrame, sector_windows: DataFrame,
                 benchmark: DataFrame, rules: FineRules) -> DataFrame:
    """Benchmark, volatility index and sector proxy at the anchor. `rows` carries `sector`; the
    single-series windows carry a constant key `one`."""
    r = rows.select(*KEY, "sector", "anchor").withColumn("one", F.lit(1))
    base = r
    r = asof_parts(base, {
        "m": daily_spec(benchmark_windows, on="one", at="anchor", take=("ret_1d", "ret_5d", "ret_20d", "rvol_20d")),
        "v": daily_spec(vix_windows, on="one", at="anchor", take=("close", "ret_5d")),
        "s": daily_spec(sector_windows, on="sector", at="anchor", take=("ret_1d", "ret_5d"))}, key=KEY)
    at = F.col("anchor")
    pts = asof_points(base, benchmark.withColumn("one", F.lit(1)), key=KEY, on=["one"], right_ts="t_end", take=["t_end", "close"],
                      points={"x_now": at, "x_long": fn.plus_seconds(at, -rules.long)}, grid=rules.grid, bucket=rules.bucket)
    positive = F.col("v.close") > 0
    out = r.select(*KEY, F.col("m.ret_1d").alias("mkt_ret_1d"), F.col("m.ret_5d").alias("mkt_ret_5d"), F.col("m.ret_20d").alias("mkt_ret_20d"),
                   F.col("m.rvol_20d").alias("mkt_rvol_20d"), F.when(positive, F.col("v.close")).alias("vix_level"),
                   F.when(positive, F.col("v.ret_5d")).alias("vix_chg_5d"), F.col("s.ret_1d").alias("sector_ret_1d"), F.col("s.ret_5d").alias("sector_ret_5d"))
    return out.join(pts.select(*KEY, _drift("x_now", "x_long").alias("mkt_drift_60m")), KEY, "left")


@feature_group("perp_state", "funding_rate funding_mean_24h premium oi_notional oi_chg_24h day_ntl_vlm perp_vol_30d max_leverage listing_age_d",
               not_point_in_time="max_leverage")
def perp_state_group(rows: DataFrame, funding: DataFrame, ctx: DataFrame, daily: DataFrame, markets: DataFrame, rules: FineRules) -> DataFrame:
    """Funding, premium, open interest, notional, leverage cap and listing age at the anchor.
    `daily`: market, end_ts, notional. `markets`: market, max_leverage, listing_start (a dimension)."""
    at = F.col("anchor")
    r = rows.select(*KEY, "market", "t0", "anchor", "has_perp")
    run = running_totals(funding, on=["market"], order=["t"], ts="t", bucket=rules.bucket, totals={"c_n": F.lit(1), "c_v": F.col("funding_rate")})
    fund = asof_points(r, run, key=KEY, on=["market"], right_ts="t", take=["t", "funding_rate", "premium", "c_n", "c_v"],
                       points={"x_now": fn.plus_seconds(at, -rules.settle_lag), "x_day": fn.plus_seconds(at, -DAY)}, grid=3600, bucket=rules.bucket)
    snap = asof_points(r, ctx, key=KEY, on=["market"], right_ts="t", take=["t", "open_interest", "mark_px", "premium", "day_ntl_vlm"],
                       points={"y_now": at, "y_day": fn.plus_seconds(at, -DAY)}, tie="seq", bucket=rules.bucket)
    w = Window.partitionBy("market").orderBy("end_ts").rowsBetween(-29, 0)  # one row per market and day
    vals = F.array_sort(F.collect_list("notional").over(w))
    n = F.size("_v")
    mid = (F.get("_v", F.floor((n - 1) / 2).cast("int")) + F.get("_v", F.floor(n / 2).cast("int"))) / 2
    med = daily.withColumn("_v", vals).withColumn("perp_vol_30d", F.when(n >= 5, mid)).drop("_v")
    j = asof_parts(r, {"d": daily_spec(med, on="market", at="anchor", take=("perp_vol_30d",))}, key=KEY)
    j = j.join(fund, KEY, "left").join(snap, KEY, "left").join(markets, "market", "left")
    oi, prev = F.col("y_now.open_interest"), F.col("y_day.open_interest")
    fresh = fn.seconds_between(at, F.col("y_day.t")) <= 2 * DAY
    listed = F.coalesce(F.col("has_perp"), F.lit(True)) & (F.col("listing_start") <= at)
    return j.select(
        *KEY, F.col("x_now.funding_rate").alias("funding_rate"),
        F.try_divide(_between("x_day", "x_now", "c_v"), _between("x_day", "x_now", "c_n")).alias("funding_mean_24h"),
        F.coalesce("y_now.premium", "x_now.premium").alias("premium"), (oi * F.col("y_now.mark_px")).alias("oi_notional"),
        F.when(fresh, fn.log_ret(oi, prev)).alias("oi_chg_24h"), F.col("y_now.day_ntl_vlm").alias("day_ntl_vlm"),
        F.col("d.perp_vol_30d").alias("perp_vol_30d"), "max_leverage",
        F.when(listed, fn.seconds_between(F.col("t0"), F.col("listing_start")) / DAY).alias("listing_age_d"))


@feature_group("surprise", "eps_surprise rev_surprise eps_beat eps_surprise_abs sign_agree eps_surprise_z rev_surprise_z n_estimates", phases=("post",),
               not_point_in_time="eps_surprise rev_surprise eps_beat eps_surprise_abs sign_agree eps_surprise_z rev_surprise_z n_estimates")
def surprise_group(events: DataFrame, rows: DataFrame, *, horizon: int = DAY) -> DataFrame:
    """Surprises of the event and their z-scores against the name's past surprises that are settled at each decision."""
    ev = events.withColumns({"eps_s": fn.surprise_pct(F.col("eps_actual"), F.col("eps_estimate")),
                             "rev_s": fn.surprise_pct(F.col("rev_actual"), F.col("rev_estimate"))})
    past = ev.withColumn("settled_at", fn.plus_seconds(F.col("t0"), horizon))
    totals = {"n_all": F.lit(1)}
    for c in ("eps_s", "rev_s"):
        totals |= {f"n_{c}": F.col(c).isNotNull().cast("double"), f"s_{c}": F.col(c), f"q_{c}": F.col(c) * F.col(c)}
    run = running_totals(past, on=["underlying"], order=["settled_at", "event_id"], ts="settled_at", totals=totals, bucket=DAY)
    own = ev.select("event_id", "eps_s", "rev_s", "n_estimates")
    j = asof_join(rows.select(*KEY, "underlying", "as_of"), run, on=["underlying"], left_ts="as_of", right_ts="settled_at",
                  take=list(totals), tie="n_all", into="h", bucket=DAY).join(own, "event_id")

    def z(c: str) -> Column:
        n, s, q = F.col(f"h.n_{c}"), F.col(f"h.s_{c}"), F.col(f"h.q_{c}")
        var = (q - s * s / F.when(n > 0, n)) / F.when(n > 1, n - 1)
        return F.when((n >= 4) & (var > 1e-9), (F.col(c) - s / F.when(n > 0, n)) / F.sqrt(F.when(var > 1e-9, var)))
    e, r = F.col("eps_s"), F.col("rev_s")
    return j.select(*KEY, e.alias("eps_surprise"), r.alias("rev_surprise"), (e > 0).cast("double").alias("eps_beat"),
                    F.abs(e).alias("eps_surprise_abs"), (fn.sign(e) * fn.sign(r)).alias("sign_agree"), z("eps_s").alias("eps_surprise_z"),
                    z("rev_s").alias("rev_surprise_z"), F.col("n_estimates").cast("double").alias("n_estimates"))


@feature_group("reaction", "r_1m r_5m r_15m r_30m r_60m r_now abs_r_now path_max path_min path_range vol_z vol_ratio ar_now premium_post", phases=("post",))
def reaction_group(rows: DataFrame, bars: DataFrame, benchmark: DataFrame, ctx: DataFrame, funding: DataFrame, rules: FineRules) -> DataFrame:
    """Early reaction from bars that end after the release and by the decision instant."""
    r = rows.select(*KEY, "market", "t0", "t0_source", "as_of")
    t0, as_of = F.col("t0"), F.col("as_of")
    back = fn.plus_seconds(t0, -fn.p0_buffer(F.col("t0_source"), dict(rules.buffers)))
    points = {"x_p0": back, "x_p0d": fn.plus_seconds(back, -DAY), "x_t0": t0, "x_now": as_of}
    points |= {f"x_{k}": F.when(fn.plus_seconds(t0, s) <= as_of, fn.plus_seconds(t0, s)) for k, s in rules.reaction}
    p = asof_points(r, bars_with_totals(bars, rules.bucket), key=KEY, on=["market"], points=points, right_ts="t_end",
                    take=["t_end", "close", "c_n", "c_v", "c_v2"], grid=rules.grid, bucket=rules.bucket)
    j = r.join(p, KEY)
    p0, p0_end = F.col("x_p0.close"), F.col("x_p0.t_end")
    post_from = F.greatest(p0_end, t0)
    j = j.withColumn("_from", F.when(p0 > 0, post_from))
    # the path only spans the reaction, so meeting its bars directly is bounded by its length
    path = range_aggregate(j.filter(F.col("_from").isNotNull()), bars, key=KEY, on=["market"], lo="_from", hi="as_of", right_ts="t_end",
                           bucket=DAY, take=["high", "low"], aggs=[F.max("high").alias("_hi"), F.min("low").alias("_lo")])
    j = j.join(path, KEY, "left")
    base = r.withColumns({"one": F.lit(1), "_f_at": fn.plus_seconds(as_of, -rules.settle_lag)})
    b = asof_points(base, benchmark.withColumn("one", F.lit(1)), key=KEY, on=["one"], right_ts="t_end", take=["t_end", "close"],
                    points={"b_ref": back, "b_now": as_of}, grid=rules.grid, bucket=rules.bucket)
    prem = asof_parts(base.select(*KEY, "market", "as_of", "_f_at"), {
        "c": (ctx, dict(on=["market"], left_ts="as_of", right_ts="t", take=["t", "premium"], tie="seq", bucket=rules.bucket)),
        "f": (funding, dict(on=["market"], left_ts="_f_at", right_ts="t", take=["t", "premium"], grid=3600, bucket=rules.bucket))}, key=KEY)
    j = j.join(b, KEY, "left").join(prem.select(*KEY, "c", "f"), KEY, "left")

    def reacted(name: str) -> Column:
        hit = F.col(name)
        ok = (hit["t_end"] > post_from) & (fn.seconds_between(hit["at"], hit["t_end"]) <= rules.staleness)
        return F.when(ok & (p0 > 0), fn.log_ret(hit["close"], p0))
    now = reacted("x_now")
    hi, lo = fn.log_ret(F.col("_hi"), p0), fn.log_ret(F.col("_lo"), p0)
    n_pre, v_pre, q_pre = (_between("x_p0d", "x_p0", c) for c in ("c_n", "c_v", "c_v2"))
    start = F.when(p0_end > t0, F.col("x_p0")).otherwise(F.col("x_t0"))  # bars after max(p0 end, t0)
    n_post = F.col("x_now.c_n") - F.coalesce(start["c_n"], F.lit(0.0))
    mean_post = F.when(n_post > 0, (F.col("x_now.c_v") - F.coalesce(start["c_v"], F.lit(0.0))) / F.when(n_post > 0, n_post))
    mean_pre = F.when((n_pre >= 5) & (p0 > 0), v_pre / F.when(n_pre > 0, n_pre))
    var_pre = (q_pre - v_pre * v_pre / F.when(n_pre > 0, n_pre)) / F.when(n_pre > 1, n_pre - 1)
    ref, cur = F.col("b_ref"), F.col("b_now")
    b_ok = (cur["t_end"] > ref["t_end"]) & (fn.seconds_between(as_of, cur["t_end"]) <= rules.staleness)
    ctx_ok = F.col("c.t") > t0
    f_ok = F.col("f.t") > fn.plus_seconds(t0, -rules.settle_lag)
    return j.select(
        *KEY, *[reacted(f"x_{k}").alias(f"r_{k}") for k, _ in rules.reaction], now.alias("r_now"), F.abs(now).alias("abs_r_now"),
        hi.alias("path_max"), lo.alias("path_min"), (hi - lo).alias("path_range"),
        F.when(var_pre > 1e-9, (mean_post - mean_pre) / F.sqrt(F.when(var_pre > 1e-9, var_pre))).alias("vol_z"),
        F.when(mean_pre > 0, mean_post / F.when(mean_pre > 0, mean_pre)).alias("vol_ratio"),
        F.when(b_ok, now - fn.log_ret(cur["close"], ref["close"])).alias("ar_now"),
        F.coalesce(F.when(ctx_ok, F.col("c.premium")), F.when(f_ok, F.col("f.premium"))).alias("premium_post"))


# ---- dataset ---------------------------------------------------------------------------------
def build_dataset(rows: DataFrame, groups: dict[str, DataFrame], targets: DataFrame, meta: list[str]) -> DataFrame:
    """One row per (event, decision): metadata, `f_*`, companions, targets, target_missing. Groups
    are stored one after the other and then joined: their own joins have the same key, and in one plan all their
    sorts would fall into one stage and hold memory at once. A group that is not admissible before the release is null
    at pre decisions. A group without decision_time is refused: it would show every decision the same past."""
    late = [n for n, df in groups.items() if "decision_time" not in df.columns]
    if late:
        raise ValueError(f"groups not keyed by decision: {late}")
    out = rows.select(*KEY, "as_of", *meta)
    post = ~F.col("decision_time").startswith("pre")
    for name, df in groups.items():
        g = REGISTRY[name]
        out = out.join(cut(df.select(*KEY, *[F.col(k).alias(f"f_{k}") for k in g.keys])), KEY, "left")
        if "pre" not in g.phases:
            out = out.withColumns({f"f_{k}": F.when(post, F.col(f"f_{k}")) for k in g.keys})
    out = missing_companions(out)
    out = out.join(targets, "event_id", "left")
    return out.withColumn("target_missing", F.col("r_24h").isNull())


def leakage_check(pairs: DataFrame, horizon: int) -> DataFrame:
    """Rows of a history table that were not settled at the decision (must be empty), and how
    many were checked. `pairs`: past_t0, as_of."""
    leaks = F.coalesce(fn.plus_seconds(F.col("past_t0"), horizon) > F.col("as_of"), F.lit(True))
    return pairs.agg(F.count("*").alias("checked"), F.count_if(leaks).alias("leaks"))


def assert_no_leak(pairs: DataFrame, horizon: int) -> None:
    if leakage_check(pairs, horizon).first()["leaks"]:
        raise AssertionError("history contains rows that were not settled at the decision instant")
