"""Fills, costs, funding, sizing and the equal-split portfolio in table form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.asof import DAY, asof_points, floor_to
from tidemark.operators.intervals import most_exposed, open_counts, peak_concurrency, peaks
from tidemark.operators.ranges import running_totals
from tidemark.session import cut

KEY = ("event_id", "decision_time", "model")  # one prediction
SIZINGS = ("fixed", "by_confidence", "by_magnitude", "magnitude_gate")


@dataclass(frozen=True)
class TradeRules:
    max_lag: int = 300
    horizon: int = DAY
    threshold: float = 0.0
    target_vol: float = 0.03
    minute: int = 60  # seconds that one decision minute stands for
    grid: int = 60
    bucket: int = DAY


def fills_at(df: DataFrame, bars: DataFrame, points: dict[str, Column], *, key: Sequence[str], max_lag: int, grid: int, bucket: int) -> DataFrame:
    """Per named instant a struct (fill, fill_time, range_bps, reason): the open of the first
    bar that starts at or after it, unless it is missing, too late or not positive."""
    hit = asof_points(df, bars, key=key, on=["market"], points=points, right_ts="t", take=["open", "high", "low", "t"],
                      direction="forward", grid=grid, bucket=bucket)

    def judge(f: Column) -> Column:
        reason = (F.when(f["t"].isNull(), "no_bar_after_signal")
                  .when(fn.seconds_between(f["t"], f["at"]) > max_lag, "fill_lag")
                  .when(~F.coalesce(f["open"] > 0, F.lit(False)), "bad_bar"))
        ok = reason.isNull()
        return F.struct(F.when(ok, f["open"]).alias("fill"), F.when(ok, f["t"]).alias("fill_time"),
                        F.when(ok, F.try_divide(f["high"] - f["low"], f["open"]) * 1e4).alias("range_bps"), reason.alias("reason"))
    return df.join(hit.select(*key, *[judge(F.col(n)).alias(n) for n in points]), list(key), "left")


def funding_between(df: DataFrame, funding: DataFrame, *, key: Sequence[str], entry: str, exit_: str, bucket: int = 5 * DAY) -> DataFrame:
    """`funding_sum` over the settlement hours h with entry < h <= exit: 0 without a
    settlement, null unless every hour is present. Two prefix-sum lookups per row."""
    run = running_totals(funding, on=["market"], order=["t"], ts="t", bucket=bucket,
                         totals={"_n": F.lit(1), "_s": F.col("funding_rate")})
    p = asof_points(df, run, key=key, on=["market"], right_ts="t", take=["_n", "_s"], grid=3600, bucket=bucket,
                    points={"_a": floor_to(F.col(entry), 3600), "_z": floor_to(F.col(exit_), 3600)})
    need = fn.seconds_between(F.col("_z.at"), F.col("_a.at")) / 3600.0
    zero = F.lit(0.0)
    got = F.coalesce("_z._n", zero) - F.coalesce("_a._n", zero)
    total = F.coalesce("_z._s", zero) - F.coalesce("_a._s", zero)
    p = p.select(*key, F.when(need <= 0, zero).when(got == need, total).alias("funding_sum"))
    return df.join(p, list(key), "left")


def trade_fills(predictions: DataFrame, bars: DataFrame, rules: TradeRules) -> DataFrame:
    """Signal and exit fills of every prediction and why a row is not traded. Bars are looked
    up for rows that pass the signal checks only."""
    t0, p = F.col("t0"), F.col("p_up")
    side = F.signum(p - 0.5).cast("int")
    early = (F.when(t0.isNull(), "no_t0").when(p.isNull() | F.isnan(p) | (p == 0.5), "no_signal")
             .when(F.abs(p - 0.5) < rules.threshold, "below_threshold"))
    minutes = fn.lookup(F.col("decision_time"), fn.DECISION_MINUTES)
    base = predictions.withColumns({
        "signal_time": fn.plus_seconds(t0, minutes * rules.minute), "exit_signal_time": fn.plus_seconds(t0, rules.horizon),
        "early": early, "side": F.when(early.isNull(), side).otherwise(0)})
    go = F.col("early").isNull()
    out = fills_at(base, bars, {"entry": F.when(go, F.col("signal_time")), "exit": F.when(go, F.col("exit_signal_time"))}, key=KEY,
                   max_lag=rules.max_lag, grid=rules.grid, bucket=rules.bucket)
    has_bars = bars.select("market").distinct().withColumn("_bars", F.lit(True))
    out = out.join(has_bars, "market", "left")
    reason = (F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("_bars").isNull(), "no_bars")
              .when(F.col("entry.reason").isNotNull(), F.concat(F.lit("entry_"), F.col("entry.reason")))
              .when(F.col("exit.reason").isNotNull(), F.concat(F.lit("exit_"), F.col("exit.reason")))
              .when(F.col("entry.range_bps").isNull() | F.col("exit.range_bps").isNull(), "bad_bar"))
    return out.withColumn("untraded_reason", reason).drop("_bars", "early")


def trade_pnl(fills: DataFrame, funding: DataFrame, rules: TradeRules) -> DataFrame:
    """Costs, funding and net return once per prediction, then one row per sizing rule."""
    ok = F.col("untraded_reason").isNull()
    span = fills.withColumns({"_e0": F.when(ok, F.col("entry.fill_time")), "_e1": F.when(ok, F.col("exit.fill_time"))})
    j = funding_between(span, funding, key=KEY, entry="_e0", exit_="_e1", bucket=rules.bucket)
    cost = F.when(ok, fn.leg_cost_bps(F.col("entry.range_bps")) + fn.leg_cost_bps(F.col("exit.range_bps")))
    funded = ok & F.coalesce(F.col("has_perp"), F.lit(False)) & F.col("funding_sum").isNotNull()
    priced = j.withColumns({
        "cost_bps": cost, "funding_source": F.when(funded, "archive").otherwise("none"),
        "funding_bps": F.when(funded, F.col("side") * F.col("funding_sum") * 1e4).otherwise(0.0),
        "gross_return": F.when(ok, F.col("side") * (F.col("exit.fill") / F.col("entry.fill") - 1.0)),
        "_mag": F.coalesce(F.abs("magnitude_hat"), F.abs("r_hat"))})
    priced = priced.withColumn("net_return", F.col("gross_return") - (F.col("cost_bps") + F.col("funding_bps")) / 1e4)
    out = priced.withColumn("sizing", F.explode(F.array(*[F.lit(s) for s in SIZINGS])))
    size = F.when(ok, fn.position_size(F.col("sizing"), F.col("p_up"), F.col("_mag"), F.col("cost_bps") / 1e4, rules.target_vol))
    out = out.withColumn("size", F.coalesce(size, F.lit(0.0)))
    why = F.coalesce("untraded_reason", F.when(F.col("size") <= 0, F.when(F.col("sizing") == "magnitude_gate", "magnitude_gate")
                                               .otherwise("zero_size")))
    out = out.withColumn("untraded_reason", why).withColumn("traded", F.col("untraded_reason").isNull())
    return out.withColumn("pnl", F.when(F.col("traded"), F.col("size") * F.col("net_return"))).drop("_mag", "_e0", "_e1", "funding_sum")


def portfolio_weights(trades: DataFrame, *, by: Sequence[str], key: str, entry: str = "entry_time",
                      exit_: str = "exit_time", cap: float = 1.0) -> DataFrame:
    """Share of each position: cap x min(size, 1) / peak number of positions open during it."""
    peaks = peak_concurrency(trades, by=by, key=key, entry=entry, exit_=exit_)
    j = trades.join(peaks, [*by, key])
    return j.withColumn("weight", F.lit(cap) * F.least(F.col("size"), F.lit(1.0)) / F.greatest("peak", F.lit(1)))


def portfolio_metrics(weighted: DataFrame, *, by: Sequence[str], entry: str = "entry_time", exit_: str = "exit_time") -> DataFrame:
    """Totals, Sharpe-like ratio, drawdown, turnover, exposure and hit rate per slice. Only the
    daily PnL table (one row per slice and exit date) is ordered."""
    by = list(by)
    w = weighted.withColumns({"_pnl": F.col("weight") * F.col("net_return"), "_day": F.to_date(exit_)})
    totals = w.groupBy(*by).agg(
        F.count("*").alias("n_trades"), F.sum("_pnl").alias("total_return"), (F.sum("weight") * 2).alias("turnover"),
        F.avg(F.when(F.col("_pnl") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg("_pnl").alias("mean_pnl_per_trade"),
        F.greatest(F.datediff(F.max("_day"), F.min(F.to_date(entry))) + 1, F.lit(1)).alias("span_days"))
    daily = daily_stats(w.groupBy(*by, "_day").agg(F.sum("_pnl").alias("pnl")), by=by, day="_day", pnl="pnl")
    peak = open_counts(w, by=by, entry=entry, exit_=exit_, weight="weight").groupBy(*by).agg(
        F.max("exposure").alias("max_gross_exposure"))
    return (totals.join(daily, by).join(peak, by)
            .withColumn("turnover_daily", F.col("turnover") / F.col("span_days")))


def portfolio_slices(trades: DataFrame, subsets: dict[str, Column], *, by: Sequence[str] = ("model", "decision_time", "sizing"), key: str = "event_id",
                     entry: str = "entry_time", exit_: str = "exit_time", cap: float = 1.0) -> DataFrame:
    """Portfolio metrics of every slice `by` and every subset of its trades. Subsets overlap, and a position's share depends on the positions that are open with
    it in the subset; marks, weights and daily sums carry a column per subset, so no trade is copied. A slice that traded nothing has zeros.
    `trades`: by, key, traded, size, net_return, `entry` and `exit_`."""
    by, names = list(by), list(subsets)
    flagged = trades.select(*by, key, "traded", "size", "net_return", F.col(entry).alias(entry), F.col(exit_).alias(exit_), *[F.coalesce(c, F.lit(False)).alias(f"_in_{n}") for n, c in subsets.items()])
    flagged = cut(flagged)  # marks, intervals, shares and counts all read the priced trades
    held = F.col("traded") & F.col(entry).isNotNull() & F.col(exit_).isNotNull() & F.col("net_return").isNotNull() & ~F.isnan("net_return")
    own = flagged.filter(held)
    shares = peaks(own, by=by, key=key, entry=entry, exit_=exit_, slices={n: F.col(f"_in_{n}") for n in names})
    w = own.join(shares.select(*by, key, *[F.col(n).alias(f"_peak_{n}") for n in names]), [*by, key])
    w = w.withColumns({f"_w_{n}": F.when(F.col(f"_in_{n}"), F.lit(cap) * F.least(F.col("size"), F.lit(1.0)) / F.greatest(f"_peak_{n}", F.lit(1))) for n in names})
    w = cut(w.select(*by, entry, exit_, *[f"_w_{n}" for n in names], *[(F.col(f"_w_{n}") * F.col("net_return")).alias(f"_p_{n}") for n in names]))

    def long(df: DataFrame, columns: dict[str, str], also: Sequence[str] = ()) -> DataFrame:
        """A row per subset; `columns` maps a result to the prefix of its columns."""
        cells = F.array(*[F.struct(F.lit(n).alias("subset"), *[F.col(f"{prefix}{n}").alias(c) for c, prefix in columns.items()]) for n in names])
        return df.select(*by, *also, F.explode(cells).alias("_c")).select(*by, *also, "_c.*")

    def _where(n: str, instant: str) -> Column:
        return F.when(F.col(f"_w_{n}").isNotNull(), F.to_date(instant))

    def per(prefix: str, agg) -> list[Column]:
        return [agg(n).alias(f"{prefix}{n}") for n in names]

    there = long(flagged.groupBy(*by).agg(*per("a_", lambda n: F.count_if(F.col(f"_in_{n}"))), *per("b_", lambda n: F.count_if(F.col(f"_in_{n}") & ~F.col("traded")))),
                 {"_rows": "a_", "n_untraded": "b_"}).filter("_rows > 0").drop("_rows")
    sums = w.groupBy(*by).agg(*per("n_", lambda n: F.count(f"_w_{n}")), *per("r_", lambda n: F.sum(f"_p_{n}")), *per("t_", lambda n: F.sum(f"_w_{n}") * 2),
                              *per("h_", lambda n: F.avg((F.col(f"_p_{n}") > 0).cast("double"))), *per("m_", lambda n: F.avg(f"_p_{n}")),
                              *per("s_", lambda n: F.greatest(F.datediff(F.max(_where(n, exit_)), F.min(_where(n, entry))) + 1, F.lit(1))))
    totals = long(sums, {"n_trades": "n_", "total_return": "r_", "turnover": "t_", "hit_rate": "h_", "mean_pnl_per_trade": "m_", "span_days": "s_"}).filter("n_trades > 0")
    daily = long(w.groupBy(*by, F.to_date(exit_).alias("_day")).agg(*per("d_", lambda n: F.sum(f"_p_{n}"))), {"pnl": "d_"}, ["_day"]).filter("pnl IS NOT NULL")
    stats = daily_stats(daily, by=[*by, "subset"], day="_day", pnl="pnl")
    most = long(most_exposed(w, by=by, entry=entry, exit_=exit_, weights=[f"_w_{n}" for n in names]), {"max_gross_exposure": "_w_"})
    slice_ = [*by, "subset"]
    out = there.join(totals, slice_, "left").join(stats, slice_, "left").join(most, slice_, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_trades", "n_days")} | {c: F.when(F.col("n_trades").isNull(), 0.0).otherwise(F.col(c)) for c in
                                                                         ("total_return", "turnover", "max_drawdown", "max_gross_exposure")}
    out = out.withColumn("turnover_daily", F.when(F.col("n_trades").isNull(), 0.0).otherwise(F.col("turnover") / F.col("span_days")))
    return out.withColumns({c: v for c, v in zero.items() if c != "n_trades"}).withColumn("n_trades", zero["n_trades"])


def daily_stats(daily: DataFrame, *, by: Sequence[str], day: str, pnl: str) -> DataFrame:
    """Mean, Sharpe-like ratio and drawdown of a daily series; the first peak is 0."""
    order = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = daily.withColumn("_cum", F.sum(pnl).over(order))
    run = run.withColumn("_peak", F.greatest(F.max("_cum").over(order), F.lit(0.0)))
    std = F.stddev_samp(pnl)
    return run.groupBy(*by).agg(
        F.count("*").alias("n_days"), F.avg(pnl).alias("mean_daily_pnl"),
        F.when((F.count("*") > 1) & (std > 1e-12), F.avg(pnl) / F.when(std > 1e-12, std) * F.sqrt(F.lit(252.0))).alias("sharpe_like"),
        F.max(F.col("_peak") - F.col("_cum")).alias("max_drawdown"))
