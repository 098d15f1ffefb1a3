"""Window functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog.common import hourly_grid
from tidemark.catalog.registry import query
from tidemark.functions import scalars as fn
from tidemark.operators import intervals
from tidemark.operators.asof import DAY, asof_join
from tidemark.plans import evaluate as ev
from tidemark.plans.training import window_starts
from tidemark.plans import features as ft
from tidemark.plans import history as hs
from tidemark.plans import patterns as pt
from tidemark.plans import trades as tr

LR = "CASE WHEN close > 0 AND {l} > 0 THEN ln(close / {l}) END"


def lagged(n: int) -> str:
    return LR.replace("{l}", f"lag(close, {n}) OVER (PARTITION BY symbol ORDER BY d)")


@query("win_returns_n", "symbol:s d:d ret_1d:n ret_5d:n ret_20d:n ret_60d:n",
       "SELECT symbol, d, " + ", ".join(f"{lagged(n)} AS ret_{n}d" for n in (1, 5, 20, 60)) + " FROM {daily}")
def win_returns_n(x):
    return ft.daily_windows(x.daily, on="symbol", order="d")


@query("win_realised_vol", "symbol:s d:d rvol_20d:n", "SELECT symbol, d, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS rvol_20d FROM (SELECT symbol, d, "
       + lagged(1) + " AS r FROM {daily}) WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def win_realised_vol(x):
    return ft.daily_windows(x.daily, on="symbol", order="d")


@query("win_52w", "symbol:s d:d dist_52w_high:n dist_52w_low:n", """
    SELECT symbol, d, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY d) >= 200 THEN ln(close / max(high) OVER w) END AS dist_52w_high,
           CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY d) >= 200 THEN ln(close / min(low) OVER w) END AS dist_52w_low FROM {daily}
    WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
def win_52w(x):
    return ft.daily_windows(x.daily, on="symbol", order="d")


@query("win_volume_ratio", "symbol:s d:d dvol_5d_ratio:n", """
    SELECT symbol, d, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY d) >= 20 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
           / avg(volume) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS dvol_5d_ratio FROM {daily}""")
def win_volume_ratio(x):
    return ft.daily_windows(x.daily, on="symbol", order="d")


@query("win_last_k", "event_id:l l1:n l2:n l3:n l4:n", """
    WITH p AS (SELECT q.event_id, b.r_24h AS r, row_number() OVER (PARTITION BY q.event_id ORDER BY b.t0 DESC, b.event_id DESC) AS k FROM {events_long} q
               JOIN {events_long} b ON b.underlying = q.underlying AND b.t0 + INTERVAL 24 HOUR <= q.t0 + INTERVAL 30 MINUTE)
    SELECT e.event_id, max(r) FILTER (WHERE k = 1) AS l1, max(r) FILTER (WHERE k = 2) AS l2, max(r) FILTER (WHERE k = 3) AS l3, max(r) FILTER (WHERE k = 4) AS l4
    FROM {events_long} e LEFT JOIN p USING (event_id) GROUP BY 1""")
def win_last_k(x):
    past = hs.last_settled(x.events_long, depth=4, horizon=DAY, as_of=fn.plus_seconds(F.col("t0"), 1800))
    wide = past.groupBy("event_id").agg(*[F.max(F.when(F.col("age") == i, F.col("past_r"))).alias(f"l{i}") for i in range(1, 5)])
    return x.events_long.select("event_id").join(wide, "event_id", "left")


@query("win_days_since", "event_id:l days:n", """
    SELECT q.event_id, epoch_us(q.t0 - max(b.t0)) / 86400e6 AS days FROM {events_long} q
    LEFT JOIN {events_long} b ON b.underlying = q.underlying AND b.t0 + INTERVAL 24 HOUR <= q.t0 + INTERVAL 30 MINUTE GROUP BY q.event_id, q.t0""")
def win_days_since(x):
    s = x.events_long.groupBy("underlying", fn.plus_seconds(F.col("t0"), DAY).alias("settled")).agg(F.max("t0").alias("last_t0"))
    q = x.events_long.select("event_id", "underlying", "t0", fn.plus_seconds(F.col("t0"), 1800).alias("as_of"))
    j = asof_join(q, s, on=["underlying"], left_ts="as_of", right_ts="settled", take=["last_t0"], bucket=DAY)
    return j.select("event_id", (fn.seconds_between(F.col("t0"), F.col("hit.last_t0")) / DAY).alias("days"))


GRID = """
    g AS (SELECT market, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS t FROM (SELECT DISTINCT market FROM {bars}), (SELECT min(t) AS a, max(t) AS z FROM {bars})),
    grid AS (SELECT g.market, g.t, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.market ORDER BY g.t) AS close, coalesce(b.volume, 0) AS volume
             FROM g LEFT JOIN {bars} b ON b.market = g.market AND b.t = g.t),
    lg AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS lc, CASE WHEN close > 0 THEN ln(close) END - lag(CASE WHEN close > 0 THEN ln(close) END) OVER (PARTITION BY market ORDER BY t) AS r FROM grid)"""


@query("win_ffill_grid", "market:s t:t close:n volume:n", "WITH" + GRID + " SELECT market, t, close, volume FROM grid")
def win_ffill_grid(x):
    return hourly_grid(x)


@query("win_log_diff", "market:s t:t r:n", "WITH" + GRID + " SELECT market, t, r FROM lg")
def win_log_diff(x):
    return pt.with_returns(hourly_grid(x))


@query("win_lag1_autocorr", "market:s n:l ac:n", "WITH" + GRID + """
    SELECT market, count(*) AS n, CASE WHEN count(*) >= 50 THEN corr(r, nx) END AS ac FROM (SELECT *, lead(r) OVER (PARTITION BY market ORDER BY t) AS nx FROM lg)
    WHERE hour(t) BETWEEN 8 AND 20 AND r IS NOT NULL AND nx IS NOT NULL GROUP BY 1""")
def win_lag1_autocorr(x):
    return pt.autocorrelation(pt.with_returns(hourly_grid(x)), F.hour("t").between(8, 20), least=50)


@query("win_forward_return", "market:s t:t f24:n f72:n", "WITH" + GRID + """
    SELECT market, t, lead(lc, 24) OVER w - lc AS f24, lead(lc, 72) OVER w - lc AS f72 FROM lg WINDOW w AS (PARTITION BY market ORDER BY t)""")
def win_forward_return(x):
    g = pt.with_returns(hourly_grid(x))
    return pt.forward_return(pt.forward_return(g, 24, "f24"), 72, "f72")


@query("win_cum_peak", "model:s d:d cum:n peak:n", """
    WITH p AS (SELECT model, CAST(exit_time AS DATE) AS d, sum(size * net_return) AS p FROM {trades_in} WHERE untraded_reason IS NULL GROUP BY 1, 2),
         c AS (SELECT model, d, sum(p) OVER (PARTITION BY model ORDER BY d) AS cum FROM p)
    SELECT model, d, cum, max(cum) OVER (PARTITION BY model ORDER BY d) AS peak FROM c""")
def win_cum_peak(x):
    t = x.trades_in.filter("untraded_reason IS NULL")
    day = t.groupBy("model", F.to_date("exit_time").alias("d")).agg(F.sum(F.col("size") * F.col("net_return")).alias("p"))
    w = Window.partitionBy("model").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    return day.withColumn("cum", F.sum("p").over(w)).withColumn("peak", F.max("cum").over(w))


OPEN = """
    tt AS (SELECT DISTINCT model, unnest([entry_time, exit_time]) AS ts FROM {trades_in} WHERE untraded_reason IS NULL),
    pl AS (SELECT model, entry_time AS ts, count(*) AS c FROM {trades_in} WHERE untraded_reason IS NULL GROUP BY 1, 2),
    mi AS (SELECT model, exit_time AS ts, count(*) AS c FROM {trades_in} WHERE untraded_reason IS NULL GROUP BY 1, 2),
    oc AS (SELECT model, ts, sum(coalesce(pl.c, 0)) OVER w - (sum(coalesce(mi.c, 0)) OVER w - coalesce(mi.c, 0)) AS n_open
           FROM tt LEFT JOIN pl USING (model, ts) LEFT JOIN mi USING (model, ts) WINDOW w AS (PARTITION BY model ORDER BY ts))"""


@query("win_open_positions", "model:s ts:t n_open:l", "WITH" + OPEN + " SELECT model, ts, n_open FROM oc")
def win_open_positions(x):
    return intervals.open_counts(x.trades_in.filter("untraded_reason IS NULL"), by=["model"], entry="entry_time", exit_="exit_time")


PEAK = OPEN + """,
    pk AS (SELECT p.model, p.event_id, max(oc.n_open) AS peak FROM {trades_in} p JOIN oc ON oc.model = p.model AND oc.ts BETWEEN p.entry_time AND p.exit_time
           WHERE p.untraded_reason IS NULL GROUP BY 1, 2)"""


@query("win_peak_concurrency", "model:s event_id:l peak:l", "WITH" + PEAK + " SELECT model, event_id, peak FROM pk")
def win_peak_concurrency(x):
    return intervals.peak_concurrency(x.trades_in.filter("untraded_reason IS NULL"), by=["model"], key="event_id", entry="entry_time", exit_="exit_time")


FOLDS = """
    sea AS (SELECT DISTINCT concat(year(t0), 'Q', quarter(t0)) AS season, CAST(date_trunc('quarter', t0) AS DATE) AS start FROM {events_long}),
    okr AS (SELECT *, concat(year(t0), 'Q', quarter(t0)) AS season, t0_confidence >= 0.6 AS trainable FROM {events_long}),
    fs AS (SELECT s.season, s.start, s.start - 5 AS cutoff, s.season = '2001Q2' AS held, (SELECT count(*) FROM okr e WHERE e.season = s.season) AS n_test,
                  (SELECT count(*) FROM okr e WHERE e.trainable AND e.season <> '2001Q2' AND e.t0 < s.start - INTERVAL 5 DAY) AS n_train FROM sea s),
    fo AS (SELECT *, CASE WHEN held THEN -1 WHEN n_train >= 400 THEN row_number() OVER (PARTITION BY n_train >= 400 AND NOT held ORDER BY start) - 1 END AS fold FROM fs)"""


def folds_of(x):
    return ev.fold_dimension(trainable_of(x), embargo_days=5, min_train=400, holdout="2001Q2")


def trainable_of(x):
    return x.events_long.withColumn("trainable", F.col("t0_confidence") >= 0.6)


@query("win_expanding_residuals", "model:s fold:l n:l q10:n q90:n", "WITH" + FOLDS + """,
    r AS (SELECT p.model, fo.fold, p.r_true - p.r_hat AS res FROM {predictions} p JOIN fo ON fo.season = concat(year(p.t0), 'Q', quarter(p.t0)) WHERE fo.fold IS NOT NULL AND fo.fold >= 0)
    SELECT r.model, f.fold, count(*) AS n, quantile_cont(res, 0.1) AS q10, quantile_cont(res, 0.9) AS q90 FROM r JOIN fo f ON f.fold > r.fold GROUP BY 1, 2""")
def win_expanding_residuals(x):
    f = folds_of(x)
    p = x.predictions.withColumn("season", fn.season(F.col("t0"))).join(F.broadcast(f.filter("fold >= 0").select("season", "fold")), "season")
    return ev.residual_bands(p, f)


@query("win_train_window", "fold:l n:l first_t0:t", "WITH" + FOLDS + """,
    t AS (SELECT f.fold, e.event_id, e.t0, e.season FROM okr e JOIN fo f ON f.fold IS NOT NULL AND e.t0 < f.cutoff WHERE e.trainable AND e.season <> '2001Q2'),
    k AS (SELECT *, dense_rank() OVER (PARTITION BY fold ORDER BY season DESC) AS sr, row_number() OVER (PARTITION BY fold ORDER BY t0 DESC, event_id DESC) AS rn FROM t),
    c AS (SELECT fold, count(*) FILTER (WHERE sr <= 2) AS nw, max(sr) AS ns FROM k GROUP BY 1)
    SELECT fold, count(*) AS n, min(t0) AS first_t0 FROM k JOIN c USING (fold) WHERE ns <= 2 OR CASE WHEN nw >= 450 THEN sr <= 2 ELSE rn <= 450 END GROUP BY 1""")
def win_train_window(x):
    return window_starts(trainable_of(x), folds_of(x), seasons=2, min_train=450).withColumnRenamed("lo_t0", "first_t0")


@query("win_prev_close_gap", "market:s t:t gap:n", """
    SELECT market, t, CASE WHEN lag(close) OVER w > 0 THEN open / lag(close) OVER w - 1 END AS gap FROM {bars} WINDOW w AS (PARTITION BY market ORDER BY t)""")
def win_prev_close_gap(x):
    from tidemark.sources.archive import with_previous
    prev = F.col("prev")
    rows = with_previous(x.bars, "close", "prev", bucket=5 * DAY)
    return rows.select("market", "t", F.when(prev > 0, F.col("open") / F.when(prev > 0, prev) - 1).alias("gap"))
