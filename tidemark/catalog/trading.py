"""Fills, PnL, weights and portfolio metrics."""

from pyspark.sql import functions as F

from tidemark.catalog.evaluation import REPLICATES, bootstrap_sql
from tidemark.catalog.registry import query
from tidemark.catalog.windows import PEAK
from tidemark.plans import evaluate as ev
from tidemark.plans import trades as tr

# forecasts on the releases that have hourly bars; one decision minute stands for 12 minutes
RULES = tr.TradeRules(max_lag=3600, threshold=0.01, minute=720, grid=3600, bucket=5 * 86400)
SIGNALS = """SELECT event_id, CASE WHEN event_id % 101 = 0 THEN 'nowhere' ELSE market END AS market, CASE WHEN event_id % 97 = 0 THEN NULL ELSE t0 END AS t0,
   CASE event_id % 3 WHEN 0 THEN 'pre_10m' WHEN 1 THEN 'post_1m' ELSE 'post_30m' END AS decision_time, CASE event_id % 2 WHEN 0 THEN 'linear' ELSE 'zero' END AS model,
   CASE WHEN event_id % 53 = 0 THEN NULL ELSE (event_id * 7919 % 201) / 200e0 END AS p_up, (event_id * 104729 % 2001 - 1000) / 20000e0 AS r_hat,
   CASE WHEN event_id % 5 <> 0 THEN (event_id * 31 % 800) / 10000e0 END AS magnitude_hat, has_perp,
   (event_id * 37 % 100) / 100e0 AS t0_confidence, CASE event_id % 4 WHEN 0 THEN 'sec_8k' WHEN 1 THEN 'manual' WHEN 2 THEN 'detected' ELSE 'calendar_flag' END AS t0_source FROM {releases}"""
FILLS = "p AS (" + SIGNALS + """),
  x AS (SELECT *, t0 + CASE decision_time WHEN 'pre_10m' THEN -120 WHEN 'post_1m' THEN 12 ELSE 360 END * INTERVAL '1' MINUTE AS signal_time, t0 + INTERVAL 24 HOUR AS exit_signal_time,
          CASE WHEN t0 IS NULL THEN 'no_t0' WHEN p_up IS NULL OR p_up = 0.5 THEN 'no_signal' WHEN abs(p_up - 0.5) < 0.01 THEN 'below_threshold' END AS early FROM p),
  y AS (SELECT x.*, b.open AS o1, b.t AS t1, b.high AS h1, b.low AS l1, c.open AS o2, c.t AS t2, c.high AS h2, c.low AS l2 FROM x
        ASOF LEFT JOIN {bars} b ON x.market = b.market AND x.signal_time <= b.t ASOF LEFT JOIN {bars} c ON x.market = c.market AND x.exit_signal_time <= c.t),
  z AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN market NOT IN (SELECT market FROM {bars}) THEN 'no_bars'
           WHEN t1 IS NULL THEN 'entry_no_bar_after_signal' WHEN t1 - signal_time > INTERVAL 1 HOUR THEN 'entry_fill_lag' WHEN NOT o1 > 0 THEN 'entry_bad_bar'
           WHEN t2 IS NULL THEN 'exit_no_bar_after_signal' WHEN t2 - exit_signal_time > INTERVAL 1 HOUR THEN 'exit_fill_lag' WHEN NOT o2 > 0 THEN 'exit_bad_bar' END AS why,
          CASE WHEN early IS NULL THEN CAST(sign(p_up - 0.5) AS INT) ELSE 0 END AS side FROM y)"""


def signals_of(x):
    return x.sql(SIGNALS)


@query("trade_fills", "event_id:l side:l signal_time:t entry_fill:n entry_time:t exit_fill:n exit_time:t untraded_reason:s", "WITH " + FILLS + """
    SELECT event_id, side, signal_time, CASE WHEN early IS NULL AND t1 - signal_time <= INTERVAL 1 HOUR AND o1 > 0 THEN o1 END AS entry_fill,
       CASE WHEN early IS NULL AND t1 - signal_time <= INTERVAL 1 HOUR AND o1 > 0 THEN t1 END AS entry_time, CASE WHEN early IS NULL AND t2 - exit_signal_time <= INTERVAL 1 HOUR AND o2 > 0 THEN o2 END AS exit_fill,
       CASE WHEN early IS NULL AND t2 - exit_signal_time <= INTERVAL 1 HOUR AND o2 > 0 THEN t2 END AS exit_time, why AS untraded_reason FROM z""")
def trade_fills(x):
    f = tr.trade_fills(signals_of(x), x.bars, RULES)
    return f.withColumns({"entry_fill": F.col("entry.fill"), "entry_time": F.col("entry.fill_time"), "exit_fill": F.col("exit.fill"), "exit_time": F.col("exit.fill_time")})


PNL = "WITH " + FILLS + """,
  f AS (SELECT z.event_id, z.decision_time, z.model, CASE WHEN t2 <= t1 THEN 0 WHEN count(g.t) = datediff('hour', t1, t2) THEN coalesce(sum(g.funding_rate), 0) END AS fs
        FROM z LEFT JOIN {funding} g ON g.market = z.market AND g.t > z.t1 AND g.t <= z.t2 WHERE why IS NULL GROUP BY z.event_id, z.decision_time, z.model, t1, t2),
  c AS (SELECT z.*, 19 + 0.25 * ((h1 - l1) / o1 * 1e4) + 0.25 * ((h2 - l2) / o2 * 1e4) AS cost, CASE WHEN z.has_perp AND fs IS NOT NULL THEN side * fs * 1e4 ELSE 0 END AS fbps,
               CASE WHEN z.has_perp AND fs IS NOT NULL THEN 'archive' ELSE 'none' END AS fsrc, side * (o2 / o1 - 1) AS gross, coalesce(abs(magnitude_hat), abs(r_hat)) AS mag
        FROM z LEFT JOIN f USING (event_id, decision_time, model)),
  e AS (SELECT *, unnest(['fixed', 'by_confidence', 'by_magnitude', 'magnitude_gate']) AS sizing, gross - (cost + fbps) / 1e4 AS net FROM c),
  s AS (SELECT *, CASE WHEN why IS NOT NULL THEN 0 WHEN sizing = 'fixed' THEN 1 WHEN sizing = 'by_confidence' THEN least(1, 2 * abs(p_up - 0.5)) WHEN sizing = 'by_magnitude' THEN CASE WHEN mag > 0 THEN least(1, 0.03 / mag) ELSE 1 END
               ELSE CASE WHEN mag > cost / 1e4 THEN 1 ELSE 0 END END AS size FROM e),
  t AS (SELECT event_id, decision_time, model, sizing, size, CASE WHEN why IS NULL THEN cost END AS cost_bps, CASE WHEN why IS NULL THEN fbps ELSE 0 END AS funding_bps, CASE WHEN why IS NULL THEN fsrc ELSE 'none' END AS funding_source,
               CASE WHEN why IS NULL THEN net END AS net_return, coalesce(why, CASE WHEN size <= 0 THEN CASE WHEN sizing = 'magnitude_gate' THEN 'magnitude_gate' ELSE 'zero_size' END END) AS untraded_reason, t1, t2, t0,
               signal_time FROM s),
  u AS (SELECT *, untraded_reason IS NULL AS traded, CASE WHEN untraded_reason IS NULL THEN size * net_return END AS pnl FROM t)"""


@query("trade_pnl", "event_id:l sizing:s size:n cost_bps:n funding_bps:n funding_source:s net_return:n untraded_reason:s traded:b pnl:n",
       PNL + " SELECT event_id, sizing, size, cost_bps, funding_bps, funding_source, net_return, untraded_reason, traded, pnl FROM u")
def trade_pnl(x):
    return pnl_of(x)


def pnl_of(x):
    return tr.trade_pnl(tr.trade_fills(signals_of(x), x.bars, RULES), x.funding, RULES)


WEIGHTS = PEAK + """,
    w AS (SELECT t.*, p.peak, least(t.size, 1) / greatest(p.peak, 1) AS weight FROM {trades_in} t JOIN pk p ON p.model = t.model AND p.event_id = t.event_id)"""


def weighted(x):
    return tr.portfolio_weights(x.trades_in.filter("untraded_reason IS NULL"), by=["model"], key="event_id")


@query("portfolio_weights", "model:s event_id:l peak:l weight:n", "WITH" + WEIGHTS + " SELECT model, event_id, peak, weight FROM w")
def portfolio_weights(x):
    return weighted(x)


SLICE = "model, decision_time, sizing, subset"


@query("portfolio_metrics", "model:s decision_time:s sizing:s subset:s n_trades:l n_untraded:l total_return:n turnover:n turnover_daily:n hit_rate:n mean_pnl_per_trade:n span_days:l n_days:l mean_daily_pnl:n "
       "sharpe_like:n max_drawdown:n max_gross_exposure:n", PNL + f""",
    al AS (SELECT u.event_id, u.decision_time, u.model, u.sizing, u.size, u.net_return, u.traded, u.t1 AS a, u.t2 AS z, unnest(list_filter(['all', CASE WHEN p.has_perp AND t0_confidence >= 0.6 AND t0_source IN ('sec_8k', 'manual', 'detected') THEN 'headline' END],
           lambda v: v IS NOT NULL)) AS subset FROM u JOIN p ON p.event_id = u.event_id AND p.decision_time = u.decision_time AND p.model = u.model),
    nu AS (SELECT {SLICE}, count(*) FILTER (NOT traded) AS n_untraded FROM al GROUP BY ALL), po AS (SELECT * FROM al WHERE traded),
    ti AS (SELECT DISTINCT {SLICE}, unnest([a, z]) AS ts FROM po), pl AS (SELECT {SLICE}, a AS ts, count(*) AS c FROM po GROUP BY ALL), mi AS (SELECT {SLICE}, z AS ts, count(*) AS c FROM po GROUP BY ALL),
    oc AS (SELECT {SLICE}, ts, sum(coalesce(pl.c, 0)) OVER q - (sum(coalesce(mi.c, 0)) OVER q - coalesce(mi.c, 0)) AS n_open FROM ti LEFT JOIN pl USING ({SLICE}, ts) LEFT JOIN mi USING ({SLICE}, ts) WINDOW q AS (PARTITION BY {SLICE} ORDER BY ts)),
    pe AS (SELECT {SLICE}, event_id, max(n_open) AS peak FROM po JOIN oc USING ({SLICE}) WHERE ts BETWEEN a AND z GROUP BY ALL),
    w AS (SELECT po.*, least(size, 1) / greatest(peak, 1) AS weight FROM po JOIN pe USING ({SLICE}, event_id)),
    d AS (SELECT {SLICE}, CAST(z AS DATE) AS d, sum(weight * net_return) AS p FROM w GROUP BY ALL), cd AS (SELECT *, sum(p) OVER (PARTITION BY {SLICE} ORDER BY d) AS cum FROM d),
    k AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY {SLICE} ORDER BY d)) AS peak FROM cd),
    dd AS (SELECT {SLICE}, count(*) AS n_days, avg(p) AS mean_daily_pnl, avg(p) / stddev_samp(p) * sqrt(252) AS sharpe_like, max(peak - cum) AS max_drawdown FROM k GROUP BY ALL),
    up AS (SELECT {SLICE}, a AS ts, sum(weight) AS v FROM w GROUP BY ALL), dn AS (SELECT {SLICE}, z AS ts, sum(weight) AS v FROM w GROUP BY ALL),
    ex AS (SELECT {SLICE}, sum(coalesce(up.v, 0)) OVER q - (sum(coalesce(dn.v, 0)) OVER q - coalesce(dn.v, 0)) AS e FROM ti LEFT JOIN up USING ({SLICE}, ts) LEFT JOIN dn USING ({SLICE}, ts) WINDOW q AS (PARTITION BY {SLICE} ORDER BY ts)),
    em AS (SELECT {SLICE}, max(e) AS max_gross_exposure FROM ex GROUP BY ALL),
    tl AS (SELECT {SLICE}, count(*) AS n_trades, sum(weight * net_return) AS total_return, 2 * sum(weight) AS turnover, avg(CAST(weight * net_return > 0 AS INT)) AS hit_rate, avg(weight * net_return) AS mean_pnl_per_trade,
                  greatest(datediff('day', CAST(min(a) AS DATE), CAST(max(z) AS DATE)) + 1, 1) AS span_days FROM w GROUP BY ALL)
    SELECT {SLICE}, coalesce(n_trades, 0) AS n_trades, n_untraded, CASE WHEN n_trades IS NULL THEN 0 ELSE total_return END AS total_return, CASE WHEN n_trades IS NULL THEN 0 ELSE turnover END AS turnover,
       CASE WHEN n_trades IS NULL THEN 0 ELSE turnover / span_days END AS turnover_daily, hit_rate, mean_pnl_per_trade, span_days, coalesce(n_days, 0) AS n_days, mean_daily_pnl, sharpe_like,
       CASE WHEN n_trades IS NULL THEN 0 ELSE max_drawdown END AS max_drawdown, CASE WHEN n_trades IS NULL THEN 0 ELSE max_gross_exposure END AS max_gross_exposure
    FROM nu LEFT JOIN tl USING ({SLICE}) LEFT JOIN dd USING ({SLICE}) LEFT JOIN em USING ({SLICE})""")
def portfolio_metrics(x):
    trades = pnl_of(x).withColumns({"entry_time": F.col("entry.fill_time"), "exit_time": F.col("exit.fill_time")})
    headline = F.col("has_perp") & (F.col("t0_confidence") >= 0.6) & F.col("t0_source").isin(*ev.HEADLINE_SOURCES)
    return tr.portfolio_slices(trades, {"all": F.lit(True), "headline": headline})


LEDGER = """SELECT event_id, t0, season, model, CASE WHEN untraded_reason IS NULL THEN size * net_return END AS pnl FROM (
   SELECT *, entry_time AS t0, concat(year(entry_time), 'Q', quarter(entry_time)) AS season FROM {trades_in}) """
# every model holds every event here: the model column of the positions is replaced by three derived books
BOOKS = """SELECT event_id, t0, season, 'base_rate' AS model, pnl FROM l UNION ALL SELECT event_id, t0, season, 'zero', pnl * 0.5e0 - 0.0001e0 FROM l
           UNION ALL SELECT event_id, t0, season, 'linear', CASE WHEN event_id % 3 = 0 THEN NULL ELSE -pnl END FROM l"""


@query("trading_compare", "baseline:s n:l improvement:n lo:n hi:n p_noise:n se:n verdict:s", "WITH l AS (" + LEDGER + "), b AS (" + BOOKS + """),
    best AS (SELECT model FROM b WHERE model <> 'linear' AND pnl IS NOT NULL GROUP BY 1 ORDER BY avg(pnl) DESC, model LIMIT 1),
    df AS (SELECT 1 AS one, m.season, coalesce(m.pnl, 0) - coalesce(q.pnl, 0) AS diff FROM b m JOIN b q ON q.event_id = m.event_id AND q.model = (SELECT model FROM best) WHERE m.model = 'linear'),"""
       + bootstrap_sql("df", "one", "diff") + """
    SELECT (SELECT model FROM best) AS baseline, n, point AS improvement, lo, hi, p_noise, (SELECT stddev_samp(diff) / sqrt(count(*)) FROM df) AS se,
           CASE WHEN lo > 0 THEN 'improves' WHEN hi < 0 THEN 'worse' ELSE concat('inconclusive at n = ', n) END AS verdict FROM bz JOIN bq USING (one)""")
def trading_compare(x):
    books = x.sql("WITH l AS (" + LEDGER + ") " + BOOKS)
    return ev.trading_compare(books, "linear", ["base_rate", "zero"], replicates=REPLICATES)
