"""Joins: as-of, band, interval and anti joins."""

from pyspark.sql import functions as F

from tidemark.catalog.common import calendar_of
from tidemark.catalog.registry import query
from tidemark.functions import scalars as fn
from tidemark.operators import matchers as mt
from tidemark.operators.asof import DAY, asof_lookup, asof_parts, asof_points
from tidemark.operators.dedup import latest_per_key
from tidemark.plans import trades as tr
from tidemark.plans import evaluate as ev
from tidemark.sources import calendar as cal


@query("asof_price", "event_id:l price:n bar_end:t strict_price:n strict_end:t", """
    SELECT r.event_id, b.close AS price, b.t_end AS bar_end, s.close AS strict_price, s.t_end AS strict_end
    FROM (SELECT event_id, market, date_trunc('hour', t0) AS h FROM {releases}) r
    ASOF LEFT JOIN {bars} b ON r.market = b.market AND r.h >= b.t_end
    ASOF LEFT JOIN {bars} s ON r.market = s.market AND r.h > s.t_end""")
def asof_price(x):
    r = x.releases.select("event_id", "market", F.date_trunc("hour", "t0").alias("h"))
    kw = dict(on=["market"], left_ts="h", right_ts="t_end", take=["close", "t_end"], grid=3600, bucket=5 * DAY)
    out = asof_parts(r, {"a": (x.bars, kw), "b": (x.bars, kw | dict(strict=True))}, key=["event_id"])
    return out.select("event_id", F.col("a.close").alias("price"), F.col("a.t_end").alias("bar_end"),
                      F.col("b.close").alias("strict_price"), F.col("b.t_end").alias("strict_end"))


@query("asof_fill_forward", "event_id:l fill:n fill_time:t range_bps:n reason:s", """
    SELECT event_id, CASE WHEN reason IS NULL THEN open END AS fill, CASE WHEN reason IS NULL THEN t END AS fill_time,
           CASE WHEN reason IS NULL THEN (high - low) / open * 1e4 END AS range_bps, reason
    FROM (SELECT r.event_id, b.*, CASE WHEN b.t IS NULL THEN 'no_bar_after_signal' WHEN b.t - r.t0 > INTERVAL 30 MINUTE THEN 'fill_lag'
                 WHEN NOT b.open > 0 THEN 'bad_bar' END AS reason
          FROM {releases} r ASOF LEFT JOIN {bars} b ON r.market = b.market AND r.t0 <= b.t)""")
def asof_fill_forward(x):
    out = tr.fills_at(x.releases, x.bars, {"f": F.col("t0")}, key=["event_id"], max_lag=1800, grid=3600, bucket=5 * DAY)
    return out.select("event_id", "f.fill", "f.fill_time", "f.range_bps", "f.reason")


@query("asof_next_session", "event_id:l next_open:t next_close:t prev_close:t is_open:b", """
    SELECT event_id, (SELECT min(open_ts) FROM {sessions} WHERE open_ts > t0) AS next_open,
           (SELECT min(close_ts) FROM {sessions} WHERE close_ts > t0) AS next_close,
           (SELECT max(close_ts) FROM {sessions} WHERE close_ts < t0) AS prev_close,
           EXISTS (SELECT 1 FROM {sessions} WHERE open_ts <= t0 AND t0 < close_ts) AS is_open FROM {events_long}""")
def asof_next_session(x):
    return cal.attach(x.events_long.select("event_id", "t0"), calendar_of(x), "t0")


@query("asof_snapshot", "event_id:l snap_time:t oi_notional:n oi_chg_24h:n", """
    WITH one AS (SELECT market, t, arg_max(open_interest, seq) AS oi, arg_max(mark_px, seq) AS mark FROM {ctx} GROUP BY 1, 2)
    SELECT r.event_id, a.t AS snap_time, a.oi * a.mark AS oi_notional,
           CASE WHEN a.oi > 0 AND b.oi > 0 AND r.t0 - b.t <= INTERVAL 2 DAY THEN ln(a.oi / b.oi) END AS oi_chg_24h
    FROM (SELECT *, t0 - INTERVAL 1 DAY AS t1 FROM {releases}) r ASOF LEFT JOIN one a ON r.market = a.market AND r.t0 >= a.t
    ASOF LEFT JOIN one b ON r.market = b.market AND r.t1 >= b.t""")
def asof_snapshot(x):
    t0 = F.col("t0")
    out = asof_points(x.releases, x.ctx, key=["event_id"], on=["market"], points={"a": t0, "b": fn.plus_seconds(t0, -DAY)}, right_ts="t",
                      take=["t", "open_interest", "mark_px"], tie="seq")
    fresh = fn.seconds_between(F.col("a.at"), F.col("b.t")) <= 2 * DAY
    return out.select("event_id", F.col("a.t").alias("snap_time"),
                      (F.col("a.open_interest") * F.col("a.mark_px")).alias("oi_notional"),
                      F.when(fresh, fn.log_ret(F.col("a.open_interest"), F.col("b.open_interest"))).alias("oi_chg_24h"))


@query("asof_consensus", "event_id:l snapshot_time:t vendor:s eps_estimate:n n_estimates:l", """
    WITH c AS (SELECT r.event_id, s.* FROM {releases} r JOIN {snapshots} s ON s.symbol = r.underlying
                AND abs(datediff('day', CAST(r.t0 AS DATE), s.report_date)) <= 1 AND s.snapshot_time < r.t0),
         m AS (SELECT event_id, max(snapshot_time) AS mt FROM c GROUP BY 1)
    SELECT event_id, snapshot_time, min_by(vendor, vendor) AS vendor, min_by(eps_estimate, vendor) AS eps_estimate,
           min_by(n_estimates, vendor) FILTER (WHERE n_estimates IS NOT NULL) AS n_estimates
    FROM c JOIN m USING (event_id) WHERE snapshot_time = mt GROUP BY 1, 2""")
def asof_consensus(x):
    e = x.releases.select("event_id", F.col("underlying").alias("symbol"), "t0", F.to_date("t0").alias("report_date"))
    return mt.asof_consensus(e, x.snapshots, ("alpha", "beta"))


@query("history_view", "event_id:l past_event_id:l past_r:n", """
    SELECT a.o_orderkey AS event_id, b.event_id AS past_event_id, b.r_24h AS past_r
    FROM {orders} a JOIN {events_long} q ON q.event_id = a.o_orderkey
    JOIN {events_long} b ON b.underlying = q.underlying AND b.t0 + INTERVAL 24 HOUR <= q.t0 + INTERVAL 30 MINUTE
    QUALIFY row_number() OVER (PARTITION BY q.event_id ORDER BY b.t0 DESC, b.event_id DESC) <= 4""")
def history_view(x):
    from tidemark.plans.history import last_settled
    return last_settled(x.events_long, depth=4, horizon=DAY, as_of=fn.plus_seconds(F.col("t0"), 1800))


@query("targets_left_join", "event_id:l t0:t r_24h:n", """
    WITH t AS (SELECT l_orderkey AS event_id, l_linenumber AS seq, l_quantity / 1000 AS r FROM {lineitem})
    SELECT e.event_id, e.t0, u.r AS r_24h FROM {events_long} e
    LEFT JOIN (SELECT event_id, max_by(r, (seq, r)) AS r FROM t GROUP BY 1) u USING (event_id)""")
def targets_left_join(x):
    t = x.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("seq"),
                          (F.col("l_quantity") / 1000).alias("r_24h"))
    last = latest_per_key(t, ["event_id"], ["seq", "r_24h"]).select("event_id", "r_24h")
    return x.events_long.select("event_id", "t0").join(last, "event_id", "left")


@query("nearest_date_match", "event_id:l vendor_date:d day_diff:l vendor_eps:n", """
    SELECT * FROM (SELECT r.event_id, v.vendor_date, datediff('day', r.report_date, v.vendor_date) AS day_diff, v.vendor_eps
    FROM {reports} r JOIN {vendor_rows} v ON v.underlying = r.underlying AND abs(datediff('day', r.report_date, v.vendor_date)) <= 10
    QUALIFY row_number() OVER (PARTITION BY r.event_id ORDER BY abs(datediff('day', r.report_date, v.vendor_date)), v.vendor_date,
                               v.order_key, v.line, v.vendor_eps) = 1)""")
def nearest_date_match(x):
    return mt.nearest_date_match(x.reports, x.vendor_rows, key="event_id", on="underlying", day="report_date",
                                 other_day="vendor_date", window=10, take=["vendor_eps"], order=["order_key", "line", "vendor_eps"])


@query("filing_acceptance_match", "event_id:l report_date:d accepted:t accession:s", """
    WITH f AS (SELECT *, (accepted AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM {filings}
               WHERE form = '8-K' AND items LIKE '%2.02%')
    SELECT event_id, report_date, accepted, accession FROM (
      SELECT r.event_id, r.report_date, f.accepted, f.accession FROM {reports} r JOIN f ON f.cik = r.cik AND (
         CAST(ny AS DATE) = report_date OR (CAST(ny AS DATE) = report_date + 1 AND CAST(ny AS TIME) < TIME '04:00:00')
         OR (CAST(ny AS DATE) = report_date - 1 AND CAST(ny AS TIME) >= TIME '16:00:00'))
      QUALIFY row_number() OVER (PARTITION BY r.event_id ORDER BY f.accepted, f.accession) = 1)""")
def filing_acceptance_match(x):
    return mt.filing_acceptance_match(x.reports, x.filings)


@query("prior_filing_flag", "event_id:l prior_accepted:t pre_announced:b", """
    WITH f AS (SELECT cik, accepted, CAST((accepted AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS d FROM {filings}
               WHERE form = '8-K' AND items LIKE '%2.02%')
    SELECT r.event_id, max(f.accepted) AS prior_accepted, count(f.accepted) > 0 AS pre_announced FROM {reports} r
    LEFT JOIN f ON f.cik = r.cik AND f.d BETWEEN r.report_date - 30 AND r.report_date - 2 GROUP BY 1""")
def prior_filing_flag(x):
    return mt.prior_filing_flag(x.reports, x.filings)


SPLITS = "SELECT l_partkey % 500 AS underlying, l_shipdate AS ex_ts FROM {lineitem} WHERE l_quantity = 50 AND l_returnflag = 'R'"


@query("split_near_event", "event_id:l ex_ts:t", "WITH s AS (" + SPLITS + """)
    SELECT event_id, ex_ts FROM (SELECT e.event_id, s.ex_ts FROM {events_long} e JOIN s ON s.underlying = e.underlying
      AND s.ex_ts >= e.t0 - INTERVAL 60 DAY AND s.ex_ts <= e.t0 + INTERVAL 24 HOUR
    QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(s.ex_ts) - epoch_us(e.t0)), s.ex_ts) = 1)""")
def split_near_event(x):
    return mt.split_near_event(x.events_long, x.sql(SPLITS), on="underlying", lookback=60 * DAY, horizon=DAY)


FACTS = """SELECT l_suppkey AS cik, last_day(CAST(l_shipdate AS DATE)) AS period_end,
                  date_add(CAST(l_shipdate AS DATE), CAST(l_orderkey % 200 AS INT)) AS filed
           FROM {lineitem} WHERE l_quantity >= 49 AND l_suppkey % 3 <> 0"""
THIRD = """SELECT o_custkey AS cik, date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 15 AS INT)) AS vendor_day,
                  last_day(CAST(o_orderdate AS DATE)) AS fiscal_end FROM {orders} WHERE o_custkey % 2 = 0 AND o_orderkey % 3 = 0"""
PROJECT = ("CASE WHEN {a} + INTERVAL (3 * CAST(floor(m{n} / 3.0) AS BIGINT)) MONTH < report_date THEN {a} + INTERVAL (3 * CAST(floor(m{n} / 3.0) AS BIGINT)) MONTH "
           "ELSE {a} + INTERVAL (3 * (CAST(floor(m{n} / 3.0) AS BIGINT) - 1)) MONTH END")


@query("fiscal_period_match", "event_id:l period_end:d period_source:s", "WITH f AS (" + FACTS + "), v AS (" + THIRD + """),
    p AS (SELECT cik, period_end, min(filed) AS filed FROM f GROUP BY 1, 2),
    a1 AS (SELECT cik, max(period_end) AS a1 FROM f GROUP BY 1), a2 AS (SELECT cik, max(fiscal_end) AS a2 FROM v GROUP BY 1),
    p1 AS (SELECT r.event_id, max(p.period_end) AS p1 FROM {reports} r JOIN p ON p.cik = r.cik AND r.report_date - p.period_end BETWEEN 1 AND 120
           AND p.filed >= r.report_date GROUP BY 1),
    p2 AS (SELECT r.event_id, v.fiscal_end AS p2 FROM {reports} r JOIN v ON v.cik = r.cik AND abs(v.vendor_day - r.report_date) <= 10
           QUALIFY row_number() OVER (PARTITION BY r.event_id ORDER BY abs(v.vendor_day - r.report_date), v.vendor_day, v.fiscal_end) = 1),
    j AS (SELECT r.*, p1, p2, a1, a2, (year(report_date) - year(a1)) * 12 + month(report_date) - month(a1) AS m1,
                 (year(report_date) - year(a2)) * 12 + month(report_date) - month(a2) AS m2
          FROM {reports} r LEFT JOIN p1 USING (event_id) LEFT JOIN p2 USING (event_id) LEFT JOIN a1 USING (cik) LEFT JOIN a2 USING (cik))
    SELECT event_id, CAST(coalesce(p1, p2, """ + PROJECT.replace("{a}", "a1").replace("{n}", "1") + ", "
       + PROJECT.replace("{a}", "a2").replace("{n}", "2") + """, date_trunc('quarter', report_date) - INTERVAL 1 DAY) AS DATE) AS period_end,
       CASE WHEN p1 IS NOT NULL THEN 'facts' WHEN p2 IS NOT NULL THEN 'vendor' WHEN a1 IS NOT NULL THEN 'facts_projected'
            WHEN a2 IS NOT NULL THEN 'vendor_projected' ELSE 'derived' END AS period_source FROM j""")
def fiscal_period_match(x):
    return mt.fiscal_period_match(x.reports, x.sql(FACTS), x.sql(THIRD))


MARKETS = """SELECT underlying, market, min_size % 5 = 0 AS is_primary, date_add(DATE '1995-01-01', CAST(cik * 13 % 2600 AS INT)) AS listing
             FROM {universe} WHERE min_size < 30"""


@query("market_at_t0", "event_id:l market:s has_perp_at_t0:b", "WITH mk AS (" + MARKETS + """),
    e AS (SELECT event_id, concat('Brand#', CAST(1 + event_id % 25 AS VARCHAR)) AS underlying, t0 FROM {events_long}),
    p AS (SELECT underlying, min(market) FILTER (WHERE is_primary) AS pm FROM mk GROUP BY 1),
    l AS (SELECT e.event_id, m.market FROM e JOIN mk m ON m.underlying = e.underlying AND m.listing <= e.t0
          QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY NOT m.is_primary, m.listing, m.market) = 1)
    SELECT e.event_id, coalesce(l.market, p.pm) AS market, l.market IS NOT NULL AS has_perp_at_t0
    FROM e JOIN p USING (underlying) LEFT JOIN l USING (event_id)""")
def market_at_t0(x):
    mk = x.sql(MARKETS).withColumn("listing_start", F.col("listing").cast("timestamp"))
    brand = F.concat(F.lit("Brand#"), (1 + F.col("event_id") % 25).cast("string"))
    return mt.market_at_t0(x.events_long.select("event_id", brand.alias("underlying"), "t0"), mk)


@query("primary_market", "market:s underlying:s is_primary:b", """
    SELECT market, underlying, row_number() OVER (PARTITION BY underlying ORDER BY coalesce(notional, -1) DESC,
           CASE dex WHEN 'STANDARD' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END, market DESC) = 1 AS is_primary FROM {universe}""")
def primary_market(x):
    return mt.primary_market(x.universe, ("STANDARD", "SMALL"))


OVERRIDES = """SELECT underlying, CASE WHEN min(min_size) % 2 = 0 THEN 'foreign' ELSE 'index' END AS o_kind,
                      CASE WHEN min(min_size) % 3 = 0 THEN min(cik) END AS o_cik, CASE WHEN min(min_size) % 4 = 0 THEN true END AS o_verify
               FROM {universe} GROUP BY underlying HAVING sum(n_parts) % 2 = 0"""
TICKERS = "SELECT underlying, max(cik) AS t_cik FROM {universe} GROUP BY underlying HAVING sum(n_parts) % 3 <> 0"


@query("classify_markets", "market:s kind:s cik:l verify:b", "WITH o AS (" + OVERRIDES + "), t AS (" + TICKERS + """)
    SELECT u.market, CASE WHEN o_kind IS NOT NULL THEN o_kind WHEN t_cik IS NOT NULL THEN 'equity_us' ELSE 'other' END AS kind,
           coalesce(o_cik, t_cik) AS cik, CASE WHEN o_kind IS NOT NULL THEN coalesce(o_verify, false) ELSE true END AS verify
    FROM {universe} u LEFT JOIN o USING (underlying) LEFT JOIN t USING (underlying)""")
def classify_markets(x):
    return mt.classify_markets(x.universe, x.sql(OVERRIDES), x.sql(TICKERS))


VERIFIED = "SELECT l_orderkey AS event_id, min(l_shipdate) AS v_t0 FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY l_orderkey"


@query("overlay_verified", "event_id:l t0:t changed:b", "WITH v AS (" + VERIFIED + """)
    SELECT event_id, coalesce(v_t0, t0) AS t0, v_t0 IS NOT NULL AND v_t0 <> t0 AS changed FROM {events_long} LEFT JOIN v USING (event_id)""")
def overlay_verified(x):
    j = x.events_long.join(x.sql(VERIFIED), "event_id", "left")
    return j.select("event_id", F.coalesce("v_t0", "t0").alias("t0"),
                    F.coalesce(F.col("v_t0") != F.col("t0"), F.lit(False)).alias("changed"))


@query("merge_ticker_maps", "ticker:s cik:l origin:s", """
    WITH live AS (SELECT s_name AS ticker, s_suppkey AS cik, 'live' AS origin FROM {supplier} WHERE s_suppkey % 2 = 0),
         bundled AS (SELECT s_name AS ticker, s_nationkey AS cik, 'bundled' AS origin FROM {supplier} WHERE s_suppkey % 3 = 0)
    SELECT * FROM live UNION ALL SELECT * FROM bundled WHERE ticker NOT IN (SELECT ticker FROM live)""")
def merge_ticker_maps(x):
    s = x.supplier
    live = s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("ticker"), F.col("s_suppkey").alias("cik"), F.lit("live").alias("origin"))
    bundled = s.filter("s_suppkey % 3 = 0").select(F.col("s_name").alias("ticker"), F.col("s_nationkey").cast("bigint").alias("cik"),
                                                   F.lit("bundled").alias("origin"))
    return mt.anti_union(live, bundled, ["ticker"])


@query("estimate_source_fill", "event_id:l estimate_source:s", """
    WITH d AS (SELECT event_id, CASE WHEN price < 0 THEN 'given' END AS est FROM {events_long}),
         src AS (SELECT l_orderkey AS event_id, max(l_returnflag) AS s FROM {lineitem} GROUP BY 1)
    SELECT event_id, CASE WHEN (SELECT count(est) FROM d) = 0 THEN coalesce(s, 'unavailable') ELSE est END AS estimate_source
    FROM d LEFT JOIN src USING (event_id)""")
def estimate_source_fill(x):
    d = x.events_long.select("event_id", F.when(F.col("price") < 0, "given").alias("estimate_source"))
    src = x.lineitem.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.max("l_returnflag").alias("s"))
    return ev.fill_if_all_null(d, src, key="event_id", column="estimate_source", other="s", default="unavailable")


OVR = "SELECT o_custkey AS underlying, CAST(o_orderdate AS DATE) AS vendor_date, date_add(CAST(min(o_orderdate) AS DATE), 1) AS corrected FROM {orders} WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2"


@query("apply_date_override", "underlying:l report_date:d event_id:l", "WITH o AS (" + OVR + """)
    SELECT r.underlying, coalesce(o.corrected, r.report_date) AS report_date, min(event_id) AS event_id FROM {reports} r
    LEFT JOIN o ON o.underlying = r.underlying AND o.vendor_date = r.report_date GROUP BY 1, 2""")
def apply_date_override(x):
    o = x.sql(OVR)
    fixed = (x.reports.join(o.withColumnRenamed("vendor_date", "report_date"), ["underlying", "report_date"], "left")
             .withColumn("report_date", F.coalesce("corrected", "report_date")))
    return fixed.groupBy("underlying", "report_date").agg(F.min("event_id").alias("event_id"))


@query("fill_estimate", "event_id:l eps_estimate:n estimate_source:s", """
    WITH v AS (SELECT order_key AS event_id, max(vendor_estimate) AS ve FROM {vendor_rows} WHERE line = 1 GROUP BY 1),
         s AS (SELECT order_key AS event_id, max(vendor_eps) AS se FROM {vendor_rows} WHERE line = 5 GROUP BY 1)
    SELECT event_id, coalesce(se, eps_estimate, ve) AS eps_estimate,
           CASE WHEN se IS NOT NULL THEN 'consensus_snapshot' WHEN eps_estimate IS NOT NULL THEN 'fmp_final'
                WHEN ve IS NOT NULL THEN 'nasdaq_final' END AS estimate_source
    FROM {reports} LEFT JOIN v USING (event_id) LEFT JOIN s USING (event_id)""")
def fill_estimate(x):
    from tidemark.plans.events import estimate_ladder
    v = x.vendor_rows.withColumnRenamed("order_key", "event_id")
    second = v.filter("line = 1").groupBy("event_id").agg(F.max("vendor_estimate").alias("second"))
    snap = v.filter("line = 5").groupBy("event_id").agg(F.max("vendor_eps").alias("snapshot"))
    return estimate_ladder(x.reports.withColumnRenamed("eps_estimate", "first"), second, snap)


@query("choose_benchmark", "event_id:l benchmark:s", """
    WITH f AS (SELECT min(t) AS first_t FROM {bars} WHERE market = 'view')
    SELECT event_id, CASE WHEN has_perp AND first_t <= t0 - INTERVAL 10 DAY THEN 'perp' ELSE 'equity' END AS benchmark FROM {releases}, f""")
def choose_benchmark(x):
    from tidemark.plans.features import choose_benchmark as pick
    return pick(x.releases, x.bars.filter("market = 'view'"), reach=10 * DAY)


@query("fallback_source", "symbol:s d:d close:n vendor:s", """
    WITH a AS (SELECT p_brand AS symbol, CAST(DATE '2024-01-01' + CAST(p_size AS INT) AS DATE) AS d, min(p_retailprice) AS close, 'a' AS vendor FROM {part}
               WHERE p_type IN ('SMALL', 'LARGE') AND length(p_brand) = 7 GROUP BY 1, 2),
         b AS (SELECT p_brand AS symbol, CAST(DATE '2024-01-01' + CAST(p_size AS INT) AS DATE) AS d, max(p_retailprice) AS close, 'b' AS vendor FROM {part} GROUP BY 1, 2)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE symbol NOT IN (SELECT symbol FROM a)""")
def fallback_source(x):
    base = x.part.withColumn("d", F.expr("date_add(DATE'2024-01-01', p_size)")).withColumnRenamed("p_brand", "symbol")
    a = (base.filter("p_type IN ('SMALL', 'LARGE') AND length(symbol) = 7").groupBy("symbol", "d")
         .agg(F.min("p_retailprice").alias("close"), F.lit("a").alias("vendor")))
    b = base.groupBy("symbol", "d").agg(F.max("p_retailprice").alias("close"), F.lit("b").alias("vendor"))
    return mt.anti_union(a, b, ["symbol"])


@query("backfill_actual_t0", "event_id:l actual_t0:t lag_s:n", """
    SELECT r.event_id, min(f.accepted) AS actual_t0, epoch_us(min(f.accepted) - (r.report_date + INTERVAL 12 HOUR)) / 1e6 AS lag_s
    FROM {reports} r JOIN {filings} f ON f.cik = r.cik AND f.form = '8-K' AND f.items LIKE '%2.02%'
     AND f.accepted BETWEEN (CAST(r.report_date AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'
       AND (CAST(r.report_date AS TIMESTAMP) + INTERVAL 28 HOUR) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC'
    GROUP BY r.event_id, r.report_date""")
def backfill_actual_t0(x):
    calls = x.reports.withColumn("t0_used", fn.plus_seconds(F.col("report_date").cast("timestamp"), 12 * 3600))
    return mt.backfill_actual_t0(calls, x.filings)


@query("infer_issuer_kind", "cik:l issuer_kind:s", """
    SELECT cik, CASE WHEN NOT bool_or(form = '8-K' AND items LIKE '%2.02%') AND bool_or(form = '6-K') THEN 'foreign'
                     ELSE 'domestic' END AS issuer_kind
    FROM (SELECT * REPLACE (cik * 1000 + CAST(split_part(accession, '-', 1) AS BIGINT) % 1000 AS cik) FROM {filings}) GROUP BY 1""")
def infer_issuer_kind(x):
    order_key = F.substring_index("accession", "-", 1).cast("bigint")
    return mt.infer_issuer_kind(x.filings.withColumn("cik", F.col("cik") * 1000 + order_key % 1000))


@query("funding_interval_join", "event_id:l funding_sum:n covered:b", """
    WITH r AS (SELECT event_id, market, date_trunc('hour', t0) AS h0, date_trunc('hour', t0 + (event_id % 4) * INTERVAL '1' HOUR) AS h1 FROM {releases}),
         g AS (SELECT r.event_id, h1 > h0 AS any_hour, datediff('hour', h0, h1) AS need, count(f.t) AS got, sum(f.funding_rate) AS s
               FROM r LEFT JOIN {funding} f ON f.market = r.market AND f.t > r.h0 AND f.t <= r.h1 GROUP BY ALL)
    SELECT event_id, CASE WHEN NOT any_hour THEN 0 WHEN got = need THEN s END AS funding_sum, NOT any_hour OR got = need AS covered FROM g""")
def funding_interval_join(x):
    r = x.releases.withColumn("exit_time", fn.plus_seconds(F.col("t0"), (F.col("event_id") % 4) * 3600))
    out = tr.funding_between(r, x.funding, key=["event_id"], entry="t0", exit_="exit_time")
    return out.withColumn("covered", F.col("funding_sum").isNotNull())


PAIRED = """SELECT a.event_id, a.decision_time, (a.p_up - CAST(a.r_true > 0 AS INT)) ** 2 AS m_brier,
       (b.p_up - CAST(b.r_true > 0 AS INT)) ** 2 AS b_brier
  FROM {predictions} a JOIN {predictions} b ON a.event_id = b.event_id AND b.model = 'base_rate'
  WHERE a.model = 'linear' AND a.r_true <> 0"""


@query("paired_models", "event_id:l decision_time:s m_brier:n b_brier:n", PAIRED)
def paired_models(x):
    scores = ev.score_rows(x.predictions).filter(F.col("brier").isNotNull())
    out = ev.paired(scores, "linear", "base_rate", ["brier"])
    return out.select("event_id", "decision_time", F.col("m_brier"), F.col("b_brier"))


@query("live_truth_join", "seq:l event_key:l r_24h:n t0:t", """
    SELECT c.seq, c.event_key, t.r_24h, t.t0 FROM {live_calls} c LEFT JOIN {events_long} t ON t.event_id = c.event_key * 7""")
def live_truth_join(x):
    truth = x.events_long.select(F.col("event_id").alias("_id"), "r_24h", "t0")
    return x.live_calls.join(truth, F.col("event_key") * 7 == F.col("_id"), "left")


@query("already_done_anti", "event_id:l decision_time:s", """
    WITH due AS (SELECT DISTINCT event_key AS event_id, decision_time FROM {live_calls}),
         done AS (SELECT DISTINCT event_key AS event_id, decision_time FROM {live_calls} WHERE NOT replay AND topic = 'click')
    SELECT * FROM due EXCEPT SELECT * FROM done""")
def already_done_anti(x):
    calls = x.live_calls.withColumn("event_id", F.col("event_key"))
    due = calls.select("event_id", "decision_time").distinct()
    done = calls.filter(~F.col("replay") & (F.col("topic") == "click")).select("event_id", "decision_time").distinct()
    return due.join(done, ["event_id", "decision_time"], "left_anti")


@query("vendor_conflict", "event_id:l eps_conflict:b date_conflict:b confidence:n", """
    WITH m AS (SELECT r.event_id, r.report_date, r.eps_actual, v.vendor_date, v.vendor_eps FROM {reports} r JOIN {vendor_rows} v
               ON v.underlying = r.underlying AND abs(datediff('day', r.report_date, v.vendor_date)) <= 10
               QUALIFY row_number() OVER (PARTITION BY r.event_id ORDER BY abs(datediff('day', r.report_date, v.vendor_date)), v.vendor_date, v.order_key, v.line, v.vendor_eps) = 1)
    SELECT event_id, abs(eps_actual - vendor_eps) > greatest(0.02, 0.05 * abs(vendor_eps)) AS eps_conflict,
           abs(vendor_date - report_date) > 1 AS date_conflict, CASE WHEN abs(vendor_date - report_date) > 1 THEN 0 ELSE 0.8 END AS confidence FROM m""")
def vendor_conflict(x):
    from tidemark.plans.events import vendor_conflicts
    hit = mt.nearest_date_match(x.reports, x.vendor_rows, key="event_id", on="underlying", day="report_date",
                                other_day="vendor_date", window=10, take=["vendor_eps"], order=["order_key", "line", "vendor_eps"], keep=("report_date", "eps_actual"))
    return vendor_conflicts(hit, confidence=F.lit(0.8))


@query("equal_asof_benchmark", "event_id:l bench:n bench_end:t fresh:b", """
    SELECT r.event_id, m.close AS bench, m.t_end AS bench_end, coalesce(r.t0 - m.t_end <= INTERVAL 30 MINUTE, false) AS fresh
    FROM {releases} r ASOF LEFT JOIN {benchmark} m ON r.t0 >= m.t_end""")
def equal_asof_benchmark(x):
    out = asof_lookup(x.releases.select("event_id", "t0"), x.benchmark, left_ts="t0", right_ts="t_end",
                      take=["close", "t_end"], into="m", grid=3600, bucket=5 * DAY)
    age = fn.seconds_between(F.col("t0"), F.col("m.t_end"))
    return out.select("event_id", F.col("m.close").alias("bench"), F.col("m.t_end").alias("bench_end"),
                      F.coalesce(age <= 1800, F.lit(False)).alias("fresh"))


INSTANT_PAGES = "SELECT l_orderkey AS k, l_linenumber AS ln, l_shipdate + INTERVAL 1 HOUR AS page_instant FROM {lineitem} WHERE l_tax > 0.04e0"


@query("verify_instants", "accession:s accepted:t verified:b changed:b", "WITH p AS (" + INSTANT_PAGES + """)
    SELECT accession, coalesce(page_instant, accepted) AS accepted, page_instant IS NOT NULL AS verified,
           coalesce(page_instant <> accepted, false) AS changed
    FROM {filings} LEFT JOIN p ON accession = concat(k, '-', ln)""")
def verify_instants(x):
    pages = x.sql(INSTANT_PAGES).select(F.concat_ws("-", "k", "ln").alias("accession"), "page_instant")
    j = x.filings.join(pages, "accession", "left")
    return j.select("accession", F.coalesce("page_instant", "accepted").alias("accepted"),
                    F.col("page_instant").isNotNull().alias("verified"),
                    F.coalesce(F.col("page_instant") != F.col("accepted"), F.lit(False)).alias("changed"))
