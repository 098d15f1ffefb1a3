"""Scalar functions."""

from pyspark.sql import functions as F

from tidemark.catalog.common import calendar_of
from tidemark.catalog.registry import query
from tidemark.functions import scalars as fn
from tidemark.sources import calendar as cal

NYT = "(({c} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


def ny(c: str) -> str:
    return NYT.replace("{c}", c)


@query("fn_log_ret", "event_id:l r:n", """
    SELECT event_id, CASE WHEN eps_actual > 0 AND k - 5 > 0 THEN ln(eps_actual / (k - 5)) END AS r FROM {releases}""")
def fn_log_ret(x):
    return x.releases.select("event_id", fn.log_ret(F.col("eps_actual"), F.col("k") - 5).alias("r"))


@query("fn_surprise_pct", "event_id:l s:n", """
    SELECT event_id, CASE WHEN k % 20 <> 0 THEN (eps_actual - k % 20) / abs(k % 20) * 100 END AS s FROM {releases}""")
def fn_surprise_pct(x):
    return x.releases.select("event_id", fn.surprise_pct(F.col("eps_actual"), (F.col("k") % 20).cast("double")).alias("s"))


@query("fn_season", "event_id:l season:s start_at:t end_at:t", """
    SELECT event_id, concat(year(t0), 'Q', quarter(t0)) AS season, CAST(date_trunc('quarter', t0) AS TIMESTAMP) AS start_at,
           CAST(date_trunc('quarter', t0) + INTERVAL 3 MONTH AS TIMESTAMP) AS end_at FROM {events_long}""")
def fn_season(x):
    s = fn.season_start(F.col("t0"))
    return x.events_long.select("event_id", fn.season(F.col("t0")).alias("season"), s.alias("start_at"),
                                (s + F.expr("INTERVAL 3 MONTH")).alias("end_at"))


@query("fn_ny_clock", "event_id:l ny_date:d weekday:l hour_ny:n", f"""
    SELECT event_id, CAST(n AS DATE) AS ny_date, isodow(n) - 1 AS weekday, hour(n) + minute(n) / 60.0 + second(n) / 3600.0 AS hour_ny
    FROM (SELECT event_id, {ny('t0')} AS n FROM {{releases}})""")
def fn_ny_clock(x):
    t = F.col("t0")
    return x.releases.select("event_id", fn.ny_date(t).alias("ny_date"), F.weekday(fn.ny_time(t)).alias("weekday"),
                             fn.ny_hour(t).alias("hour_ny"))


@query("fn_to_utc_strict", "event_id:l utc:t ambiguous:b skipped:b", """
    WITH u AS (SELECT event_id, t0 AS loc, (t0 AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS utc FROM {events_long})
    SELECT event_id, CASE WHEN NOT ambiguous THEN utc END AS utc, ambiguous, ((utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') <> loc AS skipped FROM (
      SELECT *, (((utc + INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') = loc
             OR (((utc - INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') = loc AS ambiguous FROM u)""")
def fn_to_utc_strict(x):
    t, utc = F.col("t0"), F.to_utc_timestamp("t0", fn.NY)
    return x.events_long.select("event_id", fn.to_utc(t, strict=False).alias("utc"), fn.is_ambiguous(t).alias("ambiguous"),
                                (F.from_utc_timestamp(utc, fn.NY) != t).alias("skipped"))


@query("fn_classify_timing", "event_id:l timing:s", f"""
    SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM {{sessions}} s WHERE s.open_ts <= t0 AND t0 < s.close_ts) THEN 'RTH'
       WHEN NOT EXISTS (SELECT 1 FROM {{sessions}} s WHERE s.d = CAST({ny('t0')} AS DATE)) THEN 'CLOSED'
       WHEN CAST({ny('t0')} AS TIME) < TIME '09:30:00' THEN 'BMO' ELSE 'AMC' END AS timing FROM {{events_long}}""")
def fn_classify_timing(x):
    c = calendar_of(x)
    e = cal.attach_ny_day(cal.attach(x.events_long.select("event_id", "t0"), c, "t0"), c, "t0")
    return e.select("event_id", fn.classify_timing(F.col("t0"), F.col("is_open"), F.col("is_session_day")).alias("timing"))


TIMING = ("CASE WHEN time_flag = 'AMC' THEN 'AMC' WHEN time_flag = 'Pre-Market' THEN 'BMO' END")


@query("fn_timing_flag", "event_id:l timing:s", f"SELECT event_id, {TIMING} AS timing FROM {{reports}}")
def fn_timing_flag(x):
    return x.reports.select("event_id", fn.timing_from_flag(F.col("time_flag")).alias("timing"))


@query("fn_calendar_default_t0", "event_id:l t0:t", f"""
    SELECT event_id, ((CAST(report_date AS TIMESTAMP) + CASE {TIMING} WHEN 'AMC' THEN INTERVAL 965 MINUTE WHEN 'BMO' THEN INTERVAL 420 MINUTE END)
       AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS t0 FROM {{reports}}""")
def fn_calendar_default_t0(x):
    return x.reports.select("event_id", fn.calendar_default_t0(F.col("report_date"), fn.timing_from_flag(F.col("time_flag"))).alias("t0"))


CLOCK = """CASE event_id % 3 WHEN 0 THEN '07:00 Europe/Amsterdam' WHEN 1 THEN '16:05 America/New_York' ELSE '15:30 Asia/Tokyo' END"""


@query("fn_release_clock", "event_id:l t0:t", """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN ((report_date + INTERVAL 7 HOUR) AT TIME ZONE 'Europe/Amsterdam') AT TIME ZONE 'UTC'
       WHEN 1 THEN ((report_date + INTERVAL 965 MINUTE) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'
       ELSE ((report_date + INTERVAL 930 MINUTE) AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'UTC' END AS t0 FROM {reports}""")
def fn_release_clock(x):
    return x.reports.select("event_id", fn.release_clock(F.col("report_date"), F.expr(CLOCK)).alias("t0"))


@query("fn_quarter_project", "event_id:l q:d", """
    WITH s AS (SELECT event_id, report_date AS d, unnest(generate_series(-10, 60)) AS k FROM {reports})
    SELECT event_id, max(CAST(DATE '1996-01-31' + INTERVAL (3 * k) MONTH AS DATE)) AS q FROM s
    WHERE CAST(DATE '1996-01-31' + INTERVAL (3 * k) MONTH AS DATE) < d GROUP BY 1""")
def fn_quarter_project(x):
    return x.reports.select("event_id", fn.quarter_project(F.lit("1996-01-31").cast("date"), F.col("report_date")).alias("q"))


SHOWN = """CASE event_id % 5 WHEN 0 THEN concat('$', CAST(event_id AS VARCHAR(20)), ',', '125.5') WHEN 1 THEN concat('(', CAST(k AS VARCHAR(20)), '.25)')
           WHEN 2 THEN concat(' ', CAST(k AS VARCHAR(20)), '%') WHEN 3 THEN 'N/A' ELSE '' END"""


@query("fn_parse_number", "event_id:l v:n", """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id * 1000 + 125.5 WHEN 1 THEN -(k + 0.25) WHEN 2 THEN k END AS v FROM {releases}""")
def fn_parse_number(x):
    return x.releases.withColumn("shown", F.expr(SHOWN)).select("event_id", fn.parse_number(F.col("shown")).alias("v"))


@query("fn_split_items", "accession:s n_items:l first_item:s", """
    SELECT accession, length(items) - length(replace(items, ',', '')) + 1 AS n_items, substr(items, 1, 4) AS first_item FROM {filings}""")
def fn_split_items(x):
    it = fn.split_items(F.col("items"))
    return x.filings.select("accession", F.size(it).alias("n_items"), F.get(it, F.lit(0)).alias("first_item"))


@query("fn_accession", "k:l acc:s", """
    SELECT l_orderkey * 10 + l_linenumber AS k, concat(lpad(CAST(l_suppkey AS VARCHAR), 10, '0'), '-', lpad(CAST(l_linenumber AS VARCHAR), 2, '0'),
           '-', lpad(CAST(l_orderkey AS VARCHAR), 6, '0')) AS acc FROM {lineitem}""")
def fn_accession(x):
    raw = F.concat(F.lpad(F.col("l_suppkey").cast("string"), 10, "0"), F.when(F.col("l_orderkey") % 2 == 0, "-").otherwise(""),
                   F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lpad(F.col("l_orderkey").cast("string"), 6, "0"))
    return x.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), fn.accession(raw).alias("acc"))


@query("fn_event_id", "event_id:l id:s", """
    SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN 'given' END, concat(underlying, ':', strftime(report_date, '%Y-%m'))) AS id FROM {reports}""")
def fn_event_id(x):
    given = F.when(F.col("event_id") % 4 == 0, "given")
    return x.reports.select("event_id", F.coalesce(given, fn.event_id(F.col("underlying").cast("string"), F.col("report_date"))).alias("id"))


FLAGS = "concat_ws(';', t0_source, CASE WHEN event_id % 2 = 0 THEN 'pre_announced' END, 'x')"


@query("fn_has_flag", "event_id:l pre:b src:b partial:b", """
    SELECT event_id, event_id % 2 = 0 AS pre, t0_source = 'detected' AS src, false AS partial FROM {releases}""")
def fn_has_flag(x):
    r = x.releases.withColumn("flags", F.expr(FLAGS))
    f = F.col("flags")
    return r.select("event_id", fn.has_flag(f, "pre_announced").alias("pre"), fn.has_flag(f, "detected").alias("src"),
                    fn.has_flag(f, "announced").alias("partial"))


@query("fn_max_staleness", "event_id:l limit_s:l", """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 300 WHEN 1 THEN 600 WHEN 2 THEN 1800 ELSE 7200 END AS limit_s FROM {releases}""")
def fn_max_staleness(x):
    ivl = fn.lookup(F.col("event_id") % 5, {0: "1m", 1: "5m", 2: "15m", 3: "1h"}, "1d")
    return x.releases.select("event_id", fn.max_staleness(ivl).alias("limit_s"))


@query("fn_p0_buffer", "event_id:l buffer_s:l", "SELECT event_id, CASE WHEN t0_source = 'sec_8k' THEN 180 ELSE 0 END AS buffer_s FROM {releases}")
def fn_p0_buffer(x):
    return x.releases.select("event_id", fn.p0_buffer(F.col("t0_source")).alias("buffer_s"))


@query("fn_call", "seq:l side:s forced:s", """
    SELECT seq, CASE WHEN p_up IS NULL THEN 'NO TRADE' WHEN p_up - 0.5 >= 0.1 - 1e-9 THEN 'LONG' WHEN 0.5 - p_up >= 0.1 - 1e-9 THEN 'SHORT'
                ELSE 'NO TRADE' END AS side, CASE WHEN p_up IS NULL THEN '' WHEN p_up >= 0.5 THEN 'LONG' ELSE 'SHORT' END AS forced FROM {live_calls}""")
def fn_call(x):
    return x.live_calls.select("seq", fn.call(F.col("p_up"), 0.1).alias("side"), fn.forced_call(F.col("p_up")).alias("forced"))


@query("fn_position_size", "event_id:l model:s sizing:s size:n", """
    WITH s AS (SELECT unnest(['fixed', 'by_confidence', 'by_magnitude', 'magnitude_gate']) AS sizing)
    SELECT event_id, model, sizing, CASE sizing WHEN 'fixed' THEN 1 WHEN 'by_confidence' THEN least(1, 2 * abs(p_up - 0.5))
      WHEN 'by_magnitude' THEN CASE WHEN magnitude_hat > 0 THEN least(1, 0.03 / magnitude_hat) ELSE 1 END
      ELSE CASE WHEN magnitude_hat > 0.02 THEN 1 ELSE 0 END END AS size FROM {predictions}, s""")
def fn_position_size(x):
    s = x.predictions.withColumn("sizing", F.explode(F.array(*[F.lit(v) for v in ("fixed", "by_confidence", "by_magnitude", "magnitude_gate")])))
    return s.select("event_id", "model", "sizing", fn.position_size(F.col("sizing"), F.col("p_up"), F.col("magnitude_hat"), F.lit(0.02), 0.03).alias("size"))


@query("fn_leg_cost", "market:s t:t bps:n", """
    SELECT market, t, CASE WHEN open > 0 THEN 5 + 0.25 * ((high - low) / open * 1e4) + 4.5 END AS bps FROM {bars}""")
def fn_leg_cost(x):
    rng = F.try_divide(F.col("high") - F.col("low"), F.col("open")) * 1e4
    return x.bars.select("market", "t", fn.leg_cost_bps(rng).alias("bps"))


@query("fn_sign_proba", "event_id:l p:n clipped:n", """
    SELECT event_id, 0.5 + 0.25 * sign(r_24h) AS p, CASE WHEN rvol_20d IS NOT NULL THEN greatest(least(rvol_20d * 30, 0.999), 0.001) END AS clipped FROM {events_long}""")
def fn_sign_proba(x):
    return x.events_long.select("event_id", fn.sign_proba(F.col("r_24h")).alias("p"), fn.clip_proba(F.col("rvol_20d") * 30).alias("clipped"))


@query("fn_verdict", "event_id:l verdict:s", """
    SELECT event_id, CASE WHEN r_24h > 0.02 THEN 'improves' WHEN r_30m < -0.02 THEN 'worse'
       WHEN event_id % 2 = 0 AND r_30m < 0.01 THEN 'not_predictable' ELSE concat('inconclusive at n = ', event_id) END AS verdict FROM {events_long}""")
def fn_verdict(x):
    metric = F.when(F.col("event_id") % 2 == 0, "brier").otherwise("mae")
    return x.events_long.select("event_id", fn.verdict(metric, F.col("r_24h") - 0.02, F.col("r_30m") + 0.02, F.lit(0.03), F.col("event_id")).alias("verdict"))


@query("fn_coin", "event_id:l side:s", """
    SELECT event_id, CASE WHEN substr(sha256(concat(symbol, underlying, ' ', strftime(t0, '%Y-%m-%d'))), 1, 1) <= '7' THEN 'UP' ELSE 'DOWN' END AS side FROM {events_long}""")
def fn_coin(x):
    ticker = F.concat("symbol", F.col("underlying").cast("string"))
    return x.events_long.select("event_id", fn.coin_side(ticker, F.to_date("t0")).alias("side"))


@query("fn_sector_proxy", "p_partkey:l proxy:s", """
    SELECT p_partkey, CASE WHEN p_name LIKE '% ring' THEN 'SMH' WHEN p_type = 'ECONOMY' THEN 'XLE' WHEN p_type = 'SMALL' THEN 'XLK' END AS proxy FROM {part}""")
def fn_sector_proxy(x):
    industry = F.when(F.substring_index("p_name", " ", -1) == "ring", "SMH")
    return x.part.select("p_partkey", F.coalesce(industry, fn.lookup(F.col("p_type"), {"ECONOMY": "XLE", "SMALL": "XLK"})).alias("proxy"))


@query("fn_holiday_adjacent", "event_id:l adjacent:n", f"""
    WITH n AS (SELECT event_id, CAST({ny('t0')} AS DATE) AS d FROM {{events_long}}),
         u AS (SELECT d, (SELECT max(s.d) FROM {{sessions}} s WHERE s.d < n.d) AS prv, (SELECT min(s.d) FROM {{sessions}} s WHERE s.d > n.d) AS nxt,
                      EXISTS (SELECT 1 FROM {{sessions}} s WHERE s.d = n.d) AS is_sess FROM (SELECT DISTINCT d FROM n) n),
         g AS (SELECT d, CASE WHEN (isodow(d) <= 5 AND NOT is_sess) OR EXISTS (SELECT 1 FROM {{days}} x WHERE x.d > prv AND x.d < nxt AND x.d <> u.d AND isodow(x.d) <= 5)
                         THEN 1 ELSE 0 END AS adjacent FROM u)
    SELECT event_id, adjacent FROM n JOIN g USING (d)""")
def fn_holiday_adjacent(x):
    return cal.attach_ny_day(x.events_long.select("event_id", "t0"), calendar_of(x), "t0").select(
        "event_id", F.col("holiday_adjacent").alias("adjacent"))


BUCKET = """CASE WHEN (isodow(n) = 5 AND hour(n) >= 20) OR isodow(n) = 6 OR (isodow(n) = 7 AND hour(n) < 18) THEN 'weekend'
      WHEN hour(n) >= 10 AND hour(n) < 16 AND isodow(n) <= 5 THEN 'cash 10-16' WHEN hour(n) = 9 AND isodow(n) <= 5 THEN 'open hour 9-10'
      WHEN hour(n) >= 4 AND hour(n) < 9 THEN 'pre 4-9' WHEN hour(n) >= 16 AND hour(n) < 20 THEN 'post 16-20' ELSE 'overnight 20-4' END"""


@query("fn_session_bucket", "event_id:l bucket:s", f"SELECT event_id, {BUCKET} AS bucket FROM (SELECT event_id, {ny('t0')} AS n FROM {{events_long}})")
def fn_session_bucket(x):
    return x.events_long.select("event_id", fn.session_bucket(F.col("t0")).alias("bucket"))
