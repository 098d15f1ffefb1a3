"""Event resolution."""

from pyspark.sql import functions as F

from tidemark.catalog.common import calendar_of
from tidemark.catalog.joins import FACTS, MARKETS, OVR, THIRD
from tidemark.catalog.registry import query
from tidemark.catalog.scalars import CLOCK, TIMING, ny
from tidemark.functions import scalars as fn
from tidemark.plans import events as evt

DETECTOR = evt.DetectorRules(clock_window=60, z=2.0)
QUALIFY = f"""
    a AS (SELECT market, t, open, high, low, close, volume, {ny('t')} AS n, lag(close) OVER (PARTITION BY market ORDER BY t) AS pc FROM {{bars}}),
    b AS (SELECT *, CAST(n AS DATE) AS day, hour(n) * 60 + minute(n) AS clock, CASE WHEN hour(n) * 60 + minute(n) < 570 THEN 0 WHEN hour(n) * 60 + minute(n) <= 960 THEN 1 ELSE 2 END AS seg,
                 row_number() OVER (PARTITION BY market, CAST(n AS DATE) ORDER BY t) AS pos, dense_rank() OVER (PARTITION BY market ORDER BY CAST(n AS DATE)) AS dn,
                 greatest(coalesce(CASE WHEN open <> 0 THEN abs(close / open - 1) END, 0), coalesce(CASE WHEN pc <> 0 THEN abs(open / pc - 1) END, 0)) AS ret FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY market, day, seg ORDER BY t) AS sp FROM b),
    smp AS (SELECT x.market, x.day, x.t, x.pos, x.volume AS v, x.ret, x.pc, y.volume AS bv FROM c x JOIN c y ON y.market = x.market AND y.seg = x.seg AND
              ((y.dn BETWEEN x.dn - 10 AND x.dn - 1 AND abs(y.clock - x.clock) <= 60) OR (y.day = x.day AND y.sp < x.sp AND y.sp >= x.sp - 60)) WHERE x.volume > 0),
    m AS (SELECT market, day, t, pos, v, ret, pc, count(*) AS k, median(bv) AS med, mad(bv) AS md FROM smp GROUP BY ALL),
    q AS (SELECT * FROM m WHERE k >= 10 AND (v - med) / greatest(1.4826 * md, 0.25 * med, 1) >= 2)"""


@query("detect_release", "market:s day:d t:t first_bar:b", "WITH" + QUALIFY + """
    SELECT market, day, min(t) AS t, arg_min(pos, t) = 1 AS first_bar FROM q WHERE ret >= 0.01 GROUP BY 1, 2""")
def detect_release(x):
    return evt.detect_release(x.bars, DETECTOR)


PINS = "SELECT DISTINCT market, CAST(t AS DATE) + INTERVAL 15 HOUR AS pin FROM {bars}"


@query("confirm_pinned", "market:s pin:t t0_live:t range_pct:n", "WITH" + QUALIFY + """, pins AS (SELECT DISTINCT market, CAST(t AS DATE) + INTERVAL 15 HOUR AS pin FROM {bars}),
    h AS (SELECT p.market, p.pin, q.t, q.pc FROM pins p JOIN q ON q.market = p.market AND q.ret >= 0.002 AND q.t BETWEEN p.pin - INTERVAL 1 HOUR AND p.pin + INTERVAL 5 HOUR
          WHERE q.t + INTERVAL 5 HOUR <= TIMESTAMP '2024-01-29 18:00:00'),
    r AS (SELECT h.market, h.pin, h.t, (max(b.high) - min(b.low)) / h.pc AS rng FROM h JOIN {bars} b ON b.market = h.market AND b.t >= h.t AND b.t < h.t + INTERVAL 5 HOUR WHERE h.pc > 0 GROUP BY h.market, h.pin, h.t, h.pc)
    SELECT market, pin, min(t) AS t0_live, arg_min(rng, t) AS range_pct FROM r WHERE rng >= 0.01 GROUP BY 1, 2""")
def confirm_pinned(x):
    pins = x.bars.select("market", fn.plus_seconds(F.date_trunc("day", "t"), 15 * 3600).alias("pin")).distinct()
    rules = evt.DetectorRules(clock_window=60, z=2.0, min_return=0.002)
    return evt.confirm_pinned(x.bars, pins, rules, before=3600, after=5 * 3600, span=5 * 3600, min_range=0.01, now=F.lit("2024-01-29 18:00:00").cast("timestamp"))


SOURCES = """SELECT r.event_id, r.report_date, r.time_flag, CASE WHEN r.event_id % 20 = 0 THEN e.t0 END AS manual, CASE WHEN r.event_id % 3 = 0 THEN e.t0 + INTERVAL 5 MINUTE END AS accepted,
    CASE WHEN r.event_id % 2 = 0 THEN e.t0 + INTERVAL 5 MINUTE - (r.event_id % 25) * INTERVAL '1' MINUTE + INTERVAL 3 MINUTE END AS det_near, r.event_id % 7 = 0 AS det_near_first, r.event_id % 11 = 0 AS crosses,
    CASE WHEN r.event_id % 5 = 0 THEN e.t0 + INTERVAL 1 HOUR END AS clock_t0, CASE WHEN r.event_id % 4 = 1 THEN e.t0 - INTERVAL 2 HOUR END AS det_t, r.event_id % 13 = 0 AS det_first
    FROM {reports} r JOIN {events_long} e ON e.event_id = r.event_id"""


@query("resolve_t0", "event_id:l t0:t t0_confidence:n t0_source:s flags:s t0_lag_s:n", "WITH s AS (" + SOURCES + f"""),
    l AS (SELECT *, epoch_us(accepted - det_near) / 1e6 AS lag, {TIMING} AS tm FROM s),
    v AS (SELECT *, coalesce(lag BETWEEN 0 AND 900 AND NOT crosses, false) AS moved FROM l)
    SELECT event_id, CASE WHEN manual IS NOT NULL THEN manual WHEN accepted IS NOT NULL THEN CASE WHEN moved THEN det_near ELSE accepted END WHEN clock_t0 IS NOT NULL THEN clock_t0
         WHEN det_t IS NOT NULL THEN det_t ELSE ((CAST(report_date AS TIMESTAMP) + CASE tm WHEN 'BMO' THEN INTERVAL 420 MINUTE ELSE INTERVAL 965 MINUTE END) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' END AS t0,
       CASE WHEN manual IS NOT NULL THEN 1 WHEN accepted IS NOT NULL THEN 0.95 WHEN clock_t0 IS NOT NULL THEN 0.7 WHEN det_t IS NOT NULL THEN CASE WHEN det_first THEN 0.5 ELSE 0.8 END
            WHEN tm IS NOT NULL THEN 0.5 ELSE 0.25 END AS t0_confidence,
       CASE WHEN manual IS NOT NULL THEN 'manual' WHEN accepted IS NOT NULL THEN 'sec_8k' WHEN clock_t0 IS NOT NULL THEN 'issuer_clock' WHEN det_t IS NOT NULL THEN 'detected' ELSE 'calendar_flag' END AS t0_source,
       CASE WHEN manual IS NOT NULL THEN '' WHEN accepted IS NOT NULL THEN CASE WHEN moved AND det_near_first THEN 'detection_first_bar' ELSE '' END WHEN clock_t0 IS NOT NULL THEN ''
            WHEN det_t IS NOT NULL THEN CASE WHEN det_first THEN 'detection_first_bar' ELSE '' END WHEN tm IS NULL THEN 'timing_unknown' ELSE '' END AS flags,
       CASE WHEN manual IS NULL AND accepted IS NOT NULL AND NOT coalesce(lag BETWEEN 0 AND 900 AND crosses, false) THEN lag END AS t0_lag_s FROM v""")
def resolve_t0(x):
    return evt.resolve_t0(x.sql(SOURCES)).withColumn("flags", F.array_join("flags", ";"))


LADDER = """SELECT r.event_id, r.underlying, r.report_date, r.time_flag, CASE WHEN r.event_id % 17 = 0 THEN e.t0 END AS pinned, CASE WHEN r.event_id % 13 = 0 THEN e.t0 - INTERVAL 1 HOUR END AS manual,
    CASE WHEN r.event_id % 5 = 0 THEN 600 + r.event_id % 300 END AS median_minute, CASE WHEN r.event_id % 7 = 0 THEN e.t0 + INTERVAL 2 HOUR END AS clock_t0,
    CASE WHEN r.event_id % 3 = 0 THEN e.t0 + INTERVAL 3 HOUR END AS table_t0, CASE r.event_id % 9 WHEN 1 THEN 'BMO' WHEN 2 THEN 'AMC' END AS typical
    FROM {reports} r JOIN {events_long} e ON e.event_id = r.event_id"""
LOCAL = "((CAST(report_date AS TIMESTAMP) + {m} * INTERVAL '1' MINUTE) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'"
EXPECTED = f"""SELECT *, coalesce(pinned, manual, {LOCAL.replace('{m}', 'median_minute')}, clock_t0, table_t0, {LOCAL.replace('{m}', "CASE tm WHEN 'AMC' THEN 965 WHEN 'BMO' THEN 420 END")},
      {LOCAL.replace('{m}', "CASE typical WHEN 'AMC' THEN 965 WHEN 'BMO' THEN 420 END")}, {LOCAL.replace('{m}', '965')}) AS expected_t0,
    CASE WHEN pinned IS NOT NULL THEN 'pinned' WHEN manual IS NOT NULL THEN 'manual' WHEN median_minute IS NOT NULL THEN 'median_clock' WHEN clock_t0 IS NOT NULL THEN 'issuer_clock'
         WHEN table_t0 IS NOT NULL THEN 'schedule' WHEN tm IS NOT NULL THEN 'vendor_flag' WHEN typical IS NOT NULL THEN 'typical' ELSE 'default_amc' END AS expected_t0_source
    FROM (SELECT *, {TIMING} AS tm FROM ({LADDER}))"""


@query("expected_t0", "event_id:l expected_t0:t expected_t0_source:s", "SELECT event_id, expected_t0, expected_t0_source FROM (" + EXPECTED + ")")
def expected_t0(x):
    return evt.expected_t0(x.sql(LADDER))


@query("upcoming_events", "event_id:s underlying:l report_date:d expected_t0:t expected_t0_source:s eps_estimate:n snapshot_time:t", f"""
    WITH cand AS (SELECT * FROM ({LADDER}) QUALIFY row_number() OVER (PARTITION BY underlying, report_date ORDER BY event_id) = 1),
         o AS ({OVR}), d AS (SELECT cand.* REPLACE (coalesce(o.corrected, cand.report_date) AS report_date) FROM cand LEFT JOIN o ON o.underlying = cand.underlying AND o.vendor_date = cand.report_date),
         u AS (SELECT * FROM d WHERE report_date BETWEEN DATE '2000-03-01' AND DATE '2000-03-31' QUALIFY row_number() OVER (PARTITION BY underlying, report_date ORDER BY event_id) = 1),
         k AS (SELECT underlying, report_date, min(event_id) AS id FROM {{reports}} WHERE event_id % 2 = 0 GROUP BY 1, 2),
         c AS (SELECT symbol, max(snapshot_time) AS snapshot_time, arg_max(eps_estimate, (snapshot_time, seq)) AS eps_estimate FROM {{snapshots}} GROUP BY 1)
    SELECT coalesce(CAST(k.id AS VARCHAR), concat(e.underlying, ':', strftime(e.report_date, '%Y-%m'))) AS event_id, e.underlying, e.report_date, e.expected_t0, e.expected_t0_source, c.eps_estimate, c.snapshot_time
    FROM ({EXPECTED.replace('FROM (SELECT *, ' + TIMING + ' AS tm FROM (' + LADDER + '))', 'FROM (SELECT *, ' + TIMING + ' AS tm FROM u)')}) e
    LEFT JOIN k ON k.underlying = e.underlying AND k.report_date = e.report_date LEFT JOIN c ON c.symbol = e.underlying""")
def upcoming_events(x):
    from tidemark.operators.dedup import first_per_key
    cal = first_per_key(x.sql(LADDER), ["underlying", "report_date"], ["event_id"]).withColumnRenamed("event_id", "row_id")
    corr = x.sql(OVR).withColumnRenamed("vendor_date", "report_date")
    known = x.reports.filter("event_id % 2 = 0").select("underlying", "report_date", "event_id")
    cons = x.snapshots.withColumnRenamed("symbol", "underlying")
    return evt.upcoming_events(cal, today="2000-03-01", days=30, corrections=corr, known=known, consensus=cons)


@query("build_events", "event_id:l underlying:l report_date:d t0:t t0_confidence:n t0_source:s t0_lag_s:n eps_actual:n eps_estimate:n estimate_source:s eps_surprise_pct:n "
       "fiscal_period:s period_source:s market:s has_perp_at_t0:b flags:s")
def build_events(x):
    reports = x.reports.withColumns({"det_market": fn.lookup(F.col("event_id") % 4, {0: "click", 1: "error", 2: "signup"}, "view"),
                                     "universe_name": F.concat(F.lit("Brand#"), (1 + F.col("event_id") % 25).cast("string"))})
    clocks = x.reports.select("underlying").distinct().filter("underlying % 10 = 0").withColumn(
        "clock", F.expr(CLOCK.replace("event_id", "underlying")))
    v = x.vendor_rows.withColumnRenamed("order_key", "event_id")
    second = v.filter("line = 1").groupBy("event_id").agg(F.max("vendor_estimate").alias("second"))
    snap = v.filter("line = 5").groupBy("event_id").agg(F.max("vendor_eps").alias("snapshot"))
    mk = x.sql(MARKETS).withColumn("listing_start", F.col("listing").cast("timestamp"))
    return evt.build_events(reports, corrections=x.sql(OVR).withColumnRenamed("vendor_date", "report_date"), vendor=x.vendor_rows, second=second, snapshots=snap,
                            filings=x.filings, detections=evt.detect_release(x.bars, DETECTOR), clocks=clocks, facts=x.sql(FACTS), third=x.sql(THIRD),
                            markets=mk, calendar=calendar_of(x))
