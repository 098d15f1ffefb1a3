"""Targets."""

from pyspark.sql import functions as F

from tidemark.catalog.common import calendar_of
from tidemark.catalog.registry import query
from tidemark.functions import scalars as fn
from tidemark.operators.asof import DAY
from tidemark.plans import targets as tg

# Shared by the oracles: instants of every release, hourly rules
INSTANTS = """
  cps AS (SELECT * FROM (VALUES ('5m', 1), ('15m', 2), ('30m', 3), ('60m', 6), ('2h', 12), ('24h', 24)) v(checkpoint, h)),
  inst AS (
    SELECT event_id, market, 'p0' AS checkpoint,
           t0 - CASE WHEN t0_source = 'sec_8k' THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END AS at_ts FROM {releases}
    UNION ALL SELECT event_id, market, checkpoint, t0 + h * INTERVAL '1' HOUR FROM {releases}, cps
    UNION ALL SELECT event_id, market, 'next_open', (SELECT min(open_ts) FROM {sessions} s WHERE s.open_ts > r.t0) FROM {releases} r
    UNION ALL SELECT event_id, market, 'next_open_30m', (SELECT min(open_ts) FROM {sessions} s WHERE s.open_ts > r.t0) + INTERVAL 30 MINUTE FROM {releases} r
    UNION ALL SELECT event_id, market, 'next_close', (SELECT min(close_ts) FROM {sessions} s WHERE s.close_ts > r.t0) FROM {releases} r)"""

LONG = "WITH" + INSTANTS + """,
  h AS (SELECT i.*, b.close, b.t_end FROM inst i ASOF LEFT JOIN {bars} b ON i.market = b.market AND i.at_ts >= b.t_end),
  hb AS (SELECT h.*, m.close AS mclose, m.t_end AS mend FROM h ASOF LEFT JOIN {benchmark} m ON h.at_ts >= m.t_end),
  p AS (SELECT event_id, at_ts AS at0, close AS p0, t_end AS p0_end, mclose AS b0, mend AS b0_end FROM hb WHERE checkpoint = 'p0'),
  j AS (SELECT c.event_id, c.checkpoint, c.at_ts, c.close, c.t_end, c.mclose, c.mend, p.* EXCLUDE (event_id), r.t0, r.ca_ex_date,
               CASE WHEN r.has_perp THEN 'hl_archive' ELSE 'fmp' END AS price_source, r.market
        FROM hb c JOIN p USING (event_id) JOIN {releases} r USING (event_id) WHERE c.checkpoint <> 'p0'),
  k AS (SELECT *, p0 > 0 AND at0 - p0_end <= INTERVAL 2 HOUR AS usable,
               coalesce(p0 > 0 AND at0 - p0_end <= INTERVAL 2 HOUR AND ca_ex_date >= p0_end AND ca_ex_date <= t0 + INTERVAL 24 HOUR, false) AS voided FROM j),
  ok AS (SELECT *, coalesce(usable AND t_end > p0_end AND at_ts - t_end <= INTERVAL 2 HOUR
                   AND NOT (voided AND (checkpoint = '24h' OR (price_source = 'hl_archive' AND t_end >= ca_ex_date))), false) AS valid,
               coalesce(at0 - b0_end <= INTERVAL 2 HOUR AND mend > b0_end AND at_ts - mend <= INTERVAL 2 HOUR, false) AS mvalid FROM k),
  long AS (SELECT *, CASE WHEN valid AND close > 0 THEN ln(close / p0) END AS r,
                  CASE WHEN valid AND mvalid AND close > 0 AND mclose > 0 AND b0 > 0 THEN ln(close / p0) - ln(mclose / b0) END AS ar FROM ok)
"""


def release_events(x):
    return x.releases.withColumn("price_source", F.when(F.col("has_perp"), "hl_archive").otherwise("fmp"))


def targets_of(x):
    return tg.compute_targets(release_events(x), x.bars, x.benchmark, calendar_of(x), tg.HOURLY)


@query("checkpoint_times", "event_id:l checkpoint:s at_ts:t",
       "WITH" + INSTANTS + " SELECT event_id, checkpoint, at_ts FROM inst WHERE checkpoint <> 'p0'")
def checkpoint_times(x):
    return tg.checkpoint_times(x.releases, calendar_of(x), tg.HOURLY)


@query("compute_targets",
       "event_id:l market:s p0:n p0_time:t p0_staleness_min:n label_reason:s "
       + " ".join(f"{k}_{c}:{t}" for c in tg.HOURLY.checkpoints for k, t in
                  (("p", "n"), ("t", "t"), ("s", "n"), ("r", "n"), ("ar", "n"))),
       LONG + """
       SELECT r.event_id, r.market, any_value(CASE WHEN l.p0 > 0 THEN l.p0 END) AS p0,
              any_value(CASE WHEN l.p0 > 0 THEN l.p0_end END) AS p0_time,
              any_value(CASE WHEN l.p0 > 0 THEN epoch_us(l.at0 - l.p0_end) / 60e6 END) AS p0_staleness_min,
              CASE WHEN NOT coalesce(bool_or(l.p0 > 0), false) THEN 'no_p0' WHEN NOT bool_or(l.usable) THEN 'p0_stale'
                   WHEN bool_or(l.voided) THEN 'corporate_action'
                   WHEN NOT bool_or(l.checkpoint = '24h' AND l.r IS NOT NULL) THEN 'no_24h_bar' END AS label_reason,
       """ + ", ".join(
           f"max(CASE WHEN l.checkpoint = '{c}' AND l.valid THEN {e} END) AS \"{k}_{c}\"" for c in tg.HOURLY.checkpoints
           for k, e in (("p", "l.close"), ("t", "l.t_end"), ("s", "epoch_us(l.at_ts - l.t_end) / 60e6"), ("r", "l.r"), ("ar", "l.ar")))
       + " FROM {releases} r JOIN long l USING (event_id) GROUP BY r.event_id, r.market")
def compute_targets(x):
    return targets_of(x)


@query("labels", "event_id:l direction:n magnitude:n continuation_15m:n continuation_30m:n horizon_actual_h:n h24_in_closure:b",
       LONG + """, w AS (
         SELECT event_id, any_value(t0) AS t0, any_value(p0_end) AS p0_end, max(CASE WHEN checkpoint = '15m' THEN r END) AS r15,
                max(CASE WHEN checkpoint = '30m' THEN r END) AS r30, max(CASE WHEN checkpoint = '24h' THEN r END) AS r24,
                max(CASE WHEN checkpoint = '24h' AND valid THEN t_end END) AS t24 FROM long GROUP BY event_id)
       SELECT event_id, sign(r24) AS direction, abs(r24) AS magnitude,
              CASE WHEN abs(r15) >= 0.0025 THEN sign(r15) * sign(r24 - r15) END AS continuation_15m,
              CASE WHEN abs(r30) >= 0.0025 THEN sign(r30) * sign(r24 - r30) END AS continuation_30m,
              CASE WHEN r24 IS NOT NULL THEN epoch_us(t24 - p0_end) / 3600e6 END AS horizon_actual_h,
              NOT EXISTS (SELECT 1 FROM {sessions} s WHERE s.open_ts <= w.t0 + INTERVAL 24 HOUR AND w.t0 + INTERVAL 24 HOUR < s.close_ts) AS h24_in_closure
       FROM w""")
def labels(x):
    from tidemark.sources.calendar import attach
    wide = targets_of(x).withColumn("_at", fn.plus_seconds(F.col("t0"), DAY))
    return attach(wide, calendar_of(x), "_at", "h_").withColumn("h24_in_closure", ~F.col("h_is_open"))


@query("corporate_action_void", "event_id:l checkpoint:s voided:b r:n",
       LONG + "SELECT event_id, checkpoint, voided, r FROM long WHERE ca_ex_date IS NOT NULL")
def corporate_action_void(x):
    flagged = release_events(x).filter(F.col("ca_ex_date").isNotNull())
    wide = tg.compute_targets(flagged, x.bars, None, calendar_of(x), tg.HOURLY)
    cells = F.array(*[F.struct(F.lit(c).alias("checkpoint"), F.col(f"r_{c}").alias("r")) for c in tg.HOURLY.checkpoints])
    return wide.select("event_id", (F.coalesce(F.col("label_reason"), F.lit("")) == "corporate_action").alias("voided"),
                       F.explode(cells).alias("c")).select("event_id", "voided", "c.*")


PATHS = """
  paths AS (SELECT market, 'perp' AS source, '1m' AS ivl, t, t_end FROM {bars} WHERE t >= TIMESTAMP '2024-01-05 00:00:00' AND market <> 'view'
            UNION ALL SELECT market, 'perp', '1h', t, t_end FROM {bars} WHERE market = 'view'
            UNION ALL SELECT market, 'equity', '5m', t, t_end FROM {bars} WHERE t < TIMESTAMP '2024-01-28 00:00:00')"""


@query("choose_path", "event_id:l market:s source:s", "WITH" + PATHS + """,
       cov AS (SELECT market, source, ivl, min(t) AS f, max(t_end) AS l FROM paths GROUP BY ALL)
       SELECT r.event_id, r.market, (
         SELECT source FROM cov c WHERE c.market = r.market AND c.ivl IN ('1m', '5m') AND c.f <= r.t0 - INTERVAL 1 HOUR
            AND c.l >= r.t0 + INTERVAL 23 HOUR ORDER BY CASE source WHEN 'perp' THEN 0 ELSE 1 END LIMIT 1) AS source
       FROM {releases} r""")
def choose_path(x):
    paths = x.sql("WITH" + PATHS + " SELECT market, source, ivl AS interval, t, t_end FROM paths")
    return tg.choose_path(x.releases.select("event_id", "market", "t0"), tg.path_coverage(paths))
