"""Feature groups and the dataset."""

from pyspark.sql import functions as F

from tidemark.catalog.common import calendar_of
from tidemark.catalog.registry import query
from tidemark.catalog.scalars import ny
from tidemark.catalog.targets import LONG, targets_of
from tidemark.functions import scalars as fn
from tidemark.operators.asof import DAY
from tidemark.plans import features as ft
from tidemark.plans import history as hs
from tidemark.plans import targets as tg
from tidemark.session import cut

# decision instants with hourly bars standing for minute bars
DECISIONS = {"pre_10m": -2 * 3600, "post_1m": 900, "post_30m": 3 * 3600}
MINUTES = ", ".join(f"('{k}', {s // 60})" for k, s in DECISIONS.items())
ROWS = """
  rows AS (SELECT r.*, d.decision_time, r.t0 + d.m * INTERVAL '1' MINUTE AS as_of,
                  least(r.t0 + d.m * INTERVAL '1' MINUTE, r.t0 - CASE WHEN t0_source = 'sec_8k' THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END) AS anchor,
                  r.t0 - CASE WHEN t0_source = 'sec_8k' THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END AS back
           FROM {releases} r, (VALUES ('pre_10m', -120), ('post_1m', 15), ('post_30m', 180)) d(decision_time, m))"""
# one row per market and UTC day
DAYBARS = """SELECT market, CAST(t AS DATE) AS d, CAST(t AS DATE) + INTERVAL 24 HOUR AS end_ts, arg_min(open, t) AS open, max(high) AS high, min(low) AS low,
                    arg_max(close, t) AS close, sum(volume) AS volume FROM {bars} GROUP BY 1, 2"""


def continuation():
    r, k = F.col("r_24h"), F.col("r_30m")
    return F.when(F.abs(k) >= fn.CONTINUATION_DEAD_BAND, fn.sign(k) * fn.sign(r - k))


def long_history(x):
    """History half an hour after each event of the long table."""
    ev = x.events_long.withColumn("continuation_30m", continuation())
    return hs.history_features(ev, horizon=DAY, as_of=fn.plus_seconds(F.col("t0"), 1800))


def long_rows(x):
    return ft.decisions(x.events_long, DECISIONS)


def rows_of(x):
    return ft.decisions(x.releases, DECISIONS, dict(ft.HOURLY.buffers))


def day_bars(bars, on=("market",)):
    d = F.to_date("t")
    out = bars.groupBy(*on, d.alias("d")).agg(F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                                              F.max_by("close", "t").alias("close"), F.sum("volume").alias("volume"))
    return out.withColumn("end_ts", fn.plus_seconds(F.col("d").cast("timestamp"), DAY))


def calendar_sql(source: str, minutes: str) -> str:
    """Calendar facts of `source` at decisions given as VALUES (name, minutes after t0)."""
    return f"""
    WITH e AS (SELECT event_id, underlying, t0, {ny('t0')} AS n, CAST({ny('t0')} AS DATE) AS d FROM {source}),
      s AS (SELECT e.*, EXISTS (SELECT 1 FROM {{sessions}} s WHERE s.open_ts <= t0 AND t0 < s.close_ts) AS op, EXISTS (SELECT 1 FROM {{sessions}} s WHERE s.d = e.d) AS sd FROM e),
      q AS (SELECT e.*, v.decision_time, e.t0 + v.m * INTERVAL '1' MINUTE AS as_of FROM e, (VALUES {minutes}) v(decision_time, m)),
      h AS (SELECT q.event_id, q.decision_time, max(b.t0) AS last FROM q LEFT JOIN e b ON b.underlying = q.underlying AND b.t0 + INTERVAL 24 HOUR <= q.as_of GROUP BY 1, 2),
      nd AS (SELECT d, count(*) AS same FROM e GROUP BY 1),
      u AS (SELECT d, (SELECT max(s.d) FROM {{sessions}} s WHERE s.d < n.d) AS prv, (SELECT min(s.d) FROM {{sessions}} s WHERE s.d > n.d) AS nxt,
                      EXISTS (SELECT 1 FROM {{sessions}} s WHERE s.d = n.d) AS is_sess FROM (SELECT DISTINCT d FROM e) n),
      g AS (SELECT d, CASE WHEN (isodow(d) <= 5 AND NOT is_sess) OR EXISTS (SELECT 1 FROM {{days}} x WHERE x.d > prv AND x.d < nxt AND x.d <> u.d AND isodow(x.d) <= 5) THEN 1 ELSE 0 END AS adj FROM u)
    SELECT event_id, h.decision_time, CAST(tm = 'AMC' AS INT) AS amc, CAST(tm = 'BMO' AS INT) AS bmo, CAST(tm = 'RTH' AS INT) AS rth, isodow(n) - 1 AS weekday, CAST(isodow(n) = 5 AS INT) AS friday,
       hour(n) + minute(n) / 60.0 + second(n) / 3600.0 AS hour_ny, epoch_us((SELECT min(open_ts) FROM {{sessions}} WHERE open_ts > t0) - t0) / 3600e6 AS hours_to_next_open,
       epoch_us((SELECT min(close_ts) FROM {{sessions}} WHERE close_ts > t0) - t0) / 3600e6 AS hours_to_next_close,
       CAST(NOT EXISTS (SELECT 1 FROM {{sessions}} WHERE open_ts <= t0 + INTERVAL 24 HOUR AND t0 + INTERVAL 24 HOUR < close_ts) AS INT) AS h24_closed, adj AS holiday_adjacent,
       epoch_us(t0 - last) / 86400e6 AS days_since_last_event, same AS n_events_same_day
    FROM (SELECT *, CASE WHEN op THEN 'RTH' WHEN NOT sd THEN 'CLOSED' WHEN CAST(n AS TIME) < TIME '09:30:00' THEN 'BMO' ELSE 'AMC' END AS tm FROM s) JOIN h USING (event_id) JOIN g USING (d) JOIN nd USING (d)"""


@query("feat_calendar", "event_id:l amc:n bmo:n rth:n weekday:n friday:n hour_ny:n hours_to_next_open:n hours_to_next_close:n h24_closed:n holiday_adjacent:n "
       "days_since_last_event:n n_events_same_day:n", calendar_sql("{events_long}", "('post_30m', 30)"))
def feat_calendar(x):
    rows = ft.decisions(x.events_long, {"post_30m": 1800})
    return ft.calendar_group(rows, calendar_of(x), x.events_long)


def point(name: str, ts: str, table: str = "{bars}", on: str = "x.market = b.market AND ") -> str:
    return f"ASOF LEFT JOIN {table} {name} ON {on.replace('b.', name + '.')}x.{ts} >= {name}.t_end"


def drift(a: str, b: str) -> str:
    return f"CASE WHEN {b}.t_end < {a}.t_end AND {a}.close > 0 AND {b}.close > 0 THEN ln({a}.close / {b}.close) END"


def mean_vol(lo: str, hi: str, least: int) -> str:
    return f"(SELECT CASE WHEN count(*) >= {least} THEN avg(volume) END FROM {{bars}} b WHERE b.market = x.market AND b.t_end > x.{lo} AND b.t_end <= x.{hi})"


DLY = f"""
  db AS ({DAYBARS}),
  dr AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS r1, row_number() OVER w AS rn FROM db WINDOW w AS (PARTITION BY market ORDER BY d)),
  dw AS (SELECT *, end_ts AS t_end_d, CASE WHEN close > 0 AND lag(close, 5) OVER w > 0 THEN ln(close / lag(close, 5) OVER w) END AS r5, CASE WHEN close > 0 AND lag(close, 20) OVER w > 0 THEN ln(close / lag(close, 20) OVER w) END AS r20,
                CASE WHEN count(r1) OVER w20 = 20 THEN stddev_samp(r1) OVER w20 END AS rv,
                CASE WHEN rn >= 20 THEN avg(volume) OVER (PARTITION BY market ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(volume) OVER (PARTITION BY market ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS dv
         FROM dr WINDOW w AS (PARTITION BY market ORDER BY d), w20 AS (PARTITION BY market ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
PRE_PRICE = "WITH" + ROWS + "," + DLY + f""",
  x AS (SELECT event_id, decision_time, market, anchor, anchor - INTERVAL 6 HOUR AS a6, anchor - INTERVAL 3 HOUR AS a3, anchor - INTERVAL 1 DAY AS a24,
               (SELECT max(close_ts) FROM {{sessions}} s WHERE s.close_ts < anchor) AS pc, (SELECT max(close_ts) FROM {{sessions}} s WHERE s.close_ts < anchor) - INTERVAL 1 DAY AS pcd FROM rows)
  SELECT x.event_id, x.decision_time, dw.r1 AS ret_1d, dw.r5 AS ret_5d, dw.r20 AS ret_20d, CAST(NULL AS DOUBLE) AS ret_60d, dw.rv AS rvol_20d, CAST(NULL AS DOUBLE) AS dist_52w_high, CAST(NULL AS DOUBLE) AS dist_52w_low, dw.dv AS dvol_5d_ratio,
         {drift('p0', 'p6')} AS drift_60m, {drift('p0', 'p3')} AS drift_30m, {drift('p0', 'pp')} AS gap_since_close,
         {mean_vol('pc', 'anchor', 1)} / nullif({mean_vol('pcd', 'pc', 12)}, 0) AS ext_vol_ratio, {mean_vol('a3', 'anchor', 1)} / nullif({mean_vol('a24', 'a3', 12)}, 0) AS vol_30m_ratio
  FROM x {point('p0', 'anchor')} {point('p6', 'a6')} {point('p3', 'a3')} {point('pp', 'pc')} ASOF LEFT JOIN dw ON x.market = dw.market AND x.anchor >= dw.t_end_d"""
PRE_KEYS = " ".join(f"{k}:n" for k in ft.REGISTRY["pre_price"].keys)


@query("feat_pre_price", "event_id:l decision_time:s " + PRE_KEYS, PRE_PRICE)
def feat_pre_price(x):
    return ft.pre_price_group(rows_of(x), x.bars, ft.daily_windows(day_bars(x.bars), on="market", order="d"), calendar_of(x), ft.HOURLY)


def history_sql(source: str) -> str:
    """History of `source` (event_id, underlying, t0, r_24h, c, eps_surprise) at each decision."""
    return f"""
    WITH e AS ({source}),
      q AS (SELECT e.event_id, e.underlying, v.decision_time, e.t0 + v.m * INTERVAL '1' MINUTE AS as_of FROM e, (VALUES {MINUTES}) v(decision_time, m)),
      b AS (SELECT q.event_id, q.decision_time, b.r_24h AS r, b.c, b.eps_surprise AS s, b.t0, b.event_id AS past FROM q JOIN e b ON b.underlying = q.underlying AND b.t0 + INTERVAL 24 HOUR <= q.as_of),
      p AS (SELECT *, CASE WHEN r IS NOT NULL THEN row_number() OVER (PARTITION BY event_id, decision_time, r IS NULL ORDER BY t0 DESC, past DESC) END AS k FROM b)
    SELECT q.event_id, q.decision_time, coalesce(n, 0) AS hist_n, p.* EXCLUDE (event_id, decision_time, n) FROM q LEFT JOIN (SELECT event_id, decision_time, count(r) AS n, avg(r) AS hist_r24_mean, CASE WHEN count(r) >= 2 THEN stddev_samp(r) END AS hist_r24_std,
        CASE WHEN count(r) >= 3 AND var_pop(r) > 1e-12 THEN skewness(r) END AS hist_r24_skew, avg(abs(r)) AS hist_abs_r24_mean, avg(CAST(r > 0 AS INT)) AS hist_up_rate, avg(CAST(c > 0 AS INT)) AS hist_cont_rate,
        max(r) FILTER (WHERE k = 1) AS hist_last1_r24, max(r) FILTER (WHERE k = 2) AS hist_last2_r24, max(r) FILTER (WHERE k = 3) AS hist_last3_r24, max(r) FILTER (WHERE k = 4) AS hist_last4_r24,
        CASE WHEN regr_count(r, s) >= 4 AND regr_sxx(r, s) > 0 THEN regr_slope(r, s) END AS hist_surprise_beta, avg(s) AS hist_eps_surprise_mean FROM p GROUP BY 1, 2) p ON p.event_id = q.event_id AND p.decision_time = q.decision_time"""


HIST = history_sql("SELECT *, CASE WHEN abs(r_30m) >= 0.0025 THEN sign(r_30m) * sign(r_24h - r_30m) END AS c FROM {events_long}")
HIST_KEYS = " ".join(f"{k}:n" for k in ft.REGISTRY["history"].keys)


@query("feat_history", "event_id:l decision_time:s " + HIST_KEYS, HIST)
def feat_history(x):
    ev = x.events_long.withColumn("continuation_30m", continuation())
    return ft.history_group(ev, long_rows(x))


MARKET = "WITH" + ROWS + "," + DLY + f""",
  bd AS (SELECT 'b' AS market, CAST(t AS DATE) AS d, CAST(t AS DATE) + INTERVAL 24 HOUR AS end_ts, arg_max(close, t) AS close FROM {{benchmark}} GROUP BY 2),
  br AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS r1 FROM bd WINDOW w AS (ORDER BY d)),
  bw AS (SELECT *, CASE WHEN close > 0 AND lag(close, 5) OVER w > 0 THEN ln(close / lag(close, 5) OVER w) END AS r5, CASE WHEN close > 0 AND lag(close, 20) OVER w > 0 THEN ln(close / lag(close, 20) OVER w) END AS r20,
         CASE WHEN count(r1) OVER w20 = 20 THEN stddev_samp(r1) OVER w20 END AS rv FROM br WINDOW w AS (ORDER BY d), w20 AS (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  vw AS (SELECT * FROM dw WHERE market = 'purchase'),
  x AS (SELECT event_id, decision_time, anchor, anchor - INTERVAL 6 HOUR AS a6, CASE k % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'error' ELSE 'none' END AS sector FROM rows)
  SELECT x.event_id, x.decision_time, bw.r1 AS mkt_ret_1d, bw.r5 AS mkt_ret_5d, bw.r20 AS mkt_ret_20d, bw.rv AS mkt_rvol_20d, CASE WHEN vw.close > 0 THEN vw.close END AS vix_level, CASE WHEN vw.close > 0 THEN vw.r5 END AS vix_chg_5d,
         s.r1 AS sector_ret_1d, s.r5 AS sector_ret_5d, {drift('m0', 'm6')} AS mkt_drift_60m
  FROM x ASOF LEFT JOIN bw ON x.anchor >= bw.end_ts ASOF LEFT JOIN vw ON x.anchor >= vw.end_ts ASOF LEFT JOIN dw s ON x.sector = s.market AND x.anchor >= s.end_ts
  {point('m0', 'anchor', '{benchmark}', '')} {point('m6', 'a6', '{benchmark}', '')}"""


@query("feat_market", "event_id:l decision_time:s " + " ".join(f"{k}:n" for k in ft.REGISTRY["market"].keys), MARKET)
def feat_market(x):
    rows = rows_of(x).withColumn("sector", fn.lookup(F.col("k") % 3, {0: "click", 1: "error"}, "none"))
    w = ft.daily_windows(day_bars(x.bars), on="market", order="d")
    one = lambda df: df.withColumn("one", F.lit(1))
    bench = ft.daily_windows(one(day_bars(x.benchmark, on=())), on="one", order="d")
    return ft.market_group(rows, bench, one(w.filter("market = 'purchase'")), w.withColumnRenamed("market", "sector"), x.benchmark, ft.HOURLY)


LISTED = "SELECT market, min(t) + INTERVAL 3 DAY AS listing_start, CAST(length(market) AS INT) AS max_leverage FROM {bars} GROUP BY 1"
PERP = "WITH" + ROWS + f""",
  one AS (SELECT market, t, arg_max(open_interest, seq) AS oi, arg_max(mark_px, seq) AS mark, arg_max(premium, seq) AS premium, arg_max(day_ntl_vlm, seq) AS vlm FROM {{ctx}} GROUP BY 1, 2),
  dn AS (SELECT market, d, end_ts, close * volume AS v FROM ({DAYBARS})),
  dm AS (SELECT market, end_ts, CASE WHEN count(*) OVER w >= 5 THEN median(v) OVER w END AS med FROM dn WINDOW w AS (PARTITION BY market ORDER BY end_ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
  li AS ({LISTED}),
  x AS (SELECT *, anchor - INTERVAL 1 MINUTE AS am, anchor - INTERVAL 1 DAY AS ad FROM rows)
  SELECT x.event_id, x.decision_time, f.funding_rate, (SELECT avg(funding_rate) FROM {{funding}} g WHERE g.market = x.market AND g.t <= x.am AND g.t > x.ad) AS funding_mean_24h,
         coalesce(a.premium, f.premium) AS premium, a.oi * a.mark AS oi_notional, CASE WHEN a.oi > 0 AND b.oi > 0 AND x.anchor - b.t <= INTERVAL 2 DAY THEN ln(a.oi / b.oi) END AS oi_chg_24h,
         a.vlm AS day_ntl_vlm, dm.med AS perp_vol_30d, li.max_leverage, CASE WHEN x.has_perp AND li.listing_start <= x.anchor THEN epoch_us(x.t0 - li.listing_start) / 86400e6 END AS listing_age_d
  FROM x ASOF LEFT JOIN {{funding}} f ON x.market = f.market AND x.am >= f.t ASOF LEFT JOIN one a ON x.market = a.market AND x.anchor >= a.t
  ASOF LEFT JOIN one b ON x.market = b.market AND x.ad >= b.t ASOF LEFT JOIN dm ON x.market = dm.market AND x.anchor >= dm.end_ts LEFT JOIN li ON li.market = x.market"""


@query("feat_perp_state", "event_id:l decision_time:s funding_rate:n funding_mean_24h:n premium:n oi_notional:n oi_chg_24h:n day_ntl_vlm:n perp_vol_30d:n max_leverage:n listing_age_d:n", PERP)
def feat_perp_state(x):
    listed = x.bars.groupBy("market").agg(fn.plus_seconds(F.min("t"), 3 * DAY).alias("listing_start"), F.length("market").alias("max_leverage"))
    notional = day_bars(x.bars).select("market", "end_ts", (F.col("close") * F.col("volume")).alias("notional"))
    return ft.perp_state_group(rows_of(x), x.funding, x.ctx, notional, listed, ft.HOURLY)


SURPRISE = "WITH" + ROWS + """,
    e AS (SELECT *, CASE WHEN eps_estimate <> 0 THEN (eps_actual - eps_estimate) / abs(eps_estimate) * 100 END AS es, CASE WHEN rev_estimate <> 0 THEN (rev_actual - rev_estimate) / abs(rev_estimate) * 100 END AS rs FROM {releases}),
      p AS (SELECT q.event_id, q.decision_time, count(b.es) AS ne, avg(b.es) AS me, stddev_samp(b.es) AS se, count(b.rs) AS nr, avg(b.rs) AS mr, stddev_samp(b.rs) AS sr
            FROM rows q JOIN e b ON b.underlying = q.underlying AND b.t0 + INTERVAL 24 HOUR <= q.as_of GROUP BY 1, 2)
    SELECT event_id, decision_time, es AS eps_surprise, rs AS rev_surprise, CAST(es > 0 AS INT) AS eps_beat, abs(es) AS eps_surprise_abs, sign(es) * sign(rs) AS sign_agree,
           CASE WHEN ne >= 4 AND se * se > 1e-9 THEN (es - me) / se END AS eps_surprise_z, CASE WHEN nr >= 4 AND sr * sr > 1e-9 THEN (rs - mr) / sr END AS rev_surprise_z, e.n_estimates
    FROM (SELECT event_id, decision_time FROM rows) JOIN e USING (event_id) LEFT JOIN p USING (event_id, decision_time)"""


@query("feat_surprise", "event_id:l decision_time:s " + " ".join(f"{k}:n" for k in ft.REGISTRY["surprise"].keys), SURPRISE)
def feat_surprise(x):
    return ft.surprise_group(x.releases, rows_of(x))


def reacted(p: str, ts: str) -> str:
    return f"CASE WHEN p0.close > 0 AND {p}.t_end > greatest(p0.t_end, x.t0) AND x.{ts} - {p}.t_end <= INTERVAL 2 HOUR AND {p}.close > 0 THEN ln({p}.close / p0.close) END"


REACTION = "WITH" + ROWS + """,
  one AS (SELECT market, t, arg_max(premium, seq) AS premium FROM {ctx} GROUP BY 1, 2),
  x AS (SELECT *, """ + ", ".join(f"CASE WHEN t0 + INTERVAL {m} MINUTE <= as_of THEN t0 + INTERVAL {m} MINUTE END AS w{k}" for k, m in (("1", 15), ("5", 60), ("15", 120), ("30", 180), ("60", 360))) + """,
               as_of - INTERVAL 1 MINUTE AS fm FROM rows WHERE decision_time <> 'pre_10m'),
  y AS (SELECT x.event_id, x.decision_time, x.market, x.t0, x.as_of, p0.close AS p0, p0.t_end AS p0_end, greatest(p0.t_end, x.t0) AS frm, """ + ", ".join(
      f"{reacted('w' + k, 'w' + k)} AS r_{k}m" for k in ("1", "5", "15", "30", "60")) + f""", {reacted('pn', 'as_of')} AS r_now, br.close AS b0, br.t_end AS b0_end, bn.close AS b1, bn.t_end AS b1_end,
               c.t AS ct, c.premium AS cp, f.t AS ft, f.premium AS fp, x.back
        FROM x {point('p0', 'back')} {point('pn', 'as_of')} """ + " ".join(point(f"w{k}", f"w{k}") for k in ("1", "5", "15", "30", "60")) + f"""
        {point('br', 'back', '{benchmark}', '')} {point('bn', 'as_of', '{benchmark}', '')} ASOF LEFT JOIN one c ON x.market = c.market AND x.as_of >= c.t ASOF LEFT JOIN {{funding}} f ON x.market = f.market AND x.fm >= f.t),
  post AS (SELECT y.event_id, y.decision_time, max(high) AS hi, min(low) AS lo, avg(volume) AS vp FROM y JOIN {{bars}} b ON b.market = y.market AND b.t_end > y.frm AND b.t_end <= y.as_of WHERE y.p0 > 0 GROUP BY 1, 2),
  pre AS (SELECT y.event_id, y.decision_time, count(*) AS n, avg(volume) AS m, var_samp(volume) AS v FROM y JOIN {{bars}} b ON b.market = y.market AND b.t_end <= y.back AND b.t_end > y.back - INTERVAL 1 DAY WHERE y.p0 > 0 GROUP BY 1, 2)
  SELECT y.event_id, y.decision_time, r_1m, r_5m, r_15m, r_30m, r_60m, r_now, abs(r_now) AS abs_r_now, CASE WHEN hi > 0 THEN ln(hi / p0) END AS path_max, CASE WHEN lo > 0 THEN ln(lo / p0) END AS path_min,
         CASE WHEN hi > 0 AND lo > 0 THEN ln(hi / p0) - ln(lo / p0) END AS path_range, CASE WHEN n >= 5 AND v > 1e-9 THEN (vp - m) / sqrt(v) END AS vol_z, CASE WHEN n >= 5 AND m > 0 THEN vp / m END AS vol_ratio,
         CASE WHEN b1_end > b0_end AND y.as_of - b1_end <= INTERVAL 2 HOUR AND b1 > 0 AND b0 > 0 THEN r_now - ln(b1 / b0) END AS ar_now,
         coalesce(CASE WHEN ct > y.t0 THEN cp END, CASE WHEN ft > y.t0 - INTERVAL 1 MINUTE THEN fp END) AS premium_post
  FROM y LEFT JOIN post USING (event_id, decision_time) LEFT JOIN pre USING (event_id, decision_time)"""


@query("feat_reaction", "event_id:l decision_time:s " + " ".join(f"{k}:n" for k in ft.REGISTRY["reaction"].keys), REACTION)
def feat_reaction(x):
    return reaction_of(x)


def reaction_of(x):
    rows = rows_of(x).filter(~F.col("decision_time").startswith("pre"))
    return ft.reaction_group(rows, x.bars, x.benchmark, x.ctx, x.funding, ft.HOURLY)


PARTS = {"calendar": "k", "pre_price": "a", "history": "h", "market": "m", "perp_state": "b", "surprise": "s", "reaction": "c"}
DATASET_KEYS = [k for g in PARTS for k in ft.REGISTRY[g].keys]
CHECKPOINTS = list(tg.HOURLY.checkpoints)
TARGETS = LONG + " SELECT event_id, " + ", ".join(f"max(r) FILTER (WHERE checkpoint = '{c}') AS \"r_{c}\", max(ar) FILTER (WHERE checkpoint = '{c}') AS \"ar_{c}\"" for c in CHECKPOINTS) + " FROM long GROUP BY 1"


def sub(text: str) -> str:
    return "(" + text + ")"


def post_only(k: str) -> str:
    group = next(g for g in ft.REGISTRY.values() if k in g.keys)
    src = PARTS[group.name]
    return f"{src}.{k}" if "pre" in group.phases else f"CASE WHEN r.decision_time <> 'pre_10m' THEN {src}.{k} END"


# what the past of a release is made of: its surprise and its measured reaction
RELEASE_PAST = ("SELECT r.event_id, r.underlying, r.t0, t.r_24h, CASE WHEN abs(t.r_30m) >= 0.0025 THEN sign(t.r_30m) * sign(t.r_24h - t.r_30m) END AS c, "
                "CASE WHEN eps_estimate <> 0 THEN (eps_actual - eps_estimate) / abs(eps_estimate) * 100 END AS eps_surprise FROM {releases} r LEFT JOIN (" + TARGETS + ") t USING (event_id)")
SOURCES = {"k": calendar_sql("{releases}", MINUTES), "a": PRE_PRICE, "h": history_sql(RELEASE_PAST), "m": MARKET, "b": PERP, "s": SURPRISE, "c": REACTION}


@query("build_dataset", "event_id:l decision_time:s as_of:t t0_source:s target_missing:b " + " ".join(f"r_{c}:n ar_{c}:n" for c in CHECKPOINTS) + " "
       + " ".join(f"f_{k}:n f_{k}__missing:n" for k in DATASET_KEYS),
       "WITH" + ROWS + "".join(f", {n} AS " + sub(text) for n, text in SOURCES.items()) + ", t AS " + sub(TARGETS)
       + " SELECT r.event_id, r.decision_time, r.as_of, r.t0_source, t.r_24h IS NULL AS target_missing, t.* EXCLUDE (event_id), "
       + ", ".join(f"{post_only(k)} AS f_{k}, CASE WHEN {post_only(k)} IS NULL THEN 1 ELSE 0 END AS f_{k}__missing" for k in DATASET_KEYS)
       + " FROM rows r " + " ".join(f"LEFT JOIN {n} ON {n}.event_id = r.event_id AND {n}.decision_time = r.decision_time" for n in SOURCES)
       + " LEFT JOIN t ON t.event_id = r.event_id")
def build_dataset(x):
    wide = cut(targets_of(x))  # read by the history and by the targets
    past = wide.select("event_id", "r_24h", "continuation_30m").join(x.releases, "event_id").withColumn(
        "eps_surprise", fn.surprise_pct(F.col("eps_actual"), F.col("eps_estimate")))
    rows = rows_of(x)
    groups = {"calendar": ft.calendar_group(rows, calendar_of(x), x.releases), "pre_price": feat_pre_price(x), "history": ft.history_group(past, rows),
              "market": feat_market(x), "perp_state": feat_perp_state(x), "surprise": feat_surprise(x), "reaction": reaction_of(x)}
    targets = wide.select("event_id", *[f"{k}_{c}" for c in CHECKPOINTS for k in ("r", "ar")])
    return ft.build_dataset(rows, groups, targets, ["t0_source"])


@query("leakage_check", "checked:l leaks:l", f"""
    WITH q AS (SELECT r.event_id, r.underlying, v.decision_time, r.t0 + v.m * INTERVAL '1' MINUTE AS as_of FROM {{releases}} r, (VALUES {MINUTES}) v(decision_time, m)),
      p AS (SELECT b.t0, q.as_of FROM q JOIN {{releases}} b ON b.underlying = q.underlying AND b.t0 + INTERVAL 24 HOUR <= q.as_of
            QUALIFY row_number() OVER (PARTITION BY q.event_id, q.decision_time ORDER BY b.t0 DESC, b.event_id DESC) <= 4)
    SELECT count(*) AS checked, count(*) FILTER (WHERE t0 + INTERVAL 24 HOUR > as_of) AS leaks FROM p""")
def leakage_check(x):
    # the pairs (decision, past release) that the dataset's history is made of
    past = hs.last_settled(x.releases.withColumn("r_24h", F.col("eps_actual")), depth=4, horizon=DAY, rows=rows_of(x))
    return ft.leakage_check(past, DAY)
