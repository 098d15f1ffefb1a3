"""Projections, filters and normalisation."""

from pyspark.sql import functions as F

from tidemark.catalog.common import calendar_of
from tidemark.catalog.registry import query
from tidemark.functions import scalars as fn
from tidemark.operators import matchers as mt
from tidemark.plans import evaluate as ev
from tidemark.plans import features as ft

WIDE = """SELECT event_id, r_24h AS f_r, rvol_20d AS f_rvol, eps_surprise AS f_eps, CAST(underlying AS VARCHAR(20)) AS f_text FROM {events_long}"""


@query("f_prefix_select", "f_r:n f_rvol:n f_eps:n f_text:s", "SELECT f_r, f_rvol, f_eps, f_text FROM (" + WIDE + ")")
def f_prefix_select(x):
    return ft.feature_columns(x.sql(WIDE))


@query("missing_companions", "event_id:l f_r:n f_r__missing:n f_rvol:n f_rvol__missing:n f_eps:n f_eps__missing:n", "SELECT event_id, f_r, 0 AS f_r__missing, f_rvol, "
       "CASE WHEN f_rvol IS NULL THEN 1 ELSE 0 END AS f_rvol__missing, f_eps, CASE WHEN f_eps IS NULL THEN 1 ELSE 0 END AS f_eps__missing FROM (" + WIDE + ")")
def missing_companions(x):
    return ft.missing_companions(x.sql(WIDE).drop("f_text"))


@query("cut_by_end", "market:s t_end:t close:n", "SELECT market, t_end, close FROM {bars} WHERE t_end <= TIMESTAMP '2024-01-10 12:00:00'")
def cut_by_end(x):
    return x.bars.filter(F.col("t_end") <= F.lit("2024-01-10 12:00:00").cast("timestamp"))


@query("between_ends", "market:s t_end:t close:n", """
    SELECT market, t_end, close FROM {bars} WHERE t_end > TIMESTAMP '2024-01-10 12:00:00' AND t_end <= TIMESTAMP '2024-01-12 00:00:00'""")
def between_ends(x):
    lo, hi = (F.lit(s).cast("timestamp") for s in ("2024-01-10 12:00:00", "2024-01-12 00:00:00"))
    return x.bars.filter((F.col("t_end") > lo) & (F.col("t_end") <= hi))


@query("cut_daily_sessions", "symbol:s d:d eff_end:t", """
    WITH b AS (SELECT symbol, d, ((d + INTERVAL 24 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS t_end FROM {daily})
    SELECT symbol, b.d, CASE WHEN s.close_ts < t_end THEN s.close_ts ELSE t_end END AS eff_end FROM b LEFT JOIN {sessions} s ON s.d = b.d""")
def cut_daily_sessions(x):
    return ft.daily_with_session_end(x.daily, x.sessions).select("symbol", "d", F.col("end_ts").alias("eff_end"))


@query("closed_bars", "market:s t:t", "SELECT market, t FROM {bars} WHERE t_end <= (SELECT max(ts) FROM {events})")
def closed_bars(x):
    now = x.events.agg(F.max("ts").alias("now"))  # one row
    return x.bars.join(F.broadcast(now), F.col("t_end") <= F.col("now")).select("market", "t")


@query("earnings_filings", "cik:l accession:s form:s", """
    SELECT cik, accession, form FROM {filings} WHERE (form = '8-K' AND regexp_matches(items, '(^|,)\\s*2\\.02\\s*(,|$)')) OR form = '6-K'""")
def earnings_filings(x):
    return mt.earnings_filings(x.filings)


UNI = "SELECT market, underlying, CASE WHEN min_size % 3 = 0 THEN 'event' WHEN min_size % 3 = 1 THEN 'index' ELSE 'other' END AS kind, CASE WHEN cik % 4 <> 0 THEN cik END AS cik, min_size % 5 = 0 AS verify, min_size % 3 = 0 AND n_parts % 2 = 0 AS in_universe FROM {universe}"


@query("event_universe", "market:s underlying:s kind:s", "SELECT market, underlying, kind FROM (" + UNI + ") WHERE in_universe")
def event_universe(x):
    return x.sql(UNI).filter("in_universe")


@query("verification_report", "market:s kind:s cik:l", "SELECT market, kind, cik FROM (" + UNI + ") WHERE verify OR (kind = 'event' AND cik IS NULL)")
def verification_report(x):
    return x.sql(UNI).filter(F.col("verify") | ((F.col("kind") == "event") & F.col("cik").isNull()))


@query("prepare_eval_rows", "event_id:l y:n direction:n trainable:b", """
    SELECT event_id, r_24h AS y, coalesce(CASE WHEN event_id % 4 = 0 THEN -1 END, sign(r_24h)) AS direction,
           t0_confidence >= 0.6 AND event_id % 8 <> 0 AS trainable FROM {events_long}""")
def prepare_eval_rows(x):
    rows = x.events_long.withColumns({"given": F.when(F.col("event_id") % 4 == 0, -1.0), "target_missing": F.col("event_id") % 8 == 0})
    return ev.prepare_rows(rows, target="r_24h", label="given", min_confidence=0.6)


@query("scorable_rows", "event_id:l model:s", """
    SELECT event_id, model FROM {predictions} WHERE decision_time = 'post_30m' AND coalesce(t0_confidence, 0) >= 0.6 AND r_true IS NOT NULL
     AND concat(year(t0), 'Q', quarter(t0)) <> '2001Q2'""")
def scorable_rows(x):
    return x.predictions.filter((F.col("decision_time") == "post_30m") & (F.coalesce("t0_confidence", F.lit(0.0)) >= 0.6)
                                & F.col("r_true").isNotNull() & (fn.season(F.col("t0")) != "2001Q2"))


SUBSETS = """SELECT p.*, unnest(list_filter(['all', CASE WHEN has_perp THEN 'has_perp_at_t0' END,
    CASE WHEN has_perp AND t0_confidence >= 0.6 AND t0_source IN ('sec_8k', 'manual', 'detected') THEN 'headline' END,
    't0_source=' || t0_source, 'kind=' || kind, 'timing=' || timing], lambda v: v IS NOT NULL)) AS subset FROM {predictions} p WHERE r_true IS NOT NULL"""


@query("subset_masks", "model:s subset:s n:l mean_p:n", "SELECT model, subset, count(*) AS n, avg(p_up) AS mean_p FROM (" + SUBSETS + ") GROUP BY 1, 2")
def subset_masks(x):
    return ev.explode_subsets(x.predictions).groupBy("model", "subset").agg(F.count("*").alias("n"), F.avg("p_up").alias("mean_p"))


RAWP = """SELECT event_id, model, CASE WHEN model = 'zero' AND event_id % 3 = 0 THEN NULL WHEN event_id % 50 = 0 THEN p_up * 2 - 0.5e0 ELSE p_up END AS p_up,
                 r_hat, CASE WHEN event_id % 4 = 0 THEN -magnitude_hat ELSE magnitude_hat END AS magnitude_hat FROM {predictions}"""


@query("validate_predictions", "event_id:l model:s p_up:n magnitude_hat:n accepted:b", "WITH p AS (" + RAWP + """),
    s AS (SELECT model, avg(CASE WHEN p_up IS NULL THEN 1 ELSE 0 END) AS bad FROM p GROUP BY 1)
    SELECT event_id, p.model, CASE WHEN p_up IS NOT NULL THEN greatest(0, least(1, p_up)) END AS p_up, abs(coalesce(magnitude_hat, r_hat)) AS magnitude_hat, bad <= 0.1 AS accepted
    FROM p JOIN s ON s.model = p.model""")
def validate_predictions(x):
    return ev.validate_predictions(x.sql(RAWP))


@query("non_pit_scope", "decision_time:s feature_group:s keys:l rows:l", """
    SELECT decision_time, g.feature_group, max(g.n) AS keys, count(*) AS rows FROM {predictions}
    JOIN (VALUES ('surprise', 8, 'post_30m'), ('perp_state', 1, 'post_30m'), ('perp_state', 1, 'pre_10m')) g(feature_group, n, dt) ON g.dt = decision_time GROUP BY 1, 2""")
def non_pit_scope(x):
    scope = ft.non_point_in_time(x.spark)
    phase = F.when(F.col("decision_time").startswith("pre"), "pre").otherwise("post")
    used = x.predictions.groupBy("decision_time").agg(F.count("*").alias("rows")).withColumn("phase", phase)
    return used.join(F.broadcast(scope), "phase").select("decision_time", "feature_group", "keys", "rows")


@query("group_columns", "feature_group:s columns:l filled:l", "SELECT * FROM (SELECT CASE c WHEN 'f_rvol_20d' THEN 'pre_price' WHEN 'f_eps_surprise' THEN 'surprise' ELSE 'reaction' END AS feature_group, "
       "count(DISTINCT c) AS columns, count(v) AS filled FROM (SELECT unnest(['f_rvol_20d', 'f_eps_surprise', 'f_r_30m']) AS c, unnest([rvol_20d, eps_surprise, r_30m]) AS v FROM {events_long}) GROUP BY 1)")
def group_columns(x):
    wide = x.events_long.select(F.col("rvol_20d").alias("f_rvol_20d"), F.col("eps_surprise").alias("f_eps_surprise"), F.col("r_30m").alias("f_r_30m"))
    return ft.columns_by_group(wide)
