"""Aggregations."""

from pyspark.sql import functions as F

from tidemark.catalog.projections import SUBSETS
from tidemark.catalog.registry import query
from tidemark.catalog.scalars import ny
from tidemark.functions import scalars as fn
from tidemark.operators import ranks
from tidemark.plans import evaluate as ev
from tidemark.plans import features as ft
from tidemark.plans import trades as tr
from tidemark.plans import events as evt
from tidemark.sources import archive as ar

SCORED = """SELECT *, sign(r_true) AS direction, CASE WHEN r_true <> 0 THEN CASE WHEN p_up = 0.5 THEN 0.5 WHEN (p_up > 0.5) = (r_true > 0) THEN 1 ELSE 0 END END AS hit,
   CASE WHEN r_true <> 0 THEN (p_up - CAST(r_true > 0 AS INT)) ** 2 END AS brier,
   CASE WHEN r_true > 0 THEN -ln(least(greatest(p_up, 1e-6), 1 - 1e-6)) WHEN r_true < 0 THEN -ln(1 - least(greatest(p_up, 1e-6), 1 - 1e-6)) END AS ll,
   abs(r_true - r_hat) AS ae, abs(abs(r_true) - coalesce(magnitude_hat, abs(r_hat))) AS mag_ae, concat(year(t0), 'Q', quarter(t0)) AS season,
   strftime(t0, '%Y-%m-%d') AS day FROM {predictions}"""


@query("agg_history_stats", "underlying:l n:l mean:n std:n skew:n abs_mean:n up_rate:n cont_rate:n surprise_mean:n", """
    SELECT underlying, count(r_24h) AS n, avg(r_24h) AS mean, CASE WHEN count(*) >= 2 THEN stddev_samp(r_24h) END AS std,
           CASE WHEN count(*) >= 3 AND var_pop(r_24h) > 1e-12 THEN skewness(r_24h) END AS skew, avg(abs(r_24h)) AS abs_mean, avg(CAST(r_24h > 0 AS INT)) AS up_rate,
           avg(CAST(c > 0 AS INT)) AS cont_rate, avg(eps_surprise) AS surprise_mean
    FROM (SELECT *, CASE WHEN abs(r_30m) >= 0.0025 THEN sign(r_30m) * sign(r_24h - r_30m) END AS c FROM {events_long}) GROUP BY 1""")
def agg_history_stats(x):
    r, k = F.col("r_24h"), F.col("r_30m")
    cont = F.when(F.abs(k) >= fn.CONTINUATION_DEAD_BAND, fn.sign(k) * fn.sign(r - k))
    n = F.count(r)
    skew = F.skewness(r) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return x.events_long.withColumn("c", cont).groupBy("underlying").agg(
        n.alias("n"), F.avg(r).alias("mean"), F.when(n >= 2, F.stddev_samp(r)).alias("std"),
        F.when((n >= 3) & (F.var_pop(r) > 1e-12), skew).alias("skew"),
        F.avg(F.abs(r)).alias("abs_mean"), F.avg((r > 0).cast("int")).alias("up_rate"), F.avg((F.col("c") > 0).cast("int")).alias("cont_rate"),
        F.avg("eps_surprise").alias("surprise_mean"))


@query("agg_surprise_beta", "underlying:l beta:n", """
    SELECT underlying, CASE WHEN count(*) >= 4 AND var_samp(eps_surprise) > 0 THEN covar_samp(r_24h, eps_surprise) / var_samp(eps_surprise) END AS beta
    FROM {events_long} WHERE eps_surprise IS NOT NULL GROUP BY 1""")
def agg_surprise_beta(x):
    v = F.var_samp("eps_surprise")
    return x.events_long.filter(F.col("eps_surprise").isNotNull()).groupBy("underlying").agg(
        F.when((F.count("*") >= 4) & (v > 0), F.covar_samp("r_24h", "eps_surprise") / F.when(v > 0, v)).alias("beta"))


@query("agg_zscore", "event_id:l z:n", """
    WITH p AS (SELECT q.event_id, q.eps_surprise AS e, count(b.eps_surprise) AS n, avg(b.eps_surprise) AS m, stddev_samp(b.eps_surprise) AS s
               FROM {events_long} q LEFT JOIN {events_long} b ON b.underlying = q.underlying AND b.t0 + INTERVAL 24 HOUR <= q.t0 + INTERVAL 30 MINUTE GROUP BY 1, 2)
    SELECT event_id, CASE WHEN n >= 4 AND s > 0 THEN (e - m) / s END AS z FROM p""")
def agg_zscore(x):
    from tidemark.catalog.features import long_history
    h = long_history(x).select("event_id", "hist_eps_surprise_mean", "hist_surprise_sd")
    return x.events_long.join(h, "event_id").select(
        "event_id", ((F.col("eps_surprise") - F.col("hist_eps_surprise_mean")) / F.col("hist_surprise_sd")).alias("z"))


@query("agg_median_notional", "market:s med:n n:l", """
    SELECT market, CASE WHEN count(*) >= 5 THEN median(v) END AS med, count(*) AS n FROM (
       SELECT market, CAST(t AS DATE) AS d, arg_max(close, t) * sum(volume) AS v FROM {bars} WHERE CAST(t AS DATE) > (SELECT max(CAST(t AS DATE)) - 30 FROM {bars}) GROUP BY 1, 2) GROUP BY 1""")
def agg_median_notional(x):
    last = x.bars.agg(F.max(F.to_date("t")).alias("last"))  # one row
    day = (x.bars.join(F.broadcast(last)).filter(F.to_date("t") > F.date_sub("last", 30)).groupBy("market", F.to_date("t").alias("d"))
           .agg((F.max_by("close", "t") * F.sum("volume")).alias("v")))
    # thirty daily values per market: a bounded group
    return day.groupBy("market").agg(F.when(F.count("*") >= 5, F.expr("percentile(v, 0.5)")).alias("med"), F.count("*").alias("n"))


@query("agg_listing_start", "market:s listing_start:t earliest:t", """
    SELECT market, min(t) AS listing_start, (SELECT min(t) FROM {bars}) AS earliest FROM {bars} GROUP BY 1""")
def agg_listing_start(x):
    m = x.bars.groupBy("market").agg(F.min("t").alias("listing_start"))
    return m.join(F.broadcast(m.agg(F.min("listing_start").alias("earliest"))))


@query("agg_release_clock", "cik:l clock:s n:l", f"""
    WITH a AS (SELECT cik, {ny('accepted')} AS n FROM {{filings}} WHERE form = '8-K' AND items LIKE '%2.02%' AND accepted <= TIMESTAMP '1999-06-30 00:00:00')
    SELECT cik, lpad(CAST(CAST(m AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(m AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') AS clock, n
    FROM (SELECT cik, round_even(median(hour(n) * 3600 + minute(n) * 60 + second(n)), 0) AS m, count(*) AS n FROM a GROUP BY 1)""")
def agg_release_clock(x):
    return evt_clock(x)


def evt_clock(x):
    from tidemark.operators.matchers import results_filing
    f = x.filings.filter(results_filing(F.col("form"), F.col("items")))
    return evt.release_clock(f, key="cik", at="accepted", before=F.lit("1999-06-30").cast("timestamp"))


@query("agg_typical_timing", "underlying:l typical:s", f"""
    SELECT underlying, CASE WHEN count(*) FILTER (WHERE CAST({ny('t0')} AS TIME) < TIME '09:30:00') > count(*) / 2.0 THEN 'BMO' ELSE 'AMC' END AS typical FROM {{events_long}} GROUP BY 1""")
def agg_typical_timing(x):
    bmo = F.sum((fn.ny_minute_of_day(F.col("t0")) < 570).cast("int"))
    return x.events_long.groupBy("underlying").agg(F.when(bmo * 2 > F.count("*"), "BMO").otherwise("AMC").alias("typical"))


@query("agg_same_day_count", "event_id:l n:l", f"SELECT event_id, count(*) OVER (PARTITION BY CAST({ny('t0')} AS DATE)) AS n FROM {{events_long}}")
def agg_same_day_count(x):
    return ft.same_day_counts(x.events_long).select("event_id", F.col("n_events_same_day").alias("n"))


CLASSIF = """count(hit) AS n, avg(hit) AS accuracy, coalesce((avg(hit) FILTER (WHERE r_true > 0) + avg(hit) FILTER (WHERE r_true < 0)) / 2, avg(hit)) AS balanced_accuracy,
             avg(brier) AS brier, avg(ll) AS log_loss"""


@query("agg_classification", "model:s n:l accuracy:n balanced_accuracy:n brier:n log_loss:n", "SELECT model, " + CLASSIF + " FROM (" + SCORED + ") GROUP BY 1")
def agg_classification(x):
    return ev.score_rows(x.predictions).groupBy("model").agg(*ev.classification_aggs()).withColumnRenamed("n_direction", "n")


@query("agg_regression", "model:s n_return:l mae:n rmse:n spearman_ic:n", """
    WITH r AS (SELECT model, r_true, r_hat, rank() OVER (PARTITION BY model ORDER BY r_true) + (count(*) OVER (PARTITION BY model, r_true) - 1) / 2.0 AS rt,
                      rank() OVER (PARTITION BY model ORDER BY r_hat) + (count(*) OVER (PARTITION BY model, r_hat) - 1) / 2.0 AS rh FROM {predictions})
    SELECT model, count(*) AS n_return, avg(abs(r_true - r_hat)) AS mae, sqrt(avg((r_true - r_hat) ** 2)) AS rmse, corr(rt, rh) AS spearman_ic FROM r GROUP BY 1""")
def agg_regression(x):
    s = ranks.spearman(x.predictions, by=["model"], x="r_hat", y="r_true")
    return x.predictions.groupBy("model").agg(*ev.regression_aggs()).join(s, "model")


@query("agg_spearman", "kind:s decision_time:s spearman_ic:n", """
    WITH r AS (SELECT kind, decision_time, rank() OVER (PARTITION BY kind, decision_time ORDER BY r_true) + (count(*) OVER (PARTITION BY kind, decision_time, r_true) - 1) / 2.0 AS a,
                      rank() OVER (PARTITION BY kind, decision_time ORDER BY p_up) + (count(*) OVER (PARTITION BY kind, decision_time, p_up) - 1) / 2.0 AS b FROM {predictions})
    SELECT kind, decision_time, corr(a, b) AS spearman_ic FROM r GROUP BY 1, 2""")
def agg_spearman(x):
    return ranks.spearman(x.predictions, by=["kind", "decision_time"], x="p_up", y="r_true")


@query("agg_calibration", "model:s bin:l p_lo:n p_hi:n n:l mean_p:n frac_up:n gap:n", """
    WITH s AS (SELECT * REPLACE (CASE WHEN p_up >= 0.9 THEN 0.85 ELSE p_up END AS p_up) FROM (""" + SCORED + """) WHERE hit IS NOT NULL), m AS (SELECT DISTINCT model FROM s), b AS (SELECT unnest(generate_series(0, 9)) AS bin),
         g AS (SELECT model, greatest(0, least(CAST(floor(p_up * 10) AS BIGINT), 9)) AS bin, count(*) AS n, avg(p_up) AS mean_p, avg(CAST(r_true > 0 AS INT)) AS frac_up FROM s GROUP BY 1, 2)
    SELECT model, bin, bin / 10.0 AS p_lo, (bin + 1) / 10.0 AS p_hi, coalesce(n, 0) AS n, mean_p, frac_up, frac_up - mean_p AS gap FROM m CROSS JOIN b LEFT JOIN g USING (model, bin)""")
def agg_calibration(x):
    # the topmost bin is empty: its rows are taken for forecasts of 0.85
    return ev.calibration(ev.score_rows(x.predictions).withColumn("p_up", F.when(F.col("p_up") >= 0.9, 0.85).otherwise(F.col("p_up"))))


@query("agg_residual_band", "model:s n:l q10:n q90:n", """
    SELECT model, count(*) AS n, quantile_cont(r_true - r_hat, 0.1) AS q10, quantile_cont(r_true - r_hat, 0.9) AS q90 FROM {predictions} GROUP BY 1""")
def agg_residual_band(x):
    return ranks.exact_quantiles(x.predictions, by=["model"], value="r_true", probs={"q10": 0.1, "q90": 0.9}, transform=F.col("r_true") - F.col("r_hat"))


@query("agg_band_coverage", "model:s coverage:n", "SELECT model, avg(CAST(r_true BETWEEN r_hat - 0.05 AND r_hat + 0.05 AS INT)) AS coverage FROM {predictions} GROUP BY 1")
def agg_band_coverage(x):
    return x.predictions.groupBy("model").agg(F.avg(F.col("r_true").between(F.col("r_hat") - 0.05, F.col("r_hat") + 0.05).cast("int")).alias("coverage"))


@query("agg_paired_se_mde", "decision_time:s n:l se:n mde:n bound:n", "WITH s AS (" + SCORED + """),
    d AS (SELECT a.decision_time, b.brier - a.brier AS d, b.brier AS base FROM s a JOIN s b ON a.event_id = b.event_id AND a.model = 'linear' AND b.model = 'base_rate' WHERE a.brier IS NOT NULL)
    SELECT decision_time, count(*) AS n, stddev_samp(d) / sqrt(count(*)) AS se, (1.959963984540054 + 0.8416212335729143) * stddev_samp(d) / sqrt(count(*)) AS mde,
           (1.959963984540054 + 0.8416212335729143) * sqrt(avg(base) * (1 - avg(base)) / count(*)) AS bound FROM d GROUP BY 1""")
def agg_paired_se_mde(x):
    p = ev.paired(ev.score_rows(x.predictions), "linear", "base_rate", ["brier"]).withColumn("d", F.col("b_brier") - F.col("m_brier"))
    g = p.filter(F.col("d").isNotNull()).groupBy("decision_time").agg(
        F.count("*").alias("n"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"), F.avg("b_brier").alias("base"))
    return g.withColumns({"mde": F.col("se") * fn.Z_POWER, "bound": ev.mde_closed_form(F.col("n"), F.col("base"))})


@query("agg_best_baseline", "decision_time:s subset:s metric:s model:s value:n", "WITH s AS (" + SUBSETS.replace("{predictions}", "(" + SCORED + ")") + """),
    k AS (SELECT model, decision_time, subset, rank() OVER (PARTITION BY model, decision_time, subset ORDER BY r_true) + (count(*) OVER (PARTITION BY model, decision_time, subset, r_true) - 1) / 2.0 AS rt,
                 rank() OVER (PARTITION BY model, decision_time, subset ORDER BY r_hat) + (count(*) OVER (PARTITION BY model, decision_time, subset, r_hat) - 1) / 2.0 AS rh FROM s WHERE r_hat IS NOT NULL),
    g AS (SELECT model, decision_time, subset, count(*) AS n, sum(rt * rh) AS th, sum(rt * rt) AS tt, sum(rh * rh) AS hh, count(*)::DOUBLE * (count(*) + 1) * (count(*) + 1) / 4 AS m FROM k GROUP BY ALL),
    i AS (SELECT model, decision_time, subset, CASE WHEN n >= 3 AND tt > m AND hh > m THEN (th - m) / sqrt((tt - m) * (hh - m)) END AS spearman_ic FROM g),
    c AS (SELECT model, decision_time, subset, avg(hit) AS accuracy, avg(brier) AS brier, avg(ll) AS log_loss, avg(ae) AS mae, avg(mag_ae) AS magnitude_mae FROM s GROUP BY ALL),
    l AS (SELECT decision_time, subset, model, unnest(['accuracy', 'brier', 'log_loss', 'spearman_ic', 'mae', 'magnitude_mae']) AS metric,
                 unnest([accuracy, brier, log_loss, spearman_ic, mae, magnitude_mae]) AS value FROM c LEFT JOIN i USING (model, decision_time, subset) WHERE model <> 'linear')
    SELECT decision_time, subset, metric, model, value FROM l WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY decision_time, subset, metric
       ORDER BY CASE WHEN metric IN ('accuracy', 'spearman_ic') THEN -value ELSE value END, CASE model WHEN 'zero' THEN 0 ELSE 1 END) = 1""")
def agg_best_baseline(x):
    # sums of ranks are exact on both sides up to some 190,000 rows of a cell, so equal rank correlations are ties; corr() rounds by the order of its rows
    return ev.best_baseline(ev.eval_cells(ev.score_rows(x.predictions)), ["zero", "base_rate"])


@query("agg_wilson", "model:s k:l n:l lo:n hi:n", """
    WITH c AS (SELECT model, count(*) FILTER (WHERE (p_up >= 0.5) = (r_true > 0)) AS k, count(*) AS n, 1.6448536269514722 AS z FROM {predictions} GROUP BY 1)
    SELECT model, k, n, greatest(0, (k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)) AS lo,
           least(1, (k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)) AS hi FROM c""")
def agg_wilson(x):
    g = x.predictions.groupBy("model").agg(F.sum(((F.col("p_up") >= 0.5) == (F.col("r_true") > 0)).cast("int")).alias("k"), F.count("*").alias("n"))
    return g.withColumns({"lo": fn.wilson(F.col("k"), F.col("n"), False), "hi": fn.wilson(F.col("k"), F.col("n"), True)})


@query("agg_daily_pnl", "model:s n_days:l mean_daily_pnl:n sharpe_like:n", """
    WITH d AS (SELECT model, CAST(exit_time AS DATE) AS d, sum(size * net_return) AS p FROM {trades_in} WHERE untraded_reason IS NULL GROUP BY 1, 2)
    SELECT model, count(*) AS n_days, avg(p) AS mean_daily_pnl, avg(p) / stddev_samp(p) * sqrt(252) AS sharpe_like FROM d GROUP BY 1""")
def agg_daily_pnl(x):
    t = x.trades_in.filter("untraded_reason IS NULL").withColumn("pnl", F.col("size") * F.col("net_return"))
    return tr.daily_stats(t.groupBy("model", F.to_date("exit_time").alias("d")).agg(F.sum("pnl").alias("pnl")), by=["model"], day="d", pnl="pnl")


@query("agg_drawdown", "model:s max_drawdown:n", """
    WITH d AS (SELECT model, CAST(exit_time AS DATE) AS d, sum(size * net_return) AS p FROM {trades_in} WHERE untraded_reason IS NULL GROUP BY 1, 2),
         c AS (SELECT *, sum(p) OVER (PARTITION BY model ORDER BY d) AS cum FROM d),
         k AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY model ORDER BY d)) AS peak FROM c)
    SELECT model, max(peak - cum) AS max_drawdown FROM k GROUP BY 1""")
def agg_drawdown(x):
    return agg_daily_pnl(x)


@query("agg_untraded_reasons", "model:s reason:s n:l funded_share:n funded_pnl_share:n", """
    SELECT model, coalesce(untraded_reason, 'traded') AS reason, count(*) AS n, avg(CAST(funding_source = 'archive' AS INT)) AS funded_share,
           sum(CASE WHEN funding_source = 'archive' THEN abs(size * net_return) ELSE 0 END) / nullif(sum(abs(size * net_return)), 0) AS funded_pnl_share FROM {trades_in} GROUP BY 1, 2""")
def agg_untraded_reasons(x):
    a = F.abs(F.col("size") * F.col("net_return"))
    real = F.col("funding_source") == "archive"
    return x.trades_in.groupBy("model", F.coalesce("untraded_reason", F.lit("traded")).alias("reason")).agg(
        F.count("*").alias("n"), F.avg(real.cast("int")).alias("funded_share"), F.try_divide(F.sum(F.when(real, a).otherwise(0.0)), F.sum(a)).alias("funded_pnl_share"))


@query("agg_cohorts", "decision_time:s n:l n_perp:l n_low_confidence:l n_dead_band:l n_surprise_missing:l", """
    SELECT CASE event_id % 2 WHEN 0 THEN 'pre_10m' ELSE 'post_30m' END AS decision_time, count(*) AS n, count(*) FILTER (WHERE has_perp) AS n_perp,
           count(*) FILTER (WHERE t0_confidence < 0.6) AS n_low_confidence, count(*) FILTER (WHERE abs(r_30m) < 0.0025) AS n_dead_band,
           count(*) FILTER (WHERE eps_surprise IS NULL) AS n_surprise_missing FROM {events_long} GROUP BY 1""")
def agg_cohorts(x):
    d = F.when(F.col("event_id") % 2 == 0, "pre_10m").otherwise("post_30m")
    return x.events_long.groupBy(d.alias("decision_time")).agg(
        F.count("*").alias("n"), F.count_if("has_perp").alias("n_perp"), F.count_if(F.col("t0_confidence") < 0.6).alias("n_low_confidence"),
        F.count_if(F.abs("r_30m") < fn.CONTINUATION_DEAD_BAND).alias("n_dead_band"), F.count_if(F.col("eps_surprise").isNull()).alias("n_surprise_missing"))


@query("agg_label_quality", "t0_source:s n:l low_confidence:l first_t0:t last_t0:t", """
    SELECT t0_source, count(*) AS n, count(*) FILTER (WHERE t0_confidence < 0.6) AS low_confidence, min(t0) AS first_t0, max(t0) AS last_t0 FROM {events_long} GROUP BY 1""")
def agg_label_quality(x):
    return x.events_long.groupBy("t0_source").agg(F.count("*").alias("n"), F.count_if(F.col("t0_confidence") < 0.6).alias("low_confidence"),
                                                  F.min("t0").alias("first_t0"), F.max("t0").alias("last_t0"))


@query("agg_kind_summary", "kind:s markets:l in_universe:l", """
    SELECT CASE min_size % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'index' ELSE 'other' END AS kind, count(*) AS markets,
           count(*) FILTER (WHERE min_size % 3 = 0 AND n_parts % 2 = 0) AS in_universe FROM {universe} GROUP BY 1""")
def agg_kind_summary(x):
    from tidemark.catalog.projections import UNI
    return x.sql(UNI).groupBy("kind").agg(F.count("*").alias("markets"), F.count_if("in_universe").alias("in_universe"))


@query("agg_missing_features", "n_missing:l rows:l never_r:b never_rvol:b", """
    SELECT n_missing, count(*) AS rows, (SELECT count(r_24h) = 0 FROM {events_long}) AS never_r, (SELECT count(rvol_20d) = 0 FROM {events_long}) AS never_rvol
    FROM (SELECT CAST(rvol_20d IS NULL AS INT) + CAST(eps_surprise IS NULL AS INT) AS n_missing FROM {events_long}) GROUP BY 1""")
def agg_missing_features(x):
    from tidemark.catalog.projections import WIDE
    wide = ft.missing_companions(x.sql(WIDE).drop("f_text"))
    never = wide.agg((F.count("f_r") == 0).alias("never_r"), (F.count("f_rvol") == 0).alias("never_rvol"))
    return ft.with_missing_count(wide).groupBy("n_missing").agg(F.count("*").alias("rows")).join(F.broadcast(never))


@query("agg_tstat", "kind:s t:n", "SELECT kind, CASE WHEN count(*) > 2 AND stddev_samp(r_24h) > 0 THEN avg(r_24h) / stddev_samp(r_24h) * sqrt(count(*)) END AS t FROM {events_long} GROUP BY 1")
def agg_tstat(x):
    sd = F.stddev_samp("r_24h")
    return x.events_long.groupBy("kind").agg(F.when((F.count("*") > 2) & (sd > 0), F.avg("r_24h") / F.when(sd > 0, sd) * F.sqrt(F.count("*"))).alias("t"))


@query("agg_gap_report", "market:s gap_from:t gap_to:t missing:l", """
    SELECT market, t_end AS gap_from, nxt AS gap_to, datediff('hour', t_end, nxt) AS missing
    FROM (SELECT market, t_end, lead(t) OVER (PARTITION BY market ORDER BY t) AS nxt FROM {bars}) WHERE nxt > t_end""")
def agg_gap_report(x):
    return ar.gap_report(x.bars, step=3600)


@query("batch_gap_audit", "market:s last_end:t horizon:t missing:l", """
    SELECT market, max(t_end) AS last_end, (SELECT max(t_end) FROM {bars}) AS horizon, datediff('hour', max(t_end), (SELECT max(t_end) FROM {bars})) AS missing
    FROM {bars} WHERE market <> 'click' OR t < TIMESTAMP '2024-01-28 05:00:00' GROUP BY 1""")
def batch_gap_audit(x):
    kept = x.bars.filter("market <> 'click' OR t < TIMESTAMP '2024-01-28 05:00:00'")
    return ar.horizon_gap(kept, x.bars, step=3600)


@query("agg_dataset_hash", "season:s n:l digest:s", """
    SELECT season, sum(c) AS n, sha256(string_agg(h, ',' ORDER BY b)) AS digest FROM (
      SELECT concat(year(t0), 'Q', quarter(t0)) AS season, substr(md5(CAST(event_id AS VARCHAR)), 1, 4) AS b,
             sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR))) AS h, count(*) AS c
      FROM {events_long} GROUP BY 1, 2) GROUP BY season""")
def agg_dataset_hash(x):
    return ev.id_digest(x.events_long.withColumn("season", fn.season(F.col("t0"))), by="season", key="event_id")
