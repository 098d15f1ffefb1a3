"""Live calls, schedules and grading."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.sets import DEDUP
from tidemark.functions import scalars as fn
from tidemark.plans import scorecard as sc

SCHED = """SELECT event_id, decision_time, t0 AS expected_t0, CASE WHEN event_id % 7 <> 0 THEN t0 + (event_id % 40 - 20) * INTERVAL '1' MINUTE END AS t0_live,
   t0 + (event_id % 120 - 60) * INTERVAL '1' MINUTE AS now_ts FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'pre_10m' WHEN 1 THEN 'pre_5m' WHEN 2 THEN 'post_15m' ELSE 'post_30m' END AS decision_time FROM {releases})"""


@query("schedule_state", "event_id:l as_of:t off_schedule:b", "WITH s AS (" + SCHED + """),
    k AS (SELECT *, CASE decision_time WHEN 'pre_10m' THEN -10 WHEN 'pre_5m' THEN -5 WHEN 'post_15m' THEN 15 ELSE 30 END AS k FROM s),
    a AS (SELECT *, CASE WHEN k < 0 THEN expected_t0 ELSE t0_live END + k * INTERVAL '1' MINUTE AS as_of FROM k)
    SELECT event_id, as_of, CASE WHEN k < 0 THEN now_ts > expected_t0 OR now_ts < as_of - INTERVAL 60 MINUTE
       ELSE NOT (epoch_us(now_ts - t0_live) / 60e6 BETWEEN k - 1 AND k + 5) END AS off_schedule FROM a""")
def schedule_state(x):
    return sc.schedule_state(x.sql(SCHED).withColumnRenamed("now_ts", "now"))


@query("input_lag", "source:s newest:t lag_s:n", """
    WITH s AS (SELECT concat('bars:', market) AS source, t_end AS at_ts FROM {bars} UNION ALL SELECT 'funding', t FROM {funding} UNION ALL SELECT 'ctx', t FROM {ctx})
    SELECT source, max(at_ts) AS newest, epoch_us(TIMESTAMP '2024-02-01 00:00:00' - max(at_ts)) / 1e6 AS lag_s FROM s GROUP BY 1""")
def input_lag(x):
    s = x.bars.select(F.concat(F.lit("bars:"), "market").alias("source"), F.col("t_end").alias("at_ts"))
    s = s.unionByName(x.funding.select(F.lit("funding").alias("source"), F.col("t").alias("at_ts"))).unionByName(x.ctx.select(F.lit("ctx").alias("source"), F.col("t").alias("at_ts")))
    return sc.input_lag(s, now=F.lit("2024-02-01").cast("timestamp"))


CALLS = "SELECT *, run_at AS as_of FROM {live_calls}"
# truth per call key: t0 near the calls of that key, an outcome for most
TRUTH = """SELECT event_id, t0, t0_source, CASE WHEN h % 6 <> 0 THEN (h % 201 - 100) / 1000e0 END AS r_24h FROM (
   SELECT concat(CAST(user_id AS VARCHAR(20)), ':', event_type) AS event_id, CASE WHEN user_id % 9 <> 0 THEN min(ts) + (user_id % 60 - 20) * INTERVAL '1' MINUTE END AS t0,
     CASE user_id % 5 WHEN 0 THEN 'sec_8k' WHEN 1 THEN 'detected' WHEN 2 THEN 'manual' WHEN 3 THEN 'issuer_clock' ELSE 'calendar_flag' END AS t0_source, min(event_id) * 31 % 1009 AS h
   FROM {events} WHERE user_id % 11 <> 0 GROUP BY user_id, event_type)"""
GRADE = "WITH d AS (" + DEDUP.replace("SELECT *,", "SELECT *, run_at AS as_of,", 1) + "), tt AS (" + TRUTH + """),
    j AS (SELECT d.*, tt.t0, tt.t0_source, tt.r_24h, CASE decision_time WHEN 'pre_10m' THEN -10 WHEN 'post_1m' THEN 1 WHEN 'post_15m' THEN 15 ELSE 30 END AS k, epoch_us(as_of - t0) / 60e6 AS margin,
                 coalesce(t0_source IN ('sec_8k', 'detected', 'issuer_clock', 'manual') AND t0 IS NOT NULL, false) AS known FROM d LEFT JOIN tt USING (event_id)),
    s AS (SELECT *, CASE WHEN rn > 1 THEN CASE WHEN replay THEN 'replay' WHEN off_schedule AND NOT w_off THEN 'off_schedule' ELSE 'duplicate' END WHEN replay THEN 'replay' WHEN off_schedule THEN 'off_schedule'
            WHEN p_up IS NULL THEN 'no_probability' WHEN known AND k < 0 AND margin >= 0 THEN 'contaminated' WHEN known AND k >= 0 AND margin < 0 THEN 'premature'
            WHEN known AND t0_source IN ('sec_8k', 'detected') AND k >= 0 AND round(margin, 1) > k + 20 THEN 'late' WHEN r_24h IS NOT NULL THEN 'scored'
            WHEN t0 + INTERVAL 26 HOUR <= TIMESTAMP '2024-01-10 00:00:00' THEN 'unlabelled' ELSE 'pending' END AS status FROM j),
    g AS (SELECT *, CASE WHEN status = 'scored' THEN (p_up >= 0.5) = (r_24h > 0) END AS fh, CASE WHEN status = 'scored' THEN r_24h > 0 END AS up, CASE WHEN status = 'scored' THEN (p_up - CAST(r_24h > 0 AS INT)) ** 2 END AS br,
            CASE WHEN status = 'scored' AND abs(p_up - 0.5) >= 0.1 - 1e-9 THEN (p_up > 0.5) = (r_24h > 0) END AS bh, CASE WHEN status = 'scored' AND abs(p_up - 0.5) >= 0.1 - 1e-9 THEN sign(p_up - 0.5) * r_24h END AS sr FROM s)"""


def graded(x):
    return sc.grade(x.sql(CALLS), x.sql(TRUTH), now=F.lit("2024-01-10").cast("timestamp"), band=0.1, horizon=86400, max_fill_lag_min=5.0)


@query("score_live", "seq:l status:s forced_hit:b banded_hit:b brier:n signed_r:n", GRADE + " SELECT seq, status, fh AS forced_hit, bh AS banded_hit, br AS brier, sr AS signed_r FROM g")
def score_live(x):
    return graded(x)


Z = "1.6448536269514722"


def wilson_sql(k: str, n: str, up: bool) -> str:
    s = "+" if up else "-"
    core = f"({k} / {n} + {Z} * {Z} / (2 * {n}) {s} {Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {Z} * {Z} / (4 * {n} * {n}))) / (1 + {Z} * {Z} / {n})"
    return f"CASE WHEN {n} > 0 THEN {'least(1, ' if up else 'greatest(0, '}{core}) END"


@query("agg_scorecard", "decision_time:s counted:l scored:l pending:l unlabelled:l base_rate_up:n forced_hit_rate:n forced_lo:n forced_hi:n brier:n banded_calls:l banded_hit_rate:n banded_lo:n banded_hi:n banded_mean_signed_r:n",
       GRADE + f""", a AS (SELECT decision_time, count(*) AS counted, count(*) FILTER (WHERE status = 'scored') AS scored, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'unlabelled') AS unlabelled,
         avg(CAST(up AS INT)) AS base_rate_up, count(*) FILTER (WHERE fh) AS fk, avg(br) AS brier, count(bh) AS banded_calls, count(*) FILTER (WHERE bh) AS bk, avg(sr) AS banded_mean_signed_r
         FROM g WHERE status IN ('scored', 'pending', 'unlabelled') GROUP BY 1)
    SELECT *, CASE WHEN scored > 0 THEN fk / scored END AS forced_hit_rate, {wilson_sql('fk', 'scored', False)} AS forced_lo, {wilson_sql('fk', 'scored', True)} AS forced_hi,
           CASE WHEN banded_calls > 0 THEN bk / banded_calls END AS banded_hit_rate, {wilson_sql('bk', 'banded_calls', False)} AS banded_lo, {wilson_sql('bk', 'banded_calls', True)} AS banded_hi FROM a""")
def agg_scorecard(x):
    return sc.scorecard(graded(x))


@query("agg_exclusion_counts", "reason:s n:l", GRADE + " SELECT status AS reason, count(*) AS n FROM g WHERE status NOT IN ('scored', 'pending', 'unlabelled') GROUP BY 1")
def agg_exclusion_counts(x):
    return sc.exclusion_counts(graded(x))


PAIRS = "SELECT event_id AS id, concat(underlying, ':', CAST(t0 AS DATE)) AS pair_id, p_up, r_true AS r, magnitude_hat AS size_hat FROM {predictions} WHERE model <> 'zero'"


@query("calibration_ledger", "band:l n:l hit_rate:n brier:n coin_brier:n size_error:n", "WITH o AS (SELECT pair_id, avg(p_up) AS p, max(r) AS r, avg(size_hat) AS sz FROM (" + PAIRS + """) GROUP BY 1)
    SELECT CASE WHEN p < 0.425 THEN 0 WHEN p < 0.475 THEN 1 WHEN p < 0.525 THEN 2 ELSE 3 END AS band, count(*) AS n, avg(CAST((p >= 0.5) = (r > 0) AS INT)) AS hit_rate, avg((p - CAST(r > 0 AS INT)) ** 2) AS brier,
           0.25 AS coin_brier, avg(abs(abs(r) - sz)) AS size_error FROM o WHERE p IS NOT NULL AND r IS NOT NULL GROUP BY 1""")
def calibration_ledger(x):
    return sc.calibration_ledger(x.sql(PAIRS))
