"""Sorts, top-k, dedup, set operations and upserts."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.functions import scalars as fn
from tidemark.operators import topk
from tidemark.operators.dedup import first_per_key, latest_per_key
from tidemark.operators.matchers import anti_union
from tidemark.plans import events as evt
from tidemark.plans import patterns as pt
from tidemark.plans import scorecard as sc
from tidemark.sources import archive as ar


@query("dedup_latest", "cik:l day:d accession:s form:s", """
    SELECT * FROM (SELECT cik, CAST(accepted AS DATE) AS day, accession, form FROM {filings}
    QUALIFY row_number() OVER (PARTITION BY cik, CAST(accepted AS DATE) ORDER BY accepted DESC, accession DESC) = 1)""")
def dedup_latest(x):
    f = x.filings.withColumn("day", F.to_date("accepted"))
    return latest_per_key(f, ["cik", "day"], ["accepted", "accession"])


DEDUP = """SELECT *, row_number() OVER (PARTITION BY event_id, decision_time ORDER BY replay, off_schedule, run_at, posted_at, seq) AS rn,
   first_value(off_schedule) OVER (PARTITION BY event_id, decision_time ORDER BY replay, off_schedule, run_at, posted_at, seq) AS w_off FROM {live_calls}"""


@query("dedup_live_calls", "seq:l kept:b dropped:s", "SELECT seq, rn = 1 AS kept, CASE WHEN rn = 1 THEN NULL WHEN replay THEN 'replay' "
       "WHEN off_schedule AND NOT w_off THEN 'off_schedule' ELSE 'duplicate' END AS dropped FROM (" + DEDUP + ")")
def dedup_live_calls(x):
    return sc.dedup_live_calls(x.live_calls)


@query("dedup_event_id", "id:s report_date:d event_id:l", """
    SELECT * FROM (SELECT concat(underlying, ':', strftime(report_date, '%Y-%m')) AS id, report_date, event_id FROM {reports}
    QUALIFY row_number() OVER (PARTITION BY concat(underlying, ':', strftime(report_date, '%Y-%m')) ORDER BY report_date DESC, event_id) = 1)""")
def dedup_event_id(x):
    r = x.reports.withColumn("id", fn.event_id(F.col("underlying").cast("string"), F.col("report_date")))
    return latest_per_key(r, ["id"], [F.col("report_date"), -F.col("event_id")])


PUSHES = "SELECT event_id, r_24h * 10 AS a, r_30m * 8 AS b, eps_surprise / 50 AS c, rvol_20d * 3 AS d, t0_confidence - 0.5e0 AS e, price / 500000 - 0.5e0 AS f, CASE WHEN has_perp THEN 0.1e0 ELSE 0 END AS g FROM {events_long}"


@query("topk_reasons", "event_id:l rank:l feature:s push:n", "SELECT event_id, rank, feature, push FROM (SELECT event_id, feature, push, row_number() OVER (PARTITION BY event_id ORDER BY abs(push) DESC, feature) AS rank FROM ("
       "SELECT event_id, unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g']) AS feature, unnest([a, b, c, d, e, f, g]) AS push FROM (" + PUSHES + ")) WHERE push IS NOT NULL AND push <> 0) WHERE rank <= 5")
def topk_reasons(x):
    return topk.top_contributions(x.sql(PUSHES), key=["event_id"], columns=list("abcdefg"))


CLOSES = "SELECT user_id % 20 AS market, CAST(ts AS DATE) AS d, ln(max_by(value, ts) + 1) AS lc FROM {events} GROUP BY 1, 2"
LONG_SHORT = "WITH c AS (" + CLOSES + """), g AS (SELECT d, lead(d) OVER (ORDER BY d) AS nd, lag(d) OVER (ORDER BY d) AS pd FROM (SELECT DISTINCT d FROM c)),
    j AS (SELECT c.d, c.market, (c.lc - p.lc) * 100 AS r, (n.lc - c.lc) * 100 AS nx, g.nd FROM c JOIN g ON g.d = c.d LEFT JOIN c p ON p.market = c.market AND p.d = g.pd
          LEFT JOIN c n ON n.market = c.market AND n.d = g.nd),
    k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY r, market) AS lo, count(*) OVER (PARTITION BY d) AS k FROM j WHERE r IS NOT NULL)
    SELECT d, avg(nx) FILTER (WHERE lo > k - 5) - avg(nx) FILTER (WHERE lo <= 5) AS spread FROM k WHERE k >= 10 AND nd IS NOT NULL GROUP BY 1"""


@query("topk_long_short", "d:d spread:n", LONG_SHORT)
def topk_long_short(x):
    return pt.long_short(x.sql(CLOSES))


@query("rank_trials", "model:s decision_time:s rank:l value:n", """
    SELECT model, decision_time, row_number() OVER (ORDER BY avg((p_up - CAST(r_true > 0 AS INT)) ** 2), concat(model, decision_time)) AS rank, avg((p_up - CAST(r_true > 0 AS INT)) ** 2) AS value
    FROM {predictions} GROUP BY 1, 2""")
def rank_trials(x):
    v = F.avg(F.pow(F.col("p_up") - (F.col("r_true") > 0).cast("double"), 2))
    t = x.predictions.groupBy("model", "decision_time").agg(v.alias("value")).withColumn("no", F.concat("model", "decision_time"))
    return topk.rank_trials(t, value="value", higher=False, order="no")


DUE = """SELECT event_id, decision_time, instant, already FROM (
      SELECT e.event_id, d.decision_time, e.t0 + d.m * INTERVAL '1' MINUTE AS instant, e.event_id % 5 = 0 AND d.decision_time <> 'post_1m' AS already
      FROM {releases} e, (VALUES ('pre_10m', -10), ('pre_5m', -5), ('post_1m', 1), ('post_15m', 15), ('post_30m', 30), ('post_60m', 60)) d(decision_time, m))
    WHERE instant BETWEEN TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 20 MINUTE AND TIMESTAMP '2024-01-15 12:00:00' + INTERVAL 30 HOUR"""


def due_of(x):
    up = x.releases.select("event_id", F.col("t0").alias("expected_t0"))
    done = up.filter("event_id % 5 = 0").withColumn("decision_time", F.explode(F.array(*[F.lit(k) for k in fn.DECISION_MINUTES if k != "post_1m"])))
    return sc.due_instants(up, done, decisions={k: v * 60 for k, v in fn.DECISION_MINUTES.items()}, now=F.lit("2024-01-15 12:00:00").cast("timestamp"),
                           lookback=1200, horizon=30 * 3600)


@query("due_order", "event_id:l decision_time:s instant:t already:b", DUE)
def due_order(x):
    return due_of(x).orderBy("instant", "event_id", "decision_time")


@query("due_instants", "event_id:l decision_time:s instant:t already:b", DUE)
def due_instants(x):
    return due_of(x)


@query("global_sort_outputs", "market:s dex:s notional:n pos:l", """
    SELECT market, dex, notional, row_number() OVER (ORDER BY dex, market) AS pos FROM {universe}""")
def global_sort_outputs(x):
    from pyspark.sql import Window
    pos = F.row_number().over(Window.orderBy("dex", "market"))  # the market dimension
    return x.universe.withColumn("pos", pos).orderBy("pos")


@query("union_by_name", "market:s underlying:s kind:s notional:n", """
    SELECT market, underlying, CAST(NULL AS VARCHAR) AS kind, notional FROM {universe} UNION ALL SELECT concat('x:', s_name), s_name, 'supplier', NULL FROM {supplier}""")
def union_by_name(x):
    old = x.universe.select("market", "underlying", "notional")
    new = x.supplier.select(F.concat(F.lit("x:"), "s_name").alias("market"), F.lit("supplier").alias("kind"), F.col("s_name").alias("underlying"))
    return old.unionByName(new, allowMissingColumns=True)


OLD = "SELECT market, t, t_end, close, 1 AS seq FROM {bars} WHERE t < TIMESTAMP '2024-01-20 00:00:00'"
NEW = "SELECT market, t, t_end, close * 2 AS close, 2 AS seq FROM {bars} WHERE t >= TIMESTAMP '2024-01-19 12:00:00'"


@query("upsert_append_dedup", "market:s t:t close:n", "WITH o AS (" + OLD + "), n AS (" + NEW + """)
    SELECT market, t, close FROM n UNION ALL SELECT market, t, close FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.market = o.market AND n.t = o.t)""")
def upsert_append_dedup(x):
    return ar.upsert(x.sql(OLD), x.sql(NEW), key=["market", "t"])


OLD_E = """SELECT event_id, underlying, report_date, event_id % 4 = 0 AS pending, 'old' AS origin FROM {reports} WHERE event_id % 3 <> 0"""
NEW_E = """SELECT CASE WHEN event_id % 5 = 0 THEN event_id + 10000000 ELSE event_id END AS event_id, underlying,
                  CASE WHEN event_id % 5 = 0 THEN date_add(report_date, 1) ELSE report_date END AS report_date, event_id % 2 = 0 AS pending, 'new' AS origin
           FROM {reports} WHERE underlying % 3 = 0 AND report_date >= DATE '1997-01-01'"""


@query("merge_events_protect", "event_id:l report_date:d pending:b origin:s", "WITH o AS (" + OLD_E + "), n AS (" + NEW_E + """),
    sup AS (SELECT DISTINCT n.event_id FROM n JOIN o ON o.underlying = n.underlying AND (o.event_id = n.event_id OR abs(o.report_date - n.report_date) <= 1) WHERE n.pending AND NOT o.pending),
    fresh AS (SELECT * FROM n WHERE event_id NOT IN (SELECT event_id FROM sup)),
    sh AS (SELECT DISTINCT o.event_id FROM n JOIN o ON o.underlying = n.underlying AND (o.event_id = n.event_id OR abs(o.report_date - n.report_date) <= 1) WHERE n.pending AND NOT o.pending)
    SELECT event_id, report_date, pending, origin FROM fresh UNION ALL
    SELECT event_id, report_date, pending, origin FROM o WHERE (underlying NOT IN (SELECT underlying FROM n) OR report_date < DATE '1998-01-01' OR event_id IN (SELECT event_id FROM sh))
      AND event_id NOT IN (SELECT event_id FROM fresh)""")
def merge_events_protect(x):
    import datetime
    return evt.merge_events_protect(x.sql(OLD_E), x.sql(NEW_E), datetime.date(1998, 1, 1))


LOG = "SELECT event_key, decision_time, run_at, off_schedule, seq, false AS recovered FROM {live_calls} WHERE seq % 4 <> 0"
REC = "SELECT event_key, decision_time, run_at, off_schedule, seq, true AS recovered FROM {live_calls} WHERE seq % 4 <= 1"


@query("import_idempotent", "seq:l recovered:b", "WITH l AS (" + LOG + "), r AS (" + REC + """)
    SELECT seq, recovered FROM l UNION ALL SELECT seq, recovered FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.event_key = r.event_key AND l.decision_time = r.decision_time
      AND l.run_at = r.run_at AND l.off_schedule = r.off_schedule)""")
def import_idempotent(x):
    key = ["event_key", "decision_time", "run_at", "off_schedule"]
    once = ar.append_missing(x.sql(LOG), x.sql(REC), key=key)
    return ar.append_missing(once, x.sql(REC), key=key)


@query("read_recovery_rows", "seq:l recovered:b p_up:n", """
    SELECT seq, seq % 4 = 0 AS recovered, p_up FROM {live_calls} WHERE seq % 4 <= 3""")
def read_recovery_rows(x):
    from tidemark.sources import payloads as pl
    log = x.live_calls.filter("seq % 4 <> 0").withColumn("recovered", F.lit(False))
    rec = x.live_calls.filter("seq % 4 <= 1")
    files = rec.groupBy(F.floor(F.col("seq") / 200).alias("file")).agg(F.to_json(F.struct(F.lit("lost cards").alias("note"), F.collect_list(F.struct(
        "seq", "event_id", "decision_time", F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("run_at"), "off_schedule", "p_up")).alias("rows"))).alias("payload"))
    return ar.append_missing(log, pl.recovery_rows(files), key=["event_id", "decision_time", "run_at", "off_schedule"])


@query("except_ids", "event_id:l", "SELECT event_id FROM {events_long} WHERE t0 >= TIMESTAMP '2001-04-01 00:00:00' EXCEPT SELECT l_orderkey FROM {lineitem} WHERE l_linestatus = 'F'")
def except_ids(x):
    due = x.events_long.filter(F.col("t0") >= F.lit("2001-04-01").cast("timestamp")).select("event_id")
    return due.join(x.lineitem.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("event_id")), "event_id", "left_anti").distinct()


@query("intersect_ids", "event_id:l", "SELECT event_id FROM {predictions} WHERE model = 'linear' AND p_up > 0.5 INTERSECT SELECT event_id FROM {predictions} WHERE model = 'zero' AND p_up > 0.5")
def intersect_ids(x):
    a = x.predictions.filter("model = 'linear' AND p_up > 0.5").select("event_id")
    return a.join(x.predictions.filter("model = 'zero' AND p_up > 0.5").select("event_id"), "event_id", "left_semi").distinct()


@query("calendar_from_table", "underlying:l report_date:d timing:s", """
    SELECT DISTINCT underlying, report_date, time_flag AS timing FROM {reports} WHERE report_date BETWEEN DATE '1998-06-01' AND DATE '1998-06-15'""")
def calendar_from_table(x):
    day = F.col("report_date")
    return x.reports.filter(day.between(F.lit("1998-06-01").cast("date"), F.lit("1998-06-15").cast("date"))).select(
        "underlying", "report_date", F.col("time_flag").alias("timing")).dropDuplicates()


@query("export_ticker_map", "ticker:s cik:l", """
    WITH e AS (SELECT * FROM {universe} WHERE min_size % 3 <> 1), k AS (SELECT market AS ticker, cik, market AS o FROM e UNION ALL SELECT underlying, cik, market FROM e)
    SELECT ticker, arg_min(cik, o) AS cik FROM k GROUP BY 1 ORDER BY 1""")
def export_ticker_map(x):
    k = x.universe.filter("min_size % 3 <> 1").select(F.explode(F.array("market", "underlying")).alias("ticker"), "cik", "market")
    return first_per_key(k, ["ticker"], ["market"]).orderBy("ticker")
