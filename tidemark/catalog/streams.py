"""Streaming jobs run over the whole `events` table, compared with their batch meaning."""

from pyspark.sql import functions as F

from tidemark.catalog.events import DETECTOR
from tidemark.catalog.events import QUALIFY
from tidemark.catalog.registry import query
from tidemark.catalog.scans import new_dir
from tidemark.functions import scalars as fn
from tidemark.sources.domain import K, MARKET_OF_USER
from tidemark.sources.tables import SCHEMAS
from tidemark.streaming import jobs
from tidemark.streaming import timers

BARS = "market string, t timestamp, close double, ts timestamp, event_id bigint"


def events_of(x):
    return jobs.stream_table(x.spark, f"{x.sf_dir}/events*.parquet", SCHEMAS["events"], files_per_batch=1)


def folders(x, name):
    root = new_dir(x, name)
    return f"{root}/data", f"{root}/checkpoint"


@query("stream_bars_tumbling", "market:s t:t open:n high:n low:n close:n volume:n n_trades:l", "SELECT market, t, open, high, low, close, volume, n_trades FROM {bars}")
def stream_bars_tumbling(x):
    data, cp = folders(x, "bars")
    jobs.stream_bars(jobs.tick_stream(events_of(x)), data, cp)
    return jobs.read_bars(x.spark, data)


@query("stream_archive_upsert", "market:s t:t close:n", "SELECT market, t, close FROM {bars}")
def stream_archive_upsert(x):
    data, cp = folders(x, "archive")
    versions = jobs.tick_stream(events_of(x)).select("market", F.date_trunc("hour", "ts").alias("t"), F.col("value").alias("close"), "ts", "event_id")
    jobs.stream_upsert(versions, data, cp, key=["market", "t"], order=["ts", "event_id"])
    return jobs.latest_by_event(jobs.read_log(x.spark, data, BARS), ["market", "t"], ["ts", "event_id"])


@query("stream_funding_append", "market:s t:t funding_rate:n", "SELECT market, t, funding_rate FROM {funding}")
def stream_funding_append(x):
    data, cp = folders(x, "funding")
    rows = events_of(x).filter("event_type = 'error'").select(F.expr(MARKET_OF_USER).alias("market"), F.date_trunc("hour", "ts").alias("t"),
                                                             (F.col("value") * 0.000123457).alias("funding_rate"), "ts", "event_id")
    jobs.stream_upsert(rows, data, cp, key=["market", "t"], order=["ts", "event_id"])
    log = jobs.read_log(x.spark, data, "market string, t timestamp, funding_rate double, ts timestamp, event_id bigint")
    return jobs.latest_by_event(log, ["market", "t"], ["ts", "event_id"])


@query("stream_snapshot_partition", "dt:d market:s rows:l oi:n", "SELECT CAST(t AS DATE) AS dt, market, count(*) AS rows, sum(open_interest) AS oi FROM {ctx} GROUP BY 1, 2")
def stream_snapshot_partition(x):
    data, cp = folders(x, "snapshots")
    rows = events_of(x).filter("event_type = 'view' AND value > 0").select(F.expr(MARKET_OF_USER).alias("market"), F.col("ts").alias("t"),
                                                                            (F.col("value") * 1000).alias("open_interest"), F.to_date("ts").alias("dt"))
    jobs.stream_partitioned(rows, data, cp, by="dt")
    stored = x.spark.read.schema("market string, t timestamp, open_interest double, dt date").parquet(data)
    return stored.groupBy("dt", "market").agg(F.count("*").alias("rows"), F.sum("open_interest").alias("oi"))


@query("stream_detect_release", "market:s day:d t:t first_bar:b", "WITH" + QUALIFY + """
    SELECT market, day, min(t) AS t, arg_min(pos, t) = 1 AS first_bar FROM q WHERE ret >= 0.01 GROUP BY 1, 2""")
def stream_detect_release(x):
    bars, cp0 = folders(x, "detect-bars")
    jobs.stream_bars(jobs.tick_stream(events_of(x)), bars, cp0)
    closed = jobs.read_bars(x.spark, bars).withColumn("volume", F.round("volume", 4))
    landed, cp = folders(x, "detect")
    closed.write.parquet(landed)
    root = new_dir(x, "detections")
    jobs.stream_detect(jobs.stream_table(x.spark, landed, jobs.BAR_COLUMNS), f"{root}/archive", f"{root}/found", cp, DETECTOR)
    return jobs.read_log(x.spark, f"{root}/found", "market string, day date, t timestamp, first_bar boolean")


@query("stream_live_log", "seq:l event_id:s decision_time:s", "SELECT seq, event_id, decision_time FROM {live_calls}")
def stream_live_log(x):
    data, cp = folders(x, "live")
    call = F.expr(f"CASE {K} % 4 WHEN 0 THEN 'pre_10m' WHEN 1 THEN 'post_1m' WHEN 2 THEN 'post_15m' ELSE 'post_30m' END")
    rows = events_of(x).select(F.col("event_id").alias("seq"), F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("event_id"), call.alias("decision_time"), F.col("ts").alias("run_at"))
    schema = "seq bigint, event_id string, decision_time string, run_at timestamp"
    jobs.stream_log(rows, data, cp, key=["event_id", "decision_time", "run_at"], schema=schema, ts="run_at")
    return jobs.read_log(x.spark, data, f"{schema}, day date")


@query("stream_consensus_snapshot", "snapshot_time:t symbol:l report_date:d vendor:s eps_estimate:n",
       "SELECT snapshot_time, symbol, report_date, vendor, arg_max(eps_estimate, seq) AS eps_estimate FROM {snapshots} GROUP BY 1, 2, 3, 4")
def stream_consensus_snapshot(x):
    data, cp = folders(x, "consensus-log")
    day = F.expr(f"CAST(ts + ({K} % 3) * INTERVAL '1' DAY AS DATE)")
    vendor = F.expr(f"CASE {K} % 2 WHEN 0 THEN 'alpha' ELSE 'beta' END")
    rows = events_of(x).filter("event_type = 'view'").select(F.col("ts").alias("snapshot_time"), F.col("user_id").alias("symbol"), day.alias("report_date"), vendor.alias("vendor"), F.col("value").alias("eps_estimate"), "event_id")
    key = ["snapshot_time", "symbol", "report_date", "vendor"]
    jobs.stream_upsert(rows, data, cp, key=key, order=["event_id"])
    log = jobs.read_log(x.spark, data, "snapshot_time timestamp, symbol bigint, report_date date, vendor string, eps_estimate double, event_id bigint")
    return jobs.latest_by_event(log, key, ["event_id"])


# a release is due half an hour after each purchase; two in three are detected, at a minute given by the row
DUE_SQL = f"""SELECT event_id, 'post_30m' AS decision_time, ts + INTERVAL 30 MINUTE AS due, CASE WHEN {K} % 3 <> 0 THEN ts + ({K} % 60) * INTERVAL '1' MINUTE END AS det FROM {{events}} WHERE event_type = 'purchase'"""


@query("stream_decision_timer", "event_id:l decision_time:s outcome:s at_ms:l rerun:b", "WITH d AS (" + DUE_SQL + """), w AS (SELECT max(greatest(due, coalesce(det, due))) AS top FROM d)
    SELECT event_id, decision_time, CASE WHEN det <= due + INTERVAL 15 MINUTE THEN 'card' ELSE 'no release' END AS outcome,
           CASE WHEN det <= due + INTERVAL 15 MINUTE THEN greatest(epoch_us(due), epoch_us(det)) // 1000 ELSE epoch_us(due) // 1000 + 900000 END AS at_ms,
           coalesce(det <= due + INTERVAL 15 MINUTE AND epoch_us(det) // 1000 > epoch_us(due) // 1000, false) AS rerun
    FROM d, w WHERE epoch_us(due) // 1000 + 900000 <= epoch_us(top) // 1000""")
def stream_decision_timer(x):
    data, cp = folders(x, "cards")
    e = events_of(x).filter("event_type = 'purchase'")
    due, det = fn.plus_seconds(F.col("ts"), 1800), fn.plus_seconds(F.col("ts"), F.expr(f"{K} % 60") * 60)
    recs = F.filter(F.array(F.struct(F.lit("due").alias("kind"), due.alias("at")), F.when(F.expr(f"{K} % 3 <> 0"), F.struct(F.lit("detected").alias("kind"), det.alias("at")))), lambda r: r.isNotNull())
    rows = e.select("event_id", F.lit("post_30m").alias("decision_time"), F.explode(recs).alias("r")).select(
        "event_id", "decision_time", "r.kind", "r.at", F.unix_millis("r.at").alias("ms"))
    write = jobs.batch_writer(data)
    jobs.run_available(rows, cp, lambda df, b: write(timers.card_parts(df), b))
    return timers.card_outcomes(jobs.read_log(x.spark, data, timers.PARTS))
