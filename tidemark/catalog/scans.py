"""Scans, payload readers, sinks and coverage."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.functions import scalars as fn
from tidemark.session import shared_dir
from tidemark.sources import archive as ar
from tidemark.sources import pages as pg
from tidemark.sources import payloads as pl
from tidemark.sources import settings as st

TWICE = """SELECT market, t, t_end, close, 1 AS seq FROM {bars} UNION ALL SELECT market, t, t_end, close + 1, 2 FROM {bars} WHERE n_trades % 3 = 0"""


@query("scan_candles_window", "market:s t:t close:n", """
    SELECT market, t, CASE WHEN n_trades % 3 = 0 THEN close + 1 ELSE close END AS close FROM {bars}
    WHERE t >= TIMESTAMP '2024-01-08 00:00:00' AND t < TIMESTAMP '2024-01-15 06:00:00'""")
def scan_candles_window(x):
    return ar.scan_window(x.sql(TWICE), start=F.lit("2024-01-08").cast("timestamp"), end=F.lit("2024-01-15 06:00:00").cast("timestamp"))


@query("scan_snapshots_pruned", "market:s t:t open_interest:n", """
    SELECT market, t, open_interest FROM {ctx} WHERE market = 'click' AND t <= TIMESTAMP '2024-01-20 10:00:00' AND CAST(t AS DATE) >= DATE '2024-01-10'""")
def scan_snapshots_pruned(x):
    root = new_dir(x, "ctx")
    x.ctx.withColumn("dt", F.to_date("t")).repartition("dt", "market").write.partitionBy("dt", "market").parquet(root)
    stored = x.spark.read.schema("t timestamp, open_interest double, seq bigint, dt date, market string").parquet(root)
    return ar.scan_recent(stored.filter("market = 'click'"), as_of=F.lit("2024-01-20 10:00:00").cast("timestamp"), days=10)


@query("scan_consensus", "snapshot_time:t symbol:l report_date:d eps_estimate:n vendor:s", "SELECT * FROM {snapshots}")
def scan_consensus(x):
    root = new_dir(x, "consensus")
    x.snapshots.withColumn("day", F.to_date("snapshot_time")).repartition("day").write.partitionBy("day").parquet(root)
    schema = "snapshot_time timestamp, symbol bigint, report_date date, eps_estimate double, n_estimates bigint, vendor string, seq bigint, day date"
    return x.spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(root)


def new_dir(x, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    import uuid
    return f"{shared_dir(x.spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def pack(df, by, record, extra=()):
    """Payload rows: records collected per `by`, which must bound the group."""
    return df.groupBy(*by).agg(*extra, F.to_json(F.collect_list(record)).alias("payload"))


def ms(c):
    return F.unix_millis(c)


@query("read_candles_json", "market:s interval:s t:t t_end:t open:n close:n volume:n n_trades:l", """
    SELECT market, CASE WHEN market = 'view' THEN '1w' ELSE '1h' END AS interval, t, CASE WHEN market = 'view' THEN t + INTERVAL 7 DAY ELSE t_end END AS t_end,
           open, CASE WHEN n_trades % 3 = 0 THEN close + 1 ELSE close END AS close, volume, n_trades FROM {bars}""")
def read_candles_json(x):
    again = x.bars.filter("n_trades % 3 = 0").withColumns({"close": F.col("close") + 1, "seq": F.lit(2)})
    rows = x.bars.withColumn("seq", F.lit(1)).unionByName(again)
    weekly = F.col("market") == "view"
    rec = F.struct(ms(F.col("t")).alias("t"), (F.when(weekly, ms(fn.plus_seconds(F.col("t"), 7 * 86400))).otherwise(ms(F.col("t_end"))) - 1).alias("T_"), F.col("market").alias("s"),
                   F.when(weekly, "1w").otherwise("1h").alias("i"), *[F.col(c).cast("string").alias(k) for c, k in (
                       ("open", "o"), ("close", "c"), ("high", "h"), ("low", "l"), ("volume", "v"))], F.col("n_trades").alias("n"))
    packed = pack(rows, ["market", F.to_date("t").alias("d"), "seq"], rec)  # at most a day of bars
    # T is the last millisecond of the bar
    return pl.candles(packed.withColumn("payload", F.regexp_replace("payload", '"T_":', '"T":')).drop("market", "d"))


@query("read_funding_json", "market:s t:t funding_rate:n premium:n", """
    SELECT market, date_trunc('hour', t) AS t, arg_max(fr, t) AS funding_rate, arg_max(pr, t) AS premium FROM (
      SELECT CASE user_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'signup' ELSE 'view' END AS market, date_trunc('millisecond', ts) AS t, value AS fr, value / 4 AS pr
      FROM {events} WHERE event_type = 'error') GROUP BY 1, 2""")
def read_funding_json(x):
    e = x.events.filter("event_type = 'error'")
    market = fn.lookup(F.col("user_id") % 4, {0: "click", 1: "error", 2: "signup"}, "view")
    rec = F.struct(market.alias("coin"), F.col("value").cast("string").alias("fundingRate"), (F.col("value") / 4).cast("string").alias("premium"), ms(F.col("ts")).alias("time"))
    return pl.funding(pack(e, [F.floor(F.col("event_id") / 200).alias("chunk")], rec))


@query("read_ctx_json", "market:s t:t open_interest:n mark_px:n impact_bid:n impact_ask:n", """
    SELECT market, t_end AS t, volume AS open_interest, close AS mark_px, low AS impact_bid, high AS impact_ask FROM {bars} WHERE n_trades % 7 <> 0""")
def read_ctx_json(x):
    u = F.struct(F.col("market").alias("name"), (F.col("n_trades") % 7 == 0).alias("isDelisted"))
    c = F.struct(F.col("volume").cast("string").alias("openInterest"), F.col("close").cast("string").alias("markPx"),
                 F.array(F.col("low").cast("string"), F.col("high").cast("string")).alias("impactPxs"))
    # one payload per instant: its size is the number of markets
    snap = x.bars.groupBy(F.col("t_end").alias("t")).agg(F.sort_array(F.collect_list(F.struct(F.col("market"), u.alias("u"), c.alias("c")))).alias("z"))
    body = F.struct(F.transform("z", lambda z: z["u"]).alias("universe"), F.transform("z", lambda z: z["c"]).alias("ctxs"))
    return pl.context(snap.withColumn("payload", F.to_json(body)))


@query("read_markets_json", "market:s symbol:s dex:s max_leverage:l deployer_fee_scale:n", """
    SELECT market, underlying AS symbol, dex, min_size AS max_leverage, notional AS deployer_fee_scale FROM {universe} WHERE min_size % 4 <> 0""")
def read_markets_json(x):
    rec = F.struct(F.col("market").alias("name"), F.col("min_size").alias("maxLeverage"), (F.col("min_size") % 4 == 0).alias("isDelisted"), F.col("notional").cast("string").alias("deployerFeeScale"))
    dex = x.universe.groupBy("dex").agg(F.to_json(F.struct(F.collect_list(rec).alias("universe"))).alias("payload"))
    return pl.markets(dex.drop("dex"))


@query("read_submissions_json", "cik:l accession:s form:s accepted:t items:s page:l", """
    SELECT l_suppkey * 10000000 + l_orderkey AS cik, concat(l_orderkey, '-', l_linenumber) AS accession, l_returnflag AS form, l_shipdate AS accepted,
           CASE WHEN l_linenumber = 1 THEN 'x' ELSE '' END AS items, l_linenumber % 2 AS page FROM {lineitem}
    QUALIFY row_number() OVER (PARTITION BY l_suppkey * 10000000 + l_orderkey, concat(l_orderkey, '-', l_linenumber) ORDER BY l_linenumber % 2, l_returnflag, l_shipdate) = 1""")
def read_submissions_json(x):
    li = x.lineitem.withColumns({"cik": F.col("l_suppkey") * 10000000 + F.col("l_orderkey"), "page": F.col("l_linenumber") % 2})
    s = F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("a"), F.col("l_returnflag").alias("f"),
                                             F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"))))
    g = li.groupBy("cik", "page").agg(s.alias("s"))  # the lines of one order
    # items is a short list: only the leading entry, and only where the first line is on the page
    items = F.when(F.col("s")[0]["l_linenumber"] == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    body = F.struct(F.transform("s", lambda r: r["a"]).alias("accessionNumber"), F.transform("s", lambda r: r["f"]).alias("form"),
                    F.transform("s", lambda r: r["at"]).alias("acceptanceDateTime"), items.alias("items"))
    return pl.submissions(g.select("cik", "page", F.to_json(body).alias("payload")))


@query("read_ticker_map_json", "ticker:s cik:l title:s", """
    SELECT * FROM (SELECT upper(n) AS ticker, cik, title FROM (SELECT CASE WHEN s_suppkey % 10 = 0 THEN ' ' WHEN s_suppkey % 3 = 0 THEN concat('t', s_suppkey // 2) ELSE concat('T', s_suppkey // 2) END AS n,
      s_suppkey AS cik, s_name AS title FROM {supplier}) WHERE trim(n) <> '' QUALIFY row_number() OVER (PARTITION BY upper(n) ORDER BY cik) = 1)""")
def read_ticker_map_json(x):
    k = F.col("s_suppkey")
    name = F.when(k % 10 == 0, " ").otherwise(F.concat(F.when(k % 3 == 0, "t").otherwise("T"), F.floor(k / 2).cast("string")))
    entry = F.struct(k.cast("string").alias("key"), F.struct(k.alias("cik_str"), name.alias("ticker"), F.col("s_name").alias("title")).alias("value"))
    packed = x.supplier.groupBy(F.floor(k / 500).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("payload"))
    return pl.ticker_map(packed)


@query("read_eps_facts_json", "cik:l period_end:d value:n filed:d fp:s", """
    SELECT DISTINCT l_orderkey AS cik, CAST(l_shipdate AS DATE) AS period_end, l_quantity AS value, CAST(l_shipdate + INTERVAL 30 DAY AS DATE) AS filed, 'Q1' AS fp FROM {lineitem}""")
def read_eps_facts_json(x):
    rec = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("end"), F.col("l_quantity").alias("val"), F.lit("Q1").alias("fp"),
                   F.date_format(F.date_add(F.to_date("l_shipdate"), 30), "yyyy-MM-dd").alias("filed"))
    twice = F.flatten(F.collect_list(F.array(rec, rec)))  # the lines of one order, each repeated
    units = F.struct(F.struct(F.struct(F.struct(twice.alias("USD/shares")).alias("units")).alias("EarningsPerShareDiluted")).alias("us-gaap"))
    g = x.lineitem.groupBy("l_orderkey").agg(units.alias("facts"))
    return pl.eps_facts(g.select(F.to_json(F.struct(F.col("l_orderkey").alias("cik"), "facts")).alias("payload")))


@query("read_intraday_json", "symbol:s t:t t_end:t close:n", """
    SELECT market AS symbol, ((t) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS t, ((t) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' + INTERVAL 1 HOUR AS t_end, close
    FROM {bars} WHERE day(t) % 2 = 0""")
def read_intraday_json(x):
    # the naive hour of a bar stands for a New York clock reading; each record is sent twice
    rec = F.struct(F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("date"), *[F.col(c) for c in ("open", "high", "low", "close", "volume")])
    both = x.bars.withColumn("seq", F.lit(1)).unionByName(x.bars.withColumns({"seq": F.lit(2), "close": F.col("close") + 5}))
    packed = pack(both, [F.col("market").alias("symbol"), F.to_date("t").alias("d"), "seq"], rec)  # a day of bars
    days = x.days.filter("day(d) % 2 = 0").withColumnRenamed("d", "day")
    return pl.intraday(packed.drop("d"), days=days, step=3600)


@query("read_daily_json", "symbol:s d:d t:t t_end:t close:n origin:s", """
    SELECT symbol, d, (CAST(d AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS t, (CAST(d + 1 AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS t_end,
           round(close, 2) AS close, CASE WHEN year(d) % 2 = 0 THEN 'json' ELSE 'display' END AS origin FROM {daily}""")
def read_daily_json(x):
    rec = F.struct("symbol", F.date_format("d", "yyyy-MM-dd").alias("date"), "open", "high", "low", F.round("close", 2).alias("close"), "volume")
    a = pl.daily(pack(x.daily.filter("year(d) % 2 = 0"), ["symbol", F.year("d").alias("y")], rec).drop("symbol"))  # a year of sessions
    shown = F.struct(F.date_format("d", "MM/dd/yyyy").alias("date"), F.concat(F.lit("$"), F.format_number("close", 2)).alias("close"), F.format_number("volume", 0).alias("volume"))
    g = x.daily.filter("year(d) % 2 = 1").groupBy("symbol", F.year("d").alias("y")).agg(F.to_json(F.struct(F.struct(F.struct(F.collect_list(shown).alias("rows")).alias("tradesTable")).alias("data"))).alias("payload"))
    b = pl.daily_display(g)
    return a.withColumn("origin", F.lit("json")).unionByName(b.withColumn("origin", F.lit("display")))


@query("read_earnings_json", "symbol:s report_date:d eps_actual:n last_updated:d", """
    SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS report_date, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS eps_actual,
      CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate + (o_orderkey % 50) * INTERVAL '1' DAY AS DATE) END AS last_updated FROM {orders}
    QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY last_updated DESC NULLS LAST, eps_actual) = 1)""")
def read_earnings_json(x):
    k = F.col("o_orderkey")
    fmt = "yyyy-MM-dd"
    rec = F.struct(F.col("o_custkey").cast("string").alias("symbol"), F.date_format("o_orderdate", fmt).alias("date"), F.when(k % 4 != 0, F.col("o_totalprice")).alias("epsActual"),
                   F.when(k % 5 != 0, F.date_format(F.date_add(F.to_date("o_orderdate"), (k % 50).cast("int")), fmt)).alias("lastUpdated"))
    return pl.earnings(pack(x.orders, [F.floor(k / 200).alias("chunk")], rec))


@query("read_splits_json", "symbol:s ex_date:d numerator:n denominator:n", """
    SELECT * FROM (SELECT concat('P', l_partkey) AS symbol, CAST(l_shipdate AS DATE) AS ex_date, l_quantity AS numerator, l_linenumber AS denominator FROM {lineitem} WHERE l_orderkey % 4 <> 0
    QUALIFY row_number() OVER (PARTITION BY l_partkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1)""")
def read_splits_json(x):
    rec = F.struct(F.concat(F.lit("P"), "l_partkey").alias("symbol"), F.when(F.col("l_orderkey") % 4 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
                   F.col("l_quantity").alias("numerator"), F.col("l_linenumber").alias("denominator"))
    packed = pack(x.lineitem, [(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")], rec)
    return pl.splits(packed)


@query("read_calendar_json", "day:d symbol:s eps_actual:n eps_estimate:n n_estimates:l time_flag:s", """
    SELECT report_date AS day, symbol, -(event_id % 90 + 0.25) AS eps_actual, event_id * 1000 + 5.5 AS eps_estimate, event_id % 12 AS n_estimates, time_flag FROM (
      SELECT *, concat('U', underlying % 20) AS symbol FROM {reports}) QUALIFY row_number() OVER (PARTITION BY report_date, symbol ORDER BY event_id) = 1""")
def read_calendar_json(x):
    e = F.col("event_id")
    rec = F.struct(e.alias("id"), F.concat(F.lit("u"), (F.col("underlying") % 20).cast("string")).alias("symbol"), F.concat(F.lit("($"), (e % 90).cast("string"), F.lit(".25)")).alias("eps"),
                   F.concat(F.lit("$"), e.cast("string"), F.lit(",005.50")).alias("epsForecast"), (e % 12).cast("string").alias("noOfEsts"), F.col("time_flag").alias("time"))
    # vendor pages of one day hold at most 200 rows; the first page has the first events
    page = x.reports.groupBy(F.col("report_date").alias("day"), F.floor(e / 100000).alias("page")).agg(F.sort_array(F.collect_list(rec)).alias("rows"))
    body = F.struct(F.struct(F.col("rows")).alias("data"), F.struct(F.lit(200).alias("rCode")).alias("status"))
    return pl.earnings_calendar(page.select("day", "page", F.to_json(body).alias("payload")), page="page")


@query("read_quarterly_json", "symbol:s fiscal_end:d reported:d eps_actual:n eps_estimate:n", """
    SELECT * FROM (SELECT CAST(l_orderkey AS VARCHAR) AS symbol, last_day(CAST(l_shipdate AS DATE)) AS fiscal_end, CAST(l_shipdate AS DATE) AS reported,
      CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS eps_actual, l_extendedprice AS eps_estimate FROM {lineitem}
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, last_day(CAST(l_shipdate AS DATE)) ORDER BY l_linenumber DESC, l_extendedprice DESC) = 1)""")
def read_quarterly_json(x):
    d = F.to_date("l_shipdate")
    rec = F.struct("l_linenumber", "l_extendedprice", F.date_format(F.last_day(d), "yyyy-MM-dd").alias("fiscalDateEnding"), F.date_format(d, "yyyy-MM-dd").alias("reportedDate"),
                   F.when(F.col("l_linenumber") % 3 == 0, "None").otherwise(F.col("l_quantity").cast("string")).alias("reportedEPS"), F.col("l_extendedprice").cast("string").alias("estimatedEPS"))
    g = x.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(rec)).alias("quarterlyEarnings"))  # the lines of one order
    return pl.quarterly(g.select(F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("symbol"), "quarterlyEarnings")).alias("payload")))


OVERRIDES_TEXT = """
# release pins
Brand#1: 2024-01-03 21:05:00
Brand#7: 2024-01-04 13:00:00   # checked by hand
Brand#9 without a colon
Brand#3: not a time
Brand#7: 2024-01-05 13:00:00
"""


@query("read_yaml_overrides", "market:s underlying:s pinned:t", """
    SELECT market, underlying, CASE underlying WHEN 'Brand#1' THEN TIMESTAMP '2024-01-03 21:05:00' WHEN 'Brand#7' THEN TIMESTAMP '2024-01-05 13:00:00' END AS pinned FROM {universe}""")
def read_yaml_overrides(x):
    o = st.overrides(x.spark, [OVERRIDES_TEXT], "timestamp").withColumnsRenamed({"name": "underlying", "value": "pinned"})
    return x.universe.join(F.broadcast(o), "underlying", "left")  # one row per hand-made entry


@query("holdout_log", "n:l last_seq:l last_value:n", "SELECT count(*) AS n, max(seq) AS last_seq, arg_max(value, seq) AS last_value FROM {live_calls}")
def holdout_log(x):
    path = new_dir(x, "holdout")
    runs = x.live_calls.select("seq", "run_at", "value")
    for part in (0, 1):  # two scoring runs append one after the other
        runs.filter(F.col("seq") % 2 == part).write.mode("append").parquet(path)
    log = x.spark.read.schema("seq bigint, run_at timestamp, value double").parquet(path)
    last = F.max_by(F.struct("seq", "value"), F.struct("run_at", "seq")).alias("l")
    return log.agg(F.count("*").alias("n"), last).select("n", F.col("l.seq").alias("last_seq"), F.col("l.value").alias("last_value"))


@query("write_table_versioned", "market:s rows:l version:l", "SELECT market, count(*) AS rows, 4 AS version FROM {bars} GROUP BY 1")
def write_table_versioned(x):
    path = new_dir(x, "bars")
    ar.write_versioned(x.bars, path, partition_by=["market"])
    back = ar.read_versioned(x.spark, path, "t timestamp, close double, schema_version int, market string")
    return back.groupBy("market").agg(F.count("*").alias("rows"), F.max("schema_version").alias("version"))


@query("write_report_tables", "artifact:s model:s rows:l", """
    SELECT 'predictions' AS artifact, model, count(*) AS rows FROM {predictions} GROUP BY 2 UNION ALL SELECT 'trades', model, count(*) FROM {trades_in} GROUP BY 2""")
def write_report_tables(x):
    root = new_dir(x, "reports")
    run = "run-1"
    for name, df in (("predictions", x.predictions), ("trades", x.trades_in)):
        df.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy("run_id", "model").parquet(f"{root}/{name}")
    parts = [x.spark.read.schema("event_id bigint, run_id string, model string").parquet(f"{root}/{n}").filter(F.col("run_id") == run)
             .groupBy("model").agg(F.count("*").alias("rows")).withColumn("artifact", F.lit(n)) for n in ("predictions", "trades")]
    return parts[0].unionByName(parts[1])


@query("archive_coverage", "interval:s markets:l rows:l first_t:t newest_t:t stale_market:s stale_t:t", """
    WITH b AS (SELECT market, '1h' AS ivl, t FROM {bars} WHERE market <> 'click' OR t < TIMESTAMP '2024-01-29 00:00:00' UNION ALL SELECT concat('d', symbol), '1d', CAST(d AS TIMESTAMP) FROM {daily}),
         p AS (SELECT ivl, market, max(t) AS last_t FROM b GROUP BY 1, 2)
    SELECT ivl AS interval, count(DISTINCT market) AS markets, count(*) AS rows, min(t) AS first_t, max(t) AS newest_t,
           (SELECT market FROM p WHERE p.ivl = b.ivl ORDER BY last_t, market LIMIT 1) AS stale_market, (SELECT min(last_t) FROM p WHERE p.ivl = b.ivl) AS stale_t FROM b GROUP BY ivl""")
def archive_coverage(x):
    hourly = x.bars.filter("market <> 'click' OR t < TIMESTAMP '2024-01-29 00:00:00'").select("market", F.lit("1h").alias("interval"), "t")
    daily = x.daily.select(F.concat(F.lit("d"), "symbol").alias("market"), F.lit("1d").alias("interval"), F.col("d").cast("timestamp").alias("t"))
    return ar.coverage(hourly.unionByName(daily))


# references that the given pages use; a statement has no general decoder
DECODED = "regexp_replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"
SILENT_SQL = "|".join(rf"<{k}\b.*?</{k}\s*>" for k in pg.SILENT) + "|<!--.*?-->"


@query("extract_filing_pages", "page_id:l accepted:t exhibit:s text:s", f"""
    WITH h AS (SELECT page_id, concat('<div class="info">Accepted</div><div>', strftime(TIMESTAMP '2024-01-01 00:00:00' + page_id * 3607 * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S'),
           '</div><table><tr><td><a href="/d/', page_id, '.htm">x</a></td><td>EX-99.1</td></tr></table>', html) AS m FROM {{pages}}),
    b AS (SELECT page_id, regexp_extract(m, 'Accepted[^0-9]{{{{0,80}}}}(\\d{{{{4}}}}-\\d{{{{2}}}}-\\d{{{{2}}}} \\d{{{{2}}}}:\\d{{{{2}}}}:\\d{{{{2}}}})', 1) AS stamp, regexp_extract(m, 'href="([^"]+)"[^<>]*>[^<>]*</a>\\s*</td>\\s*<td[^>]*>\\s*EX-99', 1) AS exhibit,
           {DECODED.format("regexp_replace(regexp_replace(regexp_replace(m, '(?is)" + SILENT_SQL + "', '', 'g'), '(?i)</?(" + "|".join(pg.BLOCKS) + ")\\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')")} AS t FROM h),
    l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(replace(x, chr(160), ' '), '[ \\t\\r\\f\\v]+', ' ', 'g'), ' ')), lambda x: x <> '') AS ls FROM b)
    SELECT page_id, CAST(stamp AS TIMESTAMP) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS accepted, exhibit, array_to_string(ls, chr(10)) AS text FROM b JOIN l USING (page_id)""")
def extract_filing_pages(x):
    # the given pages are articles; a filing header is put in front so that every rule has work
    stamp = F.date_format(fn.plus_seconds(F.lit("2024-01-01").cast("timestamp"), F.col("page_id") * 3607), "yyyy-MM-dd HH:mm:ss")
    head = F.concat(F.lit('<div class="info">Accepted</div><div>'), stamp, F.lit('</div><table><tr><td><a href="/d/'), F.col("page_id").cast("string"),
                    F.lit('.htm">x</a></td><td>EX-99.1</td></tr></table>'))
    return pg.extract_filing_pages(x.pages.withColumn("html", F.concat(head, "html")))
