"""Readers of raw vendor payloads: a text column `payload` in, typed rows out.

Landed files are read with `landed` (one payload per file); a payload may also come from any
table. Schemas are explicit, numbers arrive as display or JSON strings and are cast here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.dedup import first_per_key, latest_per_key

# Payload shapes
CANDLES = "array<struct<t:bigint,close_ms:bigint,s:string,i:string,o:string,c:string,h:string,l:string,v:string,n:bigint>>"
FUNDING = "array<struct<coin:string,fundingRate:string,premium:string,time:bigint>>"
META = ("struct<universe:array<struct<name:string,szDecimals:int,maxLeverage:int,isDelisted:boolean,growthMode:string,"
        "deployerFeeScale:string,onlyIsolated:boolean>>,collateralToken:int>")
CTX = ("struct<universe:array<struct<name:string,isDelisted:boolean>>,ctxs:array<struct<funding:string,openInterest:string,prevDayPx:string,"
       "dayNtlVlm:string,premium:string,oraclePx:string,markPx:string,midPx:string,impactPxs:array<string>,dayBaseVlm:string>>>")
FILINGS = ("struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>,"
           "items:array<string>,primaryDocument:array<string>,primaryDocDescription:array<string>>")
TICKERS = "map<string,struct<cik_str:bigint,ticker:string,title:string>>"
EPS_FACTS = ("struct<cik:bigint,facts:struct<`us-gaap`:struct<EarningsPerShareDiluted:struct<units:struct<`USD/shares`:"
             "array<struct<start:string,end:string,val:double,fp:string,fy:int,form:string,filed:string,accn:string>>>>>>>")
INTRADAY = "array<struct<date:string,open:double,high:double,low:double,close:double,volume:double>>"
DAILY = "array<struct<symbol:string,date:string,open:double,high:double,low:double,close:double,volume:double>>"
EARNINGS = "array<struct<symbol:string,date:string,epsActual:double,epsEstimated:double,revenueActual:double,revenueEstimated:double,lastUpdated:string>>"
SPLITS = "array<struct<symbol:string,date:string,numerator:double,denominator:double>>"
CALENDAR = ("struct<data:struct<rows:array<struct<symbol:string,name:string,eps:string,epsForecast:string,surprise:string,noOfEsts:string,"
            "fiscalQuarterEnding:string,time:string>>>,status:struct<rCode:int>>")
QUARTERLY = "struct<symbol:string,quarterlyEarnings:array<struct<fiscalDateEnding:string,reportedDate:string,reportedEPS:string,estimatedEPS:string>>>"
RECOVERY = ("struct<note:string,rows:array<struct<seq:bigint,event_id:string,decision_time:string,run_at:string,off_schedule:boolean,p_up:double>>>")
CALENDAR_INTERVALS = ("3d", "1w", "1M")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload files, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.input_file_name().alias("file"))


def _rows(df: DataFrame, schema: str, *path: str) -> DataFrame:
    parsed = df.withColumn("_p", F.from_json("payload", schema))
    col = F.col("_p")
    for step in path:
        col = col[step]
    return parsed.withColumn("_r", F.explode(col)).drop("_p", "payload")


def _num(col: str) -> Column:
    return F.col(col).try_cast("double")


def _millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def candles(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Bars from string-number records; t_end = t + interval, or T + 1 ms for calendar
    intervals; the last record per (market, interval, t) wins."""
    # t and T differ only in case, which column names do not
    r = _rows(df.withColumn("payload", F.regexp_replace("payload", '"T"\\s*:', '"close_ms":')), CANDLES)
    t = _millis(F.col("_r.t"))
    end = F.when(F.col("_r.i").isin(*CALENDAR_INTERVALS), _millis(F.col("_r.close_ms") + 1)).otherwise(
        fn.plus_seconds(t, fn.lookup(F.col("_r.i"), fn.INTERVAL_SECONDS | {"4h": 14400, "1d": 86400}, 3600)))
    out = r.select(F.col("_r.s").alias("market"), F.col("_r.i").alias("interval"), t.alias("t"), end.alias("t_end"),
                   *[_num(f"_r.{k}").alias(n) for k, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))],
                   F.col("_r.n").alias("n_trades"), seq)
    return latest_per_key(out, ["market", "interval", "t"], [seq])


def funding(df: DataFrame) -> DataFrame:
    """Hourly funding; the last record inside an hour wins."""
    r = _rows(df, FUNDING)
    at = _millis(F.col("_r.time"))
    out = r.select(F.col("_r.coin").alias("market"), at.alias("_at"), _num("_r.fundingRate").alias("funding_rate"), _num("_r.premium").alias("premium"))
    last = F.max_by(F.struct("funding_rate", "premium"), "_at")
    return out.groupBy("market", F.date_trunc("hour", "_at").alias("t")).agg(last.alias("_l")).select("market", "t", "_l.*")


def context(df: DataFrame, t: str = "t") -> DataFrame:
    """Market contexts zipped by position with the universe; delisted names drop; a length
    mismatch is an error."""
    p = df.withColumn("_p", F.from_json("payload", CTX))
    u, c = F.col("_p.universe"), F.col("_p.ctxs")
    checked = F.when(F.size(u) == F.size(c), F.arrays_zip(u.alias("u"), c.alias("c"))).otherwise(
        F.raise_error(F.lit("universe and contexts differ in length")))
    z = p.withColumn("_z", F.explode(checked)).filter(~F.coalesce(F.col("_z.u.isDelisted"), F.lit(False)))
    names = {"funding": "funding", "openInterest": "open_interest", "prevDayPx": "prev_day_px", "dayNtlVlm": "day_ntl_vlm", "premium": "premium",
             "oraclePx": "oracle_px", "markPx": "mark_px", "midPx": "mid_px", "dayBaseVlm": "day_base_vlm"}
    impact = F.col("_z.c.impactPxs")
    return z.select(F.col("_z.u.name").alias("market"), t, *[_num(f"_z.c.{k}").alias(n) for k, n in names.items()],
                    F.get(impact, F.lit(0)).try_cast("double").alias("impact_bid"), F.get(impact, F.lit(1)).try_cast("double").alias("impact_ask"))


def markets(df: DataFrame) -> DataFrame:
    """One row per live market of every exchange payload; symbol = text after the colon."""
    r = _rows(df, META, "universe").filter(~F.coalesce(F.col("_r.isDelisted"), F.lit(False)))
    name = F.col("_r.name")
    return r.select(name.alias("market"), F.substring_index(name, ":", -1).alias("symbol"),
                    F.when(name.contains(":"), F.substring_index(name, ":", 1)).otherwise("").alias("dex"),
                    F.col("_r.maxLeverage").alias("max_leverage"), F.col("_r.growthMode").alias("growth_mode"),
                    _num("_r.deployerFeeScale").alias("deployer_fee_scale"))


def submissions(df: DataFrame) -> DataFrame:
    """Filings from parallel lists; short lists read as empty text; per accession the page with
    the lowest `page` (the recent one) wins. Input: cik, page, payload."""
    p = df.withColumn("_p", F.from_json("payload", FILINGS))
    fields = {"accessionNumber": "accession", "form": "form", "filingDate": "filing_date", "acceptanceDateTime": "accepted",
              "items": "items", "primaryDocument": "document", "primaryDocDescription": "description"}
    z = p.select("cik", "page", F.posexplode(F.arrays_zip(*[
        F.coalesce(F.col(f"_p.{k}"), F.array().cast("array<string>")).alias(k) for k in fields])).alias("_pos", "_z"))
    out = z.filter(F.col("_z.accessionNumber").isNotNull()).select(
        "cik", "page", "_pos", *[F.coalesce(F.col(f"_z.{k}"), F.lit("")).alias(n) for k, n in fields.items()])
    out = first_per_key(out, ["cik", "accession"], ["page", "_pos"]).drop("_pos")
    return out.withColumns({"filing_date": F.col("filing_date").try_cast("date"), "accepted": F.col("accepted").try_cast("timestamp")})


def ticker_map(df: DataFrame) -> DataFrame:
    """(ticker, cik, title), first entry per upper-cased ticker, blanks dropped."""
    r = df.select(F.explode(F.from_json("payload", TICKERS)).alias("k", "v"))
    out = r.select(F.col("k").cast("int").alias("_i"), F.upper(F.trim("v.ticker")).alias("ticker"), F.col("v.cik_str").alias("cik"), F.col("v.title").alias("title"))
    return first_per_key(out.filter(F.col("ticker") != ""), ["ticker"], ["_i", "cik"]).drop("_i")


def eps_facts(df: DataFrame) -> DataFrame:
    """Reported diluted EPS facts, de-duplicated."""
    p = df.select(F.from_json("payload", EPS_FACTS).alias("p"))
    r = p.select(F.col("p.cik").alias("cik"), F.explode(F.col("p.facts")["us-gaap"]["EarningsPerShareDiluted"]["units"]["USD/shares"]).alias("_r"))
    out = r.select("cik", F.col("_r.start").try_cast("date").alias("period_start"), F.col("_r.end").try_cast("date").alias("period_end"),
                   F.col("_r.val").alias("value"), F.col("_r.fp").alias("fp"), F.col("_r.fy").alias("fy"), F.col("_r.form").alias("form"),
                   F.col("_r.filed").try_cast("date").alias("filed"))
    return out.dropDuplicates(["cik", "period_start", "period_end", "value", "filed"])


def intraday(df: DataFrame, *, days: DataFrame, step: int) -> DataFrame:
    """UTC bars from naive New York timestamps on the requested days; the first record per
    (symbol, t) wins. Input: symbol, seq, payload; `days`: day."""
    r = _rows(df, INTRADAY).withColumn("_ny", F.col("_r.date").try_cast("timestamp_ntz"))
    r = r.withColumn("day", F.to_date("_ny")).join(F.broadcast(days.select("day").distinct()), "day")  # requested dates
    t = F.to_utc_timestamp(F.col("_ny").cast("timestamp"), fn.NY)
    out = r.select("symbol", "seq", t.alias("t"), fn.plus_seconds(t, step).alias("t_end"),
                   *[F.col(f"_r.{k}").alias(k) for k in ("open", "high", "low", "close", "volume")])
    return first_per_key(out, ["symbol", "t"], ["seq"])


def daily(df: DataFrame) -> DataFrame:
    """Session-dated bars: t is New York midnight and t_end the next one, so a day is 23 to 25
    hours long."""
    r = _rows(df, DAILY).withColumn("d", F.col("_r.date").try_cast("date")).filter(F.col("d").isNotNull())
    return r.select(F.col("_r.symbol").alias("symbol"), "d", fn.local_to_utc(F.col("d"), 0).alias("t"), fn.local_to_utc(F.date_add("d", 1), 0).alias("t_end"),
                    *[F.col(f"_r.{k}").alias(k) for k in ("open", "high", "low", "close", "volume")])


def daily_display(df: DataFrame) -> DataFrame:
    """The second vendor's daily history: US dates and display numbers, same session rule."""
    schema = "struct<data:struct<tradesTable:struct<rows:array<struct<date:string,close:string,volume:string,open:string,high:string,low:string>>>>>"
    r = _rows(df, schema, "data", "tradesTable", "rows").withColumn("d", F.try_to_date(F.col("_r.date"), "MM/dd/yyyy")).filter(F.col("d").isNotNull())
    return r.select("symbol", "d", fn.local_to_utc(F.col("d"), 0).alias("t"), fn.local_to_utc(F.date_add("d", 1), 0).alias("t_end"),
                    *[fn.parse_number(F.col(f"_r.{k}")).alias(k) for k in ("open", "high", "low", "close", "volume")])


def earnings(df: DataFrame) -> DataFrame:
    """One row per (symbol, report date): the latest `lastUpdated` wins, missing counts as
    oldest; of equally old ones the smallest actual, a null last. A null actual is a future report."""
    r = _rows(df, EARNINGS)
    out = r.select(F.col("_r.symbol").alias("symbol"), F.col("_r.date").try_cast("date").alias("report_date"), F.col("_r.epsActual").alias("eps_actual"),
                   F.col("_r.epsEstimated").alias("eps_estimate"), F.col("_r.revenueActual").alias("rev_actual"), F.col("_r.revenueEstimated").alias("rev_estimate"),
                   F.col("_r.lastUpdated").try_cast("date").alias("last_updated"))
    oldest = F.coalesce("last_updated", F.lit("0001-01-01").cast("date"))
    # nulls are the smallest in this order, as the last actual should be
    return latest_per_key(out.filter(F.col("report_date").isNotNull()), ["symbol", "report_date"], [oldest, -F.col("eps_actual")])


def splits(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Splits with a readable date, the last record per (symbol, ex-date)."""
    r = _rows(df, SPLITS)
    out = r.select(F.col("_r.symbol").alias("symbol"), F.col("_r.date").try_cast("date").alias("ex_date"), F.col("_r.numerator").alias("numerator"),
                   F.col("_r.denominator").alias("denominator"), seq)
    return latest_per_key(out.filter(F.col("ex_date").isNotNull()), ["symbol", "ex_date"], [seq]).drop(seq)


def earnings_calendar(df: DataFrame, page: str | None = None) -> DataFrame:
    """The second vendor's calendar of a day: display numbers, first row per symbol; a status
    other than 200 is an error. Input: day, payload and, where a day has several, the number of the `page`."""
    at = F.col(page) if page else F.lit(0)
    p = df.withColumn("_p", F.from_json("payload", CALENDAR))
    rows = F.when(F.coalesce(F.col("_p.status.rCode"), F.lit(200)) == 200, F.col("_p.data.rows")).otherwise(
        F.raise_error(F.lit("calendar request failed")))
    r = p.select("day", at.alias("_page"), F.posexplode(rows).alias("_i", "_r"))
    out = r.select("day", "_page", "_i", F.upper(F.trim("_r.symbol")).alias("symbol"), *[fn.parse_number(F.col(f"_r.{k}")).alias(n) for k, n in (
        ("eps", "eps_actual"), ("epsForecast", "eps_estimate"), ("surprise", "surprise_pct"), ("noOfEsts", "n_estimates"))],
        F.col("_r.fiscalQuarterEnding").alias("quarter_ending"), F.col("_r.time").alias("time_flag"))
    return first_per_key(out, ["day", "symbol"], ["_page", "_i"]).drop("_page", "_i")


def quarterly(df: DataFrame) -> DataFrame:
    """The third vendor's quarters: 'None' reads as null, the last record per fiscal period."""
    p = df.withColumn("_p", F.from_json("payload", QUARTERLY))
    r = p.select(F.col("_p.symbol").alias("symbol"), F.posexplode("_p.quarterlyEarnings").alias("_i", "_r"))
    out = r.select("symbol", "_i", F.col("_r.fiscalDateEnding").try_cast("date").alias("fiscal_end"), F.col("_r.reportedDate").try_cast("date").alias("reported"),
                   _num("_r.reportedEPS").alias("eps_actual"), _num("_r.estimatedEPS").alias("eps_estimate"))
    return latest_per_key(out.filter(F.col("fiscal_end").isNotNull()), ["symbol", "fiscal_end"], ["_i"]).drop("_i")


def recovery_rows(df: DataFrame) -> DataFrame:
    """Recovered log rows."""
    r = _rows(df, RECOVERY, "rows")
    return r.select("_r.seq", "_r.event_id", "_r.decision_time", F.col("_r.run_at").try_cast("timestamp").alias("run_at"), "_r.off_schedule", "_r.p_up",
                    F.lit(True).alias("recovered"))
