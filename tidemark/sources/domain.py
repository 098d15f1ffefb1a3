"""Domain tables as projections of the given tables.

Each definition is one SQL text used by the Spark queries and by their DuckDB oracles, so
both sides start from the same input. ``{name}`` refers to another definition or to a given
table. The few places where the two dialects differ hold a (spark, duckdb) pair.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare
from tidemark.sources import tables
from tidemark.sources.calendar import day_dimension

K = "CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT)"
MARKET_OF_USER = ("CASE user_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'error' "
                  "WHEN 2 THEN 'signup' ELSE 'view' END")


# Closures that follow from no rule.
CLOSURES = "2001-09-11 2001-09-12 2001-09-13 2001-09-14 2004-06-11 2007-01-02 2012-10-29 2012-10-30 2018-12-05 2025-01-09".split()
# Good Friday is two days before Easter, here counted in days after 20 March (years 1900 to 2099).
_MOON = "((19 * (year(d) % 19) + 24) % 30)"
_SUNDAY = f"((2 * (year(d) % 4) + 4 * (year(d) % 7) + 6 * {_MOON} + 5) % 7)"
_GOOD_FRIDAY = f"""(month(d) IN (3, 4) AND (month(d) - 3) * 31 + day(d) = 20 + {_MOON} + {_SUNDAY}
      - CASE WHEN {_SUNDAY} = 6 AND ({_MOON} = 29 OR ({_MOON} = 28 AND year(d) % 19 > 10)) THEN 7 ELSE 0 END)"""
_HOLIDAY = f"""(
      (month(d) = 1 AND day(d) = 1) OR (month(d) = 1 AND day(d) = 2 AND isodow(d) = 1)
   OR (month(d) = 1 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21 AND year(d) >= 1998)
   OR (month(d) = 2 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21)
   OR (month(d) = 5 AND isodow(d) = 1 AND day(d) >= 25)
   OR (year(d) >= 2022 AND month(d) = 6 AND (day(d) = 19 OR (day(d) = 20 AND isodow(d) = 1) OR (day(d) = 18 AND isodow(d) = 5)))
   OR (month(d) = 7 AND (day(d) = 4 OR (day(d) = 5 AND isodow(d) = 1) OR (day(d) = 3 AND isodow(d) = 5)))
   OR (month(d) = 9 AND isodow(d) = 1 AND day(d) <= 7)
   OR (month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28)
   OR (month(d) = 12 AND (day(d) = 25 OR (day(d) = 26 AND isodow(d) = 1) OR (day(d) = 24 AND isodow(d) = 5)))
   OR {_GOOD_FRIDAY} OR d IN ({", ".join(f"DATE '{c}'" for c in CLOSURES)}))"""
_HALF_DAY = """((month(d) = 11 AND isodow(d) = 5 AND day(d) BETWEEN 23 AND 29)
             OR (month(d) = 12 AND day(d) = 24) OR (month(d) = 7 AND day(d) = 3 AND isodow(d) <= 4))"""
CALENDAR_MARGIN = 400  # days before the first and after the last instant of the data
_SPAN = " CROSS JOIN ".join(f"(SELECT CAST(min({c}) AS DATE) AS lo, CAST(max({c}) AS DATE) AS hi FROM {{{t}}}) {t[0]}"
                            for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")))

DOMAIN: dict[str, str | tuple[str, str]] = {
    # every calendar day from well before the first to well after the last instant of the data
    "days": (
        f"SELECT explode(sequence(date_sub(least(e.lo, o.lo, l.lo), {CALENDAR_MARGIN}), date_add(greatest(e.hi, o.hi, l.hi), {CALENDAR_MARGIN}))) AS d FROM {_SPAN}",
        f"""SELECT CAST(unnest(generate_series(CAST(least(e.lo, o.lo, l.lo) - {CALENDAR_MARGIN} AS TIMESTAMP), CAST(greatest(e.hi, o.hi, l.hi) + {CALENDAR_MARGIN} AS TIMESTAMP),
            INTERVAL 1 DAY)) AS DATE) AS d FROM {_SPAN}"""),
    # exchange sessions, [open_ts, close_ts) in UTC
    "sessions": (
        f"""SELECT d, to_utc_timestamp(CAST(d AS TIMESTAMP) + INTERVAL '9:30' HOUR TO MINUTE, 'America/New_York') AS open_ts,
                   to_utc_timestamp(CAST(d AS TIMESTAMP) + CASE WHEN {_HALF_DAY} THEN INTERVAL '13' HOUR ELSE INTERVAL '16' HOUR END,
                                    'America/New_York') AS close_ts
            FROM {{days}} WHERE isodow(d) <= 5 AND NOT {_HOLIDAY}""",
        f"""SELECT d, ((CAST(d AS TIMESTAMP) + INTERVAL 570 MINUTE) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS open_ts,
                   ((CAST(d AS TIMESTAMP) + CASE WHEN {_HALF_DAY} THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END)
                     AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS close_ts
            FROM {{days}} WHERE isodow(d) <= 5 AND NOT {_HOLIDAY}"""),
    # hourly bars per market; a bar is the half-open interval [t, t_end)
    "bars": """
        SELECT event_type AS market, date_trunc('hour', ts) AS t,
               date_trunc('hour', ts) + INTERVAL 1 HOUR AS t_end,
               min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
               max_by(value, (ts, event_id)) AS close, round(sum(value), 4) AS volume, count(*) AS n_trades
        FROM {events} GROUP BY event_type, date_trunc('hour', ts)""",
    # hourly bars of everything together
    "benchmark": """
        SELECT date_trunc('hour', ts) AS t, date_trunc('hour', ts) + INTERVAL 1 HOUR AS t_end,
               min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
               max_by(value, (ts, event_id)) AS close, round(sum(value), 4) AS volume, count(*) AS n_trades
        FROM {events} GROUP BY date_trunc('hour', ts)""",
    # releases with known instants
    "releases": f"""
        SELECT event_id, user_id AS underlying, ts AS t0, {MARKET_OF_USER} AS market,
               CASE {K} % 4 WHEN 0 THEN 'sec_8k' WHEN 1 THEN 'detected'
                    WHEN 2 THEN 'issuer_clock' ELSE 'calendar_flag' END AS t0_source,
               CASE {K} % 4 WHEN 0 THEN 0.95e0 WHEN 1 THEN 0.8e0
                    WHEN 2 THEN 0.7e0 ELSE 0.5e0 END AS t0_confidence,
               value AS eps_actual, round(value * (1 + ({K} % 21 - 10) / 50.0e0), 4) AS eps_estimate,
               CASE WHEN {K} % 11 = 0 THEN NULL ELSE value * 100 END AS rev_actual,
               round(value * (100 + event_id % 13 - 6), 4) AS rev_estimate,
               CASE WHEN {K} % 5 = 0 THEN NULL ELSE {K} % 9 END AS n_estimates,
               CASE WHEN event_id % 17 = 0 THEN ts + INTERVAL 7 HOUR END AS ca_ex_date,
               event_id % 3 <> 0 AS has_perp, {K} AS k
        FROM {{events}} WHERE event_type = 'purchase'""",
    # daily bars per symbol, one per New York session date d
    "daily": """
        SELECT o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS d,
               min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
               min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close,
               round(sum(o_totalprice), 4) AS volume, count(*) AS n_trades
        FROM {orders} GROUP BY o_orderstatus, CAST(o_orderdate AS DATE)""",
    # long event table: seasons, history, folds
    "events_long": """
        SELECT o_orderkey AS event_id, o_custkey AS underlying, o_orderstatus AS symbol,
               o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS t0, o_totalprice AS price,
               (o_orderkey * 104729 % 2001 - 1000) / 10000.0e0 AS r_24h,
               (o_orderkey * 7907 % 1201 - 600) / 10000.0e0 AS r_30m,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE (o_orderkey * 15485863 % 401 - 200) / 10.0e0 END AS eps_surprise,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL
                    ELSE (o_orderkey * 6700417 % 500 + 1) / 10000.0e0 END AS rvol_20d,
               (o_orderkey * 31 % 100) / 100.0e0 AS t0_confidence,
               CASE o_orderkey % 4 WHEN 0 THEN 'sec_8k' WHEN 1 THEN 'detected'
                    WHEN 2 THEN 'issuer_clock' ELSE 'calendar_flag' END AS t0_source,
               CASE o_orderkey % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'foreign' ELSE 'other' END AS kind,
               CASE WHEN o_orderkey % 24 < 13 THEN 'BMO' WHEN o_orderkey % 24 < 20 THEN 'RTH' ELSE 'AMC' END AS timing,
               o_orderkey % 5 <> 0 AS has_perp, o_orderpriority AS priority
        FROM {orders}""",
    # forecasts of three models on the same events
    "predictions": ("""
        SELECT event_id, underlying, t0, r_24h AS r_true, t0_confidence, t0_source, kind, timing, has_perp, decision_time,
               m.model, ((event_id * 7919 + m.mid * 331) % 1000) / 1000.0e0 AS p_up,
               ((event_id * 48611 + m.mid * 17) % 2001 - 1000) / 20000.0e0 AS r_hat,
               CASE WHEN event_id % 6 = m.mid THEN NULL
                    ELSE ((event_id * 27644437 + m.mid) % 900 + 50) / 10000.0e0 END AS magnitude_hat
        FROM (SELECT *, CASE event_id % 2 WHEN 0 THEN 'pre_10m' ELSE 'post_30m' END AS decision_time,
                     explode(array(named_struct('mid', 0, 'model', 'base_rate'), named_struct('mid', 1, 'model', 'linear'),
                                   named_struct('mid', 2, 'model', 'zero'))) AS m FROM {events_long})""",
        """
        SELECT event_id, underlying, t0, r_24h AS r_true, t0_confidence, t0_source, kind, timing, has_perp, decision_time,
               m.model, ((event_id * 7919 + m.mid * 331) % 1000) / 1000.0e0 AS p_up,
               ((event_id * 48611 + m.mid * 17) % 2001 - 1000) / 20000.0e0 AS r_hat,
               CASE WHEN event_id % 6 = m.mid THEN NULL
                    ELSE ((event_id * 27644437 + m.mid) % 900 + 50) / 10000.0e0 END AS magnitude_hat
        FROM (SELECT *, CASE event_id % 2 WHEN 0 THEN 'pre_10m' ELSE 'post_30m' END AS decision_time,
                     unnest([{{'mid': 0, 'model': 'base_rate'}}, {{'mid': 1, 'model': 'linear'}},
                             {{'mid': 2, 'model': 'zero'}}]) AS m FROM {events_long})"""),
    # closed positions
    "trades_in": """
        SELECT o_orderkey AS event_id, CASE o_orderkey % 3 WHEN 0 THEN 'base_rate' WHEN 1 THEN 'linear'
                    ELSE 'zero' END AS model,
               o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS entry_time,
               o_orderdate + (o_orderkey % 24 + 24 * (1 + o_orderkey % 5)) * INTERVAL '1' HOUR AS exit_time,
               (o_orderkey * 37 % 11) / 8.0e0 AS size,
               (o_orderkey * 99991 % 401 - 200) / 10000.0e0 AS net_return,
               CASE WHEN o_orderkey % 10 = 0 THEN 'below_threshold' WHEN o_orderkey % 13 = 0 THEN 'entry_fill_lag'
                    ELSE NULL END AS untraded_reason,
               CASE WHEN o_orderkey % 4 = 0 THEN 'archive' ELSE 'none' END AS funding_source
        FROM {orders}""",
    # hourly funding with holes
    "funding": f"""
        SELECT {MARKET_OF_USER} AS market, date_trunc('hour', ts) AS t,
               max_by(value, (ts, event_id)) * 0.000123457e0 AS funding_rate, min_by(value, (ts, event_id)) * 0.00123457e0 AS premium
        FROM {{events}} WHERE event_type = 'error'
        GROUP BY {MARKET_OF_USER}, date_trunc('hour', ts)""",
    # market context snapshots
    "ctx": f"""
        SELECT {MARKET_OF_USER} AS market, ts AS t, value * 1000 AS open_interest, value AS mark_px,
               value * 0.00123457e0 AS premium, value * {K} AS day_ntl_vlm, event_id AS seq
        FROM {{events}} WHERE event_type = 'view' AND value > 0""",
    # consensus snapshots of two vendors
    "snapshots": f"""
        SELECT ts AS snapshot_time, user_id AS symbol,
               CAST(ts + ({K} % 3) * INTERVAL '1' DAY AS DATE) AS report_date, value AS eps_estimate,
               CASE WHEN {K} % 3 = 0 THEN NULL ELSE {K} % 9 END AS n_estimates,
               CASE {K} % 2 WHEN 0 THEN 'alpha' ELSE 'beta' END AS vendor, event_id AS seq
        FROM {{events}} WHERE event_type = 'view'""",
    # regulatory filings
    "filings": """
        SELECT l_suppkey AS cik, concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20))) AS accession,
               CASE l_returnflag WHEN 'A' THEN '8-K' WHEN 'N' THEN '6-K' ELSE '8-K/A' END AS form,
               l_shipdate + (l_orderkey % 24) * INTERVAL '1' HOUR AS accepted,
               CASE l_linestatus WHEN 'F' THEN '2.02, 9.01' ELSE '7.01,9.01' END AS items
        FROM {lineitem}""",
    # reported fiscal results with vendor dates
    "reports": """
        SELECT o_orderkey AS event_id, o_custkey AS cik, o_custkey AS underlying,
               CAST(o_orderdate AS DATE) AS report_date, o_orderpriority AS priority,
               CASE o_orderkey % 4 WHEN 0 THEN 'AMC' WHEN 1 THEN 'Pre-Market' WHEN 2 THEN 'time-not-supplied'
                    ELSE NULL END AS time_flag, o_totalprice AS eps_actual,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice * (1 + (o_orderkey % 11 - 5) / 60.0e0) END AS eps_estimate
        FROM {orders}""",
    # second vendor's rows: one per line, dated by shipment
    "vendor_rows": """
        SELECT o.o_custkey AS underlying, l.l_orderkey AS order_key, l.l_linenumber AS line,
               CAST(l.l_shipdate AS DATE) AS vendor_date, l.l_extendedprice AS vendor_eps,
               l.l_quantity AS vendor_estimate
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    # market dimension
    "universe": """
        SELECT concat(p_type, ':', p_brand) AS market, p_type AS dex, p_brand AS underlying,
               round(avg(p_retailprice), 4) AS notional, min(p_size) AS min_size,
               count(*) AS n_parts, min(p_partkey) AS cik,
               date_add(DATE '2024-01-01', CAST(min(p_partkey) % 40 AS INT)) AS listed
        FROM {part} GROUP BY p_type, p_brand""",
    # logged calls
    "live_calls": f"""
        SELECT event_id AS seq, user_id AS event_key, event_type AS topic,
               concat(CAST(user_id AS VARCHAR(20)), ':', event_type) AS event_id,
               CASE {K} % 4 WHEN 0 THEN 'pre_10m' WHEN 1 THEN 'post_1m' WHEN 2 THEN 'post_15m'
                    ELSE 'post_30m' END AS decision_time,
               ts AS run_at, ts + INTERVAL 2 MINUTE AS posted_at, {K} % 5 = 0 AS replay,
               {K} % 3 = 0 AS off_schedule,
               CASE WHEN {K} % 7 = 0 THEN NULL ELSE least(value / 100, 1) END AS p_up, value
        FROM {{events}}""",
}


class Render:
    """Spells a definition out in one dialect."""

    _ref = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")

    @classmethod
    def references(cls, text: str) -> list[str]:
        return list(dict.fromkeys(n for n in cls._ref.findall(text)))

    @classmethod
    def duckdb(cls, text: str) -> str:
        """`text` with a WITH clause for every definition it reaches, in dependency order."""
        done: dict[str, str] = {}

        def visit(name: str) -> None:
            if name in done or name not in DOMAIN:
                return
            body = DOMAIN[name]
            body = body[1] if isinstance(body, tuple) else body
            for ref in cls.references(body):
                visit(ref)
            done[name] = cls._plain(body)

        for ref in cls.references(text):
            visit(ref)
        body = cls._plain(text).strip()
        if not done:
            return body
        ctes = ", ".join(f"{n} AS ({b.strip()})" for n, b in done.items())
        if re.match(r"WITH\s", body):
            return f"WITH {ctes}, {body[4:].lstrip()}"
        return f"WITH {ctes} {body}"

    @classmethod
    def _plain(cls, text: str) -> str:
        out = cls._ref.sub(lambda m: m.group(1), text)
        return out.replace("{{", "{").replace("}}", "}").replace("unix_micros(", "epoch_us(")


def _spark_text(text: str) -> str:
    return re.sub(r"isodow\((\w+)\)", r"extract(DOW_ISO FROM \1)", text)


class Inputs:
    """Domain tables of one data folder, built lazily as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in DOMAIN:
                body = DOMAIN[name]
                self._seen[name] = self.sql(body[0] if isinstance(body, tuple) else body)
            elif name in tables.SCHEMAS:
                self._seen[name] = tables.load(self.spark, self.sf_dir, name)
            else:
                raise AttributeError(name)
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        refs = {n: getattr(self, n) for n in Render.references(text)}
        return self.spark.sql(_spark_text(text), **refs)

    @cached_property
    def scale(self) -> str:
        return self.sf_dir.rsplit("/", 1)[-1]


def exchange_calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """The day dimension of an explicit range of dates, by the same rules as `days` and `sessions`."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS d")
    return day_dimension(days, spark.sql(_spark_text(DOMAIN["sessions"][0]), days=days))
