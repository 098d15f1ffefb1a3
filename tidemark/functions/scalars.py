"""Scalar functions of the domain as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NY = "America/New_York"

# Fixed values
INTERVAL_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600}
MIN_STALENESS_SECONDS = 300
P0_BUFFER_SECONDS = {"sec_8k": 180}
DECISION_MINUTES = {"pre_10m": -10, "pre_5m": -5, "post_1m": 1, "post_15m": 15, "post_30m": 30, "post_60m": 60}
CONFIDENCE = {"manual": 1.0, "sec_8k": 0.95, "detected": 0.8, "issuer_clock": 0.7, "calendar_flag": 0.5}
CONFIDENCE_UNKNOWN = 0.25
DEFAULT_CLOCK_MINUTES = {"AMC": 16 * 60 + 5, "BMO": 7 * 60}
AMC_WORDS = ("amc", "post-market", "postmarket", "after-hours", "afterhours", "after market close",
             "after-market", "post market")
BMO_WORDS = ("bmo", "pre-market", "premarket", "before market open", "pre market", "before-market")
CONTINUATION_DEAD_BAND = 0.0025
Z90 = 1.6448536269514722
Z_POWER = 1.959963984540054 + 0.8416212335729143
PROBA_CLIP = 1e-3
LOG_LOSS_EPS = 1e-6


def lookup(key: Column, table: dict, default=None) -> Column:
    """Constant table as a chained CASE."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def plus_seconds(ts: Column, seconds: Column | float) -> Column:
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_micros(F.unix_micros(ts) + (s.cast("double") * 1e6).cast("bigint"))


def log_ret(num: Column, den: Column) -> Column:
    """ln(num / den); null unless both are positive."""
    return F.when((num > 0) & (den > 0), F.log(num / den))


def sign(x: Column) -> Column:
    return F.signum(x) + F.lit(0.0)


def surprise_pct(actual: Column, estimate: Column) -> Column:
    return F.try_divide(actual - estimate, F.abs(estimate)) * 100.0


def season(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def season_start(ts: Column) -> Column:
    return F.date_trunc("quarter", ts)


def ny_time(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, NY)


def ny_date(ts: Column) -> Column:
    return F.to_date(ny_time(ts))


def ny_hour(ts: Column) -> Column:
    n = ny_time(ts)
    return F.hour(n) + F.minute(n) / 60.0 + F.floor(F.second(n)) / 3600.0


def ny_minute_of_day(ts: Column) -> Column:
    n = ny_time(ts)
    return F.hour(n) * 60 + F.minute(n)


def local_to_utc(day: Column, minutes: Column | int, zone: Column | str = NY) -> Column:
    """`minutes` after local midnight of `day` in `zone`, as a UTC instant."""
    m = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return F.to_utc_timestamp(plus_seconds(day.cast("timestamp"), m * 60), zone)


def to_utc(local: Column, zone: str = NY, *, strict: bool = True) -> Column:
    """The instant of a local clock reading. A reading that the clocks skip in spring moves forward by
    the gap; one that names two instants in autumn is an error, or null where not `strict`."""
    utc = F.to_utc_timestamp(local, zone)
    error = F.raise_error(F.concat(F.lit("ambiguous local time: "), local.cast("string"))).cast("timestamp")
    return F.when(is_ambiguous(local, zone), error if strict else F.lit(None).cast("timestamp")).otherwise(utc)


def later_utc(local: Column, zone: str = NY) -> Column:
    """As `to_utc`, with the later of two instants."""
    utc = F.to_utc_timestamp(local, zone)
    late = utc + F.expr("INTERVAL 1 HOUR")
    return F.when(F.from_utc_timestamp(late, zone) == local, late).otherwise(utc)


def is_ambiguous(local: Column, zone: str = NY) -> Column:
    """Local clock reading that names two instants (autumn)."""
    one = F.expr("INTERVAL 1 HOUR")
    utc = F.to_utc_timestamp(local, zone)
    return (F.from_utc_timestamp(utc + one, zone) == local) | (F.from_utc_timestamp(utc - one, zone) == local)


def is_dst_fold(local: Column, zone: str = NY) -> Column:
    """Local clock reading that names two instants (autumn) or none (spring)."""
    one = F.expr("INTERVAL 1 HOUR")
    utc = F.to_utc_timestamp(local, zone)
    twice = F.from_utc_timestamp(utc + one, zone) == local
    none = F.from_utc_timestamp(utc, zone) != local
    return twice | none | (F.from_utc_timestamp(utc - one, zone) == local)


def classify_timing(ts: Column, is_open: Column, is_session_day: Column) -> Column:
    return (F.when(is_open, "RTH").when(~is_session_day, "CLOSED")
            .when(ny_minute_of_day(ts) < 570, "BMO").otherwise("AMC"))


def timing_from_flag(text: Column) -> Column:
    """Vendor wording to AMC / BMO / null."""
    bare = F.regexp_replace(F.lower(F.trim(text)), "^time-", "")
    return F.when(bare.isin(*AMC_WORDS), "AMC").when(bare.isin(*BMO_WORDS), "BMO")


def calendar_default_t0(day: Column, timing: Column) -> Column:
    return local_to_utc(day, lookup(timing, DEFAULT_CLOCK_MINUTES))


def release_clock(day: Column, clock: Column) -> Column:
    """``HH:MM Zone/Name`` on a date."""
    hh = F.substring_index(clock, ":", 1).cast("int")
    mm = F.substring(F.substring_index(F.substring_index(clock, " ", 1), ":", -1), 1, 2).cast("int")
    return local_to_utc(day, hh * 60 + mm, F.substring_index(clock, " ", -1))


def quarter_project(anchor: Column, before: Column) -> Column:
    """The last date anchor + 3k months that lies strictly before `before`."""
    months = (F.year(before) - F.year(anchor)) * 12 + F.month(before) - F.month(anchor)
    k = F.floor(months / 3).cast("int")
    near = F.add_months(anchor, k * 3)
    return F.when(near < before, near).otherwise(F.add_months(anchor, (k - 1) * 3))


def parse_number(text: Column) -> Column:
    """``$1,234.5``, ``12%``, ``(0.12)`` to double; anything else null."""
    t = F.trim(text)
    bare = F.regexp_replace(t, "[$,%()\\s]", "")
    v = bare.try_cast("double")
    return F.when(t.rlike("^\\(.*\\)$"), -v).otherwise(v)


def split_items(items: Column) -> Column:
    return F.filter(F.transform(F.split(items, ","), F.trim), lambda x: x != "")


def accession(text: Column) -> Column:
    """10-2-6 dashed form; raises on anything else."""
    digits = F.regexp_replace(F.trim(text), "-", "")
    dashed = F.regexp_replace(digits, "^(\\d{10})(\\d{2})(\\d{6})$", "$1-$2-$3")
    return F.when(digits.rlike("^\\d{18}$"), dashed).otherwise(
        F.raise_error(F.concat(F.lit("not an accession number: "), text)).cast("string"))


def event_id(underlying: Column, day: Column) -> Column:
    return F.concat(underlying, F.lit(":"), F.date_format(day, "yyyy-MM"))


def has_flag(flags: Column, flag: str) -> Column:
    return F.coalesce(F.array_contains(F.split(flags, ";"), flag), F.lit(False))


def max_staleness(interval: Column) -> Column:
    """Seconds a checkpoint bar may lie before its instant; unknown intervals count as 1h."""
    return F.greatest(lookup(interval, INTERVAL_SECONDS, 3600) * 2, F.lit(MIN_STALENESS_SECONDS))


def p0_buffer(source: Column, table: dict | None = None) -> Column:
    return F.coalesce(lookup(source, table or P0_BUFFER_SECONDS, 0), F.lit(0))


def call(p: Column, band: float) -> Column:
    edge = p - 0.5
    return (F.when(p.isNull(), "NO TRADE").when(edge >= band - 1e-9, "LONG")
            .when(-edge >= band - 1e-9, "SHORT").otherwise("NO TRADE"))


def forced_call(p: Column) -> Column:
    return F.when(p.isNull(), "").when(p >= 0.5, "LONG").otherwise("SHORT")


def position_size(sizing: Column, p: Column, mag: Column, cost: Column, target_vol: float) -> Column:
    usable = mag.isNotNull() & (mag > 0)
    return (F.when(sizing == "fixed", F.lit(1.0))
            .when(sizing == "by_confidence", F.least(F.lit(1.0), F.abs(p - 0.5) * 2.0))
            .when(sizing == "by_magnitude", F.when(usable, F.least(F.lit(1.0), F.lit(target_vol) / F.when(usable, mag)))
                  .otherwise(1.0))
            .when(sizing == "magnitude_gate", F.when(mag > cost, 1.0).otherwise(0.0)))


def leg_cost_bps(range_bps: Column, floor: float = 5.0, coeff: float = 0.25, taker: float = 4.5) -> Column:
    return F.lit(floor) + F.lit(coeff) * range_bps + F.lit(taker)


def sign_proba(x: Column) -> Column:
    return F.lit(0.5) + F.lit(0.25) * F.signum(x)


def clip_proba(p: Column) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1 - PROBA_CLIP)), F.lit(PROBA_CLIP)))


def verdict(metric: Column, lo: Column, hi: Column, mde: Column, n: Column) -> Column:
    """Reading of an improvement interval; positive means better than the baseline."""
    powered = metric.isin("brier", "accuracy") & (hi < mde)
    return (F.when(lo > 0, "improves").when(hi < 0, "worse").when(powered, "not_predictable")
            .otherwise(F.concat(F.lit("inconclusive at n = "), n.cast("string"))))


def coin_side(ticker: Column, day: Column) -> Column:
    first = F.substring(F.sha2(F.concat_ws(" ", ticker, F.date_format(day, "yyyy-MM-dd")), 256), 1, 1)
    return F.when(first.isin(*"01234567"), "UP").otherwise("DOWN")


def session_bucket(ts: Column) -> Column:
    n = ny_time(ts)
    h, wd = F.hour(n), F.weekday(n)
    weekend = ((wd == 4) & (h >= 20)) | (wd == 5) | ((wd == 6) & (h < 18))
    return (F.when(weekend, "weekend").when((h >= 10) & (h < 16) & (wd < 5), "cash 10-16")
            .when((h == 9) & (wd < 5), "open hour 9-10").when((h >= 4) & (h < 9), "pre 4-9")
            .when((h >= 16) & (h < 20), "post 16-20").otherwise("overnight 20-4"))


def wilson(hits: Column, n: Column, upper: bool) -> Column:
    z = Z90
    p = hits / n
    denom = 1 + F.lit(z * z) / n
    centre = p + F.lit(z * z) / (2 * n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    bound = F.least(F.lit(1.0), (centre + half) / denom) if upper else F.greatest(F.lit(0.0), (centre - half) / denom)
    return F.when(n > 0, bound)
