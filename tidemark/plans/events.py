"""Release-time detection and resolution, merges, and the upcoming schedule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.dedup import first_per_key
from tidemark.operators.asof import DAY
from tidemark.operators.ranges import range_aggregate, range_join
from tidemark.session import cut


def estimate_ladder(events: DataFrame, second: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Consensus snapshot, else the first vendor, else the second, with its provenance label."""
    j = events.join(second, "event_id", "left").join(snapshots, "event_id", "left")
    return j.select("event_id", F.coalesce("snapshot", "first", "second").alias("eps_estimate"),
                    F.when(F.col("snapshot").isNotNull(), "consensus_snapshot").when(F.col("first").isNotNull(), "fmp_final")
                    .when(F.col("second").isNotNull(), "nasdaq_final").alias("estimate_source"))


def vendor_conflicts(matched: DataFrame, confidence: Column) -> DataFrame:
    """Cross-vendor checks on rows with eps_actual / vendor_eps / report_date / vendor_date."""
    limit = F.greatest(F.lit(0.02), F.abs("vendor_eps") * 0.05)
    late = F.abs(F.datediff("vendor_date", "report_date")) > 1
    return matched.withColumns({"eps_conflict": F.abs(F.col("eps_actual") - F.col("vendor_eps")) > limit,
                                "date_conflict": late, "confidence": F.when(late, 0.0).otherwise(confidence)})


@dataclass(frozen=True)
class DetectorRules:
    """Fixed values of the detector; windows in minutes so that hourly bars can scale them."""

    min_return: float = 0.01
    z: float = 6.0
    days: int = 10
    clock_window: int = 15
    same_day_bars: int = 60
    min_baseline: int = 10
    zone: str = "America/New_York"


def annotate_bars(bars: DataFrame, rules: DetectorRules) -> DataFrame:
    """Local day, clock minute, session segment, bar return and per-day numbering.

    The previous close crosses days, so it comes from the day's own bars by position and, for
    the first bar of a day, from the last bar of the previous day with data."""
    local = F.from_utc_timestamp(F.col("t"), rules.zone)
    b = bars.select("market", "t", "open", "high", "low", "close", "volume", F.to_date(local).alias("day"),
                    (F.hour(local) * 60 + F.minute(local)).alias("clock"))
    seg = F.when(F.col("clock") < 570, 0).when(F.col("clock") <= 960, 1).otherwise(2)
    w = Window.partitionBy("market", "day").orderBy("t")
    b = b.withColumns({"seg": seg, "pos": F.row_number().over(w), "_prev": F.lag("close").over(w)})
    days = b.groupBy("market", "day").agg(F.max_by("close", "t").alias("_last"))
    wd = Window.partitionBy("market").orderBy("day")  # one row per market and day
    days = days.select("market", "day", F.row_number().over(wd).alias("day_no"), F.lag("_last").over(wd).alias("_carry"))
    b = b.join(days, ["market", "day"])
    prev = F.coalesce("_prev", F.when(F.col("pos") == 1, F.col("_carry")))
    intra = F.abs(F.try_divide(F.col("close"), F.col("open")) - 1.0)
    gap = F.abs(F.try_divide(F.col("open"), prev) - 1.0)
    return b.withColumns({"ret": F.greatest(F.coalesce(intra, F.lit(0.0)), F.coalesce(gap, F.lit(0.0))),
                          "prev_close": prev}).drop("_prev", "_carry")


def qualifying_bars(bars: DataFrame, rules: DetectorRules, candidates: Column | None = None) -> DataFrame:
    """Bars whose return and robust volume score both pass: market, day, t, first_bar.

    The cheap return test runs first. A candidate then meets its baseline in two equi-joins:
    bars of the ten prior days with data in the same segment and clock cell, and the bars of its
    own segment and day in the same or the previous block of sixty positions. Median and MAD are
    exact over a sample bounded by days x clock window + same-day bars.
    """
    b = annotate_bars(bars, rules)
    b = b.withColumn("seg_pos", F.row_number().over(Window.partitionBy("market", "day", "seg").orderBy("t")))
    cond = (F.col("volume") > 0) & (F.col("ret") >= rules.min_return)
    cand = b.filter(cond if candidates is None else cond & candidates)
    cand = cand.select("market", "day", "seg", "t", F.col("volume").alias("v"), "pos", "clock", "day_no", "seg_pos", "prev_close")
    base = b.select("market", "seg", F.col("day_no").alias("_dn"), F.col("clock").alias("b_clock"), F.col("seg_pos").alias("b_pos"),
                    F.col("volume").alias("b_vol")).filter(F.col("b_vol").isNotNull())
    w, k = rules.clock_window, rules.same_day_bars
    cell = w + 1
    back = cand.withColumn("_dn", F.explode(F.sequence(F.col("day_no") - rules.days, F.col("day_no") - 1))).withColumn(
        "_cell", F.explode(F.sequence(F.floor((F.col("clock") - w) / cell), F.floor((F.col("clock") + w) / cell))))
    prior = back.join(base.withColumn("_cell", F.floor(F.col("b_clock") / cell)), ["market", "seg", "_dn", "_cell"]).filter(
        F.abs(F.col("b_clock") - F.col("clock")) <= w)
    block = F.floor(F.col("seg_pos") / k)
    own = cand.withColumn("_dn", F.col("day_no")).withColumn("_cell", F.explode(F.array(block - 1, block)))
    same = own.join(base.withColumn("_cell", F.floor(F.col("b_pos") / k)), ["market", "seg", "_dn", "_cell"]).filter(
        (F.col("b_pos") < F.col("seg_pos")) & (F.col("b_pos") >= F.col("seg_pos") - k))
    key = ["market", "day", "t", "v", "pos", "prev_close"]
    sample = prior.select(*key, "b_vol").unionByName(same.select(*key, "b_vol"))
    judged = sample.groupBy(*key).agg(F.array_sort(F.collect_list("b_vol")).alias("_x")).filter(F.size("_x") >= rules.min_baseline)

    def middle(arr: Column) -> Column:
        n = F.size(arr)
        return (F.get(arr, F.floor((n - 1) / 2).cast("int")) + F.get(arr, F.floor(n / 2).cast("int"))) / 2
    judged = judged.withColumn("_med", middle(F.col("_x")))
    judged = judged.withColumn("_mad", middle(F.array_sort(F.transform("_x", lambda x: F.abs(x - F.col("_med"))))))
    scale = F.greatest(F.col("_mad") * 1.4826, F.col("_med") * 0.25, F.lit(1.0))
    return judged.filter((F.col("v") - F.col("_med")) / scale >= rules.z).select(
        "market", "day", "t", (F.col("pos") == 1).alias("first_bar"), "prev_close")


def detect_release(bars: DataFrame, rules: DetectorRules, candidates: Column | None = None) -> DataFrame:
    """First qualifying bar per (market, local day): start `t` and whether it opens the day."""
    hit = qualifying_bars(bars, rules, candidates)
    return hit.groupBy("market", "day").agg(F.min(F.struct("t", "first_bar")).alias("_h")).select("market", "day", "_h.*")


def confirm_pinned(bars: DataFrame, pins: DataFrame, rules: DetectorRules, *, before: int, after: int, span: int,
                   min_range: float, now: Column) -> DataFrame:
    """First bar around a pinned release that passes the volume leg at the relaxed return in
    `rules` and whose next `span` seconds of bars range over `min_range` of the previous close.
    `pins`: market, pin."""
    hit = qualifying_bars(bars, rules)
    near = range_join(pins.withColumns({"_lo": fn.plus_seconds(F.col("pin"), -before), "_hi": fn.plus_seconds(F.col("pin"), after)}), hit,
                      on=["market"], lo="_lo", hi="_hi", right_ts="t", bucket=DAY, take=["day", "prev_close"], lo_open=False)
    near = near.withColumnRenamed("_r_ts", "t0_live").withColumn("_to", fn.plus_seconds(F.col("t0_live"), span))
    near = near.filter(F.col("_to") <= now)
    rng = range_aggregate(near, bars, key=["market", "pin", "t0_live", "prev_close"], on=["market"], lo="t0_live", hi="_to", right_ts="t",
                          bucket=DAY, take=["high", "low"], lo_open=False, hi_open=True, aggs=[(F.max("high") - F.min("low")).alias("_rng")])
    rng = rng.withColumn("range_pct", F.col("_rng") / F.when(F.col("prev_close") > 0, F.col("prev_close"))).filter(F.col("range_pct") >= min_range)
    return rng.groupBy("market", "pin").agg(F.min(F.struct("t0_live", "range_pct")).alias("_b")).select("market", "pin", "_b.*")


def resolve_t0(events: DataFrame, *, window: int = 900) -> DataFrame:
    """The release instant by priority with its confidence, source and flags.

    `events` carries one candidate per source: manual, accepted (8-K), clock_t0 (issuer clock),
    det_t / det_first (detection), det_near / det_near_first (detection not before acceptance
    minus the window), report_date, time_flag, and crosses: whether that near detection lies on
    the other side of a session boundary.
    """
    c = fn.CONFIDENCE
    timing = fn.timing_from_flag(F.col("time_flag"))
    lag = fn.seconds_between(F.col("accepted"), F.col("det_near"))
    close_by = lag.between(0, window)
    moves = close_by & ~F.coalesce(F.col("crosses"), F.lit(False))
    none = F.array().cast("array<string>")
    first = F.array(F.lit("detection_first_bar"))

    def rung(t0: Column, conf, source: str, flags: Column = none, lag_s: Column | None = None) -> Column:
        return F.struct(t0.alias("t0"), F.lit(conf).cast("double").alias("t0_confidence") if not isinstance(conf, Column)
                        else conf.cast("double").alias("t0_confidence"), F.lit(source).alias("t0_source"),
                        flags.alias("flags"), (lag_s if lag_s is not None else F.lit(None)).cast("double").alias("t0_lag_s"))
    moved = F.coalesce(moves, F.lit(False))
    filing = rung(F.when(moved, F.col("det_near")).otherwise(F.col("accepted")), c["sec_8k"], "sec_8k",
                  F.when(moved & F.col("det_near_first"), first).otherwise(none),
                  F.when(~F.coalesce(close_by & F.col("crosses"), F.lit(False)), lag))
    detected = rung(F.col("det_t"), F.when(F.col("det_first"), c["calendar_flag"]).otherwise(c["detected"]), "detected",
                    F.when(F.col("det_first"), first).otherwise(none))
    flagged = rung(fn.calendar_default_t0(F.col("report_date"), timing), c["calendar_flag"], "calendar_flag")
    default = rung(fn.calendar_default_t0(F.col("report_date"), F.lit("AMC")), fn.CONFIDENCE_UNKNOWN, "calendar_flag",
                   F.array(F.lit("timing_unknown")))
    pick = (F.when(F.col("manual").isNotNull(), rung(F.col("manual"), c["manual"], "manual"))
            .when(F.col("accepted").isNotNull(), filing)
            .when(F.col("clock_t0").isNotNull(), rung(F.col("clock_t0"), c["issuer_clock"], "issuer_clock"))
            .when(F.col("det_t").isNotNull(), detected).when(timing.isNotNull(), flagged).otherwise(default))
    return events.withColumn("_r", pick).select(*events.columns, "_r.*")


def merge_events_protect(old: DataFrame, new: DataFrame, since) -> DataFrame:
    """New rows plus the old rows to keep: names this run did not rebuild, report dates before
    `since`, and completed rows the run could only mark pending (same id, or same name within a
    day of the report date). Such a pending row is dropped in favour of the completed one."""
    done = old.filter(~F.col("pending"))
    pend = new.filter(F.col("pending"))
    around = F.explode(F.sequence(F.date_sub("report_date", 1), F.date_add("report_date", 1)))
    by_id = ["underlying", "event_id"]
    by_day = ["underlying", "report_date"]

    def matched(rows: DataFrame, other: DataFrame) -> DataFrame:
        near = other.select("underlying", around.alias("report_date")).distinct()
        same = rows.join(other.select(*by_id).distinct(), by_id, "left_semi").select("event_id")
        return same.unionByName(rows.join(near, by_day, "left_semi").select("event_id")).distinct()

    fresh = new.join(matched(pend, done), "event_id", "left_anti")
    shielded = matched(done, pend).withColumn("_shielded", F.lit(True))
    rebuilt = new.select("underlying").distinct().withColumn("_rebuilt", F.lit(True))
    keep = (old.join(shielded, "event_id", "left").join(rebuilt, "underlying", "left")
            .filter(F.col("_rebuilt").isNull() | (F.col("report_date") < F.lit(since)) | F.col("_shielded").isNotNull())
            .join(fresh.select("event_id"), "event_id", "left_anti").select(*old.columns))
    return keep.unionByName(fresh.select(*old.columns))


def expected_t0(upcoming: DataFrame) -> DataFrame:
    """First available of: pinned, manual row, median past clock, issuer clock, scheduled row,
    vendor flag, typical class of the name, AMC default; with its source label."""
    timing = fn.timing_from_flag(F.col("time_flag"))
    d = F.col("report_date")
    rungs = [("pinned", F.col("pinned")), ("manual", F.col("manual")),
             ("median_clock", F.when(F.col("median_minute").isNotNull(), fn.local_to_utc(d, F.col("median_minute")))),
             ("issuer_clock", F.col("clock_t0")), ("schedule", F.col("table_t0")),
             ("vendor_flag", F.when(timing.isNotNull(), fn.calendar_default_t0(d, timing))),
             ("typical", F.when(F.col("typical").isNotNull(), fn.calendar_default_t0(d, F.col("typical"))))]
    default = fn.calendar_default_t0(d, F.lit("AMC"))
    label = F.lit("default_amc")
    for name, val in reversed(rungs):
        label = F.when(val.isNotNull(), name).otherwise(label)
    return upcoming.withColumns({"expected_t0": F.coalesce(*[v for _, v in rungs], default), "expected_t0_source": label})


def release_clock(filings: DataFrame, *, key: str, at: str, before: Column) -> DataFrame:
    """Median New York clock of the acceptances known at `before`, as HH:MM. Seconds of the day
    take at most 86,400 values, so the exact percentile of a name is a bounded state."""
    n = fn.ny_time(F.col(at))
    sec = F.hour(n) * 3600 + F.minute(n) * 60 + F.second(n)
    g = (filings.filter(F.col(at).isNotNull() & (F.col(at) <= before)).groupBy(key)
         .agg(F.bround(F.percentile(sec, F.lit(0.5)), 0).cast("bigint").alias("_m"), F.count("*").alias("n")))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    return g.select(key, F.concat(two(F.floor(F.col("_m") / 3600)), F.lit(":"), two(F.floor(F.col("_m") % 3600 / 60))).alias("clock"), "n")


def upcoming_events(calendar: DataFrame, *, today, days: int, corrections: DataFrame, known: DataFrame, consensus: DataFrame) -> DataFrame:
    """Rows of the calendar inside [today, today + days] after date corrections, one per name and
    date (the smallest row_id where corrections make dates meet), with an event id (known or minted),
    the expected instant and the newest consensus.

    calendar: underlying, report_date, row_id, time_flag, and the ladder columns of `expected_t0`;
    corrections: underlying, report_date, corrected; known: underlying, report_date, event_id;
    consensus: underlying, snapshot_time, seq, eps_estimate."""
    c = calendar.join(corrections, ["underlying", "report_date"], "left").withColumn("report_date", F.coalesce("corrected", "report_date")).drop("corrected")
    lo = F.lit(today).cast("date")
    c = c.filter(F.col("report_date").between(lo, F.date_add(lo, days)))
    c = first_per_key(c, ["underlying", "report_date"], ["row_id"])
    ids = known.groupBy("underlying", "report_date").agg(F.min("event_id").alias("_id"))
    newest = consensus.groupBy("underlying").agg(F.max_by(F.struct("snapshot_time", "eps_estimate"), F.struct("snapshot_time", "seq")).alias("_c"))
    j = expected_t0(c).join(ids, ["underlying", "report_date"], "left").join(newest, "underlying", "left")
    minted = fn.event_id(F.col("underlying").cast("string"), F.col("report_date"))
    return j.select(F.coalesce(F.col("_id").cast("string"), minted).alias("event_id"), "underlying", "report_date", "expected_t0", "expected_t0_source",
                    F.col("_c.eps_estimate").alias("eps_estimate"), F.col("_c.snapshot_time").alias("snapshot_time"))


def build_events(reports: DataFrame, *, corrections: DataFrame, vendor: DataFrame, second: DataFrame, snapshots: DataFrame, filings: DataFrame,
                 detections: DataFrame, clocks: DataFrame, facts: DataFrame, third: DataFrame, markets: DataFrame, calendar: DataFrame) -> DataFrame:
    """The full event table: corrected dates, cross checks, consensus provenance, release
    instant, fiscal period, market and flags. Every source is matched on its own key and joined
    on event_id, so the joins after the matchers are co-partitioned."""
    from tidemark.operators import matchers as mt
    from tidemark.sources.calendar import attach
    r = reports.join(corrections, ["underlying", "report_date"], "left").withColumn("report_date", F.coalesce("corrected", "report_date")).drop("corrected")
    r = r.groupBy("underlying", "report_date").agg(F.min_by(F.struct(*[c for c in r.columns if c not in ("underlying", "report_date")]), "event_id").alias("_r")).select(
        "underlying", "report_date", "_r.*")
    r = cut(r)  # every matcher below starts from these rows
    hit = mt.nearest_date_match(r, vendor, key="event_id", on="underlying", day="report_date", other_day="vendor_date", window=10,
                                take=["vendor_eps"], order=["order_key", "line", "vendor_eps"])
    acc = mt.filing_acceptance_match(r, filings).select("event_id", "accepted")
    pre = mt.prior_filing_flag(r, filings).select("event_id", "pre_announced")
    det = detections.select(F.col("market").alias("det_market"), F.col("day").alias("report_date"), F.col("t").alias("det_t"), F.col("first_bar").alias("det_first"))
    det = r.select("event_id", "det_market", "report_date").join(det, ["det_market", "report_date"]).select("event_id", "det_t", "det_first")
    est = estimate_ladder(r.select("event_id", F.col("eps_estimate").alias("first")), second, snapshots)
    period = mt.fiscal_period_match(r, facts, third)
    j = r.drop("eps_estimate")
    for part in (hit, acc, pre, det, est, period):
        j = j.join(part, "event_id", "left")
    j = j.join(clocks, "underlying", "left").withColumn("clock_t0", fn.release_clock(F.col("report_date"), F.col("clock")))
    j = vendor_conflicts(j, confidence=F.lit(None).cast("double")).withColumnRenamed("confidence", "_conflict_conf")
    near = F.col("det_t") >= fn.plus_seconds(F.col("accepted"), -900)
    j = j.withColumns({"det_near": F.when(near, F.col("det_t")), "det_near_first": F.coalesce(F.col("det_first") & near, F.lit(False)),
                       "manual": F.lit(None).cast("timestamp"), "det_first": F.coalesce("det_first", F.lit(False))})
    j = attach(attach(j, calendar, "accepted", "a_"), calendar, "det_near", "d_").withColumn("crosses", F.col("a_is_open") != F.col("d_is_open"))
    e = cut(resolve_t0(j).withColumn("t0_confidence", F.coalesce("_conflict_conf", "t0_confidence")))
    mk = mt.market_at_t0(e.select("event_id", F.col("universe_name").alias("underlying"), "t0"), markets)
    out = e.join(mk, "event_id", "left")
    flags = F.concat("flags", F.when(F.col("pre_announced"), F.array(F.lit("pre_announced"))).otherwise(F.array().cast("array<string>")),
                     F.when(F.col("eps_conflict"), F.array(F.lit("eps_conflict"))).otherwise(F.array().cast("array<string>")),
                     F.when(F.col("date_conflict"), F.array(F.lit("date_conflict"))).otherwise(F.array().cast("array<string>")))
    return out.select("event_id", "underlying", "report_date", "t0", "t0_confidence", "t0_source", "t0_lag_s", "eps_actual", "eps_estimate", "estimate_source",
                      fn.surprise_pct(F.col("eps_actual"), F.col("eps_estimate")).alias("eps_surprise_pct"), F.date_format("period_end", "yyyy-MM").alias("fiscal_period"),
                      "period_source", "market", F.coalesce("has_perp_at_t0", F.lit(False)).alias("has_perp_at_t0"), F.array_join(F.array_distinct(flags), ";").alias("flags"))
