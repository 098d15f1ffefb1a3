"""Grading of logged calls, and the schedule around a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn

# Fixed values
MEASURED = ("sec_8k", "detected", "issuer_clock", "manual")
LATE = ("sec_8k", "detected")
LATE_SLACK_MIN = 15
WINDOW_SLACK = 2 * 3600
PRE_WINDOW = 3600


def dedup_live_calls(calls: DataFrame) -> DataFrame:
    """Every logged row with `kept` and, when dropped, `dropped` (replay, off_schedule for a
    superseded attempt, duplicate). The winner per (event, decision) is the minimum of a rank
    struct, found by an aggregate with map-side combine; rows then compare with it."""
    key = ["event_id", "decision_time"]
    far = F.lit("9999-12-31").cast("timestamp")
    rank = F.struct(F.coalesce("replay", F.lit(False)).alias("replay"), F.coalesce("off_schedule", F.lit(False)).alias("off"),
                    F.coalesce("run_at", far).alias("run"), F.coalesce("posted_at", far).alias("posted"), F.col("seq").alias("seq"))
    best = calls.groupBy(*key).agg(F.min(rank).alias("_w"))
    j = calls.join(best, key)
    kept = F.col("seq") == F.col("_w.seq")
    why = (F.when(kept, None).when(F.coalesce("replay", F.lit(False)), "replay")
           .when(F.coalesce("off_schedule", F.lit(False)) & ~F.col("_w.off"), "off_schedule").otherwise("duplicate"))
    return j.withColumns({"kept": kept, "dropped": why}).drop("_w")


def grade(calls: DataFrame, truth: DataFrame, *, now: Column, band: float, horizon: int, max_fill_lag_min: float, minute: int = 60) -> DataFrame:
    """Status, calls and hits of every logged row. `truth`: event_id, t0, t0_source, r_24h. The
    exclusion ladder is one ordered CASE."""
    d = dedup_live_calls(calls).join(truth, "event_id", "left")
    p, k = F.col("p_up"), fn.lookup(F.col("decision_time"), fn.DECISION_MINUTES)
    margin = fn.seconds_between(F.col("as_of"), F.col("t0")) / minute
    known = F.col("t0_source").isin(*MEASURED) & margin.isNotNull()
    late_ok = F.col("t0_source").isin(*LATE)
    closed = F.col("t0").isNotNull() & (now >= fn.plus_seconds(F.col("t0"), horizon + WINDOW_SLACK))
    status = (F.when(F.col("dropped").isNotNull(), F.col("dropped")).when(F.coalesce("replay", F.lit(False)), "replay")
              .when(F.coalesce("off_schedule", F.lit(False)), "off_schedule").when(p.isNull(), "no_probability")
              .when(known & (k < 0) & (margin >= 0), "contaminated").when(known & (k >= 0) & (margin < 0), "premature")
              .when(known & late_ok & (k >= 0) & (F.round(margin, 1) > k + max_fill_lag_min + LATE_SLACK_MIN), "late")
              .when(F.col("r_24h").isNotNull(), "scored").when(closed, "unlabelled").otherwise("pending"))
    up = F.col("r_24h") > 0
    out = d.withColumns({"status": status, "margin_min": margin, "call": fn.call(p, band), "forced": fn.forced_call(p)})
    scored = F.col("status") == "scored"
    banded = scored & F.col("call").isin("LONG", "SHORT")
    return out.withColumns({
        "forced_hit": F.when(scored, (F.col("forced") == "LONG") == up), "up": F.when(scored, up),
        "brier": F.when(scored, F.pow(p - up.cast("double"), 2)), "banded_hit": F.when(banded, (F.col("call") == "LONG") == up),
        "signed_r": F.when(banded, F.when(F.col("call") == "LONG", F.col("r_24h")).otherwise(-F.col("r_24h")))})


def scorecard(graded: DataFrame) -> DataFrame:
    """Per decision: counts, base rate, hit rates with Wilson intervals, Brier, signed return."""
    s = F.col("status")
    g = graded.filter(s.isin("scored", "pending", "unlabelled")).groupBy("decision_time").agg(
        F.count("*").alias("counted"), F.count_if(s == "scored").alias("scored"), F.count_if(s == "pending").alias("pending"),
        F.count_if(s == "unlabelled").alias("unlabelled"), F.avg(F.col("up").cast("double")).alias("base_rate_up"),
        F.count_if("forced_hit").alias("forced_hits"), F.avg("brier").alias("brier"), F.count("banded_hit").alias("banded_calls"),
        F.count_if("banded_hit").alias("banded_hits"), F.avg("signed_r").alias("banded_mean_signed_r"))
    n, b = F.col("scored"), F.col("banded_calls")
    none = F.lit(None).cast("bigint")
    safe_n, safe_b = F.when(n > 0, n).otherwise(none), F.when(b > 0, b).otherwise(none)
    return g.withColumns({
        "forced_hit_rate": F.col("forced_hits") / safe_n, "forced_lo": fn.wilson(F.col("forced_hits"), safe_n, False),
        "forced_hi": fn.wilson(F.col("forced_hits"), safe_n, True), "banded_hit_rate": F.col("banded_hits") / safe_b,
        "banded_lo": fn.wilson(F.col("banded_hits"), safe_b, False), "banded_hi": fn.wilson(F.col("banded_hits"), safe_b, True)})


def exclusion_counts(graded: DataFrame) -> DataFrame:
    s = F.col("status")
    return graded.filter(~s.isin("scored", "pending", "unlabelled")).groupBy(s.alias("reason")).agg(F.count("*").alias("n"))


def due_instants(upcoming: DataFrame, done: DataFrame, *, decisions: dict[str, int], now: Column, lookback: int, horizon: int) -> DataFrame:
    """Decision instants inside [now - lookback, now + horizon], flagged when already predicted.
    `upcoming`: event_id, expected_t0. `done`: event_id, decision_time."""
    items = F.array(*[F.struct(F.lit(k).alias("decision_time"), F.lit(v).alias("s")) for k, v in decisions.items()])
    e = upcoming.filter(F.col("expected_t0").isNotNull() & F.col("event_id").isNotNull()).withColumn("_d", F.explode(items))
    e = e.withColumns({"decision_time": F.col("_d.decision_time"), "instant": fn.plus_seconds(F.col("expected_t0"), F.col("_d.s"))}).drop("_d")
    e = e.filter((F.col("instant") >= fn.plus_seconds(now, -lookback)) & (F.col("instant") <= fn.plus_seconds(now, horizon)))
    seen = done.select("event_id", "decision_time").distinct().withColumn("_seen", F.lit(True))
    return e.join(seen, ["event_id", "decision_time"], "left").withColumn("already", F.coalesce("_seen", F.lit(False))).drop("_seen")


def schedule_state(rows: DataFrame, *, minute: int = 60, max_fill_lag_min: float = 5.0) -> DataFrame:
    """`off_schedule` and `as_of` at `now`: pre cards against the expected release, post cards
    against the detected one. Columns: decision_time, expected_t0, t0_live, now."""
    k = fn.lookup(F.col("decision_time"), fn.DECISION_MINUTES)
    pre = k < 0
    anchor = F.when(pre, F.col("expected_t0")).otherwise(F.col("t0_live"))
    as_of = fn.plus_seconds(anchor, k * minute)
    elapsed = fn.seconds_between(F.col("now"), F.col("t0_live")) / minute
    off_pre = (F.col("now") > F.col("expected_t0")) | (F.col("now") < fn.plus_seconds(as_of, -PRE_WINDOW * minute // 60))
    off_post = ~elapsed.between(k - 1, k + max_fill_lag_min)
    return rows.withColumns({"as_of": as_of, "off_schedule": F.when(pre, off_pre).otherwise(off_post)})


def input_lag(sources: DataFrame, *, now: Column) -> DataFrame:
    """Seconds from the newest input of each source to now."""
    return sources.groupBy("source").agg(F.max("at_ts").alias("newest")).withColumn("lag_s", fn.seconds_between(now, F.col("newest")))


def calibration_ledger(calls: DataFrame, *, bands: tuple[float, ...] = (0.0, 0.425, 0.475, 0.525, 1.0)) -> DataFrame:
    """Hit rate and Brier against a coin by P(up) band; a pair graded twice counts once, on the
    mean of its probabilities. They are added as doubles in a fixed order, so that a mean on a bound falls on the
    same side however the rows are dealt: the calls of an event first, then the events by id."""
    def total(c: str, by: list[str], order: str) -> Column:
        return F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    # dealt by pair once; both sums and both aggregates keep to it
    rows = calls.repartition("pair_id").withColumn("_p", total("p_up", ["pair_id", "id"], "p_up"))
    events = rows.groupBy("pair_id", "id").agg(F.max("_p").alias("_p"), F.count("p_up").alias("_n"), F.max("r").alias("r"),
                                               F.sum("size_hat").alias("_size"), F.count("size_hat").alias("_k"))
    once = events.withColumn("_p", total("_p", ["pair_id"], "id")).groupBy("pair_id").agg(
        (F.max("_p") / F.nullif(F.sum("_n"), F.lit(0))).alias("p_up"), F.max("r").alias("r"),
        (F.sum("_size") / F.nullif(F.sum("_k"), F.lit(0))).alias("size_hat"))
    band = F.lit(len(bands) - 2)
    for i in range(len(bands) - 2, 0, -1):
        band = F.when(F.col("p_up") < bands[i], i - 1).otherwise(band)
    up = (F.col("r") > 0).cast("double")
    known = once.filter(F.col("p_up").isNotNull() & F.col("r").isNotNull()).withColumn("band", band)
    return known.groupBy("band").agg(F.count("*").alias("n"), F.avg(((F.col("p_up") >= 0.5) == (F.col("r") > 0)).cast("double")).alias("hit_rate"),
                                     F.avg(F.pow(F.col("p_up") - up, 2)).alias("brier"), F.lit(0.25).alias("coin_brier"),
                                     F.avg(F.abs(F.abs("r") - F.col("size_hat"))).alias("size_error"))
