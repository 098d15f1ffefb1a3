"""Prices and returns of every event at its checkpoints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.asof import DAY, asof_join, asof_lookup, pack_points
from tidemark.sources.calendar import attach

# Checkpoint names and offsets in minutes (next_* come from the calendar)
CHECKPOINT_MINUTES = {"5m": 5, "15m": 15, "30m": 30, "60m": 60, "2h": 120}
CALENDAR_CHECKPOINTS = ("next_open", "next_open_30m", "next_close")
HEADLINE = "24h"
PERP_SOURCES = ("hl_archive", "hl_live")


@dataclass(frozen=True)
class TargetRules:
    """Offsets in seconds, so that the same rules serve minute and hourly bars."""

    offsets: dict[str, int] = field(default_factory=lambda: {k: v * 60 for k, v in CHECKPOINT_MINUTES.items()})
    horizon: int = DAY
    staleness: int = 300
    buffers: dict[str, int] = field(default_factory=lambda: dict(fn.P0_BUFFER_SECONDS))
    grid: int = 60
    bucket: int = DAY
    dead_band: float = fn.CONTINUATION_DEAD_BAND
    perp_sources: tuple[str, ...] = PERP_SOURCES
    continuation: tuple[str, ...] = ("15m", "30m")

    @property
    def checkpoints(self) -> list[str]:
        return [*self.offsets, *CALENDAR_CHECKPOINTS, HEADLINE]


# hourly bars: reference minutes scaled to hours
HOURLY = TargetRules(
    offsets={"5m": 3600, "15m": 2 * 3600, "30m": 3 * 3600, "60m": 6 * 3600, "2h": 12 * 3600},
    staleness=2 * 3600, buffers={"sec_8k": 3 * 3600}, grid=3600, bucket=5 * DAY)


def checkpoint_times(events: DataFrame, calendar: DataFrame, rules: TargetRules) -> DataFrame:
    """One row per (event, checkpoint) with its instant `at_ts`; events without t0 yield none."""
    ev = attach(events.filter(F.col("t0").isNotNull()), calendar, "t0")
    t0 = F.col("t0")
    at = {k: fn.plus_seconds(t0, s) for k, s in rules.offsets.items()}
    at["next_open"] = F.col("next_open")
    at["next_open_30m"] = fn.plus_seconds(F.col("next_open"), 1800)
    at["next_close"] = F.col("next_close")
    at[HEADLINE] = fn.plus_seconds(t0, rules.horizon)
    items = F.array(*[F.struct(F.lit(k).alias("checkpoint"), v.alias("at_ts")) for k, v in at.items()])
    return ev.withColumn("_c", F.explode(items)).select(*events.columns, "_c.checkpoint", "_c.at_ts")


def choose_path(events: DataFrame, coverage: DataFrame, *, horizon: int = DAY,
                preference: tuple[str, ...] = ("perp", "equity")) -> DataFrame:
    """`source` of the preferred price path of each event: a fine path that starts by t0 - 1 h
    and reaches t0 + horizon - 1 h. `coverage` has one row per (market, source) with `first_t`
    and `last_end` (see `path_coverage`), a bounded dimension."""
    spans = coverage.select(F.col("market").alias("_m"), "source", "interval", "first_t", "last_end")
    rank = fn.lookup(F.col("source"), {s: i for i, s in enumerate(preference)}, len(preference))
    ok = ((F.col("interval").isin("1m", "5m")) & (F.col("first_t") <= fn.plus_seconds(F.col("t0"), -3600))
          & (F.col("last_end") >= fn.plus_seconds(F.col("t0"), horizon - 3600)))
    return (events.join(spans, F.col("market") == F.col("_m"), "left")
            .groupBy(*events.columns)
            .agg(F.min_by(F.when(ok, F.col("source")), F.when(ok, rank)).alias("source")))


def path_coverage(bars: DataFrame) -> DataFrame:
    """First bar start and last bar end per path."""
    return bars.groupBy("market", "source", "interval").agg(F.min("t").alias("first_t"), F.max("t_end").alias("last_end"))


def compute_targets(events: DataFrame, bars: DataFrame, benchmark: DataFrame | None, calendar: DataFrame,
                    rules: TargetRules) -> DataFrame:
    """One row per event: p0, then p / t / r / ar / s per checkpoint, labels and the reason
    why the headline label is missing.

    `events`: event_id, market, t0, t0_source, price_source, ca_ex_date. All instants of all
    events are looked up in one as-of pass per series; nothing is done per event.
    """
    base = events.select("event_id", "market", "t0", "t0_source", "price_source", "ca_ex_date")
    anchor = base.filter(F.col("t0").isNotNull()).select(
        *base.columns, F.lit("p0").alias("checkpoint"),
        fn.plus_seconds(F.col("t0"), -fn.p0_buffer(F.col("t0_source"), rules.buffers)).alias("at_ts"))
    instants = anchor.unionByName(checkpoint_times(base, calendar, rules)).select(
        "event_id", "market", "checkpoint", "at_ts")
    hits = asof_join(instants, bars, on=["market"], left_ts="at_ts", right_ts="t_end", take=["close", "t_end"],
                     into="hit", grid=rules.grid, bucket=rules.bucket)
    names = ["p0", *rules.checkpoints]

    def pack(rows: DataFrame, prefix: str, *cols: str) -> DataFrame:
        p = pack_points(rows, key=["event_id"], name="checkpoint", value=F.struct(*cols), names=names)
        return p.select("event_id", *[F.col(f"`{n}`").alias(f"{prefix}_{n}") for n in names])
    packed = pack(hits, "x", "at_ts", "hit")
    if benchmark is not None:
        bench = asof_lookup(instants, benchmark, left_ts="at_ts", right_ts="t_end", take=["close", "t_end"], into="bench",
                            grid=rules.grid, bucket=rules.bucket)
        packed = packed.join(pack(bench, "m", "bench"), "event_id")
    else:
        empty = F.lit(None).cast("struct<bench:struct<close:double,t_end:timestamp>>")
        packed = packed.withColumns({f"m_{c}": empty for c in names})
    paths = bars.select("market").distinct().withColumn("_has_path", F.lit(True))
    wide = base.join(packed, "event_id", "left").join(paths, "market", "left")

    p0, p0_end = F.col("x_p0.hit.close"), F.col("x_p0.hit.t_end")
    lag = fn.seconds_between(F.col("x_p0.at_ts"), p0_end)
    b0, b0_end = F.col("m_p0.bench.close"), F.col("m_p0.bench.t_end")
    bench_ok = fn.seconds_between(F.col("x_p0.at_ts"), b0_end) <= rules.staleness
    usable = F.coalesce((p0 > 0) & (lag <= rules.staleness), F.lit(False))
    ex = F.col("ca_ex_date")
    voided = F.coalesce(usable & (ex >= p0_end) & (ex <= fn.plus_seconds(F.col("t0"), rules.horizon)), F.lit(False))

    out: dict[str, Column] = {}
    for c in rules.checkpoints:
        hit, at, mh = F.col(f"x_{c}.hit"), F.col(f"x_{c}.at_ts"), F.col(f"m_{c}.bench")
        ok = usable & (hit["t_end"] > p0_end) & (fn.seconds_between(at, hit["t_end"]) <= rules.staleness)
        if c == HEADLINE:
            ok = ok & ~voided
        else:
            ok = ok & ~(voided & F.col("price_source").isin(*rules.perp_sources) & (hit["t_end"] >= ex))
        m_ok = bench_ok & (mh["t_end"] > b0_end) & (fn.seconds_between(at, mh["t_end"]) <= rules.staleness)
        r = fn.log_ret(hit["close"], p0)
        out[f"p_{c}"] = F.when(ok, hit["close"])
        out[f"t_{c}"] = F.when(ok, hit["t_end"])
        out[f"s_{c}"] = F.when(ok, fn.seconds_between(at, hit["t_end"]) / 60.0)
        out[f"r_{c}"] = F.when(ok, r)
        out[f"ar_{c}"] = F.when(ok & m_ok, r - fn.log_ret(mh["close"], b0))
    r24 = out[f"r_{HEADLINE}"]
    reason = (F.when(F.col("t0").isNull(), "no_t0").when(F.col("_has_path").isNull(), "no_path")
              .when(p0.isNull() | (p0 <= 0), "no_p0").when(lag > rules.staleness, "p0_stale")
              .when(voided, "corporate_action").when(r24.isNull(), "no_24h_bar"))
    scored = wide.select(
        "event_id", "market", "t0", "price_source", F.when(p0 > 0, p0).alias("p0"),
        F.when(p0 > 0, p0_end).alias("p0_time"), F.when(p0 > 0, lag / 60.0).alias("p0_staleness_min"),
        *[v.alias(k) for k, v in out.items()], reason.alias("label_reason"))
    return attach_labels(scored, rules)


def attach_labels(wide: DataFrame, rules: TargetRules) -> DataFrame:
    """direction, magnitude, continuation outside the dead band and the measured horizon."""
    r24 = F.col(f"r_{HEADLINE}")
    cols = {
        "direction": fn.sign(r24), "magnitude": F.abs(r24),
        "horizon_actual_h": F.when(r24.isNotNull(), fn.seconds_between(F.col(f"t_{HEADLINE}"), F.col("p0_time")) / 3600.0),
    }
    for k in rules.continuation:
        rk = F.col(f"r_{k}")
        cols[f"continuation_{k}"] = F.when(F.abs(rk) >= rules.dead_band, fn.sign(rk) * fn.sign(r24 - rk))
    return wide.withColumns(cols)
