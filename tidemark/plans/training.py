"""Training sets of many folds over one copy of the rows.

Every fold trains on a stretch of time: from some row on (the first, a season's start, or the row that a floor of events
reaches back to) and before its cutoff. The ends of all folds cut time into segments, at most two per fold. A row knows its
segment, a fold is a run of segments. Sums are made per segment and added up per fold; order statistics come from
counts per (value, segment), whose running sums over any run of segments are taken inside a range of values. So no row is copied
to the folds it trains.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn

RANGES = 64


@dataclass
class TrainingSets:
    """`rows` with `seg`; `spans` maps a fold to its segments, from the first up to but not including the second. Folds are seasons, a bounded list."""

    rows: DataFrame
    spans: dict[int, tuple[int, int]]

    def table(self) -> DataFrame:
        """(fold, _from, _to)"""
        return self.rows.sparkSession.createDataFrame([(k, a, z) for k, (a, z) in self.spans.items()], "fold int, _from int, _to int")

    def of(self, fold: int) -> DataFrame:
        a, z = self.spans[fold]
        return self.rows.filter((F.col("seg") >= a) & (F.col("seg") < z))

    def totals(self, by: Sequence[str], parts: dict[str, Column], rows: DataFrame | None = None) -> DataFrame:
        """Per `by` and fold: `n_` (values), the mean `a_` and the population variance `v_` of each part. A segment's values are summed about their
        own mean, and segments are merged about the fold's, so large means lose no digits."""
        by = list(by)
        rows = self.rows if rows is None else rows
        cols = [f for name, c in parts.items() for f in (F.count(c).alias(f"n_{name}"), F.avg(c).alias(f"a_{name}"), F.var_pop(c).alias(f"v_{name}"))]
        own = rows.groupBy(*by, "seg").agg(*cols)
        runs = own.join(F.broadcast(self.table()), (F.col("seg") >= F.col("_from")) & (F.col("seg") < F.col("_to")))  # segments x folds
        n = {p: F.col(f"n_{p}") for p in parts}
        mean = runs.groupBy(*by, "fold").agg(*[F.sum(n[p]).alias(f"_n_{p}") for p in parts], *[F.try_divide(F.sum(n[p] * F.col(f"a_{p}")), F.sum(n[p])).alias(f"_a_{p}") for p in parts])
        about = runs.join(F.broadcast(mean), [*by, "fold"])
        spread = [F.try_divide(F.sum(n[p] * (F.col(f"v_{p}") + (F.col(f"a_{p}") - F.col(f"_a_{p}")) ** 2)), F.sum(n[p])).alias(f"v_{p}") for p in parts]
        return about.groupBy(*by, "fold").agg(*[F.first(f"_n_{p}").alias(f"n_{p}") for p in parts], *[F.first(f"_a_{p}").alias(f"a_{p}") for p in parts], *spread)


def expanding(events: DataFrame, folds: DataFrame) -> TrainingSets:
    """Trainable rows before the cutoff of each fold, without the held-out season. `folds`: season, fold, cutoff, held."""
    known = folds.select("season", "fold", F.unix_micros(F.col("cutoff").cast("timestamp")).alias("at"), "held").collect()  # seasons
    return _cut(_usable(events, [r["season"] for r in known if r["held"]]), {r["fold"]: (None, r["at"]) for r in known if r["fold"] is not None})


def separate(train: DataFrame) -> TrainingSets:
    """Sets of rows that name their one fold in `fold`."""
    folds = sorted(r["fold"] for r in train.select("fold").distinct().collect())  # seasons
    place = fn.lookup(F.col("fold"), {k: i for i, k in enumerate(folds)}) if folds else F.lit(None)
    return TrainingSets(train.withColumn("seg", place.cast("int")), {k: (i, i + 1) for i, k in enumerate(folds)})


def _usable(events: DataFrame, held: Sequence[str]) -> DataFrame:
    return events.filter(F.col("trainable") & F.col("t0").isNotNull()).withColumn("season", fn.season(F.col("t0"))).filter(~F.col("season").isin(*held) if held else F.lit(True))


def _key(t0: Column, event: Column) -> Column:
    return F.struct(F.unix_micros(t0).alias("t"), event.cast("long").alias("id"))


def _cut(rows: DataFrame, stretches: dict[int, tuple[tuple[int, int] | None, int]]) -> TrainingSets:
    """Stretches are from a (microsecond, event_id), or the first row, up to a microsecond."""
    least = -(2**63)
    starts = {f: lo or (least, least) for f, (lo, _) in stretches.items()}
    ends = {f: (at, least) for f, (_, at) in stretches.items()}
    marks = sorted({*starts.values(), *ends.values()} - {(least, least)})
    text = ", ".join(f"named_struct('t', {_long(t)}, 'id', {_long(i)})" for t, i in marks)
    seg = F.size(F.filter(F.expr(f"array({text})"), lambda m: m <= _key(F.col("t0"), F.col("event_id")))) if marks else F.lit(0)
    place = {m: i + 1 for i, m in enumerate(marks)} | {(least, least): 0}
    return TrainingSets(rows.withColumn("seg", seg), {f: (place[starts[f]], place[ends[f]]) for f in stretches})


def _long(v: int) -> str:
    return f"{v}L" if v > -(2**63) else "bigint('-9223372036854775808')"


def window_starts(events: DataFrame, folds: DataFrame, *, seasons: int, min_train: int) -> DataFrame:
    """Per fold: where its training set begins if it keeps its last `seasons` seasons, floored at the `min_train` most recent events: fold, cutoff, n,
    lo_t0 and lo_id (the first row kept). Rows are counted per day; rows of one day per fold are ranked where the floor ends in it."""
    known = folds.select("season", "held").collect()
    rows = _usable(events, [r["season"] for r in known if r["held"]])
    key = F.struct("t0", F.col("event_id").cast("long").alias("id"))
    daily = rows.groupBy(F.to_date("t0").alias("d"), "season").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    f = F.broadcast(folds.filter(F.col("fold").isNotNull()).select("fold", "cutoff"))
    days = daily.join(f, F.col("d") < F.col("cutoff"))  # days x seasons
    by_fold = Window.partitionBy("fold")
    newest = by_fold.orderBy(F.col("season").desc())
    days = days.withColumn("_sr", F.dense_rank().over(newest)).withColumn("_ns", F.max("_sr").over(by_fold))
    days = days.withColumn("_nw", F.sum(F.when(F.col("_sr") <= seasons, F.col("n"))).over(by_fold)).withColumn("_all", F.sum("n").over(by_fold))
    short = (F.col("_ns") > seasons) & (F.col("_nw") < min_train)
    plain = days.filter(~short & (F.col("_sr") <= seasons)).groupBy("fold", "cutoff").agg(F.sum("n").alias("n"), F.min("first").alias("lo"))
    after = F.coalesce(F.sum("n").over(by_fold.orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = F.least(F.lit(min_train), F.col("_all"))
    last = days.filter(short).withColumn("_after", after).filter((F.col("_after") < reach) & (F.col("_after") + F.col("n") >= reach))
    last = last.select("fold", "cutoff", F.col("d").alias("_d"), (reach - F.col("_after")).alias("_k"), reach.alias("n"))
    ranked = rows.select("t0", "event_id", F.to_date("t0").alias("_d")).join(F.broadcast(last), "_d")  # the one day of each fold
    ranked = ranked.withColumn("_rn", F.row_number().over(by_fold.orderBy(F.col("t0").desc(), F.col("event_id").desc()))).filter(F.col("_rn") <= min_train)
    floor = ranked.filter(F.col("_rn") == F.col("_k")).select("fold", "cutoff", "n", key.alias("lo"))
    return plain.select("fold", "cutoff", "n", "lo").unionByName(floor).select("fold", "cutoff", "n", F.col("lo.t0").alias("lo_t0"), F.col("lo.id").alias("lo_id"))


def windowed(events: DataFrame, folds: DataFrame, *, seasons: int, min_train: int) -> TrainingSets:
    """Training sets of `window_starts`."""
    held = [r["season"] for r in folds.select("season", "held").collect() if r["held"]]
    starts = window_starts(events, folds, seasons=seasons, min_train=min_train).select(
        "fold", F.unix_micros(F.col("cutoff").cast("timestamp")).alias("at"), F.unix_micros("lo_t0").alias("t"), "lo_id").collect()  # folds
    return _cut(_usable(events, held), {r["fold"]: ((r["t"], r["lo_id"]), r["at"]) for r in starts})


def segment_quantiles(sets: TrainingSets, rows: DataFrame, *, by: Sequence[str], value: str, probs: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """Exact linearly interpolated quantiles per `by` and fold, and `n`. `rows`: by, seg and the value, of any number of rows per key. Equal values of a
    segment collapse; values are split into ranges; the counts per range and segment say in which range each fold's quantile lies, and how far in; only
    these ranges are sorted."""
    by = list(by)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, "seg", F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    cell = counts.join(F.broadcast(cuts), by) if by else counts.join(F.broadcast(cuts))  # a row per key
    cell = cell.withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    spans = F.broadcast(sets.table())
    sums = cell.groupBy(*by, "_r", "seg").agg(F.sum("_c").alias("_c"))
    sums = sums.join(spans, (F.col("seg") >= F.col("_from")) & (F.col("seg") < F.col("_to"))).groupBy(*by, "fold", "_from", "_to", "_r").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy(*by, "fold")  # ranges of a fold
    sums = sums.withColumn("_before", F.coalesce(F.sum("_c").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_c").over(w))
    at = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(tag).alias("tag"), F.least(F.floor(F.lit(p) * (F.col("n") - 1)) + F.lit(step), F.col("n") - 1).alias("at"))
                   for name, p in probs.items() for tag, step in (("lo", 0), ("hi", 1))])
    wanted = sums.select(*by, "fold", "_from", "_to", "_r", "_c", "_before", "n", F.explode(at).alias("_t")).filter(
        (F.col("_t.at") >= F.col("_before")) & (F.col("_t.at") < F.col("_before") + F.col("_c")))
    wanted = wanted.select(*by, "_r", "fold", "_from", "_to", "n", "_t.name", "_t.tag", (F.col("_t.at") - F.col("_before")).alias("_k"))
    need = wanted.select(*by, "_r").distinct()
    inside = cell.join(F.broadcast(need), [*by, "_r"]).select(*by, "_r", "seg", "_v", "_c")
    both = inside.unionByName(wanted, allowMissingColumns=True)
    kinds = dict(rows.dtypes)

    def found(t: pa.Table) -> pa.Table:
        ask = np.array(t.column("name").is_valid())
        v, c, seg = (t.column(x).to_numpy()[~ask] for x in ("_v", "_c", "seg"))
        order = np.argsort(v, kind="stable")
        v, c, seg = v[order], c[order].astype(np.int64), seg[order]
        asked = t.filter(pa.array(ask)).select(["fold", "_from", "_to", "n", "name", "tag", "_k"]).to_pylist()
        sums: dict = {}
        for r in asked:
            span = r["_from"], r["_to"]
            if span not in sums:
                sums[span] = np.cumsum(np.where((seg >= span[0]) & (seg < span[1]), c, 0))
            r["value"] = float(v[np.searchsorted(sums[span], r["_k"], side="right")])
        return pa.table({**{k: pa.array([t.column(k)[0].as_py()] * len(asked), t.schema.field(k).type) for k in by},
                         **{k: pa.array([r[k] for r in asked], kind) for k, kind in (("fold", pa.int32()), ("n", pa.int64()), ("name", pa.string()), ("tag", pa.string()), ("value", pa.float64()))}})

    got = both.groupBy(*by, "_r").applyInArrow(found, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "fold int, n long, name string, tag string, value double"]))
    pick = {(name, tag): F.max(F.when((F.col("name") == name) & (F.col("tag") == tag), F.col("value"))) for name in probs for tag in ("lo", "hi")}
    wide = got.groupBy(*by, "fold").agg(F.max("n").alias("n"), *[c.alias(f"_{tag}_{name}") for (name, tag), c in pick.items()])
    part = {name: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1)) for name, p in probs.items()}
    return wide.select(*by, "fold", "n", *[(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * part[k]).alias(k) for k in probs])
