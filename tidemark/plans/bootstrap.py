"""Bootstrap intervals of many statistics at once.

A statistic is a ratio of sums. Rows collapse to sums per (cell, season, day) first; what reaches a task is a cell's
days, which the calendar bounds. Draws are digests of (replicate, slot), so they depend on the number of blocks alone
and every run and engine gets the same ones. As a matrix of counts they meet the block sums of every statistic in
one product. A cell with too few seasons and days resamples single events: they are spread over ranges of their
digests, and each range finds its share of a replicate's draws by splitting them binomially from the whole down to
itself, so no row and no task holds all events. A rank correlation isn't a ratio of sums, but the rank of a value in
a replicate is linear in the block counts; each row brings the ranks that the blocks alone give it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

# Fixed values
MIN_BLOCKS = 5
LOW, HIGH = 2.5, 97.5

#: A replicate this close to 0 is no gain: the order of a sum doesn't decide.
ZERO = 1e-12

#: Events of a range, about, where single events are resampled.
RANGE_EVENTS = 16_384
#: Draws that are held at once there.
DRAWS = 1 << 22
#: Rows of a cell, about, whose ranks are computed together.
RANK_ROWS = 512
#: With too few seasons and days, a rank correlation resamples events in at most so many random groups.
RANK_GROUPS = 512
RANGES = 64


@lru_cache(maxsize=8)
def draws(size: int, replicates: int) -> np.ndarray:
    """How often each block is drawn, by replicate: as many draws as there are blocks."""
    out = np.zeros((replicates, size))
    for rep in range(replicates):
        got = [int(hashlib.md5(f"{rep}:{slot}".encode()).hexdigest()[:8], 16) % size for slot in range(size)]
        out[rep] = np.bincount(got, minlength=size)
    return out


def by_digest(labels: Sequence[str]) -> list[str]:
    return sorted(labels, key=lambda v: hashlib.md5(v.encode()).hexdigest())


def scheme_of(seasons: int, days: int) -> str:
    return "block:season" if seasons >= MIN_BLOCKS else "block:day" if days >= MIN_BLOCKS else "iid"


def _band(stat: np.ndarray) -> dict:
    stat = stat[np.isfinite(stat)]
    if not len(stat):
        return {"lo": None, "hi": None, "p_noise": None, "se_boot": None}
    lo, hi = np.percentile(stat, [LOW, HIGH])
    return {"lo": float(lo), "hi": float(hi), "p_noise": float((stat <= ZERO).mean()), "se_boot": float(stat.std(ddof=1)) if len(stat) > 1 else None}


BAND = "metric string, scheme string, n long, n_blocks long, point double, lo double, hi double, p_noise double, se_boot double"


def _schema(df: DataFrame, by: Sequence[str], rest: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in by), rest])


def intervals(rows: DataFrame, *, by: Sequence[str], metrics: Sequence[str], replicates: int, event: str = "event_id") -> DataFrame:
    """Intervals of the mean of every metric in every cell of `by`. `rows`: by, season, day, `event` and the metrics, null where a row has none."""
    by = list(by)
    sums = rows.groupBy(*by, "season", "day").agg(*[F.sum(m).alias(f"s_{m}") for m in metrics], *[F.count(m).alias(f"n_{m}") for m in metrics])
    bands = cut(block_intervals(sums, by=by, metrics=metrics, replicates=replicates))  # a row per cell and metric
    few = bands.filter("scheme = 'iid'")
    if few.isEmpty():
        return bands
    return bands.filter("scheme <> 'iid'").unionByName(event_intervals(rows, few, by=by, metrics=metrics, replicates=replicates, event=event))


def block_intervals(sums: DataFrame, *, by: Sequence[str], metrics: Sequence[str], replicates: int) -> DataFrame:
    """The same from sums: by, season, day, and s_ and n_ of each metric. Cells that need single events have no interval yet."""
    by, metrics = list(by), list(metrics)
    daily = sums.groupBy(*by, "season", "day").agg(*[F.sum(c).alias(c) for m in metrics for c in (f"s_{m}", f"n_{m}")])

    def solved(t: pa.Table) -> pa.Table:
        head = {c: t.column(c)[0].as_py() for c in by}
        season, day = (np.array(t.column(c).to_pylist(), object) for c in ("season", "day"))
        out = []
        for m in metrics:
            s, n = (t.column(f"{k}_{m}").to_numpy() for k in "sn")
            known = n > 0
            if not known.any():
                continue
            seasons, days = set(season[known]), set(day[known])
            scheme = scheme_of(len(seasons), len(days))
            one = {**head, "metric": m, "scheme": scheme, "n": int(n[known].sum()), "point": float(s[known].sum() / n[known].sum())}
            if scheme != "iid":
                label = season if scheme == "block:season" else day
                place = {b: i for i, b in enumerate(by_digest([str(b) for b in (seasons if scheme == "block:season" else days)]))}
                at = np.array([place[str(b)] for b in label[known]])
                blocks = np.stack([np.bincount(at, x[known], len(place)) for x in (s, n)], axis=1)
                total = draws(len(place), replicates) @ blocks
                one |= {"n_blocks": len(place), **_band(total[:, 0] / total[:, 1])}
            out.append(one)
        return pa.Table.from_pylist(out, kind)

    text = _schema(sums, by, BAND)
    kind = _arrow(sums, by).append(pa.field("metric", pa.string())).append(pa.field("scheme", pa.string())).append(pa.field("n", pa.int64())).append(pa.field("n_blocks", pa.int64()))
    for c in ("point", "lo", "hi", "p_noise", "se_boot"):
        kind = kind.append(pa.field(c, pa.float64()))
    return daily.groupBy(*by).applyInArrow(solved, text)


def _arrow(df: DataFrame, by: Sequence[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.select(*by).schema)


def _seed(*path) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(path).encode(), digest_size=8).digest(), "big"))


def share_of(counts: np.ndarray, part: int, replicates: int, name: str) -> np.ndarray:
    """How many of a replicate's draws, as many as there are events, fall into range `part`: all draws are halved binomially down to it.
    Any task that walks through a node gets the same numbers there."""
    lo, hi = 0, len(counts)
    held = np.full(replicates, int(counts.sum()))
    before = np.concatenate([[0], np.cumsum(counts)])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, all_ = int(before[mid] - before[lo]), int(before[hi] - before[lo])
        first = _seed(name, lo, hi).binomial(held, left / all_ if all_ else 0.0)
        held, lo, hi = (first, lo, mid) if part < mid else (held - first, mid, hi)
    return held


def event_intervals(rows: DataFrame, cells: DataFrame, *, by: Sequence[str], metrics: Sequence[str], replicates: int, event: str = "event_id",
                    range_events: int = RANGE_EVENTS) -> DataFrame:
    """Intervals of `cells` (by, metric, n, point) by resampling single events."""
    by = list(by)
    key = [*by, "metric"]
    long = rows.select(*by, event, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")).select(
        *by, "_m.metric", "_m.value", F.conv(F.substring(F.md5(F.col(event).cast("string")), 1, 8), 16, 10).cast("long").alias("_h")).filter("value is not null")
    sized = cells.select(*key, "n", F.greatest(F.lit(1), F.ceil(F.col("n") / range_events)).alias("_parts"))
    placed = cut(long.join(F.broadcast(sized.select(*key, "_parts")), key).withColumn("_part", F.floor(F.col("_h") * F.col("_parts") / F.lit(2.0**32)).cast("int")))
    full = placed.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = full.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_part", "_n"))).alias("_counts"))  # a number per range
    mine = [f"_h_{c}" for c in (*key, "_part")]
    header = full.join(counts, key).select(*[F.col(c).alias(f"_h_{c}") for c in (*key, "_part")], F.transform("_counts", lambda c: c["_n"]).alias("_counts"), F.transform("_counts", lambda c: c["_part"]).alias("_parts"))

    def drawn(head: pa.Table, t: pa.Table) -> pa.Table:
        first = head.slice(0, 1).to_pylist()[0]
        own, part = [first[c] for c in mine[:-1]], first[mine[-1]]
        name = repr(own)
        held = share_of(np.array(first["_counts"]), first["_parts"].index(part), replicates, name)
        value = t.column("value").to_numpy()[np.lexsort((t.column("value").to_numpy(), t.column("_h").to_numpy()))]
        chance, sums = _seed(name, "events", part), np.zeros(replicates)
        step = max(1, DRAWS // max(1, int(held.max(initial=1))))
        for lo in range(0, replicates, step):
            n = held[lo:lo + step]
            got = np.concatenate([[0.0], np.cumsum(value[chance.integers(0, len(value), int(n.sum()))])])
            ends = np.cumsum(n)
            sums[lo:lo + step] = got[ends] - got[ends - n]
        return pa.table({**{c: pa.array([v] * replicates, t.schema.field(c).type) for c, v in zip(key, own)}, "rep": np.arange(replicates), "s": sums})

    got = header.groupBy(*mine).cogroup(placed.groupBy(*key, "_part")).applyInArrow(drawn, _schema(placed, key, "rep long, s double"))
    stat = got.groupBy(*key, "rep").agg(F.sum("s").alias("s")).join(F.broadcast(cells.select(*key, "scheme", "n", "point")), key).withColumn("stat", F.col("s") / F.col("n"))
    out = stat.groupBy(*key, "scheme", "n", "point").agg(  # a number per replicate
        F.expr(f"percentile(stat, array({LOW / 100}, {HIGH / 100}))").alias("_q"), F.avg((F.col("stat") <= ZERO).cast("double")).alias("p_noise"), F.stddev_samp("stat").alias("se_boot"))
    return out.select(*key, "scheme", "n", F.col("n").alias("n_blocks"), "point", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"), "p_noise", "se_boot")


# ---- rank correlations -------------------------------------------------------------------------
def block_ranks(rows: DataFrame, *, by: Sequence[str], value: str, ranges: int = RANGES) -> DataFrame:
    """`ranks` of each distinct value of a cell: by block, the rows of it below the value and half of those equal to it. `rows`: by, value,
    idx (block), size (blocks of the cell) and weight. Values are split into ranges; a range starts from the blocks' rows in earlier ones."""
    by = list(by)
    counts = rows.groupBy(*by, "size", F.col(value).cast("double").alias("value"), "idx").agg(F.sum("weight").alias("weight"))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = counts.groupBy(*by).agg(F.percentile_approx("value", probs, 1000).alias("_cuts"))
    cell = counts.join(cuts, by).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col("value")))).drop("_cuts")
    earlier = cell.groupBy(*by, "size", "_r", "idx").agg(F.sum("weight").alias("weight")).withColumn(
        "_r", F.explode(F.sequence(F.col("_r") + 1, F.lit(ranges)))).groupBy(*by, "size", "_r", "idx").agg(F.sum("weight").alias("weight"))
    both = cell.unionByName(earlier.withColumn("value", F.lit(None).cast("double")))

    def ranked(t: pa.Table) -> pa.Table:
        idx, w = t.column("idx").to_numpy(), t.column("weight").to_numpy().astype(float)
        base = np.array(t.column("value").is_null())
        size = t.column("size")[0].as_py()
        before = np.bincount(idx[base], w[base], size)
        values, at = np.unique(t.column("value").to_numpy()[~base], return_inverse=True)
        own = np.zeros((len(values), size))
        np.add.at(own, (at, idx[~base]), w[~base])
        ranks = before + np.cumsum(own, axis=0) - own / 2
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * size, pa.int32()), pa.array(ranks.reshape(-1)))
        return pa.table({**{c: pa.array([t.column(c)[0].as_py()] * len(values), t.schema.field(c).type) for c in by}, "value": values, "ranks": lists})

    return both.groupBy(*by, "_r").applyInArrow(ranked, _schema(rows, by, "value double, ranks array<double>"))


def rank_gain(pairs: DataFrame, *, by: Sequence[str], model: str, baseline: str, truth: str, replicates: int, event: str = "event_id") -> DataFrame:
    """Interval of the gain in rank correlation with `truth` of `model` over `baseline` in every cell, from three events on. `pairs`: by, season, day,
    `event` and the three values, none null."""
    by = list(by)
    days = pairs.select(*by, "season", "day").distinct()  # bounded by the calendar
    found = days.groupBy(*by).agg(F.countDistinct("season").alias("_s"), F.countDistinct("day").alias("_d"))
    found = found.join(pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by).filter("n >= 3")
    scheme = F.when(F.col("_s") >= MIN_BLOCKS, "block:season").when(F.col("_d") >= MIN_BLOCKS, "block:day").otherwise("iid")
    found = cut(found.select(*by, "n", scheme.alias("scheme")))  # a row per cell
    group = F.pmod(F.xxhash64(event), F.lit(RANK_GROUPS)).cast("string")
    block = F.when(F.col("scheme") == "block:season", F.col("season")).when(F.col("scheme") == "block:day", F.col("day")).otherwise(
        F.when(F.col("n") <= RANK_GROUPS, F.col(event).cast("string")).otherwise(group))
    rows = pairs.join(F.broadcast(found), by).withColumn("block", block)
    rows = rows.groupBy(*by, "n", "scheme", "block", F.col(model).alias("x"), F.col(baseline).alias("z"), F.col(truth).alias("y")).agg(F.count(F.lit(1)).alias("weight"))
    blocks = rows.select(*by, "block").distinct()  # seasons, days or groups of a cell
    w = Window.partitionBy(*by)
    blocks = blocks.withColumn("idx", (F.row_number().over(w.orderBy(F.md5("block"))) - 1).cast("int")).withColumn("size", F.count(F.lit(1)).over(w).cast("int"))
    rows = cut(rows.join(F.broadcast(blocks), [*by, "block"]))  # ranked three times
    for c in "xzy":
        ranks = block_ranks(rows, by=by, value=c).select(*by, F.col("value").alias(f"_{c}"), F.col("ranks").alias(f"r{c}"))
        rows = rows.withColumn(f"_{c}", F.col(c).cast("double")).join(ranks, [*by, f"_{c}"]).drop(f"_{c}")
    chunk = F.pmod(F.xxhash64("x", "z", "y", "block"), F.greatest(F.lit(1), F.ceil(F.col("n") / RANK_ROWS))).alias("_chunk")
    names = ["w", "xx", "zz", "yy", "xy", "zy", "mx", "mz", "my"]

    def summed(t: pa.Table) -> pa.Table:
        size = t.column("size")[0].as_py()
        times = np.concatenate([np.ones((1, size)), draws(size, replicates)])  # replicate -1: the rows as they are
        w = times[:, t.column("idx").to_numpy()] * t.column("weight").to_numpy()
        middle = t.column("n")[0].as_py() / 2  # keeps the squares small
        x, z, y = (times @ np.stack([np.asarray(v) for v in t.column(f"r{c}").to_pylist()]).T - middle for c in "xzy")
        sums = [w.sum(axis=1), *((w * a * b).sum(axis=1) for a, b in ((x, x), (z, z), (y, y), (x, y), (z, y))), *((w * a).sum(axis=1) for a in (x, z, y))]
        return pa.table({**{c: pa.array([t.column(c)[0].as_py()] * len(times), t.schema.field(c).type) for c in by}, "rep": np.arange(len(times)) - 1, **dict(zip(names, sums))})

    part = rows.select(*by, "n", "size", "idx", "weight", "rx", "rz", "ry", chunk).groupBy(*by, "_chunk").applyInArrow(
        summed, _schema(rows, by, "rep long, " + ", ".join(f"{c} double" for c in names)))
    g = part.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in names])

    def centred(a: str, b: str):
        return F.col(a + b) - F.col(f"m{a}") * F.col(f"m{b}") / F.col("w")

    def corr(a: str):
        both = centred(a, a) * centred("y", "y")
        return F.when(both > 0, centred(a, "y") / F.sqrt(both))

    stat = g.select(*by, "rep", (corr("x") - corr("z")).alias("stat"))
    drawn = F.when(F.col("rep") >= 0, F.col("stat"))
    out = stat.groupBy(*by).agg(F.max(F.when(F.col("rep") < 0, F.col("stat"))).alias("point"), F.expr(f"percentile(CASE WHEN rep >= 0 THEN stat END, array({LOW / 100}, {HIGH / 100}))").alias("_q"),
                                F.avg((drawn <= ZERO).cast("double")).alias("p_noise"), F.stddev_samp(drawn).alias("se_boot"))
    sizes = blocks.groupBy(*by).agg(F.count(F.lit(1)).alias("n_blocks"))
    return out.join(found, by).join(sizes, by).select(*by, F.lit("spearman_ic").alias("metric"), "scheme", "n", "n_blocks", "point", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"), "p_noise", "se_boot")
