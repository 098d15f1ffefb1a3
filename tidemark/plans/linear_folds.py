"""Ridge and logistic heads of all folds at once.

A linear head only needs sums over its training rows, so every pass over the rows serves all folds,
all strengths and all inner splits: ridge is solved from one pass (the sums of each inner split give
every held-out error in closed form), the logistic heads by Newton steps, one pass each. Tasks sum what
they read and emit a row per model and entry; the driver holds folds x strengths x splits small matrices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.plans import baselines as bl
from tidemark.plans.training import TrainingSets, segment_quantiles, separate

# Strengths tried, on standardised features
RIDGE = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)
LOGISTIC_C = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)
CV_FOLDS, MIN_ROWS = 5, 30
NEWTON_STEPS, CLOSE = 25, 1e-9


@dataclass
class Heads:
    """What one fold needs to predict; a head without enough rows is None."""

    fold: int
    median: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    ret: np.ndarray | None        # intercept first
    direction: np.ndarray | None


def preparation(train: TrainingSets, features: Sequence[str]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per fold: exact medians, then means and deviations of the features filled with them; all features and folds in one pass each. A constant
    feature keeps a deviation of one, so it adds nothing. A feature without a value is 0."""
    names = list(features)
    values = train.rows.select("seg", F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(names)])).alias("_f")).select("seg", "_f.*")
    med = {(r["fold"], r["feature"]): r["med"] for r in segment_quantiles(train, values, by=["feature"], value="value", probs={"med": 0.5}).collect()}  # folds x features
    parts = {"all": F.lit(1.0)} | {f"x{i}": F.col(c).cast("double") for i, c in enumerate(names)}
    out = {}
    for r in train.totals([], parts).collect():  # a row per fold
        median, mean, sd = (np.zeros(len(names)) for _ in range(3))
        for i in range(len(names)):
            n, have, own, var = r["n_all"], r[f"n_x{i}"], r[f"a_x{i}"] or 0.0, r[f"v_x{i}"] or 0.0
            median[i] = med.get((r["fold"], i), 0.0)
            mean[i] = (have * own + (n - have) * median[i]) / n
            sd[i] = np.sqrt((have * (var + (own - mean[i]) ** 2) + (n - have) * (median[i] - mean[i]) ** 2) / n)
        out[r["fold"]] = median, mean, np.where(sd > 1e-12 * np.maximum(1, np.abs(mean)), sd, 0.0)
    return out


def _sums(train: TrainingSets, features: Sequence[str], prep: dict, add) -> dict[tuple, np.ndarray]:
    """`add(fold, design matrix, y, label, split, out)` on the rows of every fold and batch, `out` mapping
    a key of three integers to an array; the arrays summed over all tasks. A row is read once for all its folds."""
    spans = train.spans

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple, np.ndarray] = {}
        for b in batches:
            seg = b.column("seg").to_numpy()
            x = np.stack([b.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], axis=1)
            y, label, split = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "label", "split"))
            for k, (median, mean, sd) in prep.items():
                own = (seg >= spans[k][0]) & (seg < spans[k][1])
                if not own.any():
                    continue
                z = (np.where(np.isnan(x[own]), median, x[own]) - mean) / np.where(sd > 0, sd, 1.0)
                add(k, np.column_stack([np.ones(len(z)), z]), y[own], label[own], split[own].astype(int), out)
        keys = [k for k, v in out.items() for _ in range(v.size)]
        cols = [pa.array(c, pa.int32()) for c in zip(*keys)] if keys else [pa.array([], pa.int32())] * 3
        place = pa.array([i for v in out.values() for i in range(v.size)], pa.int32())
        yield pa.RecordBatch.from_arrays([*cols, place, pa.array(np.concatenate([v.ravel() for v in out.values()]) if out else np.zeros(0))],
                                         ["fold", "a", "b", "place", "value"])

    d = F.col("direction")
    rows = train.rows.select("seg", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col("y").cast("double"),
                        F.when(d > 0, 1.0).when(d < 0, 0.0).alias("label"), F.pmod(F.xxhash64("event_id"), F.lit(CV_FOLDS)).cast("int").alias("split"))
    got = rows.mapInArrow(summed, "fold int, a int, b int, place int, value double").groupBy("fold", "a", "b", "place").agg(F.sum("value").alias("value")).collect()
    out: dict[tuple, dict[int, float]] = {}
    for r in got:
        key = r["fold"], r["a"], r["b"]
        out.setdefault(key, {})[r["place"]] = r["value"]
    return {key: np.array([v[i] for i in range(len(v))]) for key, v in out.items()}


def _penalty(width: int, strength: float) -> np.ndarray:
    p = np.eye(width) * strength
    p[0, 0] = 0.0
    return p


def ridge(train: TrainingSets, features: Sequence[str], prep: dict, alphas: Sequence[float]) -> dict[int, np.ndarray]:
    """Coefficients per fold, the strength with the least squared error on held-out splits (the weakest on ties)."""
    width = len(features) + 1

    def add(k, design, y, _label, split, out):
        ok = ~np.isnan(y)
        for s in np.unique(split[ok]).tolist():
            at = ok & (split == s)
            full = np.column_stack([design[at], y[at]])
            out[k, s, 0] = out.get((k, s, 0), 0) + full.T @ full
    sums = _sums(train, features, prep, add)
    out = {}
    for k in prep:
        parts = [v.reshape(width + 1, width + 1) for (f, _, _), v in sorted(sums.items()) if f == k]
        whole = sum(parts) if parts else np.zeros((width + 1, width + 1))
        if whole[0, 0] < MIN_ROWS:
            continue

        def solved(m, alpha):
            return np.linalg.lstsq(m[:-1, :-1] + _penalty(width, alpha), m[:-1, -1], rcond=None)[0]

        def held_out(alpha):
            total = 0.0
            for p in parts:
                e = np.append(-solved(whole - p, alpha), 1.0)
                total += e @ p @ e
            return total
        best = min(sorted(alphas), key=held_out) if len(alphas) > 1 else alphas[0]
        out[k] = solved(whole, best)
    return out


def logistic(train: TrainingSets, features: Sequence[str], prep: dict, cs: Sequence[float]) -> dict[int, np.ndarray]:
    """Coefficients per fold, the strength with the least log loss averaged over held-out splits (the strongest
    penalty on ties). Split -1 is a model of all rows."""
    width = len(features) + 1
    splits = [-1, *range(CV_FOLDS)] if len(cs) > 1 else [-1]
    models = {(k, i, s): np.zeros(width) for k in prep for i in range(len(cs)) for s in splits}
    live = set(models)
    size = _sums(train, features, prep, lambda k, d, y, label, s, out: out.update(
        {(k, 0, 0): out.get((k, 0, 0), 0) + np.array([(~np.isnan(label)).sum(), (label == 1).sum()], float)}))
    usable = {k for (k, _, _), v in size.items() if v[0] >= MIN_ROWS and min(v[1], v[0] - v[1]) >= 2}
    live = {m for m in live if m[0] in usable}
    for _ in range(NEWTON_STEPS):
        if not live:
            break

        def add(k, design, _y, label, split, out, live=frozenset(live), models=dict(models)):
            for m in (m for m in live if m[0] == k):
                at = ~np.isnan(label) & (split != m[2])
                x = design[at]
                p = 1 / (1 + np.exp(-np.clip(x @ models[m], -35, 35)))
                part = np.concatenate([x.T @ (label[at] - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
                out[m] = out.get(m, 0) + part
        sums = _sums(train, features, prep, add)
        for m in list(live):
            got = sums.get(m, np.zeros(width + width * width))
            pen = _penalty(width, 1 / cs[m[1]])
            step = np.linalg.lstsq(got[width:].reshape(width, width) + pen + np.eye(width) * 1e-12, got[:width] - pen @ models[m], rcond=None)[0]
            models[m] = models[m] + np.clip(step, -5, 5)
            if np.abs(step).max() < CLOSE:
                live.discard(m)
    if len(cs) == 1:
        return {k: models[k, 0, -1] for k in usable}

    def losses(k, design, _y, label, split, out):
        for i in range(len(cs)):
            for s in range(CV_FOLDS):
                at = ~np.isnan(label) & (split == s)
                if at.any():
                    p = np.clip(1 / (1 + np.exp(-np.clip(design[at] @ models[k, i, s], -35, 35))), 1e-3, 1 - 1e-3)
                    loss = -(label[at] * np.log(p) + (1 - label[at]) * np.log(1 - p)).sum()
                    out[k, i, s] = out.get((k, i, s), 0) + np.array([loss, at.sum()], float)
    sums = _sums(train, features, prep, losses)
    out = {}
    for k in usable:
        mean = [(np.mean([v[0] / v[1] for (f, a, _), v in sums.items() if (f, a) == (k, i)]), cs[i], i) for i in range(len(cs))]
        out[k] = models[k, min((round(m, 12), c, i) for m, c, i in mean)[2], -1]
    return out


def fit(train: TrainingSets | DataFrame, features: Sequence[str], *, alphas: Sequence[float] = RIDGE, cs: Sequence[float] = LOGISTIC_C) -> list[Heads]:
    """Both heads of every fold. Rows: seg (or fold, where each row has its one fold), event_id, y, direction and the features."""
    sets = train if isinstance(train, TrainingSets) else separate(train)
    rows = sets.rows.select("seg", "event_id", "y", "direction", *features).persist()
    sets = TrainingSets(rows, sets.spans)
    try:
        prep = preparation(sets, features)
        returns = ridge(sets, features, prep, alphas) if alphas else {}
        directions = logistic(sets, features, prep, cs) if cs else {}
    finally:
        rows.unpersist()
    return [Heads(k, *prep[k], returns.get(k), directions.get(k)) for k in sorted(prep)]


def scored(test: DataFrame, models: Sequence[Heads], features: Sequence[str]) -> DataFrame:
    """`test` (with fold) and what each feature adds to either head: `push_r` and `push_d`, arrays with the intercept
    first, null without a head. One pass over all folds, joined with one small row per fold."""
    spark = test.sparkSession
    table = spark.createDataFrame([(m.fold, m.median.tolist(), m.mean.tolist(), [s if s > 0 else 1.0 for s in m.sd.tolist()],
                                    None if m.ret is None else m.ret.tolist(), None if m.direction is None else m.direction.tolist()) for m in models],
                                  "fold int, _med array<double>, _mean array<double>, _sd array<double>, _r array<double>, _d array<double>")
    out = test.join(F.broadcast(table), "fold")
    z = [(F.coalesce(F.col(c).cast("double"), F.col("_med")[i]) - F.col("_mean")[i]) / F.col("_sd")[i] for i, c in enumerate(features)]

    def push(head: str):
        return F.when(F.col(head).isNotNull(), F.array(F.col(head)[0], *[v * F.col(head)[i + 1] for i, v in enumerate(z)]))
    return out.withColumns({"push_r": push("_r"), "push_d": push("_d")}).drop("_med", "_mean", "_sd", "_r", "_d")


def _total(c: str):
    return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)


def predict(test: DataFrame, models: Sequence[Heads], features: Sequence[str], rates: DataFrame, name: str) -> DataFrame:
    """Predictions of all folds with the base-rate fallback. `rates`: one row per fold."""
    t = scored(test, models, features).join(F.broadcast(rates), "fold")
    p = F.coalesce(1 / (1 + F.exp(-_total("push_d"))), F.col("up_rate"))
    r = F.coalesce(_total("push_r"), F.col("mean_r"))
    return t.select("event_id", "t0", "fold", "y", F.lit(name).alias("model"), fn.clip_proba(p).alias("p_up"), r.alias("r_hat"), F.abs(r).alias("magnitude_hat"))


def walk_forward(train: TrainingSets, test: DataFrame, features: Sequence[str], name: str, **grid) -> DataFrame:
    """Out-of-sample predictions of every usable fold."""
    return predict(test, fit(train, features, **grid), features, bl.base_rates(train), name)


def contributions(test: DataFrame, models: Sequence[Heads], features: Sequence[str]) -> DataFrame:
    """(event_id, fold, head, feature, push): what each feature and the bias add; they sum to r_hat, and to the
    log odds of the direction head."""
    names = F.array(*[F.lit(n) for n in ("bias", *features)])
    heads = F.array(F.struct(F.lit("return").alias("head"), F.col("push_r").alias("push")), F.struct(F.lit("direction").alias("head"), F.col("push_d").alias("push")))
    out = scored(test, models, features).select("event_id", "fold", F.explode(heads).alias("h"))
    return out.select("event_id", "fold", "h.head", F.explode(F.arrays_zip(names.alias("feature"), F.col("h.push").alias("push"))).alias("c")).select("event_id", "fold", "head", "c.feature", "c.push")


def weight_rows(models: Sequence[Heads], features: Sequence[str]) -> list[tuple]:
    """(fold, head, feature, weight) of the fitted heads."""
    return [(m.fold, head, f, float(v[i + 1])) for m in models for head, v in (("return", m.ret), ("direction", m.direction)) if v is not None
            for i, f in enumerate(features)]
