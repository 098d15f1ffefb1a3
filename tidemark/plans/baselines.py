"""Baselines with fixed semantics: fold statistics joined to the rows they predict.

Training statistics are aggregates per fold (a small table, one row per fold, from sums per segment of time:
`plans/training.py`); predictions are projections over the test rows of that fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.plans.training import TrainingSets, expanding, segment_quantiles

NAMES = ("zero", "base_rate", "historical_mean", "hist_abs_mean", "vol_scaled", "sign_of_reaction", "always_extends", "surprise_sign")
QUANTILES = {"z10": 0.1, "z25": 0.25, "z50": 0.5, "z75": 0.75, "z90": 0.9}

# Feature preference, first available wins
SIGNALS = {
    "history": ("f_history_mean_r24h", "f_hist_r24_mean"),
    "history_abs": ("f_history_mean_abs_r24h", "f_hist_abs_r24_mean"),
    "rvol": ("f_pre_price_rvol_20d", "f_rvol_20d"),
    "reaction": ("f_r_now", "f_r_60m", "f_r_30m", "f_r_15m", "f_r_5m", "f_r_1m"),
    "surprise": ("f_surprise_eps_surprise_pct", "f_eps_surprise"),
}


def signal(df: DataFrame, name: str) -> Column:
    have = [F.col(c) for c in SIGNALS[name] if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


def _rates(direction: Column) -> dict[str, Column]:
    return {"up": F.when(direction > 0, 1.0).when(direction < 0, 0.0), "y": F.col("y"), "abs": F.abs("y")}


RATES = (("n_train", F.col, "n_y"), ("up_rate", lambda c: F.coalesce(fn.clip_proba(F.col(c)), F.lit(0.5)), "a_up"),
         ("mean_r", lambda c: F.coalesce(F.col(c), F.lit(0.0)), "a_y"), ("mean_abs_r", lambda c: F.coalesce(F.col(c), F.lit(0.0)), "a_abs"))


def base_rates(train: TrainingSets) -> DataFrame:
    """Per fold: up rate over non-zero labels (clipped), mean r, mean |r|. Rows: seg, y, direction."""
    sums = train.totals([], _rates(F.col("direction")))
    return sums.select("fold", *[f(c).alias(name) for name, f, c in RATES])


def fold_statistics(train: TrainingSets, *, names: Sequence[str] = NAMES, horizon_hours: float = 24.0) -> DataFrame:
    """One row per fold with what `names` need: base rates, the typical extension of the
    reaction, and the volatility calibration (pooled sigma, moments and quantiles of
    z = r / sigma). Moments share one pass over the training rows."""
    rows = train.rows
    rv = signal(rows, "rvol")
    sigma = F.when(rv > 0, rv) * F.sqrt(F.lit(horizon_hours / 24.0))
    z = F.col("y") / sigma
    parts = _rates(F.col("direction"))
    if "always_extends" in names:
        parts["extension"] = F.abs(F.col("y") - signal(rows, "reaction"))
    if "vol_scaled" in names:
        parts |= {"sigma": sigma, "z": z, "abs_z": F.abs(z)}
    sums = train.totals([], parts)
    cols = [f(c).alias(name) for name, f, c in RATES[1:]]
    if "always_extends" in names:
        cols.append(F.coalesce("a_extension", "a_abs", F.lit(0.0)).alias("extension"))
    if "vol_scaled" in names:
        sd = F.sqrt("v_y")
        cols += [F.coalesce("a_sigma", F.when(sd > 0, sd), F.lit(1.0)).alias("pooled_sigma"), F.coalesce("a_z", F.lit(0.0)).alias("z_mean"),
                 F.coalesce("a_abs_z", F.lit(0.0)).alias("z_abs_mean")]
    out = sums.select("fold", *cols)
    if "vol_scaled" in names:
        quantiles = segment_quantiles(train, rows.select("seg", z.alias("z")), by=[], value="z", probs=QUANTILES)
        out = out.join(quantiles.drop("n"), "fold", "left")
    return out


def predict(test: DataFrame, stats: DataFrame | None, *, names: Sequence[str] = NAMES, horizon_hours: float = 24.0) -> DataFrame:
    """One row per (test row, baseline): p_up, r_hat, magnitude_hat, q10 and q90 of vol_scaled.
    `test` carries fold; `stats` has one row per fold, so it is broadcast."""
    t = test if stats is None else test.join(F.broadcast(stats), "fold")
    h, ha, rv, rk, s = (signal(test, k) for k in ("history", "history_abs", "rvol", "reaction", "surprise"))
    up, m, ma = F.col("up_rate"), F.col("mean_r"), F.col("mean_abs_r")
    zero, null = F.lit(0.0), F.lit(None).cast("double")
    sigma = F.coalesce(F.when(rv > 0, rv) * F.sqrt(F.lit(horizon_hours / 24.0)), F.col("pooled_sigma"))

    def signed(x: Column) -> Column:
        return F.when(x.isNotNull(), fn.sign_proba(x)).otherwise(up)

    def cell(name: str) -> Column:
        p, r, mag, q10, q90 = {
            "zero": (F.lit(0.5), zero, zero, null, null), "base_rate": (up, m, None, null, null),
            "historical_mean": (signed(h), F.coalesce(h, m), None, null, null),
            "hist_abs_mean": (up, zero, F.coalesce(F.when(ha >= 0, ha), ma), null, null),
            "vol_scaled": (up, sigma * F.col("z_mean"), sigma * F.col("z_abs_mean"), sigma * F.col("z10"), sigma * F.col("z90")),
            "sign_of_reaction": (signed(rk), F.coalesce(rk, m), None, null, null),
            "always_extends": (signed(rk), F.coalesce(rk + F.signum(rk) * F.col("extension"), m), None, null, null),
            "surprise_sign": (signed(s), F.coalesce(F.signum(s) * ma, m), None, null, null)}[name]
        return F.struct(F.lit(name).alias("model"), p.alias("p_up"), r.alias("r_hat"), (F.abs(r) if mag is None else mag).alias("magnitude_hat"),
                        q10.alias("q10"), q90.alias("q90"))
    return t.select(*test.columns, F.explode(F.array(*[cell(n) for n in names])).alias("_c")).select(*test.columns, "_c.*")


def walk_forward(events: DataFrame, folds: DataFrame, *, names: Sequence[str] = NAMES) -> DataFrame:
    """Out-of-sample baseline predictions of every usable fold. `events`: t0, trainable, y,
    direction and `f_*` columns."""
    train = expanding(events, folds)
    test = events.withColumn("season", fn.season(F.col("t0"))).join(
        F.broadcast(folds.filter("fold IS NOT NULL").select("season", "fold")), "season")
    stats = None if set(names) == {"zero"} else fold_statistics(train, names=names)
    return predict(test, stats, names=names)
