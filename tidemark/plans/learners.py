"""Boosted trees of `pyspark.ml` walk-forward by season, and tables about learners. Linear heads are in `linear_folds`.

Fits of independent (fold, head) pairs are submitted from a small thread pool; every fit is a
distributed job over the cached rows of its fold. Fewer than `MIN_ROWS` training rows fall back
to the base rate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.ranks import exact_quantiles
from tidemark.plans import baselines as bl
from tidemark.plans import linear_folds as lf
from tidemark.plans.evaluate import block_bootstrap
from tidemark.plans.training import TrainingSets, expanding, separate, windowed

MIN_ROWS = 30
KEYS = ["event_id", "fold"]


@dataclass
class Fitted:
    fold: int
    prep: PipelineModel
    features: list[str]
    ret: object | None
    direction: object | None


def preparation(features: Sequence[str]) -> Pipeline:
    """Median imputation, then standardisation."""
    filled = [f"{c}__filled" for c in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=list(features), outputCols=filled),
                            VectorAssembler(inputCols=filled, outputCol="_raw"),
                            StandardScaler(withMean=True, inputCol="_raw", outputCol="features")])


def tree_heads(rounds: int = 500, depth: int = 3):
    """Shallow boosted trees that stop early on a deterministic inner split."""
    common = dict(featuresCol="features", maxDepth=depth, minInstancesPerNode=20, maxIter=rounds, stepSize=0.05, validationIndicatorCol="inner_valid", seed=7)
    return (GBTRegressor(labelCol="y", predictionCol="_r", **common),
            GBTClassifier(labelCol="label", predictionCol="_c", **common).setRawPredictionCol("_raw_c").setProbabilityCol("_prob"))


def fit_fold(train: TrainingSets, fold: int, features: Sequence[str], heads: Callable) -> Fitted:
    """Both heads of one fold. Rows: seg, event_id, y, direction and the features."""
    h = F.pmod(F.xxhash64("event_id"), F.lit(10))
    rows = train.of(fold).withColumns({
        "inner_valid": h == 0, "label": F.when(F.col("direction") > 0, 1.0).when(F.col("direction") < 0, 0.0)})
    prep = preparation(features).fit(rows)
    z = prep.transform(rows).select("event_id", "y", "label", "inner_valid", "features").persist()
    try:
        n = z.agg(F.count("y").alias("n"), F.count("label").alias("d"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
        reg, clf = heads()
        ret = reg.fit(z.filter("y IS NOT NULL")) if n["n"] >= MIN_ROWS else None
        direction = clf.fit(z.filter("label IS NOT NULL")) if n["d"] >= MIN_ROWS and n["lo"] < n["hi"] else None
    finally:
        z.unpersist()
    return Fitted(fold, prep, list(features), ret, direction)


def fit_folds(train: TrainingSets, folds: Sequence[int], features: Sequence[str], heads: Callable, threads: int = 4) -> list[Fitted]:
    rows = train.rows.persist()  # once for all folds
    try:
        with ThreadPoolExecutor(max_workers=threads) as pool:
            return list(pool.map(lambda k: fit_fold(TrainingSets(rows, train.spans), k, features, heads), folds))
    finally:
        rows.unpersist()


def predict_fold(test: DataFrame, m: Fitted, rates: DataFrame, name: str) -> DataFrame:
    """Predictions of one fold with the base-rate fallback. `rates`: one row per fold."""
    t = m.prep.transform(test.filter(F.col("fold") == m.fold)).join(F.broadcast(rates), "fold")
    t = m.ret.transform(t) if m.ret is not None else t.withColumn("_r", F.col("mean_r"))
    t = m.direction.transform(t).withColumn("_p", vector_to_array("_prob")[1]) if m.direction is not None else t.withColumn("_p", F.col("up_rate"))
    return t.select("event_id", "t0", "fold", "y", F.lit(name).alias("model"), fn.clip_proba(F.col("_p")).alias("p_up"), F.col("_r").alias("r_hat"),
                    F.abs("_r").alias("magnitude_hat"))


def usable_folds(folds: DataFrame) -> list[int]:
    """Fold numbers: one per season, a bounded driver-side list."""
    return sorted(r["fold"] for r in folds.filter("fold >= 0").select("fold").collect())


def split(events: DataFrame, folds: DataFrame) -> tuple[TrainingSets, DataFrame]:
    train = expanding(events, folds)
    test = events.withColumn("season", fn.season(F.col("t0"))).join(F.broadcast(folds.filter("fold >= 0").select("season", "fold")), "season")
    return train, test


def walk_forward(events: DataFrame, folds: DataFrame, features: Sequence[str], heads: Callable, name: str, models: list[Fitted] | None = None) -> DataFrame:
    """Out-of-sample predictions of every usable fold. The fitted models are put into `models`, for what else is asked of them."""
    train, test = split(events, folds)
    rates = bl.base_rates(train)
    fitted = fit_folds(train, usable_folds(folds), features, heads)
    if models is not None:
        models += fitted
    parts = [predict_fold(test, m, rates, name) for m in fitted]
    return stacked(events.sparkSession, parts, "event_id bigint, t0 timestamp, fold int, y double, model string, p_up double, r_hat double, magnitude_hat double")


def stacked(spark: SparkSession, parts: Sequence[DataFrame], schema: str) -> DataFrame:
    """Union of per-fold results; an empty table of `schema` when no fold was usable."""
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def ensemble(preds: DataFrame, weights: dict[str, float], name: str = "ensemble") -> DataFrame:
    """Weighted mean of the members' forecasts on rows every member predicted."""
    total = sum(weights.values())
    w = fn.lookup(F.col("model"), {k: v / total for k, v in weights.items()}, 0.0)
    members = preds.filter(F.col("model").isin(*weights))
    out = members.groupBy("event_id", "decision_time").agg(
        F.count("*").alias("_n"), fn.clip_proba(F.sum(F.col("p_up") * w)).alias("p_up"), F.sum(F.col("r_hat") * w).alias("r_hat"),
        F.sum(F.coalesce("magnitude_hat", F.abs("r_hat")) * w).alias("magnitude_hat"))
    return out.filter(F.col("_n") == len(weights)).drop("_n").withColumn("model", F.lit(name))


def weight_rows(m: Fitted) -> list[tuple]:
    """(fold, head, feature, weight) of the fitted heads: gains of trees, coefficients of linear ones."""
    heads = {"return": m.ret, "direction": m.direction}
    vectors = {h: getattr(e, "featureImportances", None) or e.coefficients for h, e in heads.items() if e is not None}
    return [(m.fold, h, f, float(v[i])) for h, v in vectors.items() for i, f in enumerate(m.features)]


def shares(weights: DataFrame) -> DataFrame:
    """`share`: a feature's part of the absolute weight of its head; the shares of a head sum to 1, or are all 0. `weights`: fold, head, feature, weight,
    and model where there are several."""
    head = [c for c in ("model", "fold", "head") if c in weights.columns]
    size = weights.groupBy(*head).agg(F.sum(F.abs("weight")).alias("_size"))
    return weights.join(F.broadcast(size), head).withColumn("share", F.coalesce(F.try_divide(F.abs("weight"), F.col("_size")), F.lit(0.0))).drop("_size")


def importances(weights: DataFrame) -> DataFrame:
    """Share of a feature's absolute weight in its head, averaged over the heads of a fold. `weights`: fold,
    head, feature, weight, and model where there are several."""
    by = [c for c in ("model", "fold", "feature") if c in weights.columns]
    return shares(weights).groupBy(*by).agg(F.avg("share").alias("importance"))


def ensemble_importance(members: DataFrame, weights: dict[str, float], name: str = "ensemble") -> DataFrame:
    """Weighted mean of the members' importances per fold, over the members that have some there; a feature that a member doesn't know counts 0
    for it. `members`: model, fold, feature, importance."""
    own = members.filter(F.col("model").isin(*weights)).withColumn("_w", fn.lookup(F.col("model"), weights, 0.0))
    total = own.select("model", "fold", "_w").distinct().groupBy("fold").agg(F.sum("_w").alias("_total"))  # members of a fold
    mean = own.groupBy("fold", "feature").agg(F.sum(F.col("importance") * F.col("_w")).alias("_sum")).join(F.broadcast(total), "fold")
    return mean.select(F.lit(name).alias("model"), "fold", "feature", (F.col("_sum") / F.col("_total")).alias("importance"))


def weight_table(spark: SparkSession, models: dict[str, Sequence[tuple]]) -> DataFrame:
    """(model, fold, head, feature, weight) of fitted models, each given by its `weight_rows`: a row per fold, head and feature."""
    rows = [(name, *r) for name, own in models.items() for r in own]
    return spark.createDataFrame(rows, "model string, fold int, head string, feature string, weight double")


# ---- trials ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class Trial:
    no: int
    groups: tuple[str, ...]
    target: str
    seasons: int
    alpha: float


def trial_table(events: DataFrame, folds: DataFrame, groups: dict[str, tuple[str, ...]], trials: Sequence[Trial], *, min_train: int, replicates: int) -> DataFrame:
    """Objective (mean absolute error of r) of every declared trial over all folds, against the zero forecast,
    and how often a season bootstrap finds no improvement. Trials are a small declared list."""
    _, test = split(events, folds)
    out = events.sparkSession.createDataFrame([], "trial int, event_id bigint, season string, day string, ae double, ae0 double")
    for t in trials:
        feats = [c for g in t.groups for c in groups[g]]
        rows = windowed(events.withColumn("y", F.col(t.target)), folds, seasons=t.seasons, min_train=min_train)
        z = lf.scored(test, lf.fit(rows, feats, alphas=(t.alpha,), cs=()), feats).filter("push_r IS NOT NULL")
        r = F.aggregate("push_r", F.lit(0.0), lambda a, v: a + v)
        out = out.unionByName(z.select(F.lit(t.no).alias("trial"), "event_id", "season", F.date_format("t0", "yyyy-MM-dd").alias("day"),
                                       F.abs(F.col(t.target) - r).alias("ae"), F.abs(t.target).alias("ae0")))
    means = out.groupBy("trial").agg(F.avg("ae").alias("value"), (F.avg("ae0") - F.avg("ae")).alias("improvement"), F.count("ae").alias("n"))
    noise = block_bootstrap(out.withColumn("gain", F.col("ae0") - F.col("ae")), by=["trial"], value="gain", replicates=replicates)
    return means.join(noise.select("trial", "p_noise"), "trial", "left")


def final_cohort(events: DataFrame, *, min_train: int) -> DataFrame:
    """Trainable rows the final model uses: events with a perp when there are enough of them."""
    ok = events.filter(F.col("trainable"))
    n = ok.agg(F.count_if("has_perp").alias("_n"))  # one row
    return ok.join(F.broadcast(n)).filter((F.col("_n") < min_train) | F.col("has_perp")).withColumn(
        "cohort", F.when(F.col("_n") >= min_train, "has_perp").otherwise("all")).drop("_n")


BAND_ROWS = 30


def final_table(cohort: DataFrame, events: DataFrame, folds: DataFrame, features: Sequence[str]) -> DataFrame:
    """The final fit's residual band and where it comes from: out-of-sample residuals of the cohort, of all
    events where those are fewer than `BAND_ROWS`, else the residuals of the final fit on its own rows. The
    final fit uses every trainable row outside the holdout season."""
    held = folds.filter("held").select("season")
    own = cohort.filter("trainable").withColumn("season", fn.season(F.col("t0"))).join(F.broadcast(held), "season", "left_anti").withColumn("fold", F.lit(-1))
    sets = separate(own)
    final = lf.fit(sets, features)
    rates = bl.base_rates(sets)
    # a source is fitted only when those before it do not answer
    tables = [("walk_forward", lambda: lf.walk_forward(*split(cohort, folds), features, "linear")), ("walk_forward_all_events", lambda: lf.walk_forward(*split(events, folds), features, "linear")),
              ("in_sample", lambda: lf.predict(own, final, features, rates, "linear"))]
    for source, predicted in tables:
        known = predicted().filter("y IS NOT NULL")
        if source == "in_sample" or len(known.select("event_id").limit(BAND_ROWS).collect()) >= BAND_ROWS:
            return exact_quantiles(known.withColumn("res", F.col("y") - F.col("r_hat")), by=["model"], value="res", probs={"q10": 0.1, "q90": 0.9}).withColumn("band_source", F.lit(source))
    raise AssertionError("the last source always answers")
