"""Folds, scores, cells, bootstrap intervals and paired comparisons."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.ranks import spearman
from tidemark.plans.bootstrap import block_intervals, event_intervals, intervals, rank_gain
from tidemark.plans.training import TrainingSets, segment_quantiles
from tidemark.session import cut

# Fixed values
HEADLINE_SOURCES = ("sec_8k", "manual", "detected")
HIGHER_IS_BETTER = {"accuracy": True, "brier": False, "log_loss": False, "spearman_ic": True, "mae": False, "magnitude_mae": False}
SCORE_OF = {"accuracy": "hit", "brier": "brier", "log_loss": "ll", "mae": "ae", "magnitude_mae": "mag_ae"}
MDE_METRICS = ("accuracy", "brier")
MAX_NONFINITE_SHARE = 0.1


def fill_if_all_null(df: DataFrame, source: DataFrame, *, key: str, column: str, other: str, default: str) -> DataFrame:
    """Fill `column` from `source` only when no row of `df` carries a value."""
    have = df.agg((F.count(column) > 0).alias("_have"))  # one row
    j = df.join(source, key, "left").join(F.broadcast(have))
    filled = F.when(F.col("_have"), F.col(column)).otherwise(F.coalesce(F.col(other), F.lit(default)))
    return j.withColumn(column, filled).drop("_have", other)


def prepare_rows(df: DataFrame, *, target: str, label: str | None, min_confidence: float) -> DataFrame:
    """`y`, `direction` (given label, else the sign of y) and `trainable`."""
    y = F.col(target)
    d = F.coalesce(F.col(label), fn.sign(y)) if label else fn.sign(y)
    ok = (F.coalesce("t0_confidence", F.lit(0.0)) >= min_confidence) & ~F.coalesce("target_missing", F.lit(False)) & y.isNotNull()
    return df.withColumns({"y": y, "direction": d, "trainable": ok})


def validate_predictions(df: DataFrame) -> DataFrame:
    """Clip p, fill magnitudes from |r_hat| and make them non-negative; a model with more than
    a tenth of its probabilities missing is rejected (`accepted` is false on its rows)."""
    bad = F.col("p_up").isNull() | F.isnan("p_up")
    share = df.groupBy("model").agg(F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("_bad"))
    out = df.join(F.broadcast(share), "model")  # one row per model
    return out.withColumns({
        "p_up": F.when(~bad, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p_up")))),
        "magnitude_hat": F.abs(F.coalesce("magnitude_hat", "r_hat")),
        "accepted": F.col("_bad") <= MAX_NONFINITE_SHARE}).drop("_bad")


def score_rows(preds: DataFrame) -> DataFrame:
    """Per-row scores; direction scores are null on a zero or missing label."""
    p, r = F.col("p_up"), F.col("r_true")
    up = F.when(r > 0, 1.0).when(r < 0, 0.0)
    pc = F.greatest(F.lit(fn.LOG_LOSS_EPS), F.least(F.lit(1 - fn.LOG_LOSS_EPS), p))
    return preds.withColumns({
        "direction": fn.sign(r),
        "hit": F.when(up.isNotNull() & p.isNotNull(), F.when(p == 0.5, 0.5).when((p > 0.5) == (up == 1.0), 1.0).otherwise(0.0)),
        "brier": (p - up) * (p - up), "ll": -(up * F.log(pc) + (1 - up) * F.log(1 - pc)),
        "ae": F.abs(r - F.col("r_hat")), "mag_ae": F.abs(F.abs(r) - F.coalesce("magnitude_hat", F.abs("r_hat"))),
        "season": fn.season(F.col("t0")), "day": F.date_format("t0", "yyyy-MM-dd")})


NAMED_STRATA = ("t0_source", "kind", "timing")


def explode_subsets(df: DataFrame, *, min_confidence: float = 0.6, strata: Sequence[str] = NAMED_STRATA) -> DataFrame:
    """One copy of a scorable row per named subset it belongs to (they overlap)."""
    perp = F.coalesce("has_perp", F.lit(False))
    head = perp & (F.col("t0_confidence") >= min_confidence) & F.col("t0_source").isin(*HEADLINE_SOURCES)
    names = [F.lit("all"), F.when(perp, "has_perp_at_t0"), F.when(head, "headline"),
             *[F.concat(F.lit(f"{c}="), F.col(c)) for c in strata]]
    return (df.filter(F.col("r_true").isNotNull())
            .withColumn("subset", F.explode(F.filter(F.array(*names), lambda v: v.isNotNull()))))


def classification_aggs() -> list[Column]:
    recalls = [F.avg(F.when(F.col("direction") == s, F.col("hit"))) for s in (-1.0, 1.0)]
    balanced = F.when(recalls[0].isNull(), recalls[1]).when(recalls[1].isNull(), recalls[0]).otherwise((recalls[0] + recalls[1]) / 2)
    return [F.count("hit").alias("n_direction"), F.avg("hit").alias("accuracy"), balanced.alias("balanced_accuracy"),
            F.avg("brier").alias("brier"), F.avg("ll").alias("log_loss")]


def regression_aggs() -> list[Column]:
    err = F.col("r_true") - F.col("r_hat")
    return [F.count(err).alias("n_return"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse")]


STRATA = ("has_perp", "confident", *NAMED_STRATA)


def to_subsets(strata: DataFrame) -> DataFrame:
    """One copy of a stratum's row per named subset it belongs to."""
    perp = F.coalesce("has_perp", F.lit(False))
    head = perp & F.col("confident") & F.col("t0_source").isin(*HEADLINE_SOURCES)
    names = [F.lit("all"), F.when(perp, "has_perp_at_t0"), F.when(head, "headline"), *[F.concat(F.lit(f"{c}="), F.col(c)) for c in NAMED_STRATA]]
    return strata.withColumn("subset", F.explode(F.filter(F.array(*names), lambda v: v.isNotNull())))


def eval_cells(scores: DataFrame, by: Sequence[str] = ("model", "decision_time"), *, min_confidence: float = 0.6, replicates: int = 0) -> DataFrame:
    """All metrics per cell (`by` and subset), with bootstrap intervals of the means where `replicates` are asked for. Every metric is a ratio of sums, so rows are summed per stratum
    first and only the few strata rows are copied to the overlapping subsets they belong to;
    the rank correlation does the same with counts of equal (r_hat, r_true) pairs."""
    by = list(by)
    d, hit = F.col("direction"), F.col("hit")
    err = F.col("r_true") - F.col("r_hat")
    parts = {"n": F.lit(1), "n_direction": hit.isNotNull().cast("int"), "s_hit": hit, "n_up": (hit.isNotNull() & (d > 0)).cast("int"), "s_up": F.when(d > 0, hit),
             "n_down": (hit.isNotNull() & (d < 0)).cast("int"), "s_down": F.when(d < 0, hit), "s_brier": F.col("brier"), "s_ll": F.col("ll"),
             "n_return": err.isNotNull().cast("int"), "s_abs": F.abs(err), "s_sq": err * err, "n_mag": F.col("mag_ae").isNotNull().cast("int"), "s_mag": F.col("mag_ae")}
    rows = scores.filter(F.col("r_true").isNotNull()).withColumn("confident", F.coalesce(F.col("t0_confidence") >= min_confidence, F.lit(False)))
    keys = [*by, *STRATA]
    cell = [*by, "subset"]
    strata = rows.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in parts.items()])
    g = to_subsets(strata).groupBy(*cell).agg(*[F.sum(k).alias(k) for k in parts])
    ratio = F.try_divide
    up, down = ratio(F.col("s_up"), F.col("n_up")), ratio(F.col("s_down"), F.col("n_down"))
    base = g.select(*cell, "n", "n_direction", "n_return", ratio(F.col("s_hit"), F.col("n_direction")).alias("accuracy"),
                    F.when(up.isNull(), down).when(down.isNull(), up).otherwise((up + down) / 2).alias("balanced_accuracy"),
                    ratio(F.col("s_brier"), F.col("n_direction")).alias("brier"), ratio(F.col("s_ll"), F.col("n_direction")).alias("log_loss"),
                    ratio(F.col("s_abs"), F.col("n_return")).alias("mae"), F.sqrt(ratio(F.col("s_sq"), F.col("n_return"))).alias("rmse"),
                    ratio(F.col("s_mag"), F.col("n_mag")).alias("magnitude_mae"))
    pairs = rows.groupBy(*keys, "r_hat", "r_true").agg(F.count("*").alias("_k"))
    sizes = rows.select(*keys, F.coalesce("magnitude_hat", F.abs("r_hat")).alias("size_hat"), F.abs("r_true").alias("size")).groupBy(*keys, "size_hat", "size").agg(F.count("*").alias("_k"))
    magnitude = spearman(to_subsets(sizes), by=cell, x="size_hat", y="size", weight="_k").withColumnRenamed("spearman_ic", "magnitude_ic")
    out = base.join(spearman(to_subsets(pairs), by=cell, x="r_hat", y="r_true", weight="_k"), cell, "left").join(magnitude, cell, "left")
    if not replicates:
        return out
    bands = cell_intervals(rows, by=cell, keys=keys, spread=to_subsets, metrics=SCORE_OF, replicates=replicates)
    wide = bands.groupBy(*cell).pivot("metric", list(SCORE_OF)).agg(F.max("scheme").alias("scheme"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.join(wide, cell, "left")


def cell_intervals(rows: DataFrame, *, by: Sequence[str], keys: Sequence[str], spread: Callable[[DataFrame], DataFrame], metrics: Mapping[str, str], replicates: int) -> DataFrame:
    """Intervals of all `metrics` (name: column) of all cells in one pass. Rows are summed per stratum (`keys`) and day before `spread` copies
    the sums to the cells they belong to. Only cells that must resample single events see rows again."""
    named = rows.select(*keys, "event_id", "season", "day", *[F.col(c).alias(m) for m, c in metrics.items()])
    sums = named.groupBy(*keys, "season", "day").agg(*[f(m).alias(f"{tag}_{m}") for m in metrics for tag, f in (("s", F.sum), ("n", F.count))])
    bands = cut(block_intervals(spread(sums), by=by, metrics=list(metrics), replicates=replicates))  # a row per cell and metric
    few = bands.filter("scheme = 'iid'")
    if few.isEmpty():
        return bands
    return bands.filter("scheme <> 'iid'").unionByName(event_intervals(spread(named), few, by=by, metrics=list(metrics), replicates=replicates))


def calibration(scores: DataFrame, *, bins: int = 10) -> DataFrame:
    """Reliability table per model with empty bins kept."""
    known = scores.filter(F.col("hit").isNotNull())
    which = F.greatest(F.lit(0), F.least(F.floor(F.col("p_up") * bins), F.lit(bins - 1))).cast("int")
    got = known.groupBy("model", which.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p_up").alias("mean_p"), F.avg(F.when(F.col("r_true") > 0, 1.0).otherwise(0.0)).alias("frac_up"))
    grid = known.select("model").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(got, ["model", "bin"], "left")
    return out.select("model", "bin", (F.col("bin") / bins).alias("p_lo"), ((F.col("bin") + 1) / bins).alias("p_hi"),
                      F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "frac_up", (F.col("frac_up") - F.col("mean_p")).alias("gap"))


def paired(scores: DataFrame, model: str, baseline: str, columns: Sequence[str]) -> DataFrame:
    """Scores of a model and a baseline on their common events."""
    def side(name: str, tag: str) -> DataFrame:
        return scores.filter(F.col("model") == name).select("event_id", "decision_time", *[F.col(c).alias(f"{tag}_{c}") for c in columns])
    extra = scores.filter(F.col("model") == model).select("event_id", "decision_time", "season", "day")
    return extra.join(side(model, "m"), ["event_id", "decision_time"]).join(side(baseline, "b"), ["event_id", "decision_time"])


def best_baseline(cells: DataFrame, baselines: Sequence[str], by: Sequence[str] = ("decision_time", "subset")) -> DataFrame:
    """Best baseline per cell and metric; on ties the first in `baselines`."""
    pos = fn.lookup(F.col("model"), {m: i for i, m in enumerate(baselines)})
    cells = cells.filter(F.col("model").isin(*baselines) & (F.col("n") > 0))
    long = cells.select(*by, "model", pos.alias("_pos"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (F.col(m) * (-1.0 if up else 1.0)).alias("_loss"))
        for m, up in HIGHER_IS_BETTER.items()])).alias("_m")).select(*by, "model", "_pos", "_m.*").filter(F.col("value").isNotNull())
    best = long.groupBy(*by, "metric").agg(F.min(F.struct("_loss", "_pos", "model", "value")).alias("_b"))
    return best.select(*by, "metric", F.col("_b.model").alias("model"), F.col("_b.value").alias("value"))


def mde_closed_form(n: Column, base: Column) -> Column:
    v = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), base))
    return F.when(n > 0, F.lit(fn.Z_POWER) * F.sqrt(v * (1 - v) / F.when(n > 0, n)))


def block_bootstrap(df: DataFrame, *, by: Sequence[str], value: str, replicates: int) -> DataFrame:
    """Interval of a mean by resampling seasons, days or single events, whichever are enough (`plans/bootstrap.py`)."""
    out = intervals(df, by=by, metrics=[value], replicates=replicates)
    return out.select(*by, "scheme", "n", "n_blocks", "point", "lo", "hi", "p_noise")


def paired_compare(scores: DataFrame, model: str, baseline: str, *, metric: str, by: Sequence[str], replicates: int) -> DataFrame:
    """Improvement of a model over a given baseline on common events: interval, se, MDE, verdict."""
    col = SCORE_OF[metric]
    sign = 1.0 if HIGHER_IS_BETTER[metric] else -1.0
    p = paired(scores, model, baseline, [col]).withColumn("diff", F.lit(sign) * (F.col(f"m_{col}") - F.col(f"b_{col}")))
    p = p.filter(F.col("diff").isNotNull())
    band = block_bootstrap(p, by=by, value="diff", replicates=replicates)
    se = p.groupBy(*by).agg((F.stddev_samp("diff") / F.sqrt(F.count("*"))).alias("se"))
    out = band.join(se, list(by)).withColumn("mde", F.col("se") * fn.Z_POWER)
    return out.withColumn("verdict", F.when(F.coalesce(F.col("se"), F.lit(0.0)) <= 0, "identical_to_baseline").otherwise(
        fn.verdict(F.lit(metric), F.col("lo"), F.col("hi"), F.col("mde"), F.col("n"))))


def compare_cells(scores: DataFrame, baselines: Sequence[str], *, by: Sequence[str] = ("decision_time",), min_confidence: float = 0.6, replicates: int) -> DataFrame:
    """Every model that is no baseline against the best baseline of each cell (`by` and subset), for every metric: model, by, subset, metric, baseline,
    both values, the improvement on common events (positive is better) with its interval, se, smallest detectable effect and verdict.

    Differences to every baseline are summed per stratum and day and then copied to subsets; the best baseline's are kept. The rank correlation meets
    its best baseline first and resamples ranks. Its se is that of the replicates. Where predictions are identical, the effect is the unpaired bound."""
    by = list(by)
    cell = [*by, "subset"]
    scores = scores.withColumn("confident", F.coalesce(F.col("t0_confidence") >= min_confidence, F.lit(False))).filter(F.col("r_true").isNotNull())
    cells = cut(eval_cells(scores, ("model", *by), min_confidence=min_confidence))  # read for the best, and for the models' own values
    best = best_baseline(cells, baselines, by=cell).withColumnsRenamed({"model": "baseline", "value": "baseline_value"})
    columns = [*SCORE_OF.values(), "r_hat"]
    base = scores.filter(F.col("model").isin(*baselines)).select("event_id", *by, F.col("model").alias("baseline"), *[F.col(c).alias(f"b_{c}") for c in columns])
    pairs = scores.filter(~F.col("model").isin(*baselines)).select("event_id", "model", *by, *STRATA, "season", "day", "r_true", *columns).join(base, ["event_id", *by])
    signed = [(F.lit(1.0 if HIGHER_IS_BETTER[m] else -1.0) * (F.col(c) - F.col(f"b_{c}"))).alias(f"d_{m}") for m, c in SCORE_OF.items()]
    keys = ["model", "baseline", *by, *STRATA]
    own = ["model", "baseline", *cell]
    diffs = pairs.select(*keys, "event_id", "season", "day", *signed)
    bands = cell_intervals(diffs, by=own, keys=keys, spread=to_subsets, metrics={m: f"d_{m}" for m in SCORE_OF}, replicates=replicates)
    parts = diffs.groupBy(*keys).agg(*[x for m in SCORE_OF for x in (F.count(f"d_{m}").alias(f"n_{m}"), F.avg(f"d_{m}").alias(f"a_{m}"), F.var_pop(f"d_{m}").alias(f"v_{m}"))])
    spreads = to_subsets(parts).groupBy(*own).agg(*[_merged_sd(m).alias(m) for m in SCORE_OF])
    sd = spreads.select(*own, F.explode(F.create_map(*[x for m in SCORE_OF for x in (F.lit(m), F.col(m))])).alias("metric", "sd"))
    means = bands.join(best, [*cell, "metric", "baseline"]).join(sd, [*own, "metric"], "left").withColumn("se", F.col("sd") / F.sqrt("n"))
    ranked = to_subsets(pairs).join(best.filter("metric = 'spearman_ic'").select(*cell, "baseline"), [*cell, "baseline"])
    ranked = ranked.filter("r_hat IS NOT NULL AND b_r_hat IS NOT NULL")
    rank = rank_gain(ranked, by=own, model="r_hat", baseline="b_r_hat", truth="r_true", replicates=replicates)
    rank = rank.join(best, [*cell, "metric", "baseline"]).withColumn("se", F.col("se_boot"))
    out = means.drop("sd").unionByName(rank)
    values = cells.select("model", *cell, F.explode(F.create_map(*[x for m in HIGHER_IS_BETTER for x in (F.lit(m), F.col(m))])).alias("metric", "model_value"))
    out = out.join(values, ["model", *cell, "metric"], "left")
    powered = F.col("metric").isin(*MDE_METRICS)
    identical = powered & (F.coalesce("se", F.lit(0.0)) <= 0)
    out = out.withColumn("mde", F.when(identical, mde_closed_form(F.col("n"), F.col("baseline_value"))).when(powered, F.col("se") * fn.Z_POWER))
    out = out.withColumn("verdict", F.when(identical, "identical_to_baseline").otherwise(fn.verdict(F.col("metric"), F.col("lo"), F.col("hi"), F.col("mde"), F.col("n"))))
    return out.select("model", *cell, "metric", "baseline", "baseline_value", "model_value", "scheme", "n", "n_blocks", F.col("point").alias("improvement"),
                      "lo", "hi", "p_noise", "se", "se_boot", "mde", "verdict")


def _merged_sd(m: str) -> Column:
    """Sample deviation of groups given by their numbers, means and variances; sums are of centred values."""
    n, a, v = F.col(f"n_{m}"), F.col(f"a_{m}"), F.col(f"v_{m}")
    group = F.filter(F.collect_list(F.struct(n.alias("n"), a.alias("a"), v.alias("v"))), lambda g: g["n"] > 0)  # strata of a cell
    total = F.aggregate(group, F.lit(0).cast("long"), lambda t, g: t + g["n"])
    mean = F.aggregate(group, F.lit(0.0), lambda t, g: t + g["n"] * g["a"]) / total
    squares = F.aggregate(F.transform(group, lambda g: g["n"] * (g["v"] + (g["a"] - mean) * (g["a"] - mean))), F.lit(0.0), lambda t, x: t + x)
    return F.when(total > 1, F.sqrt(squares / (total - 1)))


# ---- folds -----------------------------------------------------------------------------------
def fold_dimension(events: DataFrame, *, embargo_days: int, min_train: int, holdout: str | None) -> DataFrame:
    """One row per season: train and test sizes, whether it is usable, and its cutoff. Events
    are counted per day first, so folds only meet the day table. `events`: t0, trainable."""
    ev = events.filter(F.col("t0").isNotNull())
    s = fn.season(F.col("t0"))
    held = s == F.lit(holdout) if holdout else F.lit(False)
    daily = ev.groupBy(F.to_date("t0").alias("d"), s.alias("season"), held.alias("held"),
                       fn.season_start(F.col("t0")).cast("date").alias("start")).agg(
        F.count("*").alias("n"), F.sum(F.col("trainable").cast("int")).alias("n_ok"))
    seasons = daily.groupBy("season", "held", "start").agg(F.sum("n").alias("n_test"))
    seasons = seasons.withColumn("cutoff", F.date_sub("start", embargo_days))
    past = daily.filter(~F.col("held")).select(F.col("d").alias("_d"), "n_ok")
    sized = (seasons.join(F.broadcast(past), F.col("_d") < F.col("cutoff"), "left")  # days x seasons
             .groupBy(*seasons.columns).agg(F.coalesce(F.sum("n_ok"), F.lit(0)).alias("n_train")))
    order = F.row_number().over(Window.orderBy("start")) - 1
    usable = sized.filter((F.col("n_train") >= min_train) & ~F.col("held")).withColumn("fold", order)
    return sized.join(usable.select("season", "fold"), "season", "left").withColumn(
        "fold", F.when(F.col("held"), -1).otherwise(F.col("fold")))


def residual_bands(preds: DataFrame, folds: DataFrame) -> DataFrame:
    """q10 / q90 of the residuals pooled over the folds whose season precedes each fold. `preds`: model, fold, r_true, r_hat."""
    later = sorted(r["fold"] for r in folds.filter("fold IS NOT NULL").select("fold").collect())  # seasons
    rows = preds.select("model", (F.col("fold") + 1).cast("int").alias("seg"), (F.col("r_true") - F.col("r_hat")).alias("res"))
    sets = TrainingSets(rows, {f: (0, f + 1) for f in later})
    return segment_quantiles(sets, rows, by=["model"], value="res", probs={"q10": 0.1, "q90": 0.9})


def id_digest(df: DataFrame, *, by: str, key: str, digits: int = 4) -> DataFrame:
    """Content hash of the ids of each group: ids are digested per slice of their md5, then the
    slice digests (65,536 at most) are digested in order. Group size never reaches one task."""
    text = F.col(key).cast("string")
    ids = df.select(by, text.alias("_id"), F.substring(F.md5(text), 1, digits).alias("_b"))
    part = ids.groupBy(by, "_b").agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("_id"))), 256).alias("_h"), F.count("*").alias("_c"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_b", "_h"))), lambda s: s["_h"])
    return part.groupBy(by).agg(F.sum("_c").alias("n"), F.sha2(F.concat_ws(",", ordered), 256).alias("digest"))


def holdout_state(dataset: DataFrame, calendar: DataFrame, *, season: str, now: Column, horizon: int = 86400) -> DataFrame:
    """One row that says whether the holdout season may be scored: it is closed, nothing is in
    the future, no row is pending or unlabelled unless its label is unobservable (path resolved),
    and every scheduled event is in the dataset."""
    hold = dataset.filter(fn.season(F.col("t0")) == season)
    missing, pending = F.col("target_missing"), F.coalesce("pending", F.lit(False))
    unobservable = missing & F.col("resolved") & ~pending
    due = calendar.filter(fn.season(F.col("t0")) == season).select("event_id", "t0")
    absent = due.join(hold.select("event_id"), "event_id", "left_anti").agg(F.count("*").alias("n_absent"))
    end = F.lit(season_end(season)).cast("timestamp")
    s = hold.agg(F.count("*").alias("n_rows"), F.count_if(fn.plus_seconds(F.col("t0"), horizon) > now).alias("n_future"),
                 F.count_if((missing | pending) & ~unobservable).alias("n_blocking"), F.count_if(unobservable).alias("n_unobservable"))
    out = s.join(F.broadcast(absent)).withColumn("closed", now >= fn.plus_seconds(end, horizon))
    ready = F.col("closed") & (F.col("n_rows") > 0) & (F.col("n_future") == 0) & (F.col("n_blocking") == 0) & (F.col("n_absent") == 0)
    return out.withColumn("ready", ready)


def season_end(season: str) -> str:
    """First day after a season label such as 2001Q2."""
    year, quarter = int(season[:4]), int(season[5:])
    return f"{year + quarter // 4}-{quarter % 4 * 3 + 1:02d}-01"


def trading_compare(books: DataFrame, model: str, baselines: Sequence[str], *, replicates: int) -> DataFrame:
    """Per-event PnL of a model (0 when untraded) against the baseline with the best mean over
    its traded events. `books`: event_id, t0, season, model, pnl (null when untraded)."""
    b = books.withColumn("day", F.date_format("t0", "yyyy-MM-dd"))
    means = b.filter(F.col("model").isin(*baselines)).groupBy("model").agg(F.avg("pnl").alias("_m"))
    best = means.filter("_m IS NOT NULL").agg(F.min(F.struct((-F.col("_m")).alias("_loss"), F.col("model").alias("baseline"))).alias("_b")).select("_b.baseline")  # one row
    m = b.filter(F.col("model") == model).select("event_id", "season", "day", F.coalesce("pnl", F.lit(0.0)).alias("_pm"))
    q = b.join(F.broadcast(best), F.col("model") == F.col("baseline")).select("event_id", "baseline", F.coalesce("pnl", F.lit(0.0)).alias("_pb"))
    d = m.join(q, "event_id").withColumn("diff", F.col("_pm") - F.col("_pb"))
    band = block_bootstrap(d, by=["baseline"], value="diff", replicates=replicates)
    se = d.groupBy("baseline").agg((F.stddev_samp("diff") / F.sqrt(F.count("*"))).alias("se"))
    none = F.lit(None).cast("double")
    return band.join(se, "baseline").withColumn("verdict", fn.verdict(F.lit("mean_pnl"), F.col("lo"), F.col("hi"), none, F.col("n"))).withColumnRenamed("point", "improvement")
