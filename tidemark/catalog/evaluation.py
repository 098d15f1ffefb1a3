"""Folds, baselines, scores, comparisons and learners."""

from pyspark.sql import functions as F

from tidemark.catalog.aggregates import SCORED
from tidemark.catalog.projections import SUBSETS
from tidemark.catalog.registry import query
from tidemark.catalog.windows import FOLDS, folds_of
from tidemark.plans import baselines as bl
from tidemark.plans import evaluate as ev
from tidemark.plans import learners as ln
from tidemark.plans import linear_folds as lf
from tidemark.plans import training as tr

# features of the long event table, as the dataset names them
FEATS = """SELECT event_id, t0, r_24h, r_24h AS y, sign(r_24h) AS direction, t0_confidence >= 0.6e0 AS trainable, has_perp, rvol_20d AS f_rvol_20d, r_30m AS f_r_30m,
   eps_surprise AS f_eps_surprise, CASE WHEN event_id % 3 = 0 THEN r_30m * 2 END AS f_hist_r24_mean, CASE WHEN event_id % 3 = 0 THEN abs(r_30m) * 2 END AS f_hist_abs_r24_mean FROM {events_long}"""


@query("folds_walk_forward", "season:s n_test:l n_train:l fold:l cutoff:d held:b", "WITH" + FOLDS + " SELECT season, n_test, n_train, fold, cutoff, held FROM fo")
def folds_walk_forward(x):
    return folds_of(x)


TRAIN = "WITH" + FOLDS + ", ft AS (" + FEATS + "), tr AS (SELECT fo.fold, ft.* FROM ft JOIN fo ON fo.fold IS NOT NULL AND ft.t0 < fo.cutoff WHERE ft.trainable AND concat(year(ft.t0), 'Q', quarter(ft.t0)) <> '2001Q2')," \
        " st AS (SELECT fold, count(y) AS n_train, coalesce(least(greatest(avg(CASE WHEN y > 0 THEN 1 WHEN y < 0 THEN 0 END), 0.001), 0.999), 0.5) AS up_rate, avg(y) AS mean_r, avg(abs(y)) AS mean_abs_r," \
        " avg(f_rvol_20d) AS pooled_sigma, avg(y / f_rvol_20d) AS z_mean, avg(abs(y / f_rvol_20d)) AS z_abs_mean, avg(abs(y - f_r_30m)) AS extension," \
        " quantile_cont(y / f_rvol_20d, 0.1) AS z10, quantile_cont(y / f_rvol_20d, 0.9) AS z90 FROM tr GROUP BY 1)," \
        " te AS (SELECT ft.*, fo.fold, st.* EXCLUDE (fold) FROM ft JOIN fo ON fo.season = concat(year(ft.t0), 'Q', quarter(ft.t0)) AND fo.fold IS NOT NULL JOIN st ON st.fold = fo.fold)"


def feats_of(x):
    return x.sql(FEATS)


@query("base_rates", "fold:l n_train:l up_rate:n mean_r:n mean_abs_r:n", TRAIN + " SELECT fold, n_train, up_rate, mean_r, mean_abs_r FROM st")
def base_rates(x):
    return bl.base_rates(tr.expanding(feats_of(x), folds_of(x)))


def signed(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN 0.5 + 0.25 * sign({c}) ELSE up_rate END"


BASELINES = {
    "bl_zero": ("zero", "0.5", "0", "0"), "bl_base_rate": ("base_rate", "up_rate", "mean_r", "abs(mean_r)"),
    "bl_historical_mean": ("historical_mean", signed("f_hist_r24_mean"), "coalesce(f_hist_r24_mean, mean_r)", "abs(coalesce(f_hist_r24_mean, mean_r))"),
    "bl_hist_abs_mean": ("hist_abs_mean", "up_rate", "0", "coalesce(f_hist_abs_r24_mean, mean_abs_r)"),
    "bl_vol_scaled": ("vol_scaled", "up_rate", "coalesce(f_rvol_20d, pooled_sigma) * z_mean", "coalesce(f_rvol_20d, pooled_sigma) * z_abs_mean"),
    "bl_sign_of_reaction": ("sign_of_reaction", signed("f_r_30m"), "f_r_30m", "abs(f_r_30m)"),
    "bl_always_extends": ("always_extends", signed("f_r_30m"), "f_r_30m + sign(f_r_30m) * extension", "abs(f_r_30m + sign(f_r_30m) * extension)"),
    "bl_surprise_sign": ("surprise_sign", signed("f_eps_surprise"), "coalesce(sign(f_eps_surprise) * mean_abs_r, mean_r)", "abs(coalesce(sign(f_eps_surprise) * mean_abs_r, mean_r))"),
}


def _register(key: str, name: str, p: str, r: str, m: str) -> None:
    band = name == "vol_scaled"
    cols = "event_id:l fold:l p_up:n r_hat:n magnitude_hat:n" + (" q10:n q90:n" if band else "")
    extra = ", coalesce(f_rvol_20d, pooled_sigma) * z10 AS q10, coalesce(f_rvol_20d, pooled_sigma) * z90 AS q90" if band else ""
    query(key, cols, TRAIN + f" SELECT event_id, fold, {p} AS p_up, {r} AS r_hat, {m} AS magnitude_hat{extra} FROM te")(
        lambda x, name=name: bl.walk_forward(feats_of(x), folds_of(x), names=[name]))


for _key, _spec in BASELINES.items():
    _register(_key, *_spec)


@query("score_rows", "event_id:l model:s hit:n brier:n ll:n ae:n mag_ae:n season:s day:s", "SELECT event_id, model, hit, brier, ll, ae, mag_ae, season, day FROM (" + SCORED + ")")
def score_rows(x):
    return ev.score_rows(x.predictions)


REPLICATES = 2000


def bootstrap_sql(rows: str, by: str, value: str, reps: int = REPLICATES, tag: str = "") -> str:
    """Season blocks (the given events always span five seasons or more)."""
    return f"""
    bb{tag} AS (SELECT {by}, season AS block, sum({value}) AS s, count(*) AS n FROM {rows} WHERE {value} IS NOT NULL GROUP BY ALL),
    bi{tag} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(block)) - 1 AS idx, count(*) OVER (PARTITION BY {by}) AS size FROM bb{tag}),
    bz{tag} AS (SELECT {by}, max(size) AS size, sum(s) / sum(n) AS point, sum(n) AS n FROM bi{tag} GROUP BY ALL),
    bd{tag} AS (SELECT {by}, rep, slot, ('0x' || substr(md5(concat(rep, ':', slot)), 1, 8))::BIGINT % size AS idx
           FROM (SELECT {by}, size, rep, unnest(range(size)) AS slot FROM (SELECT *, unnest(range({reps})) AS rep FROM bz{tag}))),
    br{tag} AS (SELECT {by}, rep, sum(s) / sum(n) AS stat FROM bd{tag} JOIN bi{tag} USING ({by}, idx) GROUP BY ALL),
    bq{tag} AS (SELECT {by}, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi, avg(CAST(stat <= 0 AS INT)) AS p_noise FROM br{tag} GROUP BY ALL)"""


def bands_sql(rows: str, by: str, value: str) -> str:
    """The same bootstrap with the draws made once per number of blocks."""
    return f"""
    bb AS (SELECT {by}, season AS block, sum({value}) AS s, count(*) AS n FROM {rows} WHERE {value} IS NOT NULL GROUP BY ALL),
    bi AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(block)) - 1 AS idx, count(*) OVER (PARTITION BY {by}) AS size FROM bb),
    bz AS (SELECT {by}, max(size) AS size, sum(s) / sum(n) AS point, sum(n) AS n FROM bi GROUP BY ALL),
    bd AS (SELECT size, rep, ('0x' || substr(md5(concat(rep, ':', slot)), 1, 8))::BIGINT % size AS idx, count(*) AS times
           FROM (SELECT size, rep, unnest(range(size)) AS slot FROM (SELECT size, unnest(range({REPLICATES})) AS rep FROM (SELECT DISTINCT size FROM bz))) GROUP BY ALL),
    br AS (SELECT {by}, rep, sum(times * s) / sum(times * n) AS stat FROM bd JOIN bi USING (size, idx) GROUP BY ALL),
    bq AS (SELECT {by}, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi, avg(CAST(stat <= 1e-12 AS INT)) AS p_noise FROM br GROUP BY ALL)"""


BANDS = ("accuracy", "brier", "log_loss", "mae", "magnitude_mae")
SPREAD = "s AS (SELECT q.*, u.subset FROM (" + SCORED + ") q JOIN (" + SUBSETS + ") u ON u.event_id = q.event_id AND u.model = q.model)"
CELL = "model, decision_time, subset"
RANKED = f"""k AS (SELECT *, rank() OVER (PARTITION BY {CELL} ORDER BY r_true) + (count(*) OVER (PARTITION BY {CELL}, r_true) - 1) / 2.0 AS rt,
                 rank() OVER (PARTITION BY {CELL} ORDER BY r_hat) + (count(*) OVER (PARTITION BY {CELL}, r_hat) - 1) / 2.0 AS rh,
                 rank() OVER (PARTITION BY {CELL} ORDER BY abs(r_true)) + (count(*) OVER (PARTITION BY {CELL}, abs(r_true)) - 1) / 2.0 AS mt,
                 rank() OVER (PARTITION BY {CELL} ORDER BY coalesce(magnitude_hat, abs(r_hat))) + (count(*) OVER (PARTITION BY {CELL}, coalesce(magnitude_hat, abs(r_hat))) - 1) / 2.0 AS mh FROM s)"""


@query("eval_cells", "model:s decision_time:s subset:s n:l n_direction:l accuracy:n balanced_accuracy:n brier:n log_loss:n mae:n rmse:n magnitude_mae:n spearman_ic:n magnitude_ic:n "
       + " ".join(f"{m}_scheme:s {m}_lo:n {m}_hi:n" for m in BANDS),
       "WITH " + SPREAD + ", " + RANKED + f""",
    l AS (SELECT {CELL}, season, unnest({list(BANDS)}) AS metric, unnest([hit, brier, ll, ae, mag_ae]) AS v FROM s),"""
       + bands_sql("l", CELL + ", metric", "v") + f""",
    w AS (SELECT {CELL}, {", ".join(f"any_value(lo) FILTER (metric = '{m}') AS {m}_lo, any_value(hi) FILTER (metric = '{m}') AS {m}_hi" for m in BANDS)} FROM bq GROUP BY ALL),
    g AS (SELECT {CELL}, corr(mt, mh) AS magnitude_ic, count(*) AS n, count(hit) AS n_direction, avg(hit) AS accuracy, coalesce((avg(hit) FILTER (WHERE r_true > 0) + avg(hit) FILTER (WHERE r_true < 0)) / 2, avg(hit)) AS balanced_accuracy,
           avg(brier) AS brier, avg(ll) AS log_loss, avg(ae) AS mae, sqrt(avg(ae * ae)) AS rmse, avg(mag_ae) AS magnitude_mae, corr(rt, rh) AS spearman_ic FROM k GROUP BY ALL)
    SELECT *, {", ".join(f"'block:season' AS {m}_scheme" for m in BANDS)} FROM g JOIN w USING ({CELL})""")
def eval_cells(x):
    return ev.eval_cells(ev.score_rows(x.predictions), replicates=REPLICATES)


@query("bootstrap_blocks", "model:s decision_time:s scheme:s n:l n_blocks:l point:n lo:n hi:n", "WITH sc AS (" + SCORED + ")," + bootstrap_sql("sc", "model, decision_time", "brier")
       + " SELECT model, decision_time, 'block:season' AS scheme, n, size AS n_blocks, point, lo, hi FROM bz JOIN bq USING (model, decision_time)")
def bootstrap_blocks(x):
    return ev.block_bootstrap(ev.score_rows(x.predictions), by=["model", "decision_time"], value="brier", replicates=REPLICATES)


# The rank of a value in a replicate is linear in the block counts, so a rank correlation's sums are cubic in them: their coefficients by (block, block,
# block) meet the products of a replicate's counts as two long lists.
COMPARED = "WITH " + SPREAD + ", " + RANKED + f""",
    c AS (SELECT {CELL}, avg(hit) AS accuracy, avg(brier) AS brier, avg(ll) AS log_loss, corr(rt, rh) AS spearman_ic, avg(ae) AS mae, avg(mag_ae) AS magnitude_mae FROM k GROUP BY ALL),
    lg AS (SELECT {CELL}, unnest(['accuracy', 'brier', 'log_loss', 'spearman_ic', 'mae', 'magnitude_mae']) AS metric, unnest([accuracy, brier, log_loss, spearman_ic, mae, magnitude_mae]) AS value FROM c),
    be AS (SELECT decision_time, subset, metric, model AS baseline, value AS baseline_value FROM lg WHERE model <> 'linear' AND value IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY decision_time, subset, metric ORDER BY CASE WHEN metric IN ('accuracy', 'spearman_ic') THEN -value ELSE value END, CASE model WHEN 'zero' THEN 0 ELSE 1 END) = 1),
    pa AS (SELECT a.decision_time, a.subset, a.season, b.model AS baseline, a.r_true, a.r_hat, b.r_hat AS b_r_hat, unnest({list(BANDS)}) AS metric,
                  unnest([a.hit - b.hit, b.brier - a.brier, b.ll - a.ll, b.ae - a.ae, b.mag_ae - a.mag_ae]) AS diff
           FROM s a JOIN s b ON a.event_id = b.event_id AND a.decision_time = b.decision_time AND a.subset = b.subset AND a.model = 'linear' AND b.model <> 'linear'),
    df AS (SELECT pa.* FROM pa JOIN be USING (decision_time, subset, metric, baseline) WHERE diff IS NOT NULL),""" + bands_sql("df", "decision_time, subset, metric", "diff") + """,
    se AS (SELECT decision_time, subset, metric, stddev_samp(diff) / sqrt(count(*)) AS se FROM df GROUP BY ALL),
    pr AS (SELECT dense_rank() OVER (ORDER BY decision_time, subset) AS cell, decision_time, subset, season, r_hat AS x, b_r_hat AS z, r_true AS y
           FROM pa JOIN (SELECT decision_time, subset, baseline FROM be WHERE metric = 'spearman_ic') USING (decision_time, subset, baseline) WHERE pa.metric = 'brier'),
    pb AS (SELECT cell, season, row_number() OVER (PARTITION BY cell ORDER BY md5(season)) AS idx, count(*) OVER (PARTITION BY cell) AS size FROM (SELECT DISTINCT cell, season FROM pr)),
    pi AS (SELECT pr.cell, idx, size, x, z, y FROM pr JOIN pb USING (cell, season)),
    pv AS (SELECT cell, size, idx, side, v, count(*) AS c FROM (SELECT cell, size, idx, unnest(['x', 'z', 'y']) AS side, unnest([x, z, y]) AS v FROM pi) GROUP BY ALL),
    pg AS (SELECT g.cell, g.side, g.v, g.p, coalesce(c, 0) AS c FROM (SELECT DISTINCT cell, side, v, unnest(range(1, size + 1)) AS p FROM pv) g
           LEFT JOIN pv ON pv.cell = g.cell AND pv.side = g.side AND pv.v = g.v AND pv.idx = g.p),
    pc AS (SELECT cell, side, v, p, sum(c) OVER (PARTITION BY cell, side, p ORDER BY v) - c / 2.0 AS a FROM pg),
    px AS (SELECT cell, side, v, list(a::DOUBLE ORDER BY p) AS a FROM pc GROUP BY ALL),
    po AS (SELECT pi.cell, pi.idx, pi.size, i.a AS ax, j.a AS az, k.a AS ay FROM pi JOIN px i ON i.cell = pi.cell AND i.side = 'x' AND i.v = pi.x
           JOIN px j ON j.cell = pi.cell AND j.side = 'z' AND j.v = pi.z JOIN px k ON k.cell = pi.cell AND k.side = 'y' AND k.v = pi.y),
    p1 AS (SELECT cell, size, idx, p, count(*)::DOUBLE AS n, sum(ax) AS x, sum(az) AS z, sum(ay) AS y FROM (SELECT cell, size, idx, unnest(range(1, size + 1)) AS p, unnest(ax) AS ax, unnest(az) AS az, unnest(ay) AS ay FROM po) GROUP BY ALL),
    p2 AS (SELECT cell, size, idx, p, q, sum(ax[q] * bx) AS xx, sum(az[q] * bz) AS zz, sum(ay[q] * b_y) AS yy, sum(ay[q] * bx) AS xy, sum(ay[q] * bz) AS zy
           FROM (SELECT *, unnest(range(1, size + 1)) AS q FROM (SELECT cell, size, idx, ax, az, ay, unnest(range(1, size + 1)) AS p, unnest(ax) AS bx, unnest(az) AS bz, unnest(ay) AS b_y FROM po)) GROUP BY ALL),
    f1 AS (SELECT cell, size, list(x ORDER BY idx, p) AS x, list(z ORDER BY idx, p) AS z, list(y ORDER BY idx, p) AS y, list(n ORDER BY idx) FILTER (p = 1) AS n FROM p1 GROUP BY ALL),
    f2 AS (SELECT cell, list(xx ORDER BY idx, p, q) AS xx, list(zz ORDER BY idx, p, q) AS zz, list(yy ORDER BY idx, p, q) AS yy, list(xy ORDER BY idx, p, q) AS xy, list(zy ORDER BY idx, p, q) AS zy FROM p2 GROUP BY ALL),
    tt AS (SELECT size, rep, list(coalesce(times, 0)::DOUBLE ORDER BY slot) AS t FROM (SELECT size, rep, unnest(range(size)) AS slot FROM (SELECT DISTINCT size, unnest(range(-1, """ + str(REPLICATES) + """)) AS rep FROM pb)) g
           LEFT JOIN (SELECT size AS zs, rep AS zr, idx AS zi, times FROM bd UNION ALL SELECT DISTINCT size, -1, unnest(range(size)), 1 FROM pb) d ON zs = size AND zr = rep AND zi = slot GROUP BY ALL),
    t2 AS (SELECT size, rep, t, flatten(list_transform(t, lambda a: list_transform(t, lambda b: a * b))) AS tb FROM tt),
    t3 AS (SELECT *, flatten(list_transform(t, lambda a: list_transform(tb, lambda b: a * b))) AS tc FROM t2),
    q1 AS (SELECT cell, rep, list_inner_product(t, n) AS w, list_inner_product(tb, x) AS mx, list_inner_product(tb, z) AS mz, list_inner_product(tb, y) AS my, list_inner_product(tc, xx) AS xx, list_inner_product(tc, zz) AS zz,
                  list_inner_product(tc, yy) AS yy, list_inner_product(tc, xy) AS xy, list_inner_product(tc, zy) AS zy FROM f1 JOIN f2 USING (cell) JOIN t3 USING (size)),
    q2 AS (SELECT cell, rep, (xy - mx * my / w) / sqrt((xx - mx * mx / w) * (yy - my * my / w)) - (zy - mz * my / w) / sqrt((zz - mz * mz / w) * (yy - my * my / w)) AS stat FROM q1),
    q3 AS (SELECT cell, any_value(stat) FILTER (rep < 0) AS point, quantile_cont(stat, 0.025) FILTER (rep >= 0) AS lo, quantile_cont(stat, 0.975) FILTER (rep >= 0) AS hi, avg(CAST(stat <= 1e-12 AS INT)) FILTER (rep >= 0) AS p_noise,
                  stddev_samp(stat) FILTER (rep >= 0) AS se FROM q2 GROUP BY ALL),
    qn AS (SELECT cell, any_value(decision_time) AS decision_time, any_value(subset) AS subset, count(*) AS n FROM pr GROUP BY cell),
    al AS (SELECT decision_time, subset, metric, size AS n_blocks, point, n, lo, hi, p_noise, se FROM bz JOIN bq USING (decision_time, subset, metric) JOIN se USING (decision_time, subset, metric)
           UNION ALL SELECT decision_time, subset, 'spearman_ic', size, point, n, lo, hi, p_noise, se FROM q3 JOIN qn USING (cell) JOIN (SELECT DISTINCT cell, size FROM pb) USING (cell)),
    am AS (SELECT *, CASE WHEN metric IN ('accuracy', 'brier') THEN (1.959963984540054 + 0.8416212335729143) * se END AS mde FROM al)
    SELECT decision_time, subset, metric, baseline, baseline_value, value AS model_value, n, n_blocks, point AS improvement, lo, hi, p_noise, se, mde,
       CASE WHEN lo > 0 THEN 'improves' WHEN hi < 0 THEN 'worse' WHEN hi < mde THEN 'not_predictable' ELSE concat('inconclusive at n = ', n) END AS verdict
    FROM am JOIN be USING (decision_time, subset, metric) JOIN (SELECT * FROM lg WHERE model = 'linear') USING (decision_time, subset, metric)"""


@query("paired_compare", "decision_time:s subset:s metric:s baseline:s baseline_value:n model_value:n n:l n_blocks:l improvement:n lo:n hi:n p_noise:n se:n mde:n verdict:s", COMPARED)
def paired_compare(x):
    return ev.compare_cells(ev.score_rows(x.predictions), ("zero", "base_rate"), replicates=REPLICATES)


@query("holdout_guard", "closed:b n_rows:l n_future:l n_blocking:l n_unobservable:l n_absent:l ready:b", """
    WITH h AS (SELECT * FROM {events_long} WHERE concat(year(t0), 'Q', quarter(t0)) = '2001Q2'), d AS (SELECT * FROM h WHERE event_id % 40 <> 0),
     s AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE t0 + INTERVAL 24 HOUR > TIMESTAMP '2001-07-02 00:00:00') AS n_future, count(*) FILTER (WHERE rvol_20d IS NULL AND eps_surprise IS NULL) AS n_blocking,
           count(*) FILTER (WHERE rvol_20d IS NULL AND eps_surprise IS NOT NULL) AS n_unobservable FROM d)
    SELECT TIMESTAMP '2001-07-02 00:00:00' >= TIMESTAMP '2001-07-02 00:00:00' AS closed, *, (SELECT count(*) FROM h WHERE event_id % 40 = 0) AS n_absent,
           n_rows > 0 AND n_future = 0 AND n_blocking = 0 AND (SELECT count(*) FROM h WHERE event_id % 40 = 0) = 0 AS ready FROM s""")
def holdout_guard(x):
    # a missing label stands as a null volatility; a resolved path as a known surprise
    rows = x.events_long.withColumns({"target_missing": F.col("rvol_20d").isNull(), "resolved": F.col("eps_surprise").isNotNull(), "pending": F.lit(False)})
    return ev.holdout_state(rows.filter("event_id % 40 <> 0"), x.events_long, season="2001Q2", now=F.lit("2001-07-02").cast("timestamp"))


@query("ml_ensemble", "event_id:l decision_time:s model:s p_up:n r_hat:n magnitude_hat:n", """
    SELECT event_id, decision_time, 'ensemble' AS model, least(greatest(sum(p_up * w), 0.001), 0.999) AS p_up, sum(r_hat * w) AS r_hat, sum(coalesce(magnitude_hat, abs(r_hat)) * w) AS magnitude_hat
    FROM (SELECT *, CASE model WHEN 'linear' THEN 0.75 ELSE 0.25 END AS w FROM {predictions} WHERE model IN ('linear', 'base_rate')) GROUP BY 1, 2""")
def ml_ensemble(x):
    return ln.ensemble(x.predictions, {"linear": 3.0, "base_rate": 1.0})


FEATURES = ["f_rvol_20d", "f_r_30m", "f_eps_surprise", "f_hist_r24_mean"]


PRED = "event_id:l fold:l model:s p_up:n r_hat:n magnitude_hat:n"


@query("ml_linear", PRED)
def ml_linear(x):
    return lf.walk_forward(*ln.split(feats_of(x), folds_of(x)), FEATURES, "linear")


@query("ml_boosted_trees", PRED)
def ml_boosted_trees(x):
    return ln.walk_forward(feats_of(x), folds_of(x), FEATURES, ln.tree_heads, "boosted_trees")


@query("ml_contributions", "event_id:l fold:l head:s feature:s push:n")
def ml_contributions(x):
    train, test = ln.split(feats_of(x), folds_of(x))
    return lf.contributions(test, lf.fit(train, FEATURES), FEATURES)


MEMBERS = {"linear": 1.0, "boosted_trees": 1.0}


@query("ml_importance", "model:s fold:l feature:s importance:n")
def ml_importance(x):
    train, _ = ln.split(feats_of(x), folds_of(x))
    trees = ln.fit_folds(train, sorted(k for k in train.spans if k >= 0), FEATURES, ln.tree_heads)
    own = {"linear": [r for r in lf.weight_rows(lf.fit(train, FEATURES), FEATURES) if r[0] >= 0], "boosted_trees": [r for m in trees for r in ln.weight_rows(m)]}
    single = ln.importances(ln.weight_table(x.spark, own))  # models x folds x features
    return single.unionByName(ln.ensemble_importance(single, MEMBERS))


@query("walk_forward_predict", "event_id:l fold:l model:s p_up:n r_hat:n magnitude_hat:n r_lo:n r_hi:n")
def walk_forward_predict(x):
    ev_, folds = feats_of(x), folds_of(x)
    preds = lf.walk_forward(*ln.split(ev_, folds), FEATURES, "linear").unionByName(
        bl.walk_forward(ev_, folds.filter("fold >= 0 OR held"), names=["base_rate", "sign_of_reaction"]).filter("fold >= 0").select(
            "event_id", "t0", "fold", "y", "model", "p_up", "r_hat", "magnitude_hat"))
    band = ev.residual_bands(preds.withColumn("r_true", F.col("y")), folds).select("model", "fold", "q10", "q90")
    j = preds.join(F.broadcast(band), ["model", "fold"], "left")  # one row per model and fold
    return j.withColumns({"r_lo": F.col("r_hat") + F.col("q10"), "r_hi": F.col("r_hat") + F.col("q90")})


GROUPS = {"pre_price": ("f_rvol_20d",), "reaction": ("f_r_30m",), "surprise": ("f_eps_surprise",), "history": ("f_hist_r24_mean",)}
TRIALS = (ln.Trial(0, ("pre_price", "reaction"), "r_24h", 4, 0.01), ln.Trial(1, ("reaction", "surprise", "history"), "r_24h", 40, 1.0), ln.Trial(2, ("surprise",), "r_24h", 8, 0.1))


@query("trial_table", "trial:l value:n improvement:n n:l p_noise:n rank:l")
def trial_table(x):
    from tidemark.operators.topk import rank_trials
    return rank_trials(ln.trial_table(feats_of(x), folds_of(x), GROUPS, TRIALS, min_train=400, replicates=REPLICATES), value="value", higher=False, order="trial")


@query("train_final_table", "model:s cohort:s n_events:l q10:n q90:n band_source:s n:l")
def train_final_table(x):
    ev_, folds = feats_of(x), folds_of(x)
    cohort = ln.final_cohort(ev_, min_train=400)
    size = cohort.groupBy("cohort").agg(F.count("*").alias("n_events"))
    return ln.final_table(cohort.drop("cohort"), ev_, folds, FEATURES).join(F.broadcast(size))
