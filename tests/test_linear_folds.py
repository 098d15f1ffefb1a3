"""Linear heads of all folds against plain solutions on collected rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import learners as ln
from tidemark.plans import linear_folds as lf

FEATURES = ["f_a", "f_b", "f_c"]


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(0)
    rows = []
    for fold in (0, 1):
        for i in range(300 + 200 * fold):
            a, b = rng.normal(size=2)
            y = 0.5 * a - 0.2 * b + rng.normal() * 0.5
            rows.append((fold, i, float(y) if i % 11 else None, float(np.sign(y)) if i % 13 else 0.0, float(a) if i % 7 else None, float(b) * 10, 3.0))
    return spark.createDataFrame(rows, "fold int, event_id bigint, y double, direction double, f_a double, f_b double, f_c double")


def design(train, m):
    p = train.filter(F.col("fold") == m.fold).withColumn("split", F.pmod(F.xxhash64("event_id"), F.lit(lf.CV_FOLDS))).toPandas()
    x = p[FEATURES].to_numpy(float)
    x = np.where(np.isnan(x), m.median, x)
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    return p, np.column_stack([np.ones(len(z)), z])


def test_one_strength_equals_the_plain_solution(train):
    for m in lf.fit(train, FEATURES, alphas=(10.0,), cs=(0.1,)):
        p, x = design(train, m)
        pen = np.diag([0, 10.0, 10.0, 10.0])
        ok = p["y"].notna().to_numpy()
        want = np.linalg.lstsq(x[ok].T @ x[ok] + pen, x[ok].T @ p["y"].to_numpy()[ok], rcond=None)[0]
        assert np.allclose(m.ret, want, atol=1e-8)
        lab = (p["direction"] != 0).to_numpy()
        up = (p["direction"].to_numpy()[lab] > 0).astype(float)
        prob = 1 / (1 + np.exp(-x[lab] @ m.direction))
        gradient = x[lab].T @ (up - prob) - np.r_[0, m.direction[1:]] / 0.1
        assert np.abs(gradient).max() < 1e-6


def test_strengths_come_from_held_out_splits(train):
    models = lf.fit(train, FEATURES)
    for m in models:
        p, x = design(train, m)
        ok = p["y"].notna().to_numpy()
        y, split = p["y"].to_numpy(), p["split"].to_numpy()

        def solve(rows, alpha):
            return np.linalg.lstsq(x[rows].T @ x[rows] + np.diag([0, *[alpha] * 3]), x[rows].T @ y[rows], rcond=None)[0]

        def error(alpha):
            return sum(((y[ok & (split == s)] - x[ok & (split == s)] @ solve(ok & (split != s), alpha)) ** 2).sum() for s in range(lf.CV_FOLDS))
        best = min(lf.RIDGE, key=error)
        assert np.allclose(m.ret, solve(ok, best), atol=1e-8)
        assert m.direction is not None and m.direction[1] > 0 > m.direction[2]


def test_contributions_sum_to_the_forecast(spark, train):
    models = lf.fit(train, FEATURES, alphas=(10.0,), cs=(0.1,))
    test = train.withColumn("t0", F.current_timestamp())
    rates = spark.createDataFrame([(0, 0.5, 0.0), (1, 0.5, 0.0)], "fold int, up_rate double, mean_r double")
    got = {(r["fold"], r["event_id"]): r for r in lf.predict(test, models, FEATURES, rates, "linear").collect()}
    sums = lf.contributions(test, models, FEATURES).groupBy("fold", "event_id", "head").agg(F.sum("push").alias("s")).collect()
    for r in sums:
        p = got[r["fold"], r["event_id"]]
        want = p["r_hat"] if r["head"] == "return" else np.log(p["p_up"] / (1 - p["p_up"]))
        assert abs(r["s"] - want) < 1e-6 or p["p_up"] in (0.001, 0.999)


def test_few_rows_fall_back_to_the_base_rate(spark, train):
    few = train.filter("event_id < 20")
    models = lf.fit(few, FEATURES)
    assert all(m.ret is None and m.direction is None for m in models)
    rates = spark.createDataFrame([(0, 0.7, 0.1), (1, 0.7, 0.1)], "fold int, up_rate double, mean_r double")
    got = lf.predict(few.withColumn("t0", F.current_timestamp()), models, FEATURES, rates, "linear").collect()
    assert len(got) == 40 and all((r["p_up"], r["r_hat"]) == (0.7, 0.1) for r in got)
    assert lf.fit(train.limit(0), FEATURES) == []


def test_importances_average_shares_over_heads(spark):
    w = spark.createDataFrame([(0, "return", "a", 3.0), (0, "return", "b", -1.0), (0, "direction", "a", 0.0), (0, "direction", "b", 2.0), (1, "return", "a", 0.0)],
                              "fold int, head string, feature string, weight double")
    assert {(r["fold"], r["feature"]): r["importance"] for r in ln.importances(w).collect()} == {(0, "a"): 0.375, (0, "b"): 0.625, (1, "a"): 0.0}
