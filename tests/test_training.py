"""Training sets as segments of time against sets made row by row."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import baselines as bl
from tidemark.plans import evaluate as ev
from tidemark.plans import learners as ln
from tidemark.plans import linear_folds as lf
from tidemark.plans import training as tr

FEATURES = ["f_a", "f_b"]


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        t0 = dt.datetime(2000, 1, 1) + dt.timedelta(days=int(rng.integers(0, 900)), hours=int(rng.integers(0, 24)))
        y = float(np.round(rng.normal() * 0.1, 2))
        rows.append((i, str(t0), y if i % 9 else None, float(np.sign(y)), i % 4 != 0, float(np.round(rng.normal(), 1)) if i % 5 else None, 1e9 + float(rng.normal())))
    df = spark.createDataFrame(rows, "event_id long, t0 string, y double, direction double, trainable boolean, f_a double, f_b double")
    return df.withColumn("t0", F.col("t0").cast("timestamp")).cache()


@pytest.fixture(scope="module")
def folds(events):
    return ev.fold_dimension(events, embargo_days=5, min_train=100, holdout="2002Q2").cache()


def sets_of(events, folds):
    """Rows of every fold, one by one."""
    known = [r for r in folds.collect() if r["fold"] is not None]
    rows = [r for r in events.collect() if r["trainable"]]

    def season(t):
        return f"{t.year}Q{(t.month + 2) // 3}"
    return {f["fold"]: sorted((r for r in rows if r["t0"].date() < f["cutoff"] and season(r["t0"]) != "2002Q2"), key=lambda r: (r["t0"], r["event_id"])) for f in known}, season


def test_every_fold_gets_its_rows(events, folds):
    want, _ = sets_of(events, folds)
    got = tr.expanding(events, folds)
    assert set(got.spans) == set(want) and len(want) > 5
    for k in want:
        assert sorted(r["event_id"] for r in got.of(k).collect()) == sorted(r["event_id"] for r in want[k])
    assert got.rows.count() <= events.count()


@pytest.mark.parametrize("seasons, least", [(2, 50), (2, 240), (1, 500), (30, 10)])
def test_windows_and_their_floor(events, folds, seasons, least):
    want, season = sets_of(events, folds)
    for k, rows in want.items():
        names = sorted({season(r["t0"]) for r in rows})
        last = [r for r in rows if season(r["t0"]) in names[-seasons:]]
        want[k] = rows[-least:] if len(names) > seasons and len(last) < least else last
    got = tr.windowed(events, folds, seasons=seasons, min_train=least)
    for k in want:
        assert sorted(r["event_id"] for r in got.of(k).collect()) == sorted(r["event_id"] for r in want[k]), k
    starts = {r["fold"]: (r["n"], r["lo_t0"], r["lo_id"]) for r in tr.window_starts(events, folds, seasons=seasons, min_train=least).collect()}
    assert starts == {k: (len(v), v[0]["t0"], v[0]["event_id"]) for k, v in want.items()}


def test_totals_lose_no_digits(events, folds):
    want, _ = sets_of(events, folds)
    sets = tr.expanding(events, folds)
    for r in sets.totals([], {"b": F.col("f_b"), "a": F.col("f_a")}).collect():
        b = np.array([x["f_b"] for x in want[r["fold"]]])
        assert r["n_b"] == len(b) and r["a_b"] == pytest.approx(b.mean(), rel=1e-14) and r["v_b"] == pytest.approx(np.var(b - 1e9), rel=1e-5)
        assert r["n_a"] == sum(x["f_a"] is not None for x in want[r["fold"]])


@pytest.mark.parametrize("ranges", [2, 64])
def test_quantiles_of_all_features_and_folds(events, folds, ranges):
    want, _ = sets_of(events, folds)
    sets = tr.expanding(events, folds)
    long = sets.rows.select("seg", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in FEATURES])).alias("f")).select("seg", F.col("f.name").alias("feature"), "f.v")
    probs = {"q10": 0.1, "med": 0.5, "q99": 0.99, "top": 1.0}
    got = {(r["feature"], r["fold"]): r for r in tr.segment_quantiles(sets, long, by=["feature"], value="v", probs=probs, ranges=ranges).collect()}
    for k, rows in want.items():
        for c in FEATURES:
            v = [r[c] for r in rows if r[c] is not None]
            assert got[c, k]["n"] == len(v)
            assert [got[c, k][p] for p in probs] == pytest.approx(list(np.quantile(v, list(probs.values()))), rel=1e-12)


def test_medians_of_the_linear_heads_are_exact(events, folds):
    want, _ = sets_of(events, folds)
    sets = tr.expanding(events, folds)
    for k, (median, mean, sd) in lf.preparation(sets, FEATURES).items():
        x = np.array([[np.nan if r[c] is None else r[c] for c in FEATURES] for r in want[k]])
        filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
        assert median == pytest.approx(np.nanmedian(x, axis=0), rel=1e-14)
        assert mean == pytest.approx(filled.mean(axis=0), rel=1e-12) and sd == pytest.approx(filled.std(axis=0), rel=1e-5)


def test_rates_and_residual_bands(spark, events, folds):
    want, _ = sets_of(events, folds)
    for r in bl.base_rates(tr.expanding(events, folds)).collect():
        y = [x["y"] for x in want[r["fold"]] if x["y"] is not None]
        up = [x["direction"] > 0 for x in want[r["fold"]] if x["direction"]]
        assert r["n_train"] == len(y) and r["up_rate"] == pytest.approx(np.mean(up)) and r["mean_abs_r"] == pytest.approx(np.mean(np.abs(y)))
    rng = np.random.default_rng(1)
    rows = [(m, int(k), float(rng.normal()), 0.0) for m in "mn" for k in rng.integers(0, 6, 200)]
    got = {(r["model"], r["fold"]): r for r in ev.residual_bands(spark.createDataFrame(rows, "model string, fold int, r_true double, r_hat double"), folds).collect()}
    for m in "mn":
        for k in range(1, 6):
            v = [r[2] for r in rows if r[0] == m and r[1] < k]
            assert got[m, k]["n"] == len(v) and (got[m, k]["q10"], got[m, k]["q90"]) == pytest.approx(tuple(np.quantile(v, [0.1, 0.9])))
        assert (m, 0) not in got


def test_trees_find_a_known_split(spark):
    """y jumps at f_a = 0.3 and nothing else matters: forecasts step there, and all of the gain is f_a's."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        t0 = dt.datetime(2000, 1, 1) + dt.timedelta(hours=15 * i)
        a, b = rng.uniform(size=2)
        rows.append((i, str(t0), 0.05 if a > 0.3 else -0.05, 1.0 if a > 0.3 else -1.0, True, float(a), float(b)))
    events = spark.createDataFrame(rows, "event_id long, t0 string, y double, direction double, trainable boolean, f_a double, f_b double").withColumn("t0", F.col("t0").cast("timestamp"))
    folds = ev.fold_dimension(events, embargo_days=5, min_train=500, holdout=None)
    train, test = ln.split(events, folds)
    kept = ln.usable_folds(folds)[:1]
    fitted = ln.fit_folds(train, kept, FEATURES, lambda: ln.tree_heads(rounds=40, depth=1))
    got = ln.predict_fold(test, fitted[0], bl.base_rates(train), "trees").join(events.select("event_id", "f_a"), "event_id").collect()
    assert len(got) > 50
    for r in got:
        if abs(r["f_a"] - 0.3) > 0.03:
            assert (r["r_hat"] > 0.02) == (r["f_a"] > 0.3) and (r["p_up"] > 0.5) == (r["f_a"] > 0.3) and abs(r["r_hat"]) > 0.02
    w = {(h, f): x for _, h, f, x in ln.weight_rows(fitted[0])}
    assert w["return", "f_a"] > 0.95 and w["direction", "f_a"] > 0.95
    assert w["return", "f_a"] + w["return", "f_b"] == pytest.approx(1.0)


def test_importances_of_several_models_and_their_ensemble(spark):
    table = ln.weight_table(spark, {"linear": [(0, "return", "a", 3.0), (0, "return", "b", -1.0), (1, "return", "a", 2.0)], "trees": [(0, "return", "b", 0.4), (0, "return", "c", 0.0), (0, "direction", "b", 0.1), (0, "direction", "c", 0.3)]})
    heads = {(r["model"], r["fold"], r["head"]): r["s"] for r in ln.shares(table).groupBy("model", "fold", "head").agg(F.sum("share").alias("s")).collect()}
    assert len(heads) == 4 and all(v == pytest.approx(1.0) for v in heads.values())
    single = ln.importances(table)
    got = {(r["fold"], r["feature"]): r["importance"] for r in ln.ensemble_importance(single, {"linear": 3.0, "trees": 1.0}).collect()}
    b = (1 + 0.25) / 2
    assert got == pytest.approx({(0, "a"): 0.75 * 0.75, (0, "b"): 0.25 * 0.75 + b * 0.25, (0, "c"): 0.25 * 0.75 / 2, (1, "a"): 1.0})


def test_final_table_fits_no_source_beyond_the_one_that_answers(monkeypatch, spark):
    from tidemark.plans import learners as ln
    calls = []
    preds = spark.range(40).selectExpr("id AS event_id", "CAST(id AS double) AS y", "0.0D AS r_hat", "'linear' AS model")
    monkeypatch.setattr(ln, "split", lambda e, f: (None, None))
    monkeypatch.setattr(ln.lf, "fit", lambda *a, **k: [])
    monkeypatch.setattr(ln.bl, "base_rates", lambda s: None)
    monkeypatch.setattr(ln.lf, "predict", lambda *a: calls.append("in_sample") or preds)
    monkeypatch.setattr(ln.lf, "walk_forward", lambda *a, **k: calls.append("walk") or preds)
    rows = spark.sql("SELECT 1L AS event_id, true AS trainable, TIMESTAMP '2001-01-01' AS t0")
    folds = spark.sql("SELECT '2000Q1' AS season, true AS held")
    assert ln.final_table(rows, rows, folds, []).first()["band_source"] == "walk_forward" and calls == ["walk"]
