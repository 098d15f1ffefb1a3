"""Bootstrap intervals against plain resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import bootstrap as bs
from tidemark.plans import evaluate as ev


def made(spark, cells, n=400, seed=1, seasons=9, days=40):
    rng = np.random.default_rng(seed)
    rows = []
    for c in cells:
        for i in range(n):
            d = int(rng.integers(days))
            rows.append((c, f"{c}{i}", f"S{d * seasons // days}", f"d{d:03d}", float(rng.normal(0.1, 1)), float(rng.integers(0, 2)) if rng.random() < 0.8 else None,
                         float(rng.integers(-5, 6)), float(rng.integers(-5, 6)), float(np.round(rng.normal(), 1))))
    return rows, spark.createDataFrame(rows, "cell string, event_id string, season string, day string, a double, b double, x double, z double, y double")


def plain_blocks(values, labels, reps):
    """Sums of whole blocks, drawn as the library draws them."""
    names = bs.by_digest(sorted(set(labels)))
    s = np.array([sum(v for v, x in zip(values, labels) if x == b) for b in names])
    n = np.array([labels.count(b) for b in names])
    t = bs.draws(len(names), reps)
    return (t @ s) / (t @ n)


@pytest.mark.parametrize("seasons, days, scheme", [(9, 40, "block:season"), (3, 40, "block:day")])
def test_intervals_of_many_metrics_equal_plain_blocks(spark, seasons, days, scheme):
    rows, df = made(spark, "pq", seasons=seasons, days=days)
    got = {(r["cell"], r["metric"]): r for r in bs.intervals(df, by=["cell"], metrics=["a", "b"], replicates=300).collect()}
    assert len(got) == 4
    for cell in "pq":
        for k, m in ((4, "a"), (5, "b")):
            own = [r for r in rows if r[0] == cell and r[k] is not None]
            stat = plain_blocks([r[k] for r in own], [r[2 if scheme == "block:season" else 3] for r in own], 300)
            r = got[cell, m]
            assert r["scheme"] == scheme and r["n"] == len(own) and r["point"] == pytest.approx(np.mean([x[k] for x in own]))
            assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.percentile(stat, [2.5, 97.5]))) and r["p_noise"] == pytest.approx((stat <= 0).mean())
            assert r["se_boot"] == pytest.approx(stat.std(ddof=1))


def test_single_events_in_many_ranges(spark):
    """Few seasons and days: events are drawn one by one, whatever the number of ranges they are spread over."""
    rows, df = made(spark, "p", n=3000, seasons=2, days=3)
    values = np.array([r[4] for r in rows])
    for size in (100_000, 50):
        cells = bs.block_intervals(df.groupBy("cell", "season", "day").agg(F.sum("a").alias("s_a"), F.count("a").alias("n_a")), by=["cell"], metrics=["a"], replicates=4000)
        r = bs.event_intervals(df, cells, by=["cell"], metrics=["a"], replicates=4000, range_events=size).first()
        se = values.std() / np.sqrt(len(values))
        assert r["scheme"] == "iid" and r["n_blocks"] == 3000 and r["point"] == pytest.approx(values.mean())
        assert r["se_boot"] == pytest.approx(se, rel=0.06)
        assert (r["lo"] - r["point"], r["hi"] - r["point"]) == pytest.approx((-1.96 * se, 1.96 * se), rel=0.1)


def test_shares_of_a_replicate_add_up():
    counts = np.array([5, 0, 17, 100, 3])
    parts = np.stack([bs.share_of(counts, k, 2000, "cell") for k in range(5)])
    assert (parts.sum(axis=0) == 125).all() and (parts[1] == 0).all()
    assert parts.mean(axis=1) == pytest.approx(counts, rel=0.1)
    assert parts[3].var() == pytest.approx(125 * 0.8 * 0.2, rel=0.15)  # binomial


def test_a_million_events_of_one_day(spark):
    df = spark.range(1_000_000).select(F.lit("p").alias("cell"), F.col("id").alias("event_id"), F.lit("S").alias("season"), F.lit("d").alias("day"), (F.col("id") % 2).cast("double").alias("a"))
    r = bs.intervals(df, by=["cell"], metrics=["a"], replicates=200).first()
    assert r["point"] == 0.5 and r["n"] == 1_000_000 and r["se_boot"] == pytest.approx(0.0005, rel=0.2)


def rank(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def corr(a, b):
    return np.corrcoef(rank(a), rank(b))[0, 1]


@pytest.mark.parametrize("seasons, days, by", [(9, 40, 2), (3, 12, 3), (2, 3, 1)])
def test_rank_gain_equals_plain_resampling(spark, seasons, days, by):
    rows, df = made(spark, "pq", n=90, seasons=seasons, days=days)
    reps = 60
    got = {r["cell"]: r for r in bs.rank_gain(df, by=["cell"], model="x", baseline="z", truth="y", replicates=reps).collect()}
    for cell in "pq":
        own = [r for r in rows if r[0] == cell]
        x, z, y = (np.array([r[k] for r in own]) for k in (6, 7, 8))
        names = bs.by_digest(sorted({r[by] for r in own}))
        at = [np.array([i for i, r in enumerate(own) if r[by] == b]) for b in names]
        stat = []
        for t in bs.draws(len(names), reps):
            i = np.concatenate([np.tile(a, int(k)) for a, k in zip(at, t)])
            stat.append(corr(x[i], y[i]) - corr(z[i], y[i]))
        r, stat = got[cell], np.array(stat)
        assert r["point"] == pytest.approx(corr(x, y) - corr(z, y)) and r["n"] == 90 and r["n_blocks"] == len(names)
        assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.percentile(stat, [2.5, 97.5]))) and r["se_boot"] == pytest.approx(stat.std(ddof=1))


def test_block_ranks_in_many_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [("p", float(v), int(b), 3, 1) for v, b in zip(rng.integers(0, 200, 900), rng.integers(0, 3, 900))]
    df = spark.createDataFrame(rows, "cell string, v double, idx int, size int, weight long")
    got = {r["value"]: r["ranks"] for r in bs.block_ranks(df, by=["cell"], value="v").collect()}
    for v in {r[1] for r in rows}:
        assert got[v] == [sum(r[1] < v and r[2] == b for r in rows) + sum(r[1] == v and r[2] == b for r in rows) / 2 for b in range(3)]


def test_compare_cells_picks_the_best_baseline_and_reads_identical_models(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        r, day = float(np.round(rng.normal(), 3)) + 0.0004, f"2001-{1 + i % 12:02d}-{1 + i % 28:02d}"
        for model, p, hat in (("m", 0.7 if r > 0 else 0.3, r / 2), ("same", 0.5, 0.0), ("zero", 0.5, 0.0), ("bad", 0.3 if r > 0 else 0.7, -r)):
            rows.append((i, model, "t", f"{day} 12:00:00", r, p, hat, abs(hat), 0.9, "manual", "event", "AMC", True))
    df = spark.createDataFrame(rows, "event_id long, model string, decision_time string, t0 string, r_true double, p_up double, r_hat double, magnitude_hat double, "
                                     "t0_confidence double, t0_source string, kind string, timing string, has_perp boolean").withColumn("t0", F.col("t0").cast("timestamp"))
    got = {(r["model"], r["subset"], r["metric"]): r for r in ev.compare_cells(ev.score_rows(df), ("zero", "bad"), replicates=200).collect()}
    assert {s for _, s, _ in got} == {"all", "has_perp_at_t0", "headline", "t0_source=manual", "kind=event", "timing=AMC"}
    best = got["m", "all", "brier"]
    assert best["baseline"] == "zero" and best["improvement"] == pytest.approx(0.25 - 0.09) and best["verdict"] == "improves" and best["n"] == 300
    assert got["m", "all", "accuracy"]["improvement"] == pytest.approx(0.5)
    same = got["same", "all", "brier"]
    assert same["verdict"] == "identical_to_baseline" and same["mde"] == pytest.approx(2.8015852 * np.sqrt(0.25 * 0.75 / 300), rel=1e-6)
    ic = got["m", "all", "spearman_ic"]
    assert ic["baseline"] == "bad" and ic["improvement"] == pytest.approx(2.0) and ic["mde"] is None and ic["verdict"] == "improves"
    assert got["m", "all", "mae"]["baseline"] == "zero" and got["m", "all", "mae"]["improvement"] > 0
