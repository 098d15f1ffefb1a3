"""The best baseline of every decision time, subset and metric, against plain loops."""

import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.plans import evaluate as ev
from tidemark.sources.domain import Inputs

SF = "/root/testdata/sf0.001"
METRICS = ("accuracy", "brier", "log_loss", "spearman_ic", "mae", "magnitude_mae")
HEADLINE = ("sec_8k", "manual", "detected")


def subsets_of(r):
    names = ["all"] + [f"{c}={r[c]}" for c in ("t0_source", "kind", "timing") if r[c] is not None]
    perp = bool(r["has_perp"])
    sure = r["t0_confidence"] is not None and r["t0_confidence"] >= 0.6
    return names + ["has_perp_at_t0"] * perp + ["headline"] * (perp and sure and r["t0_source"] in HEADLINE)


def rank_correlation(x, y):
    """From twice the averaged ranks, in whole numbers, so that equal correlations are equal."""
    x, y = np.array(x), np.array(y)
    n = len(x)
    a, b = ([int(2 * (v < u).sum() + (v == u).sum() + 1) for u in v] for v in (x, y))
    m = n * (n + 1) * (n + 1)  # four times the sum of products about the mean
    ab, aa, bb = (sum(p * q for p, q in zip(s, t)) - m for s, t in ((a, b), (a, a), (b, b)))
    return ab / math.sqrt(aa * bb) if n >= 3 and aa and bb else None


def plain_best(rows, baselines):
    """{(decision_time, subset, metric): (model, value)}; the first of `baselines` on ties."""
    cells = defaultdict(list)
    for r in rows:
        if r["r_true"] is not None:
            for s in subsets_of(r):
                cells[r["decision_time"], s, r["model"]].append(r)
    best = {}
    for d, s in {k[:2] for k in cells}:
        for metric in METRICS:
            for model in baselines:
                c = cells.get((d, s, model), [])
                moved = [(r["p_up"], float(r["r_true"] > 0)) for r in c if r["r_true"] != 0]
                size = [(r["magnitude_hat"] if r["magnitude_hat"] is not None else abs(r["r_hat"]), abs(r["r_true"])) for r in c]
                v = {"accuracy": [0.5 if p == 0.5 else float((p > 0.5) == (u == 1)) for p, u in moved], "brier": [(p - u) ** 2 for p, u in moved],
                     "log_loss": [-math.log(min(max(p if u else 1 - p, 1e-6), 1 - 1e-6)) for p, u in moved],
                     "mae": [abs(r["r_true"] - r["r_hat"]) for r in c], "magnitude_mae": [abs(a - b) for a, b in size]}.get(metric)
                v = rank_correlation([r["r_hat"] for r in c], [r["r_true"] for r in c]) if v is None else float(np.mean(v)) if v else None
                if v is None:
                    continue
                had = best.get((d, s, metric))
                if had is None or (v > had[1] + 1e-12 if metric in ("accuracy", "spearman_ic") else v < had[1] - 1e-12):
                    best[d, s, metric] = (model, v)
    return best


def test_query_covers_every_subset_and_metric(spark):
    got = {(r["decision_time"], r["subset"], r["metric"]): (r["model"], r["value"]) for r in entry.queries()["agg_best_baseline"](spark, SF).collect()}
    want = plain_best([r.asDict() for r in Inputs(spark, SF).predictions.collect()], ("zero", "base_rate"))
    assert {m for _, _, m in got} == set(METRICS)
    assert {"all", "has_perp_at_t0", "headline", "t0_source=sec_8k", "kind=event", "timing=BMO"} <= {s for _, s, _ in got}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()}, abs=1e-6)


def test_query_equals_statement(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    res = con.execute(entry.oracle_sql()["agg_best_baseline"])
    cols = [d[0] for d in res.description]
    want = sorted(tuple(r) for r in res.fetchall())
    got = sorted(tuple(r[c] for c in cols) for r in entry.queries()["agg_best_baseline"](spark, SF).collect())
    assert [g[:-1] for g in got] == [w[:-1] for w in want] and [g[-1] for g in got] == pytest.approx([w[-1] for w in want], abs=1e-5)


def test_constant_forecasts_small_subsets_and_missing_strata(spark):
    """A constant forecast has no rank correlation, two rows have none either, and a row without a stratum is in the other subsets only."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        r = 0.0 if i == 7 else None if i == 8 else float(np.round(rng.normal(), 2))
        kind = "rare" if i < 2 else None if i < 5 else "event"
        for model, p, hat, size in (("zero", 0.5, 0.0, 0.0), ("noise", float(rng.integers(0, 11)) / 10, float(np.round(rng.normal(), 1)), None), ("learner", 0.9, 1.0, 1.0)):
            rows.append((i, model, "t", f"2001-02-{1 + i % 28:02d} 12:00:00", r, p, hat, size, [0.3, None, 0.9][i % 3], "manual" if i % 2 else "calendar_flag", kind, "AMC", [True, None, False][i % 5 % 3]))
    df = spark.createDataFrame(rows, "event_id long, model string, decision_time string, t0 string, r_true double, p_up double, r_hat double, magnitude_hat double, "
                                     "t0_confidence double, t0_source string, kind string, timing string, has_perp boolean").withColumn("t0", F.col("t0").cast("timestamp"))
    out = ev.best_baseline(ev.eval_cells(ev.score_rows(df)), ["zero", "noise"]).collect()
    got = {(r["decision_time"], r["subset"], r["metric"]): (r["model"], r["value"]) for r in out}
    want = plain_best([r.asDict() for r in df.collect()], ("zero", "noise"))
    assert got["t", "all", "spearman_ic"][0] == "noise" and ("t", "kind=rare", "spearman_ic") not in got and ("t", "kind=rare", "mae") in got
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()}, abs=1e-9)
