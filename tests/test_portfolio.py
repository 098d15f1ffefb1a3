"""Range maxima over blocks of instants and portfolios of overlapping subsets, against plain versions."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals
from tidemark.plans import trades as tr

T0 = datetime(2001, 1, 1)


def n_open(rows, t):
    return sum(a <= t for a, _ in rows) - sum(z < t for _, z in rows)


def peak(rows, a, z):
    return max(n_open(rows, t) for t in {x for r in rows for x in r} if a <= t <= z)


@pytest.mark.parametrize("block", [1, 4, 2048])
def test_peaks_of_overlapping_slices(spark, block):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        start = T0 + timedelta(minutes=rng.randrange(4000))
        rows.append((rng.choice("aaab"), i, start, start + timedelta(minutes=rng.choice([0, 1, 7, 45, 45, 900, 3000])), rng.random() < 0.4))
    df = spark.createDataFrame(rows, "m string, id int, a timestamp, z timestamp, f boolean")
    got = {r["id"]: (r["every"], r["some"]) for r in intervals.peaks(df, by=["m"], key="id", entry="a", exit_="z", slices={"every": F.lit(True), "some": F.col("f")}, block=block).collect()}
    for m, i, a, z, f in rows:
        every = [(r[2], r[3]) for r in rows if r[0] == m]
        some = [(r[2], r[3]) for r in rows if r[0] == m and r[4]]
        assert got[i] == (peak(every, a, z), peak(some, a, z) if f else None), i


def test_many_equal_intervals_in_bounded_blocks(spark):
    """One slice, one length, all in a few hours: no group holds more than a block of instants and a minute's."""
    n = 60_000
    df = spark.range(n).select(F.lit("m").alias("m"), "id", F.timestamp_seconds(F.col("id") / 4).alias("a"), F.timestamp_seconds(F.col("id") / 4 + 600).alias("z"))
    marks = df.select("m", F.explode(F.array("a", "z")).alias("ts")).distinct()
    sizes = [r["count"] for r in intervals.row_blocks(marks, by=["m"], ts="ts", each=512).groupBy("blk").count().collect()]
    assert max(sizes) <= 512 + 60 * 4 and len(sizes) > 80
    got = intervals.peak_concurrency(df, by=["m"], key="id", entry="a", exit_="z", block=512)
    assert got.count() == n
    # 2401 starts lie in a closed window of 600 s; while it is open, an interval sees as many as exist on either side
    assert {r["peak"] for r in got.filter("id between 5000 and 50000").select("peak").distinct().collect()} == {2401}


def plain_metrics(rows):
    """rows: size, net_return, entry, exit of the traded positions of one slice."""
    spans = [(a, z) for _, _, a, z in rows]
    w = np.array([min(size, 1) / max(peak(spans, a, z), 1) for size, _, a, z in rows])
    pnl = w * np.array([r[1] for r in rows])
    daily = defaultdict(float)
    for p, r in zip(pnl, rows):
        daily[r[3].date()] += p
    d = np.array([daily[k] for k in sorted(daily)])
    cum = np.cumsum(d)
    open_ = [sum(x for x, (a, z) in zip(w, spans) if a <= t <= z) for t in {x for s in spans for x in s}]
    days = max((max(daily) - min(a.date() for a, _ in spans)).days + 1, 1)
    return {"n_trades": len(rows), "total_return": pnl.sum(), "turnover": 2 * w.sum(), "turnover_daily": 2 * w.sum() / days, "hit_rate": (pnl > 0).mean(), "mean_pnl_per_trade": pnl.mean(), "n_days": len(d),
            "mean_daily_pnl": d.mean(), "sharpe_like": d.mean() / d.std(ddof=1) * np.sqrt(252), "max_drawdown": (np.maximum(np.maximum.accumulate(cum), 0) - cum).max(), "max_gross_exposure": max(open_)}


def test_portfolio_of_overlapping_subsets(spark):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        a = T0 + timedelta(hours=rng.randrange(400))
        traded = rng.random() < 0.8
        rows.append((rng.choice("pq"), "d", rng.choice(["fixed", "half"]), i, traded, rng.choice([0.25, 1.0, 2.0]), rng.gauss(0, 0.02) if traded else None, a if traded else None,
                     a + timedelta(hours=rng.choice([1, 24, 24, 100])) if traded else None, rng.random() < 0.3))
    rows += [("r", "d", "fixed", 900 + k, False, 1.0, None, None, None, True) for k in range(3)]
    df = spark.createDataFrame(rows, "model string, decision_time string, sizing string, event_id int, traded boolean, size double, net_return double, entry_time timestamp, exit_time timestamp, f boolean")
    got = {(r["model"], r["sizing"], r["subset"]): r for r in tr.portfolio_slices(df, {"all": F.lit(True), "few": F.col("f"), "none": F.lit(False)}).collect()}
    want = {(m, s, sub) for m, s in {(r[0], r[2]) for r in rows} for sub in ("all", "few")}
    assert set(got) == want
    for m, s, sub in want:
        own = [r for r in rows if r[0] == m and r[2] == s and (sub == "all" or r[9])]
        held, r = [(x[5], x[6], x[7], x[8]) for x in own if x[4]], got[m, s, sub]
        assert r["n_untraded"] == len(own) - len(held)
        if held:
            for k, v in plain_metrics(held).items():
                assert r[k] == pytest.approx(v, rel=1e-9, abs=1e-12), k
        else:
            assert (r["n_trades"], r["n_days"], r["total_return"], r["turnover"], r["turnover_daily"], r["max_drawdown"], r["max_gross_exposure"], r["sharpe_like"], r["hit_rate"]) == (0, 0, 0, 0, 0, 0, 0, None, None)


def test_priced_trades_are_stored_before_they_are_read_again(monkeypatch):
    class Stop(Exception):
        pass

    def first(df):
        raise Stop(df.columns)
    monkeypatch.setattr(tr, "cut", first)
    from tidemark.session import local_session
    rows = local_session(4, "4g").sql("SELECT 1 AS event_id, 'm' AS model, true AS traded, 1.0D AS size, 0.1D AS net_return, TIMESTAMP '2001-01-01' AS entry_time, TIMESTAMP '2001-01-02' AS exit_time")
    monkeypatch.setattr(tr, "peaks", lambda df, **k: df.selectExpr("model", "event_id", "1 AS `all`"))
    with pytest.raises(Stop, match="traded.*_in_all"):
        tr.portfolio_slices(rows, {"all": F.lit(True)}, by=["model"])
