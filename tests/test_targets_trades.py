"""Hand-computed targets, fills, costs, funding, portfolio and metrics."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans import evaluate as ev
from tidemark.plans import scorecard as sc
from tidemark.plans import targets as tg
from tidemark.plans import trades as tr
from tidemark.sources.calendar import attach, attach_ny_day
from tidemark.sources.domain import exchange_calendar

BARS = "market string, t timestamp, t_end timestamp, open double, high double, low double, close double, volume double"


def five_minute(start: datetime, closes: list[float], market="m"):
    return [(market, start + timedelta(minutes=5 * i), start + timedelta(minutes=5 * i + 5), c, c + 1, c - 1, c, 10.0) for i, c in enumerate(closes)]


@pytest.fixture(scope="module")
def calendar(spark):
    return exchange_calendar(spark, "1995-01-01", "2027-12-31").cache()


RULES = tg.TargetRules(staleness=600, grid=300)


def event(spark, t0, source="manual", ex=None, price_source="hl_archive"):
    return spark.createDataFrame([(1, "m", t0, source, price_source, ex)], "event_id int, market string, t0 timestamp, t0_source string, price_source string, ca_ex_date timestamp")


def path(spark, hours=30):
    start = datetime(2026, 8, 26, 19, 0)
    return spark.createDataFrame(five_minute(start, [200.0 + i * 0.1 for i in range(hours * 12)]), BARS)


def test_reference_price_uses_closed_bars_and_buffer(spark, calendar):
    t0 = datetime(2026, 8, 26, 20, 21, 19)
    base = tg.compute_targets(event(spark, t0), path(spark), None, calendar, RULES).first()
    assert base["p0_time"] == datetime(2026, 8, 26, 20, 20)
    late = tg.compute_targets(event(spark, t0, "sec_8k"), path(spark), None, calendar, RULES).first()
    assert late["p0_time"] == datetime(2026, 8, 26, 20, 15)
    assert base["t_5m"] == datetime(2026, 8, 26, 20, 25) and base["s_5m"] == pytest.approx(79 / 60)
    assert base["label_reason"] is None and base["direction"] == 1.0
    assert base["t_next_open"] == datetime(2026, 8, 27, 13, 30) and base["t_next_close"] == datetime(2026, 8, 27, 20)


def test_bars_after_the_checkpoint_change_nothing(spark, calendar):
    t0 = datetime(2026, 8, 26, 20, 21, 19)
    full = tg.compute_targets(event(spark, t0), path(spark), None, calendar, RULES).first()
    cut = path(spark).filter(F.col("t_end") <= F.lit(t0 + timedelta(minutes=30)))
    part = tg.compute_targets(event(spark, t0), cut, None, calendar, RULES).first()
    for c in ("p0", "r_5m", "r_15m", "r_30m"):
        assert full[c] == part[c]
    assert part["r_24h"] is None and part["label_reason"] == "no_24h_bar"


def test_reasons(spark, calendar):
    p = path(spark)
    def why(e, bars=p):
        return tg.compute_targets(e, bars, None, calendar, RULES).first()["label_reason"]
    assert why(event(spark, None)) == "no_t0"
    assert why(event(spark, datetime(2026, 8, 26, 20, 21)), p.withColumn("market", F.lit("other"))) == "no_path"
    assert why(event(spark, datetime(2026, 8, 26, 18, 0))) == "no_p0"
    assert why(event(spark, datetime(2026, 8, 28, 20, 0))) == "p0_stale"
    assert why(event(spark, datetime(2026, 8, 26, 20, 21), ex=datetime(2026, 8, 27, 4, 0))) == "corporate_action"


def test_split_voids_later_checkpoints_of_unadjusted_paths_only(spark, calendar):
    t0, ex = datetime(2026, 8, 26, 20, 21), datetime(2026, 8, 26, 20, 50)
    perp = tg.compute_targets(event(spark, t0, ex=ex), path(spark), None, calendar, RULES).first()
    proxy = tg.compute_targets(event(spark, t0, ex=ex, price_source="fmp"), path(spark), None, calendar, RULES).first()
    assert perp["r_15m"] is not None and perp["r_60m"] is None and perp["r_24h"] is None
    assert proxy["r_60m"] is not None and proxy["r_24h"] is None


def test_holidays(spark, calendar):
    days = ["2024-07-03", "2024-07-05", "2024-09-03", "2024-11-27", "2024-11-28", "2024-08-28"]
    df = spark.createDataFrame([(d, datetime.fromisoformat(d) + timedelta(hours=18)) for d in days], "d string, t timestamp")
    got = {r["d"]: r["holiday_adjacent"] for r in attach_ny_day(df, calendar, "t").collect()}
    assert got == {"2024-07-03": 1.0, "2024-07-05": 1.0, "2024-09-03": 1.0, "2024-11-27": 1.0, "2024-11-28": 1.0, "2024-08-28": 0.0}


def test_sessions_follow_daylight_time(spark, calendar):
    df = spark.createDataFrame([(1, datetime(2024, 1, 12, 21, 30)), (2, datetime(2024, 7, 2, 12, 0))], "id int, t timestamp")
    r = {x["id"]: x for x in attach(df, calendar, "t").collect()}
    assert r[1]["next_open"] == datetime(2024, 1, 16, 14, 30)  # a Friday before a Monday holiday
    assert r[2]["next_open"] == datetime(2024, 7, 2, 13, 30) and not r[2]["is_open"]


def test_fills(spark):
    bars = spark.createDataFrame([("m", datetime(2026, 1, 1, 20, m), datetime(2026, 1, 1, 20, m + 1), 100.0 + m, 101.0 + m, 99.0 + m, 100.5, 1.0) for m in (3, 4, 10)], BARS)
    sig = spark.createDataFrame([(1, "m", datetime(2026, 1, 1, 20, 3, 30)), (2, "m", datetime(2026, 1, 1, 20, 4)), (3, "m", datetime(2026, 1, 1, 20, 4, 30)),
                                 (4, "m", datetime(2026, 1, 1, 20, 11))], "id int, market string, at timestamp")
    out = {r["id"]: r["f"] for r in tr.fills_at(sig, bars, {"f": F.col("at")}, key=["id"], max_lag=300, grid=60, bucket=86400).collect()}
    assert out[1]["fill"] == 104.0 and out[2]["fill"] == 104.0
    assert out[3]["reason"] == "fill_lag" and out[4]["reason"] == "no_bar_after_signal"
    assert out[1]["range_bps"] == pytest.approx(2 / 104 * 1e4)


def test_funding_needs_every_hour(spark):
    f = spark.createDataFrame([("m", datetime(2026, 1, 1, h), 0.001 * h) for h in (1, 2, 3, 5)], "market string, t timestamp, funding_rate double")
    pos = spark.createDataFrame([(1, "m", datetime(2026, 1, 1, 0, 30), datetime(2026, 1, 1, 3, 10)), (2, "m", datetime(2026, 1, 1, 2, 30), datetime(2026, 1, 1, 5, 0)),
                                 (3, "m", datetime(2026, 1, 1, 1, 5), datetime(2026, 1, 1, 1, 50))], "id int, market string, a timestamp, z timestamp")
    got = {r["id"]: r["funding_sum"] for r in tr.funding_between(pos, f, key=["id"], entry="a", exit_="z").collect()}
    assert got[1] == pytest.approx(0.006) and got[2] is None and got[3] == 0.0


def test_portfolio_of_disjoint_and_equal_positions(spark):
    d = datetime(2026, 1, 1)
    schema = "m string, id int, entry_time timestamp, exit_time timestamp, size double, net_return double"
    apart = spark.createDataFrame([("a", 1, d, d + timedelta(days=1), 1.0, 0.01), ("a", 2, d + timedelta(days=2), d + timedelta(days=3), 1.0, -0.02)], schema)
    r = tr.portfolio_metrics(tr.portfolio_weights(apart, by=["m"], key="id"), by=["m"]).first()
    assert r["total_return"] == pytest.approx(-0.01) and r["max_drawdown"] == pytest.approx(0.02) and r["turnover"] == pytest.approx(4) and r["hit_rate"] == 0.5
    same = spark.createDataFrame([("a", i, d, d + timedelta(days=1), 1.0, 0.01) for i in (1, 2)], schema)
    assert {x["weight"] for x in tr.portfolio_weights(same, by=["m"], key="id").collect()} == {0.5}
    assert tr.portfolio_metrics(tr.portfolio_weights(same, by=["m"], key="id"), by=["m"]).first()["max_gross_exposure"] == pytest.approx(1.0)


def test_metric_values(spark):
    p, y = [0.9, 0.8, 0.3, 0.6, 0.5, 0.7], [1, -1, -1, 1, 1, 0]
    df = spark.createDataFrame([(i, "x", a, float(b), 0.1, 0.1, datetime(2026, 1, 1)) for i, (a, b) in enumerate(zip(p, y, strict=True))],
                               "event_id int, model string, p_up double, r_true double, r_hat double, magnitude_hat double, t0 timestamp")
    r = ev.score_rows(df).groupBy("model").agg(*ev.classification_aggs()).first()
    assert r["n_direction"] == 5 and r["accuracy"] == pytest.approx(0.7) and r["balanced_accuracy"] == pytest.approx(2 / 3) and r["brier"] == pytest.approx(0.23)


def test_season_end():
    assert ev.season_end("2001Q2") == "2001-07-01" and ev.season_end("2026Q4") == "2027-01-01"
    assert date.fromisoformat(ev.season_end("2026Q1")) == date(2026, 4, 1)


def test_ledger_adds_a_pair_as_doubles_in_one_order(spark):
    """Two events whose decimal mean is 0.525 and whose mean of doubles is one bit below."""
    p = [(1, 0.118), (1, 0.449), (2, 0.601), (2, 0.932)]
    assert ((p[0][1] + p[1][1]) + (p[2][1] + p[3][1])) / 4 < 0.525
    rows = [(i, f"n{k}", v, 0.01, 0.02 if k else None) for k in range(40) for i, v in p] + [(3, "null", None, 0.01, 0.02), (4, "open", 0.9, None, 0.02)]
    schema = "id long, pair_id string, p_up double, r double, size_hat double"
    for dealt in (rows, rows[::-1], rows[1::2] + rows[::2]):
        got = sc.calibration_ledger(spark.createDataFrame(dealt, schema).repartition(7)).collect()
        assert [(g["band"], g["n"], g["hit_rate"]) for g in got] == [(2, 40, 1.0)]
        assert got[0]["size_error"] == pytest.approx(0.01)


def test_ledger_with_three_calls_of_an_event_is_the_same_in_any_order(spark):
    """The sum ends on either side of the bound; the smallest is added first."""
    p = next((a, b, c) for a in range(1, 999) for b in range(a, 999) for c in [1425 - a - b] if b <= c < 999
             and (a / 1000 + b / 1000 + c / 1000) / 3 < 0.475 <= (c / 1000 + b / 1000 + a / 1000) / 3)
    schema = "id long, pair_id string, p_up double, r double, size_hat double"
    for dealt in (p, p[::-1]):
        got = sc.calibration_ledger(spark.createDataFrame([(1, "n", v / 1000, 0.01, 0.02) for v in dealt], schema)).collect()
        assert [(g["band"], g["n"]) for g in got] == [(1, 1)]
