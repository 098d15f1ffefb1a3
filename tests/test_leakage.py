"""Look-ahead traps on the feature groups."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import DAY
from tidemark.plans import features as ft
from tidemark.plans import history as hs


@pytest.fixture(scope="module")
def past(spark):
    d = datetime(2024, 1, 1)
    rows = [(i, 1, d + timedelta(days=10 * i), 0.01 * (i - 2), None, float(i)) for i in range(6)]
    return spark.createDataFrame(rows, "event_id int, underlying int, t0 timestamp, r_24h double, continuation_30m double, eps_surprise double")


def features(df):
    return {r["event_id"]: r for r in hs.history_features(df, horizon=DAY, as_of=F.col("t0")).collect()}


def test_own_return_changes_no_feature(past):
    mine = past.withColumn("r_24h", F.when(F.col("event_id") == 3, 5.0).otherwise(F.col("r_24h")))
    assert features(past)[3] == features(mine)[3]
    assert features(past)[4] != features(mine)[4]


def test_history_counts_settled_events_only(past):
    got = features(past)
    assert [got[i]["hist_n"] for i in range(6)] == [0, 1, 2, 3, 4, 5]
    close = past.withColumn("t0", F.when(F.col("event_id") == 3, F.lit(datetime(2024, 1, 21, 12))).otherwise(F.col("t0")))
    assert features(close)[3]["hist_n"] == 2  # the event twelve hours earlier is not settled
    assert got[5]["hist_last1_r24"] == pytest.approx(0.02) and got[5]["hist_last4_r24"] == pytest.approx(-0.01)


def test_a_settlement_after_the_decision_is_not_seen(past):
    # the release of day 21 settles between the two decisions of the release of day 22
    d = datetime(2024, 1, 22)
    moved = past.withColumn("t0", F.when(F.col("event_id") == 3, F.lit(d)).when(F.col("event_id") == 2, F.lit(d - timedelta(hours=22))).otherwise(F.col("t0")))
    rows = ft.decisions(moved.withColumn("t0_source", F.lit("manual")), {"post_1m": 900, "post_30m": 3 * 3600})
    got = {(r["event_id"], r["decision_time"]): r for r in ft.history_group(moved, rows).collect()}
    assert got[3, "post_1m"]["hist_n"] == 2 and got[3, "post_30m"]["hist_n"] == 3
    full = moved.withColumns({"eps_actual": F.col("eps_surprise"), "eps_estimate": F.lit(1.0), "rev_actual": F.lit(1.0), "rev_estimate": F.lit(1.0), "n_estimates": F.lit(1)})
    more = full.union(full.withColumn("event_id", F.col("event_id") + 100).withColumn("t0", F.col("t0") - F.expr("INTERVAL 300 DAYS")))
    z = {(r["event_id"], r["decision_time"]): r["eps_surprise_z"] for r in ft.surprise_group(more, rows.select(*[c for c in rows.columns])).collect()}
    assert z[3, "post_1m"] is not None and z[3, "post_1m"] != z[3, "post_30m"]
    with pytest.raises(ValueError):
        ft.build_dataset(rows, {"history": hs.history_features(moved, horizon=DAY, as_of=F.col("t0"))}, moved.select("event_id", "r_24h"), [])


def test_leakage_assertion(spark):
    bad = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1, 12))], "past_t0 timestamp, as_of timestamp")
    with pytest.raises(AssertionError):
        ft.assert_no_leak(bad, DAY)
    ft.assert_no_leak(bad.withColumn("as_of", F.lit(datetime(2024, 1, 2))), DAY)


def bars(spark, n):
    d = datetime(2024, 1, 3)
    return spark.createDataFrame([("m", d + timedelta(minutes=5 * i), d + timedelta(minutes=5 * i + 5), 100.0 + i, 101.0 + i, 99.0 + i, 100.0 + i, 10.0 + i % 7) for i in range(n)],
                                 "market string, t timestamp, t_end timestamp, open double, high double, low double, close double, volume double")


def test_bars_that_end_after_the_decision_change_nothing(spark):
    rules = ft.FineRules(staleness=600, grid=300)
    t0 = datetime(2024, 1, 3, 20, 2)
    ev = spark.createDataFrame([(1, "m", t0, "manual")], "event_id int, market string, t0 timestamp, t0_source string")
    rows = ft.decisions(ev, {"post_30m": 1800})
    bench = bars(spark, 400).drop("market")
    ctx = spark.createDataFrame([], "market string, t timestamp, premium double, seq int")
    fund = spark.createDataFrame([], "market string, t timestamp, premium double")
    a = ft.reaction_group(rows, bars(spark, 400), bench, ctx, fund, rules).first()
    short = bars(spark, 400).filter(F.col("t_end") <= F.lit(t0 + timedelta(minutes=30)))
    b = ft.reaction_group(rows, short, bench, ctx, fund, rules).first()
    assert a == b and a["r_30m"] is not None and a["r_60m"] is None and a["r_1m"] is None


def test_registry_rejects_shared_keys_and_unknown_columns(spark):
    with pytest.raises(ValueError):
        ft.feature_group("again", "ret_1d")(lambda: None)
    with pytest.raises(ValueError):
        ft.columns_by_group(spark.createDataFrame([(1.0,)], "f_nope double"))


def test_joins_of_the_groups_stay_out_of_the_datasets_plan(past):
    # all of them have one key: in one plan they make one stage, whose sorts hold memory at once
    rows = ft.decisions(past.withColumn("t0_source", F.lit("manual")), {"post_1m": 900, "post_30m": 3 * 3600})
    group = ft.history_group(past, rows)
    for _ in range(3):
        group = group.join(rows.select(*ft.KEY), ft.KEY)
    out = ft.build_dataset(rows, {"history": group}, past.select("event_id", "r_24h"), [])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and out.count() == 12  # the group's and the targets'


def test_history_is_one_sort_and_the_same_for_names_cut_by_days(spark, past):
    d = datetime(2024, 1, 1)
    rows = [(i, i % 2, d + timedelta(hours=7 * i * i % 900), None if i % 5 == 3 else 0.01 * (i % 7 - 3), None if i % 4 else 1.0, None if i % 3 else float(i)) for i in range(60)]
    ev = past.union(spark.createDataFrame(rows, past.schema).withColumns({"event_id": F.col("event_id") + 100, "underlying": F.col("underlying") + 7}))
    ask = ft.decisions(ev.withColumn("t0_source", F.lit("manual")), {"post_1m": 900, "post_30m": 30 * 3600})
    one, cut_ = ([{k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in hs.history_features(ev, horizon=DAY, rows=ask, most=most).orderBy(*ft.KEY).collect()]
                 for most in (1000, 3))
    assert one == cut_ and len(one) == 132
    last = {(r["event_id"], r["decision_time"], r["age"]): r["past_r"] for r in hs.last_settled(ev.filter("r_24h IS NOT NULL"), depth=4, horizon=DAY, rows=ask).collect()}
    for r in one:
        assert [r[f"hist_last{i}_r24"] for i in (1, 2, 3, 4)] == [last.get((r["event_id"], r["decision_time"], i)) for i in (1, 2, 3, 4)]
    plan = hs.history_features(ev, horizon=DAY, rows=ask)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 8  # no table of past rows is joined back
