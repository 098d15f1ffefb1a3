"""As-of, range and interval operators against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import HOUR, asof_join, asof_lookup, asof_points
from tidemark.operators.intervals import peak_concurrency
from tidemark.operators.ranges import range_aggregate, running_totals, sequence_number, shifted

T0 = datetime(2024, 1, 1)


def make(spark, seed, n=120, grid=None):
    rnd = random.Random(seed)
    span = 6 * 24 * 60
    step = grid or 1
    # one hot key holds most rows; another has none on the right side
    keys = ["hot"] * 8 + ["cold", "none"]
    left = [(i, rnd.choice(keys), T0 + timedelta(minutes=rnd.randrange(span), seconds=rnd.choice([0, 0, 7]))) for i in range(n)]
    slots = sorted({(rnd.choice(keys[:-1]), rnd.randrange(0, span, step)) for _ in range(n)})
    right = [(k, T0 + timedelta(minutes=m), float(j)) for j, (k, m) in enumerate(slots)]
    return left, right, spark.createDataFrame(left, "id int, k string, at timestamp"), spark.createDataFrame(right, "k string, t timestamp, v double")


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("grid", [None, 15])
def test_asof_matches_brute_force(spark, direction, strict, grid):
    left, right, dl, dr = make(spark, 3, grid=grid)
    out = asof_join(dl, dr, on=["k"], left_ts="at", right_ts="t", take=["t", "v"], direction=direction, strict=strict, bucket=7 * HOUR,
                    grid=grid * 60 if grid else None)
    got = {r["id"]: (r["hit"]["v"] if r["hit"] else None) for r in out.collect()}
    for i, k, at in left:
        if direction == "backward":
            ok = [(t, v) for kk, t, v in right if kk == k and (t < at if strict else t <= at)]
            want = max(ok)[1] if ok else None
        else:
            ok = [(t, v) for kk, t, v in right if kk == k and (t > at if strict else t >= at)]
            want = min(ok)[1] if ok else None
        assert got[i] == want
    assert len(got) == len(left)


def test_ties_take_the_largest_sequence(spark):
    right = spark.createDataFrame([("a", T0, 1.0, 2), ("a", T0, 5.0, 1)], "k string, t timestamp, v double, seq int")
    left = spark.createDataFrame([("a", T0)], "k string, at timestamp")
    hit = asof_join(left, right, on=["k"], left_ts="at", right_ts="t", take=["v"], tie="seq").first()["hit"]
    assert hit["v"] == 1.0


def test_null_instants_and_unkeyed_lookup(spark):
    right = spark.createDataFrame([(T0, 1.0), (T0 + timedelta(days=3), 2.0)], "t timestamp, v double")
    left = spark.createDataFrame([(1, None), (2, T0 + timedelta(days=2)), (3, T0 - timedelta(days=1))], "id int, at timestamp")
    got = {r["id"]: r["hit"] and r["hit"]["v"] for r in asof_lookup(left, right, left_ts="at", right_ts="t", take=["v"]).collect()}
    assert got == {1: None, 2: 1.0, 3: None}


def test_points_share_one_row_per_key(spark):
    right = spark.createDataFrame([("a", T0 + timedelta(hours=h), float(h)) for h in range(5)], "k string, t timestamp, v double")
    left = spark.createDataFrame([(1, "a", T0 + timedelta(hours=3))], "id int, k string, at timestamp")
    r = asof_points(left, right, key=["id"], on=["k"], right_ts="t", take=["v"],
                    points={"now": F.col("at"), "before": F.col("at") - F.expr("INTERVAL 90 MINUTES"), "never": F.lit(None).cast("timestamp")}).collect()
    assert len(r) == 1 and r[0]["now"]["v"] == 3.0 and r[0]["before"]["v"] == 1.0 and r[0]["never"]["v"] is None


def test_range_aggregate(spark):
    left, right, dl, dr = make(spark, 5)
    spans = dl.withColumn("hi", F.col("at") + F.expr("INTERVAL 9 HOURS"))
    got = {r["id"]: (r["n"], r["m"]) for r in range_aggregate(spans, dr, key=["id"], on=["k"], lo="at", hi="hi", right_ts="t", bucket=2 * HOUR, take=["v"],
                                                              aggs=[F.count("*").alias("n"), F.max("v").alias("m")]).collect()}
    for i, k, at in left:
        ok = [v for kk, t, v in right if kk == k and at < t <= at + timedelta(hours=9)]
        assert got.get(i) == ((len(ok), max(ok)) if ok else None)


def test_running_totals_numbers_and_shifts(spark):
    _, right, _, dr = make(spark, 9)
    out = running_totals(dr, on=["k"], order=["t"], ts="t", totals={"s": F.col("v")}, bucket=5 * HOUR)
    num = sequence_number(out, on=["k"], order=["t"], ts="t", bucket=5 * HOUR)
    rows = shifted(num, on=["k"], seq="seq", lags=[2], take="v", prefix="lag").collect()
    for r in rows:
        past = sorted((t, v) for kk, t, v in right if kk == r["k"] and t <= r["t"])
        assert r["s"] == pytest.approx(sum(v for _, v in past)) and r["seq"] == len(past)
        assert r["lag2"] == (past[-3][1] if len(past) > 2 else None)


def test_peak_concurrency(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(150):
        start = T0 + timedelta(minutes=rnd.randrange(2000))
        rows.append((rnd.choice(["a", "a", "a", "b"]), i, start, start + timedelta(minutes=rnd.choice([0, 1, 7, 30, 45, 600]))))
    df = spark.createDataFrame(rows, "m string, id int, a timestamp, z timestamp")
    got = {r["id"]: r["peak"] for r in peak_concurrency(df, by=["m"], key="id", entry="a", exit_="z", bucket=3 * HOUR).collect()}
    for m, i, a, z in rows:
        times = {x for mm, _, s, e in rows if mm == m for x in (s, e) if a <= x <= z}
        want = max(sum(1 for mm, _, s, e in rows if mm == m and s <= t) - sum(1 for mm, _, s, e in rows if mm == m and e < t) for t in times)
        assert got[i] == want


def test_nearest_date_match_against_pairs_and_without_a_join(spark):
    from datetime import date, timedelta
    from tidemark.operators import matchers as mt
    first = date(1969, 12, 1)  # spans meet at multiples of their length, also below zero
    left = [(i, i % 3 if i % 10 else None, first + timedelta(days=i * 13 % 420) if i % 11 else None) for i in range(80)]
    right = [(i % 4, first + timedelta(days=i * i * 7 % 430) if i % 9 else None, i % 5, float(i)) for i in range(120)]
    a = spark.createDataFrame(left, "id int, u int, day date")
    b = spark.createDataFrame(right, "u int, other date, seq int, v double")
    got = mt.nearest_date_match(a, b, key="id", on="u", day="day", other_day="other", window=10, take=["v"], order=["seq", "v"], keep=("day",))
    want = set()
    for i, u, day in left:
        near = [(abs((o - day).days), o, s, v) for w, o, s, v in right if u is not None and day and w == u and o and abs((o - day).days) <= 10]
        if near:
            _, o, _, v = min(near)
            want.add((i, day, o, (o - day).days, v))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_market_at_t0_makes_no_row_per_market(spark):
    from datetime import datetime
    from tidemark.operators import matchers as mt
    d = datetime
    mk = spark.createDataFrame([("a", "late", True, d(2024, 3, 1)), ("a", "x2", False, d(2024, 1, 1)), ("a", "x1", False, d(2024, 1, 1)), ("a", "y", None, d(2023, 12, 1)),
                                ("b", "q", True, None), ("b", "p", True, d(2024, 2, 1)), ("c", "o", False, d(2025, 1, 1))], "underlying string, market string, is_primary boolean, listing_start timestamp")
    ev = spark.createDataFrame([(1, "a", d(2024, 4, 1)), (2, "a", d(2024, 1, 1)), (3, "a", d(2023, 1, 1)), (4, "b", d(2024, 1, 1)), (5, "b", d(2024, 2, 1)), (6, "c", d(2024, 1, 1)), (7, "a", None), (8, "z", d(2024, 1, 1))],
                               "event_id int, underlying string, t0 timestamp")
    out = mt.market_at_t0(ev, mk)
    assert {tuple(r) for r in out.collect()} == {(1, "late", True), (2, "y", True), (3, "late", False), (4, "p", False), (5, "p", True), (6, None, False), (7, "late", False)}
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert min(i for i, x in enumerate(plan) if "Aggregate" in x) > min(i for i, x in enumerate(plan) if "Join" in x)  # markets are summed up below the join
