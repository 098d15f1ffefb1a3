import random

import numpy as np
import pytest

from tidemark.operators.ranks import digest_index, exact_quantiles, spearman


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    return [("g" if i % 3 else "h", rnd.choice([0.0, 1.0, rnd.random() * 9]), rnd.gauss(0, 1)) for i in range(400)]


def test_quantiles_interpolate_linearly(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double, y double")
    for r in exact_quantiles(df, by=["g"], value="x", probs={"a": 0.1, "m": 0.5, "z": 0.93}).collect():
        x = [v for g, v, _ in rows if g == r["g"]]
        assert [r["a"], r["m"], r["z"]] == pytest.approx(list(np.quantile(x, [0.1, 0.5, 0.93])))
        assert r["n"] == len(x)


def test_spearman_averages_ties(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double, y double")

    def ranks(v):
        v = np.asarray(v)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    for r in spearman(df, by=["g"], x="x", y="y").collect():
        x, y = zip(*[(a, b) for g, a, b in rows if g == r["g"]], strict=True)
        assert r["spearman_ic"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])


def test_spearman_needs_three_varied_pairs(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0)], "g string, x double, y double")
    assert {r["g"]: r["spearman_ic"] for r in spearman(df, by=["g"], x="x", y="y").collect()} == {"a": None, "b": None}


def test_spearman_of_billions_of_pairs(spark):
    pairs = [(1.0, 2.0), (2.0, 1.0), (3.0, 3.0)]
    df = spark.createDataFrame([("a", x, y, w) for x, y in pairs for w in (1_000_000, 2_000_000_000)], "g string, x double, y double, w long")
    assert spearman(df, by=["g"], x="x", y="y", weight="w").first()["spearman_ic"] == pytest.approx(0.5)


def test_digest_index_is_dense(spark):
    df = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 7)], "g string, i int")
    out = digest_index(df, by=["g"], key="i").collect()
    assert sorted(r["idx"] for r in out if r["g"] == "a") == list(range(300))
    assert {r["size"] for r in out if r["g"] == "a"} == {300}
