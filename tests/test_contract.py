"""The driver contract on the smallest folder: a sample of queries against their statements."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.sources.tables import SCHEMAS

SF = "/root/testdata/sf0.001"
SAMPLE = ["asof_price", "asof_consensus", "compute_targets", "feat_history", "resolve_t0", "folds_walk_forward", "trade_pnl", "win_peak_concurrency",
          "score_live", "pat_weekend", "read_candles_json", "merge_events_protect"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in SCHEMAS:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_statements_name_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_statement(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)

    def norm(v):
        return round(v, 5) or 0.0 if isinstance(v, float) else v
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    want = sorted((tuple(norm(v) for v in r) for r in res.fetchall()), key=str)
    assert got == want
