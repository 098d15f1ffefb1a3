"""Streams over several landed files equal their batch meaning; a rerun adds nothing."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import ENTRIES
from tidemark.sources.domain import Inputs
from tidemark.sources.tables import SCHEMAS
from tidemark.plans import events as evt
from tidemark.streaming import jobs

SF = "/root/testdata/sf0.001"
TICKS = "market string, ts timestamp, value double, event_id bigint"


def landed(spark, tmp_path, parts=4):
    """The ticks split by hash: every file has ticks of the whole time."""
    x = Inputs(spark, SF)
    t = x.events.select(F.col("event_type").alias("market"), "ts", "value", "event_id")
    src = str(tmp_path / "ticks")
    for i in range(parts):
        t.filter(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(src)
    return x, src


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """A data folder whose events lie in four files split by hash."""
    folder = tmp_path_factory.mktemp("scattered")
    for name in SCHEMAS:
        if name != "events":
            (folder / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(4):
        part = str(folder / f"part{i}")
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).coalesce(1).write.parquet(part)
        next((folder / f"part{i}").glob("*.parquet")).rename(folder / f"events{i}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_bars_tumbling", "stream_archive_upsert", "stream_funding_append", "stream_consensus_snapshot", "stream_decision_timer",
                                  "stream_live_log", "stream_detect_release"])
def test_files_in_any_order_equal_batch(spark, scattered, name):
    got, want = (ENTRIES[name].run(spark, d).collect() for d in (scattered, SF))
    assert sorted(map(str, got)) == sorted(map(str, want)) and want


def test_bars_and_upsert(spark, tmp_path):
    x, src = landed(spark, tmp_path)
    data, cp = str(tmp_path / "bars"), str(tmp_path / "cp")
    stream = jobs.stream_table(spark, src, TICKS, files_per_batch=1)
    jobs.stream_bars(stream, data, cp)
    jobs.stream_bars(stream, data, cp)  # nothing new
    got = jobs.read_bars(spark, data).select("market", "t", "open", "close", "n_trades")
    want = x.bars.select("market", "t", "open", "close", "n_trades")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_detector_over_batches(spark, tmp_path):
    x = Inputs(spark, "/root/testdata/sf0.01")
    rules = evt.DetectorRules(clock_window=60, z=2.0)
    src = str(tmp_path / "bars")
    bars = x.bars.select("market", "t", "t_end", "open", "high", "low", "close", "volume", "n_trades").persist()
    day = F.to_date(F.from_utc_timestamp("t", rules.zone))
    for lo, hi in (("2023-12-01", "2024-01-10"), ("2024-01-11", "2024-01-19"), ("2024-01-20", "2024-02-28")):
        bars.filter(day.between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).coalesce(1).write.mode("append").parquet(src)
    stream = jobs.stream_table(spark, src, jobs.BAR_COLUMNS, files_per_batch=1)
    jobs.stream_detect(stream, str(tmp_path / "a"), str(tmp_path / "f"), str(tmp_path / "cp"), rules)
    got = {(r["market"], r["day"]): r["t"] for r in jobs.read_log(spark, str(tmp_path / "f"), "market string, day date, t timestamp, first_bar boolean").collect()}
    want = {(r["market"], r["day"]): r["t"] for r in evt.detect_release(bars, rules).collect()}
    # the previous close of a market's first archived bar is the only input a bounded re-read may lack
    assert got == want


def test_log_skips_known_keys(spark, tmp_path):
    src, data, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    d = datetime(2026, 1, 1)
    schema = "event_id string, run_at timestamp, p double"
    for rows in ([("a", d, 0.1), ("b", d, 0.2)], [("a", d, 0.9), ("c", d + timedelta(hours=1), 0.3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_log(jobs.stream_table(spark, src, schema), data, cp, key=["event_id", "run_at"], schema=schema, ts="run_at")
    assert sorted((r["event_id"], r["p"]) for r in jobs.read_log(spark, data, f"{schema}, day date").collect()) == [("a", 0.1), ("b", 0.2), ("c", 0.3)]
