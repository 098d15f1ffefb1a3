from datetime import datetime

import pytest
from pyspark.errors import PySparkException

from tidemark.functions import scalars as fn
from tidemark.sources import archive as ar
from tidemark.sources import pages as pg
from tidemark.sources import payloads as pl
from tidemark.sources import settings as st
from pyspark.sql import functions as F


def test_landed_files_and_weekly_candles(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"t":1767225600000,"T":1767830399999,"s":"T","i":"1w","o":"1.5","c":"2","h":"3","l":"1","v":"10","n":4}]')
    r = pl.candles(pl.landed(spark, str(tmp_path)).withColumn("seq", F.lit(1))).first()
    assert r["market"] == "T" and r["t_end"] == datetime(2026, 1, 8) and r["open"] == 1.5


def test_context_length_mismatch_is_an_error(spark):
    df = spark.createDataFrame([('{"universe":[{"name":"a"},{"name":"b"}],"ctxs":[{"markPx":"1"}]}', datetime(2026, 1, 1))], "payload string, t timestamp")
    with pytest.raises(PySparkException):
        pl.context(df).collect()


def test_failed_calendar_is_an_error(spark):
    df = spark.createDataFrame([("2026-01-01", '{"data":null,"status":{"rCode":500}}')], "day string, payload string")
    with pytest.raises(PySparkException):
        pl.earnings_calendar(df).collect()


def test_first_row_of_a_symbol_over_the_pages_of_a_day(spark):
    def body(*rows):
        return '{"data":{"rows":[%s]},"status":{"rCode":200}}' % ",".join(f'{{"symbol":"{s}","eps":"${v}"}}' for s, v in rows)
    pages = [("d", 10, body(("a", 4), ("b", 5))), ("d", 2, body(("c", 1), ("b", 2), ("a", 3)))]
    for order in (pages, pages[::-1]):
        df = spark.createDataFrame(order, "day string, page int, payload string")
        assert {r["symbol"]: r["eps_actual"] for r in pl.earnings_calendar(df, page="page").collect()} == {"A": 3.0, "B": 2.0, "C": 1.0}


def test_earnings_of_equal_age_keep_the_smallest_actual(spark):
    old, new = '"lastUpdated":"2026-01-01"', '"lastUpdated":"2026-02-01"'
    rows = [f'{{"symbol":"A","date":"2026-01-01","epsActual":{v},{u}}}' for v, u in ((1, old), (3, new), ("null", new), (2, new))]
    rows += ['{"symbol":"B","date":"2026-01-01","epsActual":null}', '{"symbol":"B","date":"2026-01-01","epsActual":-1}', '{"symbol":"B","date":"2026-01-01","epsActual":0}']
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(f"[{','.join(order)}]",)], "payload string")
        assert {r["symbol"]: r["eps_actual"] for r in pl.earnings(df).collect()} == {"A": 2.0, "B": -1.0}


def test_numbers_and_accessions(spark):
    df = spark.createDataFrame([("$0.65", 0.65), ("109,756,200", 109756200.0), ("(0.12)", -0.12), ("5%", 5.0), ("N/A", None), ("", None)], "s string, v double")
    assert all(r[0] == r[1] for r in df.select(fn.parse_number(F.col("s")), "v").collect())
    one = spark.createDataFrame([("000104581026000073",)], "a string")
    assert one.select(fn.accession(F.col("a"))).first()[0] == "0001045810-26-000073"
    with pytest.raises(PySparkException):
        spark.createDataFrame([("12",)], "a string").select(fn.accession(F.col("a"))).collect()


def test_local_times_in_the_spring_gap_and_autumn_fold_are_flagged(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00", True), ("2024-11-03 01:30:00", True), ("2024-06-03 02:30:00", False), ("2024-11-03 03:30:00", False)], "s string, odd boolean")
    assert all(r[0] == r[1] for r in df.select(fn.is_dst_fold(F.col("s").cast("timestamp")), "odd").collect())


def test_page_text():
    page = "<html><head><title>x</title></head><body><p>A&amp;B  <b>c</b></p><script>no</script><div>d<br>e</div></body></html>"
    assert pg.page_text(page) == "A&B c\nd\ne" and pg.page_text(None) is None


def test_exhibit_prefers_the_press_release(spark):
    row = '<tr><td><a href="/%s">f</a></td><td>%s</td></tr>'
    both = "<table>" + row % ("b.htm", "EX-99.2") + row % ("a.htm", "EX-99.1") + "</table>"
    df = spark.createDataFrame([(1, both), (2, row % ("b.htm", "EX-99.2")), (3, row % ("c.htm", "EX-10"))], "page_id int, html string")
    got = {r["page_id"]: r["e"] for r in df.select("page_id", pg.exhibit_link(F.col("html")).alias("e")).collect()}
    assert got == {1: "/a.htm", 2: "/b.htm", 3: None}


def test_acceptance_in_the_repeated_hour_is_the_later_instant(spark):
    stamps = {"2024-11-03 01:18:05": datetime(2024, 11, 3, 6, 18, 5), "2024-11-03 02:18:05": datetime(2024, 11, 3, 7, 18, 5), "2024-11-03 00:18:05": datetime(2024, 11, 3, 4, 18, 5),
              "2024-03-10 02:30:00": datetime(2024, 3, 10, 7, 30), "2024-07-01 12:00:00": datetime(2024, 7, 1, 16)}
    df = spark.createDataFrame([(s, f"<div>Accepted</div><div>{s}</div>") for s in stamps], "s string, html string")
    assert {r["s"]: r["t"] for r in df.select("s", pg.accepted_instant(F.col("html")).alias("t")).collect()} == stamps


def test_malformed_overrides_are_skipped():
    assert st.parse_flat("A: 1\n# note\nbroken\nB:  x # why\n: 3\n") == [("A", "1"), ("B", "x")]


def test_merge_twice_changes_nothing(spark):
    a = spark.createDataFrame([("m", 1, 1.0, 1), ("m", 2, 2.0, 1)], "k string, t int, v double, seq int")
    b = spark.createDataFrame([("m", 2, 9.0, 1), ("m", 3, 3.0, 1)], "k string, t int, v double, seq int")
    once = ar.upsert(a, b, key=["k", "t"])
    assert sorted((r["t"], r["v"]) for r in ar.upsert(once, b, key=["k", "t"]).collect()) == [(1, 1.0), (2, 9.0), (3, 3.0)]
    assert ar.upsert_counts(a, b, key=["k", "t"]).first().asDict() == {"added": 1, "replaced": 1}


def test_newer_tables_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).withColumn("schema_version", F.lit(99)).write.parquet(path)
    with pytest.raises(PySparkException):
        ar.read_versioned(spark, path).collect()


def test_calendar_follows_rules_without_an_end(spark):
    import re
    from datetime import date

    from tidemark.sources.domain import DOMAIN
    x = spark.createDataFrame([(date(y, m, d),) for y in (1995, 2001, 2004, 2012, 2018, 2025, 2026, 2031, 2038) for m in range(1, 13) for d in range(1, 29)], "d date")
    text = re.sub(r"isodow\((\w+)\)", r"extract(DOW_ISO FROM \1)", DOMAIN["sessions"][0])
    open_ = {r["d"] for r in spark.sql(text, days=x).collect()}
    closed = [date(2001, 9, 11), date(2001, 9, 14), date(2004, 6, 11), date(2018, 12, 5), date(2025, 1, 9),
              date(2026, 4, 3), date(2025, 4, 18), date(2031, 4, 11), date(2038, 4, 23), date(1995, 4, 14), date(2026, 9, 7), date(2026, 11, 26)]
    assert not open_ & set(closed)
    assert {date(2026, 9, 4), date(2026, 9, 8), date(2026, 4, 2), date(2026, 4, 6), date(2001, 9, 17), date(2001, 9, 10), date(2031, 4, 10)} <= open_


def test_instants_outside_the_calendar_are_an_error(spark):
    from datetime import date

    from tidemark.sources.calendar import attach, day_dimension
    days = spark.createDataFrame([(date(2026, 1, d),) for d in range(1, 9)], "d date")
    sessions = spark.createDataFrame([(date(2026, 1, 5), datetime(2026, 1, 5, 14, 30), datetime(2026, 1, 5, 21))], "d date, open_ts timestamp, close_ts timestamp")
    cal = day_dimension(days, sessions)
    rows = spark.createDataFrame([(datetime(2026, 1, 5, 15),), (None,)], "t timestamp")
    assert {r["is_open"] for r in attach(rows, cal, "t").collect()} == {True, None}
    with pytest.raises(Exception, match="outside the calendar"):
        attach(spark.createDataFrame([(datetime(2027, 1, 5),)], "t timestamp"), cal, "t").collect()


def test_clock_readings_that_are_skipped_or_named_twice(spark):
    t = spark.createDataFrame([(datetime(2026, 3, 8, 2, 30),), (datetime(2026, 7, 1, 12),), (datetime(2026, 11, 1, 1, 30),)], "t timestamp")
    assert [r[0] for r in t.select(fn.to_utc(F.col("t"), strict=False)).collect()] == [datetime(2026, 3, 8, 7, 30), datetime(2026, 7, 1, 16), None]
    assert t.filter("month(t) = 7").select(fn.to_utc(F.col("t"))).collect()[0][0] == datetime(2026, 7, 1, 16)
    with pytest.raises(Exception, match="ambiguous"):
        t.select(fn.to_utc(F.col("t"))).collect()
