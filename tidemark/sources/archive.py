"""Archive maintenance: windowed scans, coverage, gaps and idempotent merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import SCHEMA_VERSION
from tidemark.functions import scalars as fn
from tidemark.operators.asof import DAY, time_bucket
from tidemark.operators.dedup import latest_per_key


def scan_window(candles: DataFrame, *, start: Column, end: Column, key: Sequence[str] = ("market", "t"), seq: str = "seq") -> DataFrame:
    """Bars with start <= t < end, the last ingested version per key. The time filter sits on
    the scan column, so it prunes row groups and partitions."""
    return latest_per_key(candles.filter((F.col("t") >= start) & (F.col("t") < end)), list(key), [seq])


def scan_recent(snapshots: DataFrame, *, as_of: Column, days: int, dt: str = "dt", t: str = "t") -> DataFrame:
    """Snapshots at or before `as_of` from day partitions within `days` before it."""
    day = F.col(dt)
    return snapshots.filter((day >= F.date_sub(as_of.cast("date"), days)) & (day <= as_of.cast("date")) & (F.col(t) <= as_of))


def coverage(bars: DataFrame) -> DataFrame:
    """Per interval: markets, rows, first and newest bar, and the most stale market. Two
    aggregations: per market with map-side combine, then over the few markets."""
    per = bars.groupBy("interval", "market").agg(F.count("*").alias("rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return per.groupBy("interval").agg(
        F.count("*").alias("markets"), F.sum("rows").alias("rows"), F.min("first_t").alias("first_t"), F.max("last_t").alias("newest_t"),
        F.min(F.struct("last_t", "market")).alias("_s")).select("interval", "markets", "rows", "first_t", "newest_t",
                                                                F.col("_s.market").alias("stale_market"), F.col("_s.last_t").alias("stale_t"))


def gap_report(bars: DataFrame, *, step: int, bucket: int = 30 * DAY) -> DataFrame:
    """Holes between consecutive bars per market, two-level: `lead` inside a time bucket, and
    the first bar of the next bucket for a bucket's last row."""
    b = bars.select("market", "t", "t_end").withColumn("_b", time_bucket(F.col("t"), bucket))
    firsts = b.groupBy("market", "_b").agg(F.min("t").alias("_first"))
    nxt = firsts.select("market", "_b", F.lead("_first").over(Window.partitionBy("market").orderBy("_b")).alias("_next"))
    lead = F.lead("t").over(Window.partitionBy("market", "_b").orderBy("t"))
    j = b.withColumn("_lead", lead).join(nxt, ["market", "_b"]).withColumn("gap_to", F.coalesce("_lead", "_next"))
    return (j.filter(F.col("gap_to") > F.col("t_end"))
            .select("market", F.col("t_end").alias("gap_from"), "gap_to",
                    (fn.seconds_between(F.col("gap_to"), F.col("t_end")) / step).cast("bigint").alias("missing")))


def with_previous(bars: DataFrame, value: str, into: str, *, bucket: int = 30 * DAY) -> DataFrame:
    """`value` of each market's bar before, two-level as in `gap_report`: a lag inside a time bucket, and the last
    bar of the bucket before for a bucket's first row."""
    b = bars.withColumn("_b", time_bucket(F.col("t"), bucket))
    lasts = b.groupBy("market", "_b").agg(F.max_by(value, "t").alias("_last"))
    before = lasts.select("market", "_b", F.lag("_last").over(Window.partitionBy("market").orderBy("_b")).alias("_before"))  # one row per bucket
    w = Window.partitionBy("market", "_b").orderBy("t")
    j = b.withColumns({"_lag": F.lag(value).over(w), "_n": F.row_number().over(w)}).join(before, ["market", "_b"])
    return j.withColumn(into, F.when(F.col("_n") > 1, F.col("_lag")).otherwise(F.col("_before"))).drop("_b", "_lag", "_n", "_before")


def horizon_gap(archived: DataFrame, served: DataFrame, *, step: int) -> DataFrame:
    """Bars between the end of each market's archive and the newest served bar."""
    top = served.agg(F.max("t_end").alias("horizon"))  # one row
    last = archived.groupBy("market").agg(F.max("t_end").alias("last_end"))
    return last.join(F.broadcast(top)).withColumn(
        "missing", (fn.seconds_between(F.col("horizon"), F.col("last_end")) / step).cast("bigint"))


def upsert(archive: DataFrame, incoming: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Archive with incoming rows replacing stored ones of the same key. `seq` orders versions
    inside either side; incoming always wins."""
    both = archive.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, list(key), ["_new", "seq"]).drop("_new")


def upsert_counts(archive: DataFrame, incoming: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Rows added and replaced by a merge."""
    old = archive.select(*key).distinct().withColumn("_old", F.lit(True))
    new = incoming.select(*key).distinct().join(old, list(key), "left")
    return new.agg(F.count_if(F.col("_old").isNull()).alias("added"), F.count_if(F.col("_old").isNotNull()).alias("replaced"))


def append_missing(log: DataFrame, rows: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Log plus the rows whose key it lacks; importing twice changes nothing. Null keys match."""
    have = log.select(*[F.col(k).alias(f"_k_{k}") for k in key]).distinct()
    cond = [rows[k].eqNullSafe(have[f"_k_{k}"]) for k in key]
    return log.unionByName(rows.join(have, cond, "left_anti"), allowMissingColumns=True)


def write_versioned(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet with a `schema_version` column; the commit protocol makes the write atomic."""
    w = df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_versioned(spark, path: str, schema: str | None = None) -> DataFrame:
    """A versioned table; a table of a newer schema version than this code is refused."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    ok = F.col("schema_version") <= SCHEMA_VERSION
    return df.filter(F.when(ok, True).otherwise(F.raise_error(F.lit("table written by a newer schema version")).cast("boolean")))
