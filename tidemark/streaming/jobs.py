"""Incremental maintenance as Structured Streaming.

Sinks write one folder per micro-batch (``batch=<id>``, overwritten on a retry), so a restarted
batch replaces its own output and every row lands exactly once. Tables that take later versions
of a row keep all versions with their batch number; the reader takes the last one per key and
`compact` folds the log into a plain table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.dedup import latest_per_key
from tidemark.plans import events as evt

VERSION = "batch"


def stream_table(spark: SparkSession, path: str, schema: str, *, files_per_batch: int | None = None) -> DataFrame:
    """A folder or glob of landed parquet files as a stream, oldest first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process everything that has landed, then stop. Restarting with the same checkpoint picks
    up where the last run ended."""
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .foreachBatch(sink).start())
    q.awaitTermination()
    return q


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{VERSION}={batch}")
    return write


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, {VERSION} bigint").parquet(path)


def latest_view(log: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Last version per key: by batch, then by `order` inside one."""
    return latest_per_key(log, list(key), [VERSION, *order])


def compact(log: DataFrame, key: Sequence[str], path: str, order: Sequence[str] = ()) -> None:
    latest_view(log, key, order).drop(VERSION).write.mode("overwrite").parquet(path)


# ---- bars ------------------------------------------------------------------------------------
BAR_COLUMNS = "market string, t timestamp, t_end timestamp, open double, high double, low double, close double, volume double, n_trades bigint"


PART_COLUMNS = ("market string, t timestamp, t_end timestamp, first struct<ts: timestamp, event_id: bigint, value: double>, "
                "last struct<ts: timestamp, event_id: bigint, value: double>, high double, low double, volume double, n_trades bigint")


def partial_bars(ticks: DataFrame, *, width: str = "1 hour") -> DataFrame:
    """Ticks (market, ts, event_id, value) to mergeable parts of bars: the first and the last tick instead of
    open and close. Ticks combine map-side, so a hot market sends one row per task and window."""
    tick = F.struct("ts", "event_id", "value")
    return (ticks.groupBy("market", F.window("ts", width).alias("w"))
            .agg(F.min(tick).alias("first"), F.max(tick).alias("last"), F.max("value").alias("high"), F.min("value").alias("low"),
                 F.sum("value").alias("volume"), F.count("*").alias("n_trades"))
            .select("market", F.col("w.start").alias("t"), F.col("w.end").alias("t_end"), "first", "last", "high", "low", "volume", "n_trades"))


def merged_bars(parts: DataFrame) -> DataFrame:
    """Bars from the parts of all batches. Ticks may have landed in any order and any batch."""
    return (parts.groupBy("market", "t", "t_end")
            .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.sum("volume").alias("volume"), F.sum("n_trades").alias("n_trades"))
            .select("market", "t", "t_end", F.col("first.value").alias("open"), "high", "low", F.col("last.value").alias("close"), "volume", "n_trades"))


def stream_bars(ticks: DataFrame, path: str, checkpoint: str) -> None:
    """Each batch logs the parts its ticks make; nothing waits for a watermark, so no tick is late."""
    write = batch_writer(path)
    run_available(ticks, checkpoint, lambda df, b: write(partial_bars(df), b))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return merged_bars(read_log(spark, path, PART_COLUMNS))


def stream_upsert(versions: DataFrame, path: str, checkpoint: str, *, key: Sequence[str], order: Sequence[str]) -> None:
    """Versions of keyed rows: each batch logs its last version per key by `order`. Read them with
    `latest_by_event`, which takes the last version of all batches whatever order they landed in."""
    write = batch_writer(path)
    run_available(versions, checkpoint, lambda df, b: write(latest_per_key(df, list(key), list(order)), b))


def latest_by_event(log: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last version per key by the rows' own order; a repeated pull of an old row changes nothing."""
    return latest_per_key(log, list(key), list(order)).drop(VERSION)


def stream_partitioned(rows: DataFrame, path: str, checkpoint: str, *, by: str) -> None:
    """Append to a table partitioned by `by` with the exactly-once file sink."""
    q = (rows.writeStream.format("parquet").partitionBy(by).option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_log(rows: DataFrame, path: str, checkpoint: str, *, key: Sequence[str], schema: str, ts: str) -> None:
    """Append-only log: rows whose key an earlier batch already holds are skipped. `ts` is the instant in
    the key; the log is partitioned by its day, and only the days of a batch are read again."""
    if ts not in key:
        raise ValueError(f"{ts} must be part of the key")
    day = F.coalesce(F.to_date(ts), F.lit("1970-01-01").cast("date"))

    def write(df: DataFrame, batch: int) -> None:
        fresh = latest_per_key(df, list(key), [c for c in df.columns if c not in key]).withColumn("day", day)
        if batch > 0:
            days = [r["day"] for r in df.select(day.alias("day")).distinct().collect()]  # bounded by the calendar
            have = df.sparkSession.read.schema(f"{schema}, {VERSION} bigint, day date").parquet(path)
            have = have.filter((F.col(VERSION) < batch) & F.col("day").isin(days)).select(*[F.col(k).alias(f"_k_{k}") for k in key])
            fresh = fresh.join(have, [fresh[k].eqNullSafe(have[f"_k_{k}"]) for k in key], "left_anti")
        fresh.write.mode("overwrite").partitionBy("day").parquet(f"{path}/{VERSION}={batch}")
    run_available(rows, checkpoint, write)


# ---- detector --------------------------------------------------------------------------------
def stream_detect(bars: DataFrame, archive: str, found: str, checkpoint: str, rules: evt.DetectorRules) -> None:
    """Detector on closed bars: each batch is added to the bar archive, the days it touches are
    judged against the archive's last days, and a (market, day) is emitted once, by the batch
    that first finds it. What is read again reaches back `rules.days` days with bars of each market,
    however far apart they lie, and is pruned by `day`."""
    def step(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        local = F.to_date(F.from_utc_timestamp(F.col("t"), rules.zone))
        df.withColumn("day", local).write.mode("overwrite").partitionBy("day").parquet(f"{archive}/{VERSION}={batch}")
        all_bars = spark.read.schema(f"{BAR_COLUMNS}, {VERSION} bigint, day date").parquet(archive).filter(F.col(VERSION) <= batch)
        span = df.agg(F.min(local).alias("lo"), F.max(local).alias("hi")).first()
        if span["lo"] is None:
            return
        days = all_bars.filter(F.col("day") < F.lit(span["lo"])).select("market", "day").distinct()  # one row per market and day
        back = Window.partitionBy("market").orderBy(F.col("day").desc())
        since = days.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= rules.days + 1).groupBy("market").agg(F.min("day").alias("_since"))
        near = all_bars.filter(F.col("day") <= F.lit(span["hi"])).join(since, "market", "left")
        near = near.filter(F.col("day") >= F.coalesce("_since", F.lit(span["lo"]))).drop("_since")
        unique = latest_per_key(near, ["market", "t"], [VERSION]).drop(VERSION, "day")
        hits = evt.detect_release(unique, rules).filter(F.col("day").between(F.lit(span["lo"]), F.lit(span["hi"])))
        if batch > 0:
            seen = read_log(spark, found, "market string, day date, t timestamp, first_bar boolean").filter(F.col(VERSION) < batch)
            hits = hits.join(seen.select("market", "day"), ["market", "day"], "left_anti")
        hits.write.mode("overwrite").parquet(f"{found}/{VERSION}={batch}")
    run_available(bars, checkpoint, step)


# ---- live rows -------------------------------------------------------------------------------
def tick_stream(events: DataFrame, kinds: Column | None = None) -> DataFrame:
    rows = events if kinds is None else events.filter(kinds)
    return rows.select(F.col("event_type").alias("market"), "ts", "value", "event_id", "user_id", "props")
