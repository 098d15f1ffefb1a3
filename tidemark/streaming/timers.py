"""Decision cards with event-time timers.

Records of one (event, decision) meet in keyed state: the due record sets a deadline, a
detection before it yields a card, and the timer at the deadline yields a note when none came.
Keys are events, so state is spread evenly and each key holds two instants.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

# Fixed values
RETRY_FOR_MS = 15 * 60 * 1000

OUTPUT = StructType([StructField("event_id", LongType()), StructField("decision_time", StringType()), StructField("outcome", StringType()),
                     StructField("at_ms", LongType()), StructField("rerun", BooleanType())])
INSTANT = StructType([StructField("ms", LongType())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Timers need the RocksDB state store; the session's own choice is restored afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class CardTimer(StatefulProcessor):
    """State per key: the due instant and the release detected so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", INSTANT)
        self.seen = handle.getValueState("seen", INSTANT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else None
        seen = self.seen.get()[0] if self.seen.exists() else None
        for batch in rows:
            for kind, ms in zip(batch["kind"], batch["ms"], strict=True):
                if kind == "due":
                    due = int(ms)
                elif seen is None or ms < seen:
                    seen = int(ms)
        if due is not None:
            if not self.due.exists():
                self.handle.registerTimer(due + RETRY_FOR_MS)
            self.due.update((due,))
        if seen is not None:
            self.seen.update((seen,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0]
        seen = self.seen.get()[0] if self.seen.exists() else None
        made = seen is not None and seen <= due + RETRY_FOR_MS
        yield pd.DataFrame({"event_id": [int(key[0])], "decision_time": [str(key[1])], "outcome": ["card" if made else "no release"],
                            "at_ms": [max(due, seen) if made else due + RETRY_FOR_MS], "rerun": [bool(made and seen > due)]})
        self.due.clear()
        self.seen.clear()

    def close(self) -> None:
        pass


def cards(records: DataFrame, *, late: str) -> DataFrame:
    """`records`: event_id, decision_time, kind ('due' or 'detected'), ms, at (event time). The
    outcome is emitted when the watermark passes the deadline. Records older than `late` at their
    arrival are dropped, so `late` must cover the source; where it can't, use `card_parts`."""
    return (records.withWatermark("at", late).groupBy("event_id", "decision_time")
            .transformWithStateInPandas(statefulProcessor=CardTimer(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"))


PARTS = "event_id bigint, decision_time string, due bigint, seen bigint, newest bigint"


def card_parts(records: DataFrame) -> DataFrame:
    """Mergeable state of each key: due instant, earliest detection, newest instant met."""
    ms = F.col("ms")
    return records.groupBy("event_id", "decision_time").agg(
        F.max(F.when(F.col("kind") == "due", ms)).alias("due"), F.min(F.when(F.col("kind") == "detected", ms)).alias("seen"), F.max("ms").alias("newest"))


def card_outcomes(parts: DataFrame) -> DataFrame:
    """Outcomes of the keys whose deadline lies at or before the newest instant of all records. The parts
    of all batches merge first, so records may have landed in any order."""
    now = parts.agg(F.max("newest").alias("_now"))  # one row
    p = parts.groupBy("event_id", "decision_time").agg(F.max("due").alias("due"), F.min("seen").alias("seen"))
    p = p.join(F.broadcast(now)).filter(F.col("due") + RETRY_FOR_MS <= F.col("_now"))
    made = F.coalesce(F.col("seen") <= F.col("due") + RETRY_FOR_MS, F.lit(False))
    return p.select("event_id", "decision_time", F.when(made, "card").otherwise("no release").alias("outcome"),
                    F.when(made, F.greatest("due", "seen")).otherwise(F.col("due") + RETRY_FOR_MS).alias("at_ms"),
                    (made & (F.col("seen") > F.col("due"))).alias("rerun"))
