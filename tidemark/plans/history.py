"""A name's own settled past as of an instant, in cumulative form.

An event is settled at t0 + horizon. Settled rows carry running sums per name, so what a
query instant may know is the sums of the rows before it; nothing is joined with all of its past.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.asof import DAY, asof_join, time_bucket
from tidemark.operators.ranges import sequence_number

LAST = (1, 2, 3, 4)
MANY = 1 << 16


def settled_stream(events: DataFrame, horizon: int, bucket: int = DAY) -> DataFrame:
    """Events numbered per underlying in settlement order."""
    s = events.withColumn("settled_at", fn.plus_seconds(F.col("t0"), horizon))
    return sequence_number(s, on=["underlying"], order=["settled_at", "event_id"], ts="settled_at", bucket=bucket)


def asked(events: DataFrame, rows: DataFrame | None, as_of: Column | None) -> tuple[DataFrame, list[str]]:
    """Who asks and when: the decisions `rows` (event_id, decision_time, underlying, as_of), or each event
    once at `as_of`; and the key of the answer."""
    if rows is not None:
        return rows.select("event_id", "decision_time", "underlying", "as_of"), ["event_id", "decision_time"]
    return events.select("event_id", "underlying", as_of.alias("as_of")), ["event_id"]


def last_settled(events: DataFrame, *, depth: int, horizon: int, as_of: Column | None = None, rows: DataFrame | None = None, value: str = "r_24h") -> DataFrame:
    """The `depth` newest earlier events that are settled at each asking instant, as rows."""
    s = settled_stream(events, horizon)
    q, key = asked(events, rows, as_of)
    hit = asof_join(q, s, on=["underlying"], left_ts="as_of", right_ts="settled_at", take=["seq"], tie="seq", bucket=DAY)
    want = hit.filter(F.col("hit").isNotNull()).withColumn(
        "seq", F.explode(F.sequence(F.greatest(F.col("hit.seq") - depth + 1, F.lit(1)), F.col("hit.seq"))))
    past = s.select("underlying", "seq", F.col("event_id").alias("past_event_id"), F.col(value).alias("past_r"), F.col("t0").alias("past_t0"))
    return want.join(past, ["underlying", "seq"]).select(
        *key, "as_of", "past_event_id", "past_r", "past_t0", (F.col("hit.seq") - F.col("seq") + 1).alias("age"))


def history_features(events: DataFrame, *, horizon: int, as_of: Column | None = None, rows: DataFrame | None = None, r: str = "r_24h", cont: str = "continuation_30m",
                     surprise: str = "eps_surprise", most: int = MANY) -> DataFrame:
    """Moments of the past reactions, last four values, continuation rate, surprise slope and
    the moments used to standardise a surprise, as known at each asking instant. Settled events and asking
    instants of a name are one time line, read in one pass; it is cut by days for names with more than `most` events."""
    x, y = F.col("_x"), F.col("_y")
    both = x.isNotNull() & y.isNotNull()
    one = F.lit(1.0)
    totals = {
        "h_n": F.when(y.isNotNull(), one), "h_s1": y, "h_s2": y * y, "h_s3": y * y * y, "h_abs": F.abs(y),
        "h_up": F.when(y > 0, one), "h_cn": F.when(F.col("_c").isNotNull(), one), "h_cu": F.when(F.col("_c") > 0, one),
        "h_xn": F.when(x.isNotNull(), one), "h_x1": x, "h_x2": x * x,
        "h_bn": F.when(both, one), "h_bx": F.when(both, x), "h_by": F.when(both, y), "h_bxx": F.when(both, x * x), "h_bxy": F.when(both, x * y)}
    past = events.select("underlying", fn.plus_seconds(F.col("t0"), horizon).alias("_ts"), F.col("event_id").alias("_id"), *[F.col(c).cast("double").alias(n) for c, n in ((r, "_y"), (cont, "_c"), (surprise, "_x"))])
    past = past.filter(F.col("underlying").isNotNull() & F.col("_ts").isNotNull())
    q, key = asked(events, rows, as_of)
    many = past.groupBy("underlying").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("underlying", F.lit(True).alias("_many"))

    def placed(df: DataFrame) -> DataFrame:
        # of all rows, at most one in `most` is a name with many
        return df.join(F.broadcast(many), "underlying", "left").withColumn("_b", F.when(F.col("_many"), time_bucket(F.col("_ts"), DAY)).otherwise(F.lit(0)))
    past = placed(past)
    asks = placed(q.select("underlying", F.col("as_of").alias("_ts"), F.struct(*key).alias("_ask")))
    line = past.withColumn("_kind", F.lit(0)).unionByName(asks.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    own = Window.partitionBy("underlying", "_b").orderBy("_ts", "_kind", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = line.select("underlying", "_b", "_ask", *[F.sum(e).over(own).alias(f"_s_{k}") for k, e in totals.items()], *_lags("underlying, _b", "_ts, _kind, _id", "_l")).filter(F.col("_ask").isNotNull())
    j = run.join(_opening(past, asks, totals), ["underlying", "_b"], "left")
    hit = j.select("_ask.*", "_s_h_n", *[(F.coalesce(f"_s_{k}", F.lit(0.0)) + F.coalesce(f"_p_{k}", F.lit(0.0))).alias(k) for k in totals],
                   *[f"_l{i}" for i in LAST], F.array(*[f"_o{i}" for i in LAST]).alias("_older"))
    h = {k: F.col(k) for k in totals}
    n, mean = h["h_n"], F.try_divide(h["h_s1"], h["h_n"])
    m2 = F.greatest(h["h_s2"] / F.when(n > 0, n) - mean * mean, F.lit(0.0))
    var = m2 * n / F.when(n > 1, n - 1)
    m3 = h["h_s3"] / F.when(n > 0, n) - 3 * mean * h["h_s2"] / F.when(n > 0, n) + 2 * mean * mean * mean
    tiny = 1e-12
    skew = F.when((n >= 3) & (m2 > tiny), m3 / F.pow(F.when(m2 > tiny, m2), 1.5) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))
    bn = h["h_bn"]
    sxx = h["h_bxx"] - h["h_bx"] * h["h_bx"] / F.when(bn > 0, bn)
    sxy = h["h_bxy"] - h["h_bx"] * h["h_by"] / F.when(bn > 0, bn)
    xn = h["h_xn"]
    xmean = F.try_divide(h["h_x1"], xn)
    xvar = (h["h_x2"] - h["h_x1"] * h["h_x1"] / F.when(xn > 0, xn)) / F.when(xn > 1, xn - 1)
    # values of the own day first, then those of earlier days
    inside = F.coalesce("_s_h_n", F.lit(0.0)).cast("int")
    last = [F.when(inside >= i, F.col(f"_l{i}")).otherwise(F.get("_older", F.greatest(F.lit(i - 1) - inside, F.lit(0)))).alias(f"hist_last{i}_r24") for i in LAST]
    return hit.select(
        *key, n.alias("hist_n"), mean.alias("hist_r24_mean"), F.when(n >= 2, F.sqrt(var)).alias("hist_r24_std"),
        skew.alias("hist_r24_skew"), F.try_divide(h["h_abs"], n).alias("hist_abs_r24_mean"),
        F.try_divide(h["h_up"], n).alias("hist_up_rate"), F.try_divide(h["h_cu"], h["h_cn"]).alias("hist_cont_rate"),
        F.when((bn >= 4) & (sxx > 1e-9), sxy / F.when(sxx > 1e-9, sxx)).alias("hist_surprise_beta"),
        xmean.alias("hist_eps_surprise_mean"),
        F.when((xn >= 4) & (xvar > 1e-9), F.sqrt(xvar)).alias("hist_surprise_sd"), *last)


def _lags(by: str, order: str, name: str) -> list[Column]:
    """The last values of `_y` before a row, newest first, nulls passed over."""
    return [F.expr(f"lag(_y, {i}) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY {order})").alias(f"{name}{i}") for i in LAST]


def _opening(past: DataFrame, asks: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """For names with many events, what the earlier days hold at the start of each day: totals and the last values.
    A day gives one row of sums and its last values only."""
    past, asks = past.filter("_many"), asks.filter("_many")
    sums = past.groupBy("underlying", "_b").agg(*[F.sum(e).alias(k) for k, e in totals.items()])
    newest = Window.partitionBy("underlying", "_b").orderBy(F.col("_ts").desc(), F.col("_id").desc())
    tails = past.filter("_y IS NOT NULL").withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= len(LAST)).select("underlying", "_b", F.lit(2).alias("_at"), "_n", "_y")
    opens = asks.select("underlying", "_b").distinct().withColumn("_at", F.lit(0))
    line = opens.unionByName(sums.withColumn("_at", F.lit(1)), allowMissingColumns=True).unionByName(tails, allowMissingColumns=True)
    so_far = Window.partitionBy("underlying").orderBy("_b", "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line.select("underlying", "_b", "_at", *[F.sum(k).over(so_far).alias(f"_p_{k}") for k in totals],
                       *_lags("underlying", "_b, _at, _n DESC", "_o")).filter("_at = 0").drop("_at")
