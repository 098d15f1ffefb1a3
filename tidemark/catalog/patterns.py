"""Tests on the hourly grid."""

import re

from pyspark.sql import functions as F

from tidemark.catalog.common import hourly_grid
from tidemark.catalog.registry import query
from tidemark.catalog.scalars import BUCKET, ny
from tidemark.catalog.sets import CLOSES, LONG_SHORT
from tidemark.catalog.windows import GRID
from tidemark.functions import scalars as fn
from tidemark.plans import patterns as pt


#: Every test is run over all bars and over the later ones, as a second view.
SINCE = "2024-01-12 00:00:00"
#: Markets that are tested each for itself; the others are one book of equal weights.
ALONE = ("click", "purchase")
BOOK = f"CASE WHEN market IN {ALONE} THEN market ELSE 'rest' END"


def grid_of(x):
    return pt.with_returns(hourly_grid(x))


def viewed(statement: str) -> str:
    """The statement over all bars and over those since SINCE; it marks the place for the condition on an instant t with /*since t*/."""
    late = re.sub(r"/\*since ([\w.]+)\*/", rf" AND \1 >= TIMESTAMP '{SINCE}'", statement)
    return f"SELECT 'all' AS view, * FROM ({statement}) UNION ALL SELECT 'since' AS view, * FROM ({late})"


def in_views(build):
    """`build(since)` for both views."""
    late = F.lit(SINCE).cast("timestamp")
    return build(None).withColumn("view", F.lit("all")).unionByName(build(late).withColumn("view", F.lit("since")))


def book_of(market: str = "market"):
    return F.when(F.col(market).isin(*ALONE), F.col(market)).otherwise("rest")


@query("pat_session_stats", "view:s session:s hours:l sum_ret_pct:n var_share_pct:n vol_share_pct:n big_hours:l big_rate_pct:n", viewed("WITH" + GRID + f""",
    s AS (SELECT {BUCKET} AS session, r, volume FROM (SELECT *, {ny('t')} AS n FROM lg) WHERE r IS NOT NULL/*since t*/)
    SELECT session, count(*) AS hours, 100 * sum(r) AS sum_ret_pct, 100 * sum(r * r) / (SELECT sum(r * r) FROM s) AS var_share_pct, 100 * sum(volume) / (SELECT sum(volume) FROM s) AS vol_share_pct,
           count(*) FILTER (WHERE abs(r) >= 1) AS big_hours, 100.0 * count(*) FILTER (WHERE abs(r) >= 1) / count(*) AS big_rate_pct FROM s GROUP BY 1"""))
def pat_session_stats(x):
    grid = grid_of(x)
    return in_views(lambda since: pt.session_stats(grid, big=1.0, since=since))


def at(day: str, minutes: int) -> str:
    return f"((CAST({day} AS TIMESTAMP) + INTERVAL {minutes} MINUTE) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'"


DAYS = f", sp AS (SELECT min(t) AS a, max(t) AS z FROM lg), dd AS (SELECT d FROM {{days}}, sp WHERE d BETWEEN CAST({ny('a')} AS DATE) AND CAST({ny('z')} AS DATE))"


@query("pat_weekend", "view:s book:s n:l up_weekend:l mean_weekend:n t_weekend:n up_reopen:l mean_reopen:n same_sign:l", viewed("WITH" + GRID + DAYS + f""",
    i AS (SELECT d, {at('d', 1140)} AS f, {at('d + 2', 1020)} AS s, {at('d + 3', 480)} AS m FROM dd, sp WHERE isodow(d) = 5 AND {at('d', 1140)} >= a AND {at('d + 3', 480)} <= z),
    w AS (SELECT i.d, {BOOK.replace("market", "a.market")} AS book, 100 * avg(b.lc - a.lc) AS we, 100 * avg(c.lc - b.lc) AS ro FROM i JOIN lg a ON a.t = i.f JOIN lg b ON b.t = i.s AND b.market = a.market JOIN lg c ON c.t = i.m AND c.market = a.market
          WHERE true/*since i.f*/ GROUP BY 1, 2)
    SELECT book, count(*) AS n, count(*) FILTER (WHERE we > 0) AS up_weekend, avg(we) AS mean_weekend, CASE WHEN count(*) > 2 THEN avg(we) / stddev_samp(we) * sqrt(count(*)) END AS t_weekend,
           count(*) FILTER (WHERE ro > 0) AS up_reopen, avg(ro) AS mean_reopen, count(*) FILTER (WHERE sign(we) = sign(ro)) AS same_sign FROM w GROUP BY 1"""))
def pat_weekend(x):
    grid = grid_of(x)
    return in_views(lambda since: pt.weekend_summary(pt.weekend_moves(grid, books=F.array(book_of()), since=since)))


@query("pat_night_control", "view:s n:l up:l mean_move:n", viewed("WITH" + GRID + DAYS + f""",
    i AS (SELECT d, {at('d', 1140)} AS f, {at('d + 1', 180)} AS s FROM dd, sp WHERE isodow(d) < 5 AND {at('d', 1140)} >= a AND {at('d + 1', 180)} <= z),
    w AS (SELECT i.d, 100 * avg(b.lc - a.lc) AS mv FROM i JOIN lg a ON a.t = i.f JOIN lg b ON b.t = i.s AND b.market = a.market WHERE true/*since i.f*/ GROUP BY 1)
    SELECT count(mv) AS n, count(*) FILTER (WHERE mv > 0) AS up, avg(mv) AS mean_move FROM w"""))
def pat_night_control(x):
    grid = grid_of(x)
    return in_views(lambda since: pt.night_control(grid, since=since))


@query("pat_follow_through", "view:s mask:s mean_ac:n markets:l n_big:l reversed_pct:n mean_signed:n", viewed("WITH" + GRID + f""",
    m AS (SELECT market, t, r, lead(r) OVER (PARTITION BY market ORDER BY t) AS nx, {BUCKET} AS ses FROM (SELECT *, {ny('t')} AS n FROM lg)),
    k AS (SELECT *, concat({BOOK}, CASE WHEN ses = 'weekend' THEN ', weekend' WHEN market IN {ALONE} THEN ', weekdays' WHEN ses = 'cash 10-16' THEN ', cash' ELSE ', off' END) AS mask FROM m WHERE r IS NOT NULL AND nx IS NOT NULL/*since t*/),
    p AS (SELECT mask, market, corr(r, nx) AS ac, stddev_samp(r) AS sd FROM k GROUP BY 1, 2 HAVING count(*) >= 50),
    b AS (SELECT k.mask, 100 * sign(r) * nx AS s FROM k JOIN p USING (mask, market) WHERE abs(r) >= 2 * sd)
    SELECT p.mask, avg(ac) AS mean_ac, count(*) AS markets, (SELECT count(*) FROM b WHERE b.mask = p.mask) AS n_big, (SELECT 100 * avg(CAST(s < 0 AS INT)) FROM b WHERE b.mask = p.mask) AS reversed_pct,
           (SELECT avg(s) FROM b WHERE b.mask = p.mask) AS mean_signed FROM p GROUP BY p.mask"""))
def pat_follow_through(x):
    s, grid = fn.session_bucket(F.col("t")), grid_of(x)
    rest, weekend, cash = ~F.col("market").isin(*ALONE), s == "weekend", s == "cash 10-16"
    masks = {"rest, weekend": rest & weekend, "rest, cash": rest & cash, "rest, off": rest & ~weekend & ~cash}
    for m in ALONE:
        masks |= {f"{m}, weekend": (F.col("market") == m) & weekend, f"{m}, weekdays": (F.col("market") == m) & ~weekend}
    return in_views(lambda since: pt.follow_through(grid, masks, since=since))


@query("pat_overnight_sign", "view:s n:l same:l n_big:l same_big:l", viewed("WITH" + GRID + DAYS + f""",
    i AS (SELECT d, {at('d - 1', 900)} AS f, {at('d', 480)} AS s, {at('d', 900)} AS m FROM dd, sp WHERE isodow(d) BETWEEN 2 AND 5 AND d > (SELECT min(d) FROM dd) AND {at('d - 1', 900)} >= a AND {at('d', 900)} <= z),
    w AS (SELECT 100 * (b.lc - a.lc) AS o, 100 * (c.lc - b.lc) AS y FROM i JOIN lg a ON a.t = i.f JOIN lg b ON b.t = i.s AND b.market = a.market JOIN lg c ON c.t = i.m AND c.market = a.market WHERE true/*since i.f*/)
    SELECT count(*) AS n, count(*) FILTER (WHERE sign(o) = sign(y)) AS same, count(*) FILTER (WHERE abs(o) >= 2) AS n_big, count(*) FILTER (WHERE abs(o) >= 2 AND sign(o) = sign(y)) AS same_big
    FROM w WHERE o IS NOT NULL AND y IS NOT NULL AND o <> 0"""))
def pat_overnight_sign(x):
    grid = grid_of(x)
    return in_views(lambda since: pt.overnight_sign(grid, since=since))


@query("pat_funding_level", "view:s book:s market:s hours:l annual_pct:n positive_pct:n", viewed(f"""
    SELECT {BOOK} AS book, market, count(funding_rate) AS hours, avg(funding_rate) * 24 * 365 * 100 AS annual_pct, 100.0 * count(*) FILTER (WHERE funding_rate > 0) / count(*) AS positive_pct
    FROM {{funding}} WHERE true/*since t*/ GROUP BY 1, 2"""))
def pat_funding_level(x):
    return in_views(lambda since: pt.funding_level(x.funding, since=since)).withColumn("book", book_of())


@query("pat_long_short", "view:s n:l mean_spread:n positive:l", viewed("SELECT count(*) AS n, avg(spread) AS mean_spread, count(*) FILTER (WHERE spread > 0) AS positive FROM ("
       + LONG_SHORT.replace("(" + CLOSES + ")", "(SELECT * FROM (" + CLOSES + ") WHERE true/*since d*/)") + ")"))
def pat_long_short(x):
    closes = x.sql(CLOSES)
    return in_views(lambda since: pt.long_short(closes, since=since).agg(F.count("*").alias("n"), F.avg("spread").alias("mean_spread"), F.count_if(F.col("spread") > 0).alias("positive")))


@query("pat_premium_decile", "view:s market:s n:l after_rich:n after_cheap:n after_funding:n mean_fw:n", viewed("WITH" + GRID + """,
    f AS (SELECT g.market, g.t, 100 * (lead(lc, 24) OVER (PARTITION BY g.market ORDER BY g.t) - lc) AS fw, u.premium AS z, u.funding_rate AS fr FROM lg g LEFT JOIN {funding} u ON u.market = g.market AND u.t = g.t),
    m AS (SELECT * FROM f WHERE fw IS NOT NULL AND z IS NOT NULL AND fr IS NOT NULL/*since t*/),
    q AS (SELECT market, count(*) AS n, quantile_cont(z, 0.1) AS lo, quantile_cont(z, 0.9) AS hi, quantile_cont(fr, 0.95) AS fq FROM m GROUP BY 1 HAVING count(*) >= 200)
    SELECT market, max(n) AS n, avg(fw) FILTER (WHERE z >= hi) AS after_rich, avg(fw) FILTER (WHERE z <= lo) AS after_cheap, avg(fw) FILTER (WHERE fr >= fq) AS after_funding, avg(fw) AS mean_fw FROM m JOIN q USING (market) GROUP BY 1"""))
def pat_premium_decile(x):
    grid = grid_of(x)
    return in_views(lambda since: pt.premium_deciles(grid, x.funding, slots=24, since=since))
