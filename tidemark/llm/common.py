"""Pieces the operators share: written intermediate tables, id ranges, joins that survive hot keys,
connected components."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import prepare, shared_dir

#: Rows in one Arrow batch. Texts may be long, so batches are kept short.
ARROW_ROWS = 512
#: A key is hot from this share of all rows on; so there are at most that many hot keys.
HOT_KEYS = 1000
SALTS = 1009
#: Characters that separate words and pad lines: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return prepare(spark)


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """`df` written once to the shared folder and read back. Unlike an unpersisted checkpoint it is
    computed a single time, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[i], ..., first[i] + sizes[i] - 1 for all i."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def cut_points(docs: DataFrame, col: str, rows_each: int, most: int = 100_000) -> list[int]:
    """Ascending values of `col` that part the rows into ranges of about `rows_each` rows. They only
    balance work; any cut points give the same results. `most` bounds the list, not the rows."""
    n = docs.count()
    parts = min(most, math.ceil(n / rows_each))
    if parts <= 1:
        return []
    probs = [i / parts for i in range(1, parts)]
    got = docs.agg(F.percentile_approx(col, probs, max(10_000, 10 * parts)).alias("c")).first()["c"] or []
    return sorted(set(got))


def range_of(col: str, cuts: list[int]) -> Column:
    """How many of `cuts` are <= the value, by binary search; null for null."""
    if not cuts:
        return F.when(F.col(col).isNotNull(), F.lit(0).cast("long"))
    size = 1 << len(cuts).bit_length()
    padded = cuts + [2**63 - 1] * (size - len(cuts))
    array = "array(" + ",".join(f"{c}L" if c > -(2**63) else "bigint('-9223372036854775808')" for c in padded) + ")"
    steps = ",".join(f"{1 << k}L" for k in range(len(cuts).bit_length() - 1, -1, -1))
    return F.expr(f"if(`{col}` is null, null, aggregate(array({steps}), 0L, (at, s) -> "
                  f"if(at + s <= {len(cuts)}L and element_at({array}, cast(at + s as int)) <= `{col}`, at + s, at)))")


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: str) -> DataFrame:
    """Left join of `rows` with `groups`, which has one row per key and in `size` the number of `rows`
    with it. A key with a thousandth of all rows or more is hot; there are at most a thousand of them,
    so those go by broadcast. Rows of hot keys carry a salt from the hash of `spread` in the shuffled
    join, where they match nothing, so no key fills a task. Null keys match nothing."""
    values = [c for c in groups.columns if c not in keys]
    hot = groups.filter(F.col(size) * HOT_KEYS >= F.lit(total)).select(*keys, F.struct(*values).alias("_hot"))
    cold = groups.select(*keys, F.lit(0).alias("_salt"), F.struct(*values).alias("_cold"))
    salt = F.when(F.col("_hot").isNull() & F.col(keys[0]).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    out = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    got = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[got[v].alias(v) for v in values])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as (a, b): (node, root), root being the
    smallest node reachable. Each round every node takes the smallest grandparent among its
    neighbours, hands it to its parent and jumps to its own grandparent; the rounds end when no
    parent changes, after a logarithmic number on usual graphs."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "roots")
    before = None
    while True:
        now = parent.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return parent
        before = now
        up = parent.select(F.col("node").alias("_n"), F.col("root").alias("grand"))
        grand = parent.join(up, F.col("root") == F.col("_n")).select("node", "root", "grand")
        near = (both.join(grand.select(F.col("node").alias("b"), "grand"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("least")))
        hooks = parent.join(near, "node").select("node", "root", "least")
        cand = (hooks.select("node", F.col("least").alias("root"))
                .union(hooks.select(F.col("root").alias("node"), F.col("least").alias("root")))
                .union(grand.select("node", F.col("grand").alias("root"))).union(parent))
        parent = stored(cand.groupBy("node").agg(F.min("root").alias("root")), "roots")
