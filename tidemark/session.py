"""Session settings the plans rely on."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and benchmarks on one machine. Call-site capture is off: on wide
    plans it costs more than building the plan."""
    return (SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
            .config("spark.checkpoint.dir", _scratch().name).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", memory)
            .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings: UTC clock and adaptive execution (skew-join splitting included)."""
    for key, val in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
    ):
        if spark.conf.get(key, None) != val:
            spark.conf.set(key, val)
    return spark


@cache
def _scratch() -> tempfile.TemporaryDirectory:
    """The folder of an in-process session; it goes when the process ends."""
    return tempfile.TemporaryDirectory(prefix="tidemark-", ignore_cleanup_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables, as the cluster names it in
    ``spark.checkpoint.dir``. Only an in-process master may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _scratch().name
    return root.rstrip("/")


def cut(df):
    """`df` checkpointed in the shared folder: later plans start from the stored rows, which
    survive the loss of any executor."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
