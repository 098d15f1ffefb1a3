"""Small hand-maintained override tables kept as YAML-like text.

They are configuration (one entry per name), parsed on the driver and joined as dimensions.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def parse_flat(text: str) -> list[tuple[str, str]]:
    """``KEY: value`` lines, comments and blank lines ignored; a malformed line is skipped with
    a warning."""
    out: list[tuple[str, str]] = []
    for line in text.splitlines():
        bare = line.split(" #", 1)[0].strip()
        if not bare or bare.startswith("#"):
            continue
        key, sep, value = bare.partition(": ")
        if not sep or not key.strip() or not value.strip():
            log.warning("skipped override line: %s", line)
            continue
        out.append((key.strip().strip("\"'"), value.strip().strip("\"'")))
    return out


def overrides(spark: SparkSession, texts: Iterable[str], value_type: str = "string") -> DataFrame:
    """Override dimension (name, value); a later entry replaces an earlier one, values that do
    not read as `value_type` are dropped."""
    rows = list(dict(pair for text in texts for pair in parse_flat(text)).items())
    df = spark.createDataFrame(rows, "name string, raw string")
    return df.selectExpr("name", f"try_cast(raw AS {value_type}) AS value").filter("value IS NOT NULL")
