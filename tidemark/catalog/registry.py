"""Registered queries and their DuckDB statements.

An entry declares its result columns once as ``name:kind``; both sides are projected to that
schema so that types, names and rounding agree. Kinds: l bigint, n double to 6 digits,
s string, b boolean, t timestamp as text, d date as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.domain import Inputs, Render


@dataclass(frozen=True)
class Entry:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Inputs], DataFrame]
    statement: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Inputs(spark, sf_dir))
        return df.select(*[_spark_cast(c, k).alias(c) for c, k in self.columns])

    def oracle(self) -> str | None:
        if self.statement is None:
            return None
        cols = ", ".join(f'{_duck_cast(c, k)} AS "{c}"' for c, k in self.columns)
        return f"SELECT {cols} FROM ({Render.duckdb(self.statement)}) q"


# Means of decimal data often end exactly on half of the sixth digit, where the order of a sum
# decides the rounding; both sides move off that point by the same amount.
NUDGE = 1e-9

ENTRIES: dict[str, Entry] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``build(inputs) -> DataFrame`` under `name`."""
    parsed = tuple((c.split(":")[0], c.split(":")[1]) for c in columns.split())

    def register(build: Callable[[Inputs], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"duplicate entry {name}")
        ENTRIES[name] = Entry(name, parsed, build, sql)
        return build

    return register


def _spark_cast(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "l":
        return c.cast("bigint")
    if kind == "n":
        d = c.cast("double")
        return F.when(~F.isnan(d), F.round(d + F.lit(NUDGE), 6) + F.lit(0.0))
    if kind == "b":
        return c.cast("boolean")
    return c.cast("string")


def _duck_cast(name: str, kind: str) -> str:
    c = f'q."{name}"'
    if kind == "l":
        return f"CAST({c} AS BIGINT)"
    if kind == "n":
        d = f"CAST({c} AS DOUBLE)"
        return f"CASE WHEN NOT isnan({d}) THEN round({d} + {NUDGE!r}, 6) + 0.0 END"
    if kind == "b":
        return f"CAST({c} AS BOOLEAN)"
    return f"CAST({c} AS VARCHAR)"
