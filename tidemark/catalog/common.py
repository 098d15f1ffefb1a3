"""Pieces shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.sources.calendar import day_dimension
from tidemark.sources.domain import Inputs


def calendar_of(x: Inputs) -> DataFrame:
    return day_dimension(x.days, x.sessions)


def hourly_grid(x: Inputs) -> DataFrame:
    from tidemark.plans.patterns import ffill_grid
    return ffill_grid(x.bars)
