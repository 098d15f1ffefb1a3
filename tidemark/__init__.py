"""Tidemark: point-in-time event studies and forecast evaluation on Spark DataFrames."""

SCHEMA_VERSION = 4
