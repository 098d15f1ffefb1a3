"""Reusable DataFrame operators: as-of joins, range aggregates, running totals, dedup."""
