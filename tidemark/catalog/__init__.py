"""All registered queries."""

from importlib import import_module

from tidemark.catalog.registry import ENTRIES

MODULES = ("scans", "targets", "joins", "scalars", "projections", "aggregates", "windows", "sets", "events", "features",
           "evaluation", "trading", "live", "patterns", "streams")
for _m in MODULES:
    import_module(f"tidemark.catalog.{_m}")

__all__ = ["ENTRIES"]
