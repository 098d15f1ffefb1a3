"""All registered queries of this package."""

from importlib import import_module

from tidemark.llm.registry import QUERIES, STATEMENTS

MODULES = ("queries_dedup", "queries_text", "queries_search")
for _m in MODULES:
    import_module(f"tidemark.llm.{_m}")
import_module("corpus_pipeline")

__all__ = ["QUERIES", "STATEMENTS"]
