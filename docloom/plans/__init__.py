"""Registered queries with their SQL."""

from importlib import import_module

MODULES = ["orphan_queries", "search_queries", "curate_queries", "link_queries", "eval_queries", "event_queries", "document_queries", "stream_queries", "more_queries", "upkeep_queries", "gate_queries", "arm_queries", "graph_queries", "source_queries"]


def load() -> None:
    """Imports the modules that register queries."""
    for name in MODULES:
        import_module(f"docloom.plans.{name}")
