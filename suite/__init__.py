"""Registered queries and their DuckDB counterparts over views of the given tables."""

from importlib import import_module

MODULES = ["views_checks", "scalars", "track_queries", "day_queries", "area_queries", "neighbor_queries", "plan_queries", "table_queries"]


def load() -> None:
    """Import every query module; importing registers its queries."""
    for name in MODULES:
        import_module(f"suite.{name}")
