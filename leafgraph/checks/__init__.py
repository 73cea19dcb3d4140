"""Every operator as a query over the given tables, with the SQL to check it."""

from importlib import import_module

from leafgraph.checks.base import ORACLES, QUERIES

MODULES = [
    "shape", "structure", "lexical", "graph", "search", "traverse", "enrich", "storage",
]

for _name in MODULES:
    import_module(f"leafgraph.checks.{_name}")

__all__ = ["QUERIES", "ORACLES"]
