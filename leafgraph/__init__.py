"""Document knowledge graphs as Spark DataFrames."""

from leafgraph.config import Settings

__all__ = ["Settings"]
