"""Columns that an operator only carries, under names that clash with none of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def carried(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but ``used`` named by their place, and what gives them their names back.

    The second takes a frame with these columns and, by name, columns to put in place of used ones.
    """
    names = docs.columns
    inner = {c: c.lower() if c.lower() in used else f"_c{i}" for i, c in enumerate(names)}

    def restored(df: DataFrame, **new: Column) -> DataFrame:
        return df.select(*[new.get(inner[c], F.col(inner[c])).alias(c) for c in names])

    return docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in names]), restored
