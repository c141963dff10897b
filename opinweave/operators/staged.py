"""Costly expressions computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters and projections read but never compute again.

    The optimizer pushes a filter below a projection by copying the projected expression
    into it, which for labels of a few hundred text searches multiplies the work. A one-row
    generator is a boundary it does not cross.
    """
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    staged = df.withColumn("_row", F.array(row))
    return staged.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), F.inline_outer("_row"))
