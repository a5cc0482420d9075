"""One-row results used as values (scalar subqueries, never joins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def one_row(df: DataFrame) -> Column:
    """The only row of an aggregate as a struct value."""
    return df.select(F.struct("*").alias("_row")).scalar()
