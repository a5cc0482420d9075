"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rnd(c: Column | str, n: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n) + F.lit(0.0)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: rnd(c, n) for c, n in digits.items()})


def sr(expr: str, n: int = 6) -> str:
    """SQL text of the same rounding."""
    return f"(round({expr}, {n}) + 0.0)"


def off_tie(c: Column | str, n: int = 8) -> Column:
    """Rounding of short binary fractions: a fixed shift of a third of a unit
    moves them off the exact halves, where last-bit noise would decide."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(0.31 * 10.0 ** -n), n) + F.lit(0.0)


def sr_off_tie(expr: str, n: int = 8) -> str:
    return f"(round({expr} + {0.31 * 10.0 ** -n!r}, {n}) + 0.0)"
