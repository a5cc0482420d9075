"""Paired-prediction metrics with explicit undefined cases, per any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable, stored
from .scalars import one_row

SMALL_TARGET = 1e-6


def _metric_aggregates(y: str, p: str) -> list[Column]:
    t, e = F.col(y), F.col(p) - F.col(y)
    rel = F.when(F.abs(t) >= SMALL_TARGET, 100 * e / t)
    n = F.count(F.lit(1))
    sst = F.when(F.min(t) < F.max(t), n * F.var_pop(t)).otherwise(0.0)
    return [
        n.alias("n_measurements"),
        F.when((n >= 2) & (sst > 1e-20), 1 - F.sum(e * e) / sst).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.max(F.abs(e)).alias("max_abs_error"),
        F.avg(F.abs(rel)).alias("mape_pct"),
        F.avg(rel).alias("relative_bias_pct"),
        F.stddev_samp(rel).alias("relative_1sigma_pct"),
        F.count(rel).alias("n_relative"),
    ]


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """One row per group; R2 is NULL for one row or a constant target."""
    return df.groupBy(*by).agg(*_metric_aggregates(y, p))


def balanced_rmse(df: DataFrame, y: str, p: str, group: str, by: list[str] = ()) -> DataFrame:
    """RMSE in which every group carries the same total weight."""
    e = F.col(p) - F.col(y)
    per_group = df.groupBy(*by, group).agg(F.avg(e * e).alias("_mse"))
    return per_group.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_conditions"), F.sqrt(F.avg("_mse")).alias("condition_balanced_rmse"))


def condition_weights(df: DataFrame, group: str, out: str = "weight") -> DataFrame:
    """Row weights that sum to the row count with equal mass per group."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_groups"))
    t = one_row(total)
    weights = counts.select(group, (t["_rows"] / t["_groups"] / F.col("_n")).alias(out))
    return df.join(stored(weights), group)


def weighted_metrics(df: DataFrame, y: str, p: str, group: str) -> DataFrame:
    """Condition-weighted R2, RMSE, MAE and MAPE from per-group sums.

    Within a group all weights are equal, so one partial row per group is
    enough and the weights never join back to the rows.
    """
    t, e = F.col(y), F.col(p) - F.col(y)
    ok = F.abs(t) >= SMALL_TARGET
    g = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(t).alias("my"), F.var_pop(t).alias("vy"),
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(F.when(ok, F.abs(e / t))).alias("ape"), F.count_if(ok).alias("n_ok"),
        F.min(t).alias("lo"), F.max(t).alias("hi"))
    spread = F.avg("vy") + F.var_pop("my")  # equal-mass groups: within + between
    return g.agg(
        F.sum("n").alias("n_measurements"),
        F.sqrt(F.avg("mse")).alias("rmse"), F.avg("mae").alias("mae"),
        F.when((F.sum("n") >= 2) & (F.max("hi") > F.min("lo")), 1 - F.avg("mse") / spread).alias("r2"),
        (100 * F.sum(F.col("ape") / F.col("n")) / F.sum(F.col("n_ok") / F.col("n"))).alias("mape_pct"))
