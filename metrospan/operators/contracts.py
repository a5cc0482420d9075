"""Data-contract rules.

Every rule yields rows of one result table ``(rule, column, n_bad, example)``;
row rules of one table are counted together in a single aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import is_blank
from .scalars import one_row


class ContractViolation(ValueError):
    """Raised with the violated rules when a contract does not hold."""


def require_columns(df: DataFrame, columns) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractViolation(f"missing columns: {missing}")
    if df.limit(1).isEmpty():
        raise ContractViolation("input table is empty")


def row_rules(df: DataFrame, rules: dict[str, tuple[str, Column]], key: str) -> DataFrame:
    """Count rows failing each rule in one pass.

    ``rules`` maps a rule name to (column label, fault predicate); the example
    is the smallest failing key.
    """
    stats = []
    for i, (_, fault) in enumerate(rules.values()):
        bad = F.coalesce(fault, F.lit(True))
        stats += [F.count_if(bad).alias(f"n{i}"),
                  F.min(F.when(bad, F.col(key).cast("string"))).alias(f"e{i}")]
    one = df.agg(*stats)
    entries = [
        F.struct(F.lit(rule).alias("rule"), F.lit(label).alias("column"),
                 F.col(f"n{i}").alias("n_bad"), F.col(f"e{i}").alias("example"))
        for i, (rule, (label, _)) in enumerate(rules.items())
    ]
    return one.select(F.inline(F.array(*entries)))


def missing_rule(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    return row_rules(df, {f"missing_{c}": (c, is_blank(c)) for c in columns}, key)


def unique_rule(df: DataFrame, keys: list[str], name: str | None = None) -> DataFrame:
    """Keys seen more than once: counted rows, not lists, cross the shuffle."""
    label = "+".join(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    bad = (F.col("_n") > 1) | reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return counts.agg(
        F.lit(name or "unique").alias("rule"), F.lit(label).alias("column"),
        F.count_if(bad).alias("n_bad"), F.min(F.when(bad, text)).alias("example"))


def functional_dependency(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that map to more than one group (min and max differ)."""
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(group).alias("_lo"), F.max(group).alias("_hi"))
    bad = F.col("_lo") != F.col("_hi")
    return per_key.agg(
        F.lit("one_group_per_key").alias("rule"), F.lit(f"{key}->{group}").alias("column"),
        F.count_if(bad).alias("n_bad"),
        F.min(F.when(bad, F.col(key).cast("string"))).alias("example"))


def constant_rule(df: DataFrame, column: str) -> DataFrame:
    """A column that must hold one value throughout."""
    return df.agg(
        F.lit("constant").alias("rule"), F.lit(column).alias("column"),
        F.greatest(F.count_distinct(column) - 1, F.lit(0)).cast("long").alias("n_bad"),
        F.max(F.col(column).cast("string")).alias("example"))


def closeness_rule(df: DataFrame, column: str, reference: float | Column, rtol: float) -> DataFrame:
    """All values within ``rtol`` of a reference: the model's own scale, or the
    first value of the table by a key, which the caller looks up."""
    c, given = F.col(column), reference if isinstance(reference, Column) else F.lit(float(reference))
    df, ref = df.select(c, given.alias("_ref")), F.col("_ref")
    off = F.abs(c - ref)
    return df.agg(
        F.lit("closeness").alias("rule"), F.lit(column).alias("column"),
        F.count_if(off > rtol * F.abs(ref)).alias("n_bad"),
        F.max(off / F.abs(ref)).alias("max_relative"))


def combine(*results: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), results)


def raise_on_violation(result: DataFrame) -> None:
    """One small action; the rule table has one row per declared rule."""
    bad = result.where("n_bad > 0").orderBy("rule", "column").collect()
    if bad:
        raise ContractViolation(f"{len(bad)} rules violated: " + "; ".join(
            f"{r['rule']}[{r['column']}]: {r['n_bad']} bad, e.g. {r['example']}" for r in bad))


def inclusion(include: str, reason: str) -> Column:
    """included, excluded, include_text (neither yes nor no) or exclusion_reason
    (excluded without a reason)."""
    flag = F.lower(F.col(include).cast("string"))
    return (F.when(flag.isin("true", "1"), "included").when(~F.coalesce(flag.isin("false", "0"), F.lit(False)), "include_text")
            .when(is_blank(reason), "exclusion_reason").otherwise("excluded"))


def bounds_refusal(df: DataFrame, bounds: dict[str, tuple[float, float]], key: str) -> DataFrame:
    """No extrapolation: rows outside the declared bounds, per feature."""
    return row_rules(
        df, {f"outside_{c}": (c, ~F.col(c).between(lo, hi)) for c, (lo, hi) in bounds.items()}, key)


def training_ranges(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of minima and maxima."""
    return train.agg(*[f(c).alias(f"{p}_{c}") for c in columns for f, p in ((F.min, "lo"), (F.max, "hi"))])


def flag_outside(df: DataFrame, ranges: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Flag rows outside the training range of any column."""
    r = F.col("_range")
    outside = reduce(lambda a, b: a | b, [
        (F.col(c) < r[f"lo_{c}"]) | (F.col(c) > r[f"hi_{c}"]) for c in columns])
    return df.withColumn("_range", one_row(ranges)).withColumn(out, outside).drop("_range")


def flags_text(flags: dict[str, Column], sep: str = ";") -> Column:
    """Names of the flags that hold, in declared order."""
    return F.concat_ws(sep, *[F.when(c, F.lit(name)) for name, c in flags.items()])


def missing_levels(df: DataFrame, by: list[str], column: str, levels: list[float]) -> DataFrame:
    """Design levels never observed in a group; one boolean per level, no lists."""
    seen = df.groupBy(*by).agg(*[
        F.bool_or(F.col(column) == level).alias(f"_s{i}") for i, level in enumerate(levels)])
    text = F.concat_ws("|", *[
        F.when(~F.coalesce(F.col(f"_s{i}"), F.lit(False)), F.lit(str(level)))
        for i, level in enumerate(levels)])
    n = sum((F.when(F.coalesce(F.col(f"_s{i}"), F.lit(False)), 0).otherwise(1) for i in range(len(levels))), F.lit(0))
    return seen.select(*by, n.cast("long").alias("n_missing"), text.alias("missing"))


def flag_gate(df: DataFrame, by: list[str], flags: str) -> DataFrame:
    """Groups refused because any of their rows carries a flag."""
    any_flag = F.bool_or(F.coalesce(F.col(flags), F.lit("")) != "")
    return df.groupBy(*by).agg(any_flag.alias("flagged"), F.count(F.lit(1)).alias("n_rows"))


def required_categories(df: DataFrame, by: list[str], column: str, required: list[str]) -> DataFrame:
    """Required categories absent from, or repeated in, each group."""
    stats = df.groupBy(*by).agg(*[
        F.count_if(F.col(column) == v).alias(f"_c{i}") for i, v in enumerate(required)])

    def names(test) -> Column:
        return F.concat_ws("|", *[F.when(test(F.col(f"_c{i}")), F.lit(v)) for i, v in enumerate(required)])

    return stats.select(*by, names(lambda n: n == 0).alias("missing"), names(lambda n: n > 1).alias("repeated"))
