"""Group folds, hold-outs and splits decided by group tables or text hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.draws import uniform
from .ranks import ordered_rank, uniform_rank
from .scalars import one_row


def group_sizes(df: DataFrame, group: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"))


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """One fold per group, numbered in group order: (group, n, outer_fold)."""
    return ordered_rank(group_sizes(df, group), [group], out="_r").select(
        group, "n", (F.col("_r") - 1).alias("outer_fold"))


def group_kfold(sizes: DataFrame, group: str, k: int, by: list[str] = ()) -> DataFrame:
    """Balanced group folds: largest group first, each to the lightest fold.

    ``sizes`` is (by..., group, n).  Ties between groups go to the later name,
    ties between folds to the lower number.  Groups of one size are dealt out
    in rounds whose order depends only on the fold loads, so the sequential
    part runs over distinct sizes (at most sqrt(2 * rows) of them), not over
    groups; the groups themselves are ranked and joined in parallel.
    """
    keys = list(by) or ["_all"]
    base = sizes if by else sizes.withColumn("_all", F.lit(0))
    runs = base.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("m"))
    fields = [f for f in base.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("lo", T.LongType()),
                           T.StructField("hi", T.LongType()), T.StructField("order", T.ArrayType(T.IntegerType()))])

    def deal(pdf):
        import pandas as pd

        rows, head = [], [pdf[c].iloc[0] for c in keys]
        loads = [0] * k
        for size, count in sorted(zip(pdf["n"], pdf["m"]), reverse=True):
            size, left = int(size), int(count)
            level = [(load // size, load % size, f) for f, load in enumerate(loads)]
            starts = sorted({q for q, _, _ in level})
            given, position = [0] * k, 0
            for i, start in enumerate(starts):
                active = [f for _, _, f in sorted((0, r, f) for q, r, f in level if q <= start)]
                rounds = starts[i + 1] - start if i + 1 < len(starts) else left // len(active) + 1
                take = min(left, rounds * len(active))
                if take <= 0:
                    continue
                for j, f in enumerate(active):
                    given[f] += take // len(active) + (j < take % len(active))
                rows.append([*head, size, position, position + take, active])
                position, left = position + take, left - take
            loads = [load + size * g for load, g in zip(loads, given)]
        return pd.DataFrame(rows, columns=[*keys, "n", "lo", "hi", "order"])

    segments = runs.groupBy(*keys).applyInPandas(deal, schema)
    ranked = ordered_rank(base, [F.col(group).desc()], [*keys, "n"], "_r").withColumn("_r", F.col("_r") - 1)
    hit = ranked.join(segments, [*keys, "n"]).where((F.col("_r") >= F.col("lo")) & (F.col("_r") < F.col("hi")))
    place = ((F.col("_r") - F.col("lo")) % F.size("order") + 1).cast("int")
    return hit.select(*by, group, "n", F.element_at("order", place).alias("fold"))


def group_holdout(df: DataFrame, group: str, fraction: float, seed: int, at_least: int = 2) -> DataFrame:
    """Whole groups drawn into the test set: the lowest hash ranks."""
    groups = group_sizes(df, group).withColumn("_u", uniform(seed, F.col(group)))
    ranked = uniform_rank(groups, "_u", [group], "_r")
    total = groups.agg(F.greatest(F.lit(at_least), F.ceil(F.count(F.lit(1)) * fraction)).alias("_test"))
    cut = one_row(total)["_test"]
    return ranked.select(group, "n", F.when(F.col("_r") <= cut, "test").otherwise("train").alias("split"))


def three_way_split(df: DataFrame, key: str, seed: int, test: float = 0.2, validation: float = 0.25) -> DataFrame:
    """Exact-count random split: ``test`` of all, then ``validation`` of the rest."""
    ranked = uniform_rank(df.withColumn("_u", uniform(seed, F.col(key))), "_u", [key], "_r")
    n = one_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    cut_test = F.ceil(n * test)
    cut_validation = cut_test + F.ceil((n - cut_test) * validation)
    split = (F.when(F.col("_r") <= cut_test, "test").when(F.col("_r") <= cut_validation, "validation")
             .otherwise("train"))
    return ranked.select(*df.columns, split.alias("split"))


def run_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Seeded permutation 1..n of the rows."""
    return uniform_rank(df.withColumn("_u", uniform(seed, F.col(key))), "_u", [key], "run_order").drop("_u")


def stratified_sample(df: DataFrame, key: str, bounds: dict[str, tuple[float, float]], seed: int) -> DataFrame:
    """Latin hypercube over the rows: each dimension gets one draw per stratum.

    The stratum of a row in a dimension is its hash rank there; n rows fill n
    strata exactly once per dimension.
    """
    n = one_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    out = df.select(key)
    for name, (lo, hi) in bounds.items():
        keyed = df.select(key).withColumn("_u", uniform(seed, name, F.col(key)))
        ranked = uniform_rank(keyed, "_u", [key], "_r")
        jitter = uniform(seed, name, "jitter", F.col(key))
        value = lo + (hi - lo) * ((F.col("_r") - 1 + jitter) / n)
        out = out.join(ranked.select(key, value.alias(name)), key)
    return out
