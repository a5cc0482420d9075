"""Group-held-out model evaluation from sufficient statistics.

Rows are weighted so that every condition has the same mass, hence a training
set is described by the average of its conditions' moments.  One scan gives
the moments of every condition; every fold, candidate and validation error of
the linear family follows from that table, whatever the number of rows.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from math import factorial, frexp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..session import durable, stored
from .folds import group_kfold, leave_one_group_out
from .scalars import one_row

COEF = T.ArrayType(T.DoubleType())


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def condition_moments(df: DataFrame, group: str, features: list[str], y: str) -> DataFrame:
    """(group, n, m): mean of 1, x, x x', x y, y, y^2 per condition about the
    overall centre, flattened; ``centre`` is the same one-row value for all."""
    centre = one_row(df.agg(*[F.avg(c).alias(f"c{i}") for i, c in enumerate([*features, y])]))
    d = len(features)
    z = df.select(group, *[(F.col(c) - centre[f"c{i}"]).alias(f"_z{i}") for i, c in enumerate([*features, y])])
    zs = [F.col(f"_z{i}") for i in range(d)]
    t = F.col(f"_z{d}")
    terms = [*zs, *[zs[i] * zs[j] for i, j in _pairs(d)], *[c * t for c in zs], t, t * t]
    g = z.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_m{k}") for k, c in enumerate(terms)])
    return g.select(group, "n", F.array(*[F.col(f"_m{k}") for k in range(len(terms))]).alias("m"))


def _unpack(m: np.ndarray, d: int):
    p = d * (d + 1) // 2
    x, flat, xy, y, yy = m[:d], m[d:d + p], m[d + p:d + p + d], m[-2], m[-1]
    xx = np.zeros((d, d))
    for v, (i, j) in zip(flat, _pairs(d)):
        xx[i, j] = xx[j, i] = v
    return x, xx, xy, y, yy


def _solve_ridge(total, groups, rows, alpha, d: int) -> np.ndarray:
    """Intercept and slopes of standardised ridge, in centred original units."""
    x, xx, xy, y, yy = _unpack(np.asarray(total) / groups, d)
    cov, cxy = xx - np.outer(x, x), xy - x * y
    sx, sy = np.sqrt(np.maximum(np.diag(cov), 0)), np.sqrt(max(yy - y * y, 0))
    sx, sy = np.where(sx > 0, sx, 1.0), sy if sy > 0 else 1.0
    beta = np.linalg.solve(rows * cov / np.outer(sx, sx) + alpha * np.eye(d), rows * cxy / sx / sy) * sy / sx
    return np.concatenate([[y - beta @ x], beta])


def ridge_coefficients(total: Column, groups: Column, rows: Column, alpha: Column, d: int) -> Column:
    @pandas_udf(COEF)
    def solve(t: pd.Series, g: pd.Series, n: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([_solve_ridge(*row, d) for row in zip(t, g, n, a)])
    return solve(total, groups.cast("double"), rows.cast("double"), alpha.cast("double"))


def moment_mse(m: Column, coef: Column, d: int) -> Column:
    """Mean squared error of a condition under coefficients, from its moments."""
    @pandas_udf(T.DoubleType())
    def mse(ms: pd.Series, cs: pd.Series) -> pd.Series:
        out = []
        for mm, c in zip(ms, cs):
            x, xx, xy, y, yy = _unpack(np.asarray(mm), d)
            b0, b = c[0], np.asarray(c[1:])
            out.append(yy - 2 * b0 * y - 2 * b @ xy + b0 * b0 + 2 * b0 * (b @ x) + b @ xx @ b)
        return pd.Series(np.maximum(out, 0.0))
    return mse(m, coef)


def _sum_arrays(df: DataFrame, by: list[str], arrays: list[str], k: int) -> DataFrame:
    sums = [F.sum(F.get(a, i)).alias(f"_{a}{i}") for a in arrays for i in range(k)]
    g = df.groupBy(*by).agg(*sums, F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"))
    return g.select(*by, "rows", "groups", *[F.array(*[F.col(f"_{a}{i}") for i in range(k)]).alias(a) for a in arrays])


def nested_folds(sizes: DataFrame, group: str, k: int) -> DataFrame:
    """(outer, group, n, fold): inner folds of every leave-one-condition-out
    training set.  The pair table is conditions squared, as the method itself."""
    everyone = one_row(sizes.agg(F.collect_list(group).alias("g")))["g"]
    pairs = sizes.withColumn("outer", F.explode(everyone)).where(F.col("outer") != F.col(group))
    return group_kfold(pairs.select("outer", group, "n"), group, k, by=["outer"])


def nested_ridge(df: DataFrame, group: str, features: list[str], y: str, alphas: list[float], inner: int = 3):
    """Nested evaluation of ridge: (candidate scores, chosen models per outer fold).

    Candidates are scored by condition-balanced inner RMSE; the first minimum
    in candidate order wins; the winner is refitted on the outer training set.
    """
    d = len(features)
    k = 2 * d + d * (d + 1) // 2 + 2
    # Both tables are condition-sized and read several times: computed once.
    moments = durable(condition_moments(df, group, features, y))
    folds = nested_folds(moments.select(group, "n"), group, inner)
    members = durable(folds.join(moments.select(group, "m"), group))
    per_fold = _sum_arrays(members, ["outer", "fold"], ["m"], k)
    whole = _sum_arrays(members, ["outer"], ["m"], k)
    rest = whole.select("outer", F.col("rows").alias("_rows"), F.col("groups").alias("_groups"), F.col("m").alias("_m"))
    train = per_fold.join(rest, "outer").select(
        "outer", "fold", (F.col("_rows") - F.col("rows")).alias("rows"), (F.col("_groups") - F.col("groups")).alias("groups"),
        F.zip_with("_m", "m", lambda a, b: a - b).alias("m"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(float(a)).alias("alpha"))
                               for i, a in enumerate(alphas)]))
    fits = train.withColumn("_c", grid).select("*", "_c.*").drop("_c")
    fits = fits.select("outer", "fold", "candidate", "alpha",
                       ridge_coefficients(F.col("m"), F.col("groups"), F.col("rows"), F.col("alpha"), d).alias("coef"))
    val = members.join(fits, ["outer", "fold"]).withColumn("mse", moment_mse(F.col("m"), F.col("coef"), d))
    scores = val.groupBy("outer", "candidate", "alpha").agg(F.sqrt(F.avg("mse")).alias("inner_rmse"))
    best = candidate_argmin(scores, ["outer"], "inner_rmse", ["candidate"], ["alpha"])
    final = best.join(whole, "outer")
    chosen = final.select("outer", "alpha", "inner_rmse", ridge_coefficients(
        F.col("m"), F.col("groups"), F.col("rows"), F.col("alpha"), d).alias("coef"))
    return scores, chosen


def candidate_argmin(scores: DataFrame, by: list[str], score: str, order: list[str], keep: list[str]) -> DataFrame:
    """Lowest score per group; the first candidate in order wins a tie."""
    g = scores.groupBy(*by).agg(F.min(F.struct(score, *order, *keep)).alias("_best"))
    return g.select(*by, "_best.*")


def linear_predictions(df: DataFrame, models: DataFrame, group: str, features: list[str], y: str, centred_on: DataFrame,
                       out: str = "pred") -> DataFrame:
    """Out-of-fold rows: each condition is predicted by the model that never saw it."""
    centre = one_row(centred_on.agg(*[F.avg(c).alias(f"c{i}") for i, c in enumerate([*features, y])]))
    p = F.get("coef", 0) + centre[f"c{len(features)}"]
    for i, c in enumerate(features):
        p = p + F.get("coef", i + 1) * (F.col(c) - centre[f"c{i}"])
    m = stored(models.select(F.col("outer").alias(group), "alpha", "coef"))
    return df.join(m, group).withColumn(out, p).drop("coef")


def fold_scaling(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Weighted mean and SD of each feature in each leave-one-out training set.

    Derived from one moment row per condition: all others minus the held-out.
    """
    g = df.groupBy(group).agg(*[f(c).alias(f"{n}_{c}") for c in features for f, n in ((F.avg, "m"), (F.var_pop, "v"))])
    stats = [F.sum(e).alias(n) for c in features for n, e in (
        (f"t_{c}", F.col(f"m_{c}")), (f"q_{c}", F.col(f"v_{c}") + F.col(f"m_{c}") * F.col(f"m_{c}")))]
    total = one_row(g.agg(F.count(F.lit(1)).alias("groups"), *stats))
    k = total["groups"] - 1
    entries = []
    for c in features:
        mean = (total[f"t_{c}"] - F.col(f"m_{c}")) / k
        square = (total[f"q_{c}"] - F.col(f"v_{c}") - F.col(f"m_{c}") * F.col(f"m_{c}")) / k
        sd = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))
        entries.append(F.struct(F.lit(c).alias("feature"), mean.alias("mean"),
                                F.when(sd > 0, sd).otherwise(1.0).alias("scale")))
    return g.select(F.col(group).alias("held_out"), F.inline(F.array(*entries)))


# --- smooth non-linear family ---------------------------------------------------

def _fourier_basis(d: int, size: int, seed: int):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(d, size)), rng.uniform(0, 2 * np.pi, size)


def fourier_nested(df: DataFrame, group: str, features: list[str], y: str, gammas=(0.03, 0.2), alphas=(0.01, 0.1),
                   inner: int = 3, size: int = 48, seed: int = 0, epsilon: float | None = None, rounds: int = 6):
    """Nested evaluation of an RBF model by random Fourier features.

    Every (outer, inner) training set has its own scaling.  One scan per round
    fills the Gram sums of all fits at once: each task adds up its own rows and
    emits one array per fit, and Spark adds the arrays by position.  With
    ``epsilon`` the squared loss becomes epsilon-insensitive by reweighting.
    Returns (candidate scores, out-of-fold predictions).
    """
    d = len(features)
    sizes = leave_one_group_out(df, group).select(group, "n")
    scaling = _all_scalings(df, group, features, y, sizes, inner)
    fits = _scan_plan(scaling, gammas, alphas)
    w, b = _fourier_basis(d, size, seed)
    coef: dict[int, np.ndarray] = {}
    for _ in range(1 if epsilon is None else rounds):
        coef = _solve_all(_gram_sums(df, group, features, y, fits, w, b, coef, epsilon, "train"), fits, size)
    errors = _validation(df, group, features, y, [f for f in fits if f["fold"] >= 0], w, b, coef)
    spark = df.sparkSession
    cand = [(f["outer"], f["candidate"], f["gamma"], f["alpha"], f["id"]) for f in fits if f["fold"] >= 0]
    kind = dict(df.dtypes)[group]
    index = spark.createDataFrame(cand, f"outer {kind}, candidate int, gamma double, alpha double, id int")
    scores = errors.join(index, "id").groupBy("outer", "candidate", "gamma", "alpha").agg(
        F.sqrt(F.sum("sse") / F.sum("groups")).alias("inner_rmse"))
    best = candidate_argmin(scores, ["outer"], "inner_rmse", ["candidate"], ["gamma", "alpha"])
    chosen = {r["outer"]: r["candidate"] for r in best.select("outer", "candidate").collect()}  # one row per condition
    finals = {f["outer"]: f for f in fits if f["fold"] < 0 and chosen.get(f["outer"]) == f["candidate"]}

    @pandas_udf(T.DoubleType())
    def predict(g: pd.Series, *cols: pd.Series) -> pd.Series:
        x, out = np.column_stack(cols), np.full(len(g), np.nan)
        for outer, f in finals.items():
            rows = (g == outer).to_numpy()
            if rows.any():
                out[rows] = _features(x[rows], f, w, b) @ coef[f["id"]] * f["sy"] + f["my"]
        return pd.Series(out)

    oof = df.withColumn("pred", predict(F.col(group), *[F.col(c).cast("double") for c in features]))
    return scores, oof


def _all_scalings(df, group, features, y, sizes, inner) -> list[dict]:
    """Scaling of every training set; a table of conditions x folds rows."""
    g = df.groupBy(group).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate([*features, y])
                                for f, n in ((F.avg, "m"), (F.var_pop, "v"))], F.count(F.lit(1)).alias("n"))
    moments = {r[group]: r for r in g.collect()}
    folds: dict = {}
    for r in nested_folds(sizes, group, inner).collect():
        folds.setdefault(r["outer"], {})[r[group]] = r["fold"]
    out = []
    for outer, member in sorted(folds.items(), key=lambda kv: str(kv[0])):
        for fold in [-1, *sorted(set(member.values()))]:
            train = [x for x, f in member.items() if f != fold]
            m = np.array([[moments[x][f"m{i}"] for i in range(len(features) + 1)] for x in train])
            v = np.array([[moments[x][f"v{i}"] for i in range(len(features) + 1)] for x in train])
            mean = m.mean(0)
            sd = np.sqrt(np.maximum(v.mean(0) + (m * m).mean(0) - mean * mean, 0))
            sd[sd == 0] = 1.0
            out.append(dict(outer=outer, fold=fold, train=set(train), val={x for x, f in member.items() if f == fold},
                            mx=mean[:-1], sx=sd[:-1], my=mean[-1], sy=sd[-1],
                            rows=sum(moments[x]["n"] for x in train), n={x: moments[x]["n"] for x in member}))
    return out


def _scan_plan(scalings, gammas, alphas) -> list[dict]:
    plan = []
    for s in scalings:
        for i, (gamma, alpha) in enumerate((g, a) for a in alphas for g in gammas):
            plan.append({**s, "candidate": i, "gamma": gamma, "alpha": alpha, "id": len(plan)})
    return plan


def _features(x, f, w, b):
    z = (x - f["mx"]) / f["sx"]
    return np.sqrt(2.0 / w.shape[1]) * np.cos(z @ (w * np.sqrt(2 * f["gamma"])) + b)


def _weights(g: tuple, fit: dict, side: str) -> np.ndarray:
    """Weight of each row in a fit, zero outside ``side``: looked up once per
    condition of the batch, whose rows are given by their code."""
    codes, names = g
    return np.array([*[1.0 / fit["n"][k] if k in fit[side] else 0.0 for k in names], 0.0])[codes]


def _gram_sums(df, group, features, y, fits, w, b, coef, epsilon, side) -> dict[int, np.ndarray]:
    size = w.shape[1]
    every = fits
    weighted = epsilon is not None and bool(coef)
    # Plain sums do not depend on alpha: one fit per scaling and gamma is enough.
    shared = {f["id"]: min(g["id"] for g in fits if (g["outer"], g["fold"], g["gamma"]) == (f["outer"], f["fold"], f["gamma"])) for f in fits}
    if not weighted:
        fits = [f for f in fits if shared[f["id"]] == f["id"]]

    def partial(batches):
        acc = {f["id"]: np.zeros(size * size + size) for f in fits}
        for pdf in batches:
            x, t, g = pdf[features].to_numpy(float), pdf[y].to_numpy(float), pd.factorize(pdf[group])
            for f in fits:
                weight = _weights(g, f, side)
                rows = weight > 0
                if not rows.any():
                    continue
                z, target = _features(x[rows], f, w, b), (t[rows] - f["my"]) / f["sy"]
                weight = weight[rows]
                if weighted:
                    r = target - z @ coef[f["id"]]
                    excess = np.abs(r) - epsilon
                    weight = weight * np.where(excess > 0, 1.0 / np.maximum(2 * excess, 1e-3), 0.0)
                    target = target - np.sign(r) * epsilon
                zw = z * weight[:, None]
                acc[f["id"]] += np.concatenate([(zw.T @ z).ravel(), zw.T @ target])
        yield pd.DataFrame({"id": list(acc), "s": [v.tolist() for v in acc.values()]})

    parts = df.select(group, *[F.col(c).cast("double") for c in [*features, y]]).mapInPandas(
        partial, "id int, s array<double>")
    summed = (parts.select("id", F.posexplode("s").alias("i", "v")).groupBy("id", "i").agg(F.sum("v").alias("v"))
              .groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s")))
    # Model-sized results: size^2 numbers per fit.
    sums = {r["id"]: np.array([e["v"] for e in r["s"]]) for r in summed.toLocalIterator()}
    return {f["id"]: sums[f["id"] if weighted else shared[f["id"]]] for f in every}


def _solve_all(sums, fits, size) -> dict[int, np.ndarray]:
    out = {}
    for f in fits:
        s = sums[f["id"]] * f["rows"] / len(f["train"])
        out[f["id"]] = np.linalg.solve(s[: size * size].reshape(size, size) + f["alpha"] * np.eye(size), s[size * size:])
    return out


def _validation(df, group, features, y, fits, w, b, coef) -> DataFrame:
    def partial(batches):
        acc = {f["id"]: 0.0 for f in fits}
        for pdf in batches:
            x, t, g = pdf[features].to_numpy(float), pdf[y].to_numpy(float), pd.factorize(pdf[group])
            for f in fits:
                weight = _weights(g, f, "val")
                rows = weight > 0
                if rows.any():
                    e = _features(x[rows], f, w, b) @ coef[f["id"]] * f["sy"] + f["my"] - t[rows]
                    acc[f["id"]] += float(np.sum(e * e * weight[rows]))
        yield pd.DataFrame({"id": list(acc), "sse": list(acc.values())})

    parts = df.select(group, *[F.col(c).cast("double") for c in [*features, y]]).mapInPandas(partial, "id int, sse double")
    counts = df.sparkSession.createDataFrame([(f["id"], len(f["val"])) for f in fits], "id int, groups int")
    return parts.groupBy("id").agg(F.sum("sse").alias("sse")).join(counts, "id")


# --- tree family -----------------------------------------------------------------

#: Cells that one task grows to the end; larger nodes are split by aggregates first.
_NODE_CELLS = 1 << 20
#: Fits of one tree that one task grows.
_TASK_FITS = 24


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=features, outputCol="_features").transform(df)


def fit_forest(train: DataFrame, features: list[str], y: str, seed: int, trees: int = 60, leaf: int = 1,
               weight: str | None = None, depth: int = 5):
    from pyspark.ml.regression import RandomForestRegressor
    rf = RandomForestRegressor(featuresCol="_features", labelCol=y, predictionCol="pred", numTrees=trees,
                               minInstancesPerNode=leaf, maxDepth=depth, seed=seed)
    if weight:
        rf = rf.setWeightCol(weight)
    return rf.fit(_assembled(train, features))


def forest_predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(_assembled(df, features)).drop("_features")


def forest_nested(df: DataFrame, group: str, features: list[str], y: str, leaves=(1, 3), inner: int = 3,
                  seed: int = 0, trees: int = 60, depth: int | None = None, bins: int = 32):
    """Nested evaluation of forests, all fits grown on the same cells.

    One scan bins the rows and adds them up by (condition, cell, tree), with
    their bootstrap counts; every fold, candidate and validation error follows
    from these cells, which stop growing where rows share them.  Trees draw
    Poisson counts, look at every feature and split where the variance falls
    most, without ``depth`` until nothing is left to split.  A condition brings
    its own quantiles as thresholds, and a fit splits only at those of its
    training conditions.  Held-out cells fall through a tree while it grows, so
    that no tree is kept.  ``df`` is read three times.
    """
    where = _forest_edges(df, group, features, y, bins)  # one row per condition
    if len(where) < 3:
        raise ValueError("nested evaluation needs at least three conditions")
    edges = [sorted({v for r in where for v in r[f"q{i}"] if np.isfinite(v)}) for i in range(len(features))]
    centre = sum(r["mean"] for r in where) / len(where)
    cells = stored(_forest_cells(df, group, features, y, edges, centre, trees, seed), "cells")
    whole = cells.where("tree = -1").select(group, "cell", "n", "mean", "var")
    folds = nested_folds(whole.groupBy(group).agg(F.sum("n").alias("n")), group, min(inner, len(where) - 1))
    index = {r[group]: [{bisect_left(e, v) for v in r[f"q{i}"] if np.isfinite(v)} for i, e in enumerate(edges)] for r in where}
    fits = _forest_fits(folds.collect(), group, leaves, index)
    # Trees grow on targets between -1 and 1; whole numbers add up alike in any order.
    scale, unit = 2.0 ** frexp(max(abs(v - centre) for r in where for v in (r["low"], r["top"])))[1], 2.0 ** (61 - int(trees).bit_length())
    fallen = _grow_forests(cells, fits, group, len(features), trees, depth, scale)
    total = F.sum(F.round(F.col("value") * unit).cast("long"))
    known = stored(fallen.groupBy(group, "cell", "fit").agg((total / F.count(F.lit(1)) / unit * scale).alias("value")), "values")
    kind = df.schema[group].dataType
    plan = df.sparkSession.createDataFrame([(i, f["outer"], f["held"], f["candidate"], f["leaf"]) for i, f in enumerate(fits)], T.StructType([
        T.StructField("fit", T.IntegerType()), T.StructField("outer", kind), *[T.StructField(c, T.IntegerType()) for c in ("held", "candidate", "leaf")]]))
    known = known.join(F.broadcast(plan), "fit")
    off = F.col("mean") - F.col("value")
    val = known.where("held >= 0").join(whole, [group, "cell"])
    mse = val.groupBy("outer", "candidate", "leaf", group).agg((F.sum(F.col("n") * (F.col("var") + off * off)) / F.sum("n")).alias("mse"))
    scores = mse.groupBy("outer", "candidate", "leaf").agg(F.sqrt(F.avg("mse")).alias("inner_rmse"))
    best = candidate_argmin(scores, ["outer"], "inner_rmse", ["candidate"], ["leaf"])
    final = known.where("held = -1").join(F.broadcast(best.select("outer", "candidate")), ["outer", "candidate"])
    final = final.select(group, "cell", (F.col("value") + centre).alias("pred"), F.col("leaf").alias("min_leaf"))
    return _binned(df, features, edges).join(stored(final, "known"), [group, "cell"], "left").select(*df.columns, "pred", "min_leaf")


def _forest_fits(folds, group, leaves, index) -> list[dict]:
    """Every fit with its training and held-out conditions (fold -1 holds out
    the outer one), row weights and, by feature, the thresholds it may use."""
    dealt: dict = {}
    for r in folds:
        dealt.setdefault(r["outer"], {})[r[group]] = (r["fold"], r["n"])
    fits = []
    for outer, member in sorted(dealt.items(), key=lambda kv: str(kv[0])):
        for held in [-1, *sorted({f for f, _ in member.values()})]:
            train = {g: 1.0 / n for g, (f, n) in member.items() if f != held}
            val = {outer} if held < 0 else {g for g, (f, _) in member.items() if f == held}
            allowed = [sorted(set().union(*e)) for e in zip(*(index[g] for g in train))]
            if train:
                fits += [dict(outer=outer, held=held, candidate=i, leaf=int(v), train=train, val=val, allowed=allowed) for i, v in enumerate(leaves)]
    return fits


def _forest_edges(df, group, features, y, bins) -> list:
    """Quantiles of every feature, mean and ends of the target, by condition."""
    at = [i / bins for i in range(1, bins)]
    return df.groupBy(group).agg(F.avg(y).alias("mean"), *[f(F.col(y).cast("double")).alias(n) for f, n in ((F.min, "low"), (F.max, "top"))], *[
        F.percentile_approx(F.col(c).cast("double"), at, 10000).alias(f"q{i}") for i, c in enumerate(features)]).collect()


def _binned(df, features, edges) -> DataFrame:
    """Adds ``cell``: for each feature the number of thresholds at or below it."""
    from pyspark.ml.feature import Bucketizer
    raw, out = [f"_x{i}" for i in range(len(features))], [f"_b{i}" for i in range(len(features))]
    d = df.select("*", *[F.col(c).cast("double").alias(r) for c, r in zip(features, raw)])
    ends = [[-float("inf"), *e, float("inf")] for e in edges]
    d = Bucketizer(splitsArray=ends, inputCols=raw, outputCols=out).transform(d)
    return d.select(*df.columns, F.array(*[F.col(c).cast("int") for c in out]).alias("cell"))


def _forest_cells(df, group, features, y, edges, centre, trees, seed) -> DataFrame:
    """(group, cell, tree, n, mean, var): bootstrap count and target about
    ``centre`` of each cell in each tree; tree -1 takes every row once and alone
    has the spread.  Rows of a cell come to one task, or to a few if many, and
    are added up there batch by batch."""
    bad = F.col(y).isNull() | F.isnan(F.col(y).cast("double"))
    target = F.when(bad, F.raise_error(F.lit("targets must be numbers")).cast("double")).otherwise(F.col(y).cast("double") - centre)
    rows = _binned(df, features, edges).select(group, "cell", target.alias("_t"), F.rand(seed).alias("_u"))
    rows = rows.withColumn("_k", F.xxhash64(group, "cell")).hint("rebalance", "_k").sortWithinPartitions("_k").select(group, "cell", "_t", "_u")
    d = len(features)

    def add(batches):
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            t, u = (b.column(i).to_numpy() for i in (2, 3))
            at = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]).any(1)])
            n = np.concatenate([np.ones((1, len(t)), np.int64), _poisson(u, trees)])
            own = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(t))))
            counts, sums = np.add.reduceat(n, at, axis=1), np.add.reduceat(n * t, at, axis=1)
            spread = np.add.reduceat((t - (sums[0] / counts[0])[own]) ** 2, at)
            ends = pa.array(np.arange(len(at) + 1) * (trees + 1), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.T.ravel())) for v in (counts, sums)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), *lists, pa.array(spread)], names=[group, "cell", "n", "s", "q"])

    schema = T.StructType([df.schema[group], *[T.StructField(c, k) for c, k in (
        ("cell", T.ArrayType(T.IntegerType())), ("n", T.ArrayType(T.LongType())), ("s", COEF), ("q", T.DoubleType()))]])
    parts = rows.mapInArrow(add, schema).select(group, "cell", "q", F.posexplode(F.arrays_zip("n", "s")).alias("i", "p"))
    n, s = F.col("p.n"), F.col("p.s")
    mean = F.try_divide(F.sum(s), F.sum(n))
    var = F.try_divide(F.sum("q") + F.sum(F.try_divide(s * s, n)) - F.sum(s) * mean, F.sum(n))
    sums = parts.groupBy(group, "cell", (F.col("i") - 1).alias("tree")).agg(F.sum(n).alias("n"), mean.alias("mean"), F.greatest(F.lit(0.0), var).alias("var"))
    return sums.select(group, "cell", "tree", "n", "mean", F.when(F.col("tree") < 0, F.col("var")).alias("var"))


def _poisson(u: np.ndarray, trees: int) -> np.ndarray:
    """Poisson counts of mean 1, a row for each tree, from one uniform number a column."""
    z = u.view(np.uint64)[None] + (np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z = (z ^ (z >> np.uint64(31))) >> np.uint64(11)
    below = (np.cumsum([np.exp(-1.0) / factorial(i) for i in range(16)]) * 2.0 ** 53).astype(np.uint64)
    # Nearly all counts follow from the 12 leading bits.
    lead = np.arange(4097, dtype=np.uint64) << np.uint64(41)
    low, high = np.searchsorted(below, lead[:-1], "right"), np.searchsorted(below, lead[1:] - np.uint64(1), "right")
    n = np.where(low == high, low, -1)[(z >> np.uint64(41)).astype(np.intp)]
    n[n < 0] = np.searchsorted(below, z[n < 0], "right")
    return n


def _grow_forests(cells, fits, group, d, trees, depth, scale) -> DataFrame:
    """(group, cell, fit, value): for each tree of each fit and each cell that
    the fit holds out, the mean of the leaf where the cell falls, over ``scale``.

    A task grows a tree from its cells.  Where these are more than a task takes,
    nodes are split by aggregates, level by level, until they are small.
    """
    spark = cells.sparkSession
    drawn = cells.where("tree >= 0").select(group, "cell", "tree", "n", F.coalesce(F.col("n") * F.col("mean") / scale, F.lit(0.0)).alias("s"))
    out = T.StructType([cells.schema[group], cells.schema["cell"], T.StructField("fit", T.IntegerType()), T.StructField("value", T.DoubleType())])
    if cells.where("tree = -1").count() <= _NODE_CELLS:
        parts = -(-len(fits) // _TASK_FITS)

        def grow(key, table):
            return _fallen(table, group, d, fits, range(key[1].as_py(), len(fits), parts), depth)

        spread = drawn.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(trees * parts, "tree", "part")
        return spread.groupBy("tree", "part").applyInArrow(grow, out)

    kind = cells.schema[group].dataType
    ints = [T.StructField(c, T.IntegerType()) for c in ("fit", "f", "leaf")]
    members = [(i, g, f["leaf"], f["train"].get(g)) for i, f in enumerate(fits) for g in {*f["train"], *f["val"]}]
    members = spark.createDataFrame(members, T.StructType([ints[0], T.StructField(group, kind), ints[2], T.StructField("w", T.DoubleType())]))
    allowed = spark.createDataFrame([(i, k, e) for i, f in enumerate(fits) for k, e in enumerate(f["allowed"])], T.StructType([*ints[:2], T.StructField("allowed", T.ArrayType(T.IntegerType()))]))
    at = drawn.join(F.broadcast(members), group).select((F.col("fit") * trees + F.col("tree")).alias("slot"), "leaf", F.lit(0).cast("long").alias("node"), group, "cell", "n", "s", "w")
    held, fallen, level = F.col("w").isNull(), None, 0

    def finish(left):
        return lambda key, table: _fallen(table, group, d, fits, [key[0].as_py() // trees], left)

    while True:
        at = stored(at, "nodes")
        sizes = stored(at.groupBy("slot", "node").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > _NODE_CELLS), "sizes")
        left = None if depth is None else depth - level
        small = at.join(sizes, ["slot", "node"], "left_anti").groupBy("slot", "node").applyInArrow(finish(left), out)
        fallen = small if fallen is None else fallen.unionByName(small)
        if sizes.isEmpty():
            return fallen
        at = at.join(sizes.select("slot", "node"), ["slot", "node"])
        hist = at.where(~held & (F.col("n") > 0)).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(d - 1)))).groupBy(
            "slot", "leaf", "node", "f", F.get("cell", F.col("f")).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("w")).alias("w"), F.sum(F.col("s") * F.col("w")).alias("s"))
        splits = stored(_best_splits(hist, allowed, trees).withColumn("id", F.monotonically_increasing_id()), "splits")
        ends = splits.where("f IS NULL") if left != 0 else splits
        fallen = fallen.unionByName(at.where(held).join(ends.select("slot", "node", "value"), ["slot", "node"]).select(
            group, "cell", (F.col("slot") / trees).cast("int").alias("fit"), "value"))
        if left == 0:
            return fallen
        above = F.when(F.get("cell", F.col("f")) > F.col("e"), 1).otherwise(0)
        at = at.join(splits.where("f IS NOT NULL").select("slot", "node", "f", "e", "id"), ["slot", "node"]).select(
            "slot", "leaf", (F.col("id") * 2 + above).alias("node"), group, "cell", "n", "s", "w")
        level += 1


def _best_splits(hist, allowed, trees) -> DataFrame:
    """(slot, node, value, f, e) of the best split of every node, f null where
    none helps: bins up to e fall below, the others above.  Gains are compared
    in single precision, so that equal ones go to the first feature."""
    part = W.partitionBy("slot", "node", "f")
    upto = part.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    h = hist.select("*", *[F.sum(c).over(upto).alias(f"{c}l") for c in "nws"], *[F.sum(c).over(part).alias(f"{c}t") for c in "nws"],
                    F.lead("bin").over(part.orderBy("bin")).alias("_next"), (F.col("slot") / trees).cast("int").alias("fit"))
    h = h.join(F.broadcast(allowed), ["fit", "f"], "left")
    h = h.withColumn("e", F.get(F.filter("allowed", lambda v: v >= F.col("bin")), 0))
    nl, wl, sl, nt, wt, st = (F.col(c) for c in ("nl", "wl", "sl", "nt", "wt", "st"))
    below, above, value = sl / wl, (st - sl) / F.nullif(wt - wl, F.lit(0.0)), st / wt
    gain = wl * (below - value) * (below - value) + (wt - wl) * (above - value) * (above - value)
    fits = (F.col("e") < F.col("_next")) & (nl >= F.col("leaf")) & (nt - nl >= F.col("leaf")) & (gain > 0)
    split = F.when(fits, F.struct(gain.cast("float").alias("gain"), -F.col("f").alias("_f"), F.col("f").alias("f"), F.col("e").alias("e")))
    best = h.groupBy("slot", "node").agg(F.max(split).alias("_best"), F.max(value).alias("value"))
    return best.select("slot", "node", "value", *[F.col(f"_best.{c}").alias(c) for c in ("f", "e")])


def _fallen(table: pa.Table, group: str, d: int, fits: list[dict], own, levels: int | None) -> pa.Table:
    """Rows (group, cell, fit, value) of the cells of one tree, or of a node of
    it, that the fits ``own`` hold out."""
    names = table.column(group).combine_chunks().dictionary_encode()
    code, names = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
    x = table.column("cell").combine_chunks().flatten().to_numpy().reshape(-1, d)
    n, s = (table.column(c).to_numpy() for c in ("n", "s"))
    at, values, which = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int32)]
    alike: dict = {}  # one training set may serve several fits
    for i in own:
        alike.setdefault((frozenset(fits[i]["train"]), fits[i]["leaf"]), []).append(i)
    for same in alike.values():
        f = fits[same[0]]
        share = np.array([*[f["train"].get(g, 0.0) for g in names], 0.0])[code]
        rows = np.flatnonzero((share > 0) & (n > 0))
        held = [np.array([*[g in fits[i]["val"] for g in names], False])[code] for i in same]
        seen = np.flatnonzero(np.any(held, axis=0))
        if len(rows) and len(seen):
            bins = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(f["allowed"])], axis=1)
            v = _tree_values(bins[rows], n[rows], n[rows] * share[rows], s[rows] * share[rows], bins[seen], f["leaf"], levels)
            for i, h in zip(same, held):
                at.append(seen[h[seen]])
                values.append(v[h[seen]])
                which.append(np.full(len(at[-1]), i, np.int32))
    at = pa.array(np.concatenate(at))
    return pa.Table.from_arrays([*[table.column(c).take(at) for c in (group, "cell")], pa.array(np.concatenate(which)), pa.array(np.concatenate(values))],
                                names=[group, "cell", "fit", "value"])


def _tree_values(x: np.ndarray, n: np.ndarray, w: np.ndarray, s: np.ndarray, seen: np.ndarray, leaf: int, levels: int | None) -> np.ndarray:
    """Means s / w of the leaves where the rows of ``seen`` fall in the tree grown
    on x.  All nodes of a level are split together: ``order`` holds, by feature,
    the rows sorted by node and value.  Nodes without rows of ``seen`` are left.
    Splits are chosen as in ``_best_splits``."""
    out, left, node = np.empty(len(seen)), np.arange(len(seen)), np.zeros(len(seen), np.int64)
    order = [np.argsort(x[:, k], kind="stable") for k in range(x.shape[1])]
    start, least = np.zeros(1, np.int64), 1e-24 * np.sum(s * s / w)  # smaller gains are noise
    while True:
        many = np.diff(np.append(start, len(order[0])))
        nt, wt, st = (np.add.reduceat(v[order[0]], start) for v in (n, w, s))
        value, feature, edge, best = st / wt, np.full(len(start), -1), np.zeros(len(start), x.dtype), np.full(len(start), least, np.float32)
        own = np.repeat(np.arange(len(start)), many)
        for k in range(x.shape[1] if levels != 0 else 0):
            o = order[k]
            c, wo = x[o, k], w[o]
            p = np.flatnonzero((own[1:] == own[:-1]) & (c[1:] != c[:-1]))
            at = own[p]
            nl, wl, rl = (np.cumsum(v) for v in (n[o], wo, s[o] - wo * value[own]))
            nl, wl, rl = (v[p] - np.append(0, v)[start][at] for v in (nl, wl, rl))
            ok = (nl >= leaf) & (nt[at] - nl >= leaf)
            p, at, wl, rl = p[ok], at[ok], wl[ok], rl[ok]
            if not len(p):
                continue
            gain = (rl * rl * (1 / wl + 1 / (wt[at] - wl))).astype(np.float32)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            top = np.maximum.reduceat(gain, first)
            hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(first, len(p)))))
            hit = hit[np.r_[at[hit][1:] != at[hit][:-1], True]]
            hit = hit[top > best[at[first]]]
            best[at[hit]], feature[at[hit]], edge[at[hit]] = gain[hit], k, c[p[hit]]
        ended = (feature < 0)[node]
        out[left[ended]] = value[node[ended]]
        left, node = left[~ended], node[~ended]
        if not len(left):
            return out
        kept = np.zeros(len(start), bool)
        kept[node] = True
        number = np.cumsum(kept) - 1
        rise = np.zeros(len(x), bool)
        rise[order[0]] = x[order[0], feature[own]] > edge[own]
        rows = kept[own]
        order, own = [o[rows] for o in order], number[own[rows]]
        high = np.bincount(own[rise[order[0]]], minlength=number[-1] + 1)
        low = np.bincount(own, minlength=number[-1] + 1) - high
        start = np.append(0, np.cumsum(np.stack([low, high], axis=1).ravel())[:-1])
        to = [start[::2] - np.append(0, np.cumsum(low)[:-1]), start[1::2] - np.append(0, np.cumsum(high)[:-1])]
        for k, o in enumerate(order):
            up = rise[o]
            order[k] = np.empty_like(o)
            for side, some in zip(to, (~up, up)):
                order[k][np.arange(np.count_nonzero(some)) + side[own[some]]] = o[some]
        node = 2 * number[node] + (seen[left, feature[node]] > edge[node])
        levels = None if levels is None else levels - 1


def permutation_importance(df: DataFrame, key: str, features: list[str], y: str, score, repeats: int, seed: int) -> DataFrame:
    """Mean and SD of the MAE increase when one feature is shuffled.

    Shuffles come from two hash ranks joined on the rank; all features and
    repeats are shuffled together.  ``score`` adds a ``pred`` column.  Rows move
    with their rank: joined by key the table, small on disk but not in memory,
    would be broadcast.
    """
    from ..functions.draws import uniform
    from .ranks import uniform_rank
    cases = F.explode(F.array(*[F.lit(f) for f in features]))
    value = F.coalesce(*[F.when(F.col("_feature") == f, F.col(f).cast("double")) for f in features])
    base = df.withColumn("_feature", cases).withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    part = ["_feature", "_repeat"]
    ids = base.select(*part, *df.columns, uniform(seed, F.col("_feature"), F.col("_repeat"), F.col(key), "to").alias("_u"))
    src = base.select(*part, key, value.alias("_value"),
                      uniform(seed, F.col("_feature"), F.col("_repeat"), F.col(key), "from").alias("_u"))
    a = uniform_rank(ids, "_u", [key], "_r", partition=part).select(*part, *df.columns, "_r")
    b = uniform_rank(src, "_u", [key], "_r", partition=part).select(*part, "_value", "_r")
    shuffled = a.join(b.hint("merge"), [*part, "_r"]).withColumns(
        {f: F.when(F.col("_feature") == f, F.col("_value")).otherwise(F.col(f)) for f in features})
    mae = score(shuffled).groupBy(*part).agg(F.avg(F.abs(F.col("pred") - F.col(y))).alias("_mae"))
    plain = one_row(score(df).agg(F.avg(F.abs(F.col("pred") - F.col(y))).alias("m")))["m"]
    return mae.groupBy(F.col("_feature").alias("feature")).agg(
        F.avg(F.col("_mae") - plain).alias("mae_increase_mean"), F.stddev_pop("_mae").alias("mae_increase_std"))


def prediction_role(df: DataFrame, train_ids: DataFrame, key: str) -> DataFrame:
    """Re-predictions of training rows are told apart from new observations."""
    seen = train_ids.select(key).distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, key, "left").withColumn(
        "prediction_role", F.when(F.col("_seen"), "training_reprediction").otherwise("unverified_final_inference")
    ).drop("_seen")


# --- final model -------------------------------------------------------------------

def final_ridge(df: DataFrame, group: str, features: list[str], y: str, alphas: list[float], inner: int = 3) -> DataFrame:
    """All-label fit after a separate grouped selection: one row with the
    candidate, coefficients and the centre they refer to."""
    d = len(features)
    k = 2 * d + d * (d + 1) // 2 + 2
    moments = durable(condition_moments(df, group, features, y))
    folds = group_kfold(moments.select(group, "n"), group, inner)
    members = durable(folds.join(moments.select(group, "m"), group))
    whole = _sum_arrays(moments, [], ["m"], k)
    per_fold = _sum_arrays(members, ["fold"], ["m"], k)
    t = one_row(whole)
    train = per_fold.select("fold", (t["rows"] - F.col("rows")).alias("rows"), (t["groups"] - F.col("groups")).alias("groups"),
                            F.array(*[F.get(t["m"], i) - F.get("m", i) for i in range(k)]).alias("m"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(float(a)).alias("alpha")) for i, a in enumerate(alphas)]))
    fits = train.withColumn("_c", grid).select("*", "_c.*").select(
        "fold", "candidate", "alpha", ridge_coefficients(F.col("m"), F.col("groups"), F.col("rows"), F.col("alpha"), d).alias("coef"))
    val = members.join(fits, "fold").withColumn("mse", moment_mse(F.col("m"), F.col("coef"), d))
    scores = val.groupBy("candidate", "alpha").agg(F.sqrt(F.avg("mse")).alias("selection_rmse"))
    best = scores.agg(F.min(F.struct("selection_rmse", "candidate", "alpha")).alias("b")).select("b.*")
    full = whole.withColumn("_c", grid).select("*", "_c.candidate", F.col("_c.alpha").alias("_alpha")).select(
        "candidate", ridge_coefficients(F.col("m"), F.col("groups"), F.col("rows"), F.col("_alpha"), d).alias("coef"))
    centre = one_row(df.agg(*[F.avg(c).alias(f"c{i}") for i, c in enumerate([*features, y])]))
    return full.join(best, "candidate").select(
        "alpha", "selection_rmse", "coef", F.array(*[centre[f"c{i}"] for i in range(d + 1)]).alias("centre"))


def apply_linear(df: DataFrame, model: DataFrame, features: list[str], out: str = "pred") -> DataFrame:
    """Batch inference with a one-row saved linear model."""
    m = one_row(model)
    p = F.get(m["coef"], 0) + F.get(m["centre"], len(features))
    for i, c in enumerate(features):
        p = p + F.get(m["coef"], i + 1) * (F.col(c) - F.get(m["centre"], i))
    return df.withColumn(out, p).withColumn("negative_prediction", F.col(out) < 0)


def save_final(model: DataFrame, train: DataFrame, features: list[str], y: str, key: str, scale: str, origin: str, path: str) -> str:
    """A final linear model with all that inference has to check: role, columns,
    training ranges, label range, origin, pixel scale and the training ids."""
    from ..sources.sinks import save_models, write_once
    from .contracts import training_ranges
    ranges = training_ranges(train.select(*features, F.col(y).alias("_label")), [*features, "_label"])
    about = one_row(train.agg(F.min(scale).alias("scale"), F.min(origin).alias("origin"), F.count(F.lit(1)).alias("n")))
    meta = ranges.select("*", F.lit("final_all_labels").alias("role"), F.array(*[F.lit(c) for c in features]).alias("columns"),
                         about["scale"].alias("pixel_size_um"), about["origin"].alias("origin"), about["n"].alias("n_train"))
    write_once(train.select(key).distinct(), f"{path}/train_ids")
    return save_models(model, meta, path)


def predict_final(data: DataFrame, path: str, key: str, scale: str, origin: str, out: str = "pred") -> DataFrame:
    """Batch inference with a saved final model.

    Data of another origin, a pixel scale more than one per cent off, or a
    feature that is not finite are refused with their counts.  Each row gets the
    prediction, negative_prediction, outside_training_feature_range,
    outside_training_target_range and its prediction_role.
    """
    from ..functions.rules import is_finite, within
    from ..sources.sinks import load_models
    from .contracts import flag_outside, raise_on_violation, row_rules
    spark = data.sparkSession
    models, meta = load_models(spark, path, "final_all_labels")
    about = meta.select("columns", "origin", "pixel_size_um").first()  # one row
    features = list(about["columns"])
    finite = [is_finite(c) for c in features]
    raise_on_violation(row_rules(data, {
        "model_origin": (origin, F.col(origin) != about["origin"]),
        "model_scale": (scale, ~within(F.col(scale).try_cast("double"), F.lit(about["pixel_size_um"]), 0.01, 0.0)),
        "finite_features": ("features", ~reduce(lambda a, b: a & b, finite))}, key))
    scored = apply_linear(flag_outside(data, meta, features, "outside_training_feature_range"), models, features, out)
    lo, hi = (one_row(meta)[c] for c in ("lo__label", "hi__label"))
    scored = scored.withColumn("outside_training_target_range", (F.col(out) < lo) | (F.col(out) > hi))
    return prediction_role(scored, spark.read.parquet(f"{path}/train_ids"), key)
