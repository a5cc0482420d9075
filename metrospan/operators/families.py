"""Nested evaluation of several model families from one table of condition sums.

Every family is linear in a basis of the features under one common scaling, so
that a condition enters any fit only through its means of basis products.  The
sums of a training set are the sums of all conditions less those held out;
folds, candidates, validation errors and the choice between families are
arithmetic on one row per condition and basis, whatever the number of rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..session import durable, shuffle_width, stored
from .contracts import ContractViolation
from .folds import group_kfold
from .joins import leakage_audit
from .models import _unpack


@dataclass(frozen=True)
class Linear:
    """Standardised ridge of the features themselves."""
    name: str = "linear"
    alphas: tuple = (0.01, 0.1, 1.0)

    def bases(self) -> list[tuple]:
        return [("linear",)]

    def candidates(self) -> list[tuple[int, dict]]:
        return [(0, {"alpha": a}) for a in self.alphas]


@dataclass(frozen=True)
class Fourier:
    """Kernel ridge of a Gaussian kernel, by ``size`` random Fourier features."""
    name: str = "fourier"
    alphas: tuple = (0.01, 0.1)
    gammas: tuple = (0.03, 0.2)
    size: int = 48
    seed: int = 0

    def bases(self) -> list[tuple]:
        return [("fourier", g, self.size, self.seed) for g in self.gammas]

    def candidates(self) -> list[tuple[int, dict]]:
        return [(b, {"alpha": a, "gamma": g}) for a in self.alphas for b, g in enumerate(self.gammas)]


def fourier_waves(d: int, size: int, seed: int, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    waves = rng.normal(size=(d, size))
    return waves * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, size)


def basis_values(z: np.ndarray, basis: tuple) -> np.ndarray:
    """The basis functions of scaled features, one row each."""
    if basis[0] == "linear":
        return z
    _, gamma, size, seed = basis
    waves, phase = fourier_waves(z.shape[1], size, seed, gamma)
    return np.sqrt(2.0 / size) * np.cos(z @ waves + phase)


def _scaling(df: DataFrame, group: str, features: list[str], y: str) -> tuple[DataFrame, list[float], list[float]]:
    """(group, n, lo, hi) and the means and SDs of features and y in which every condition has the same mass."""
    cols = [*features, y]
    g = durable(df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for f, k in ((F.avg, "m"), (F.var_pop, "v"))],
        F.array(*[F.min(c).cast("double") for c in features]).alias("lo"), F.array(*[F.max(c).cast("double") for c in features]).alias("hi")))
    t = g.agg(F.count(F.lit(1)).alias("groups"), *[e.alias(n) for i in range(len(cols)) for n, e in (
        (f"m{i}", F.avg(f"m{i}")), (f"q{i}", F.avg(F.col(f"v{i}") + F.col(f"m{i}") * F.col(f"m{i}"))))]).first()
    if t["groups"] < 3:
        raise ContractViolation(f"nested evaluation needs at least three conditions, got {t['groups']}")
    mean = [t[f"m{i}"] for i in range(len(cols))]
    sd = [max(t[f"q{i}"] - m * m, 0.0) ** 0.5 or 1.0 for i, m in enumerate(mean)]
    return g.select(group, "n", "lo", "hi"), mean, sd


def condition_sums(df: DataFrame, group: str, features: list[str], y: str, bases: list[tuple], mean: list[float], sd: list[float]) -> DataFrame:
    """(group, basis, n, m): per condition and basis the means of b, b b', b t,
    t and t^2 with t the scaled y.  Tasks add up their own rows; the parts of
    one condition, one a task, meet in one group."""
    d = len(features)
    kind = df.schema[group].dataType.simpleString()

    def partial(batches):
        total: dict = {}
        for pdf in batches:
            z = (pdf[features].to_numpy(float) - mean[:d]) / sd[:d]
            t = (pdf[y].to_numpy(float) - mean[d]) / sd[d]
            codes, names = pd.factorize(pdf[group])
            for k, basis in enumerate(bases):
                b = basis_values(z, basis)
                upper = np.triu_indices(b.shape[1])
                for c, name in enumerate(names):
                    rows = codes == c
                    own, w = b[rows], t[rows]
                    sums = np.concatenate([own.sum(0), (own.T @ own)[upper], own.T @ w, [w.sum(), w @ w]])
                    n, before = total.get((name, k), (0, 0.0))
                    total[name, k] = (n + len(w), before + sums)
        if total:
            yield pd.DataFrame({group: [c for c, _ in total], "basis": [k for _, k in total], "n": [n for n, _ in total.values()], "s": [s.tolist() for _, s in total.values()]})

    def meet(key, pdf):
        n = int(pdf["n"].sum())
        return pd.DataFrame({group: [key[0]], "basis": [key[1]], "n": [n], "m": [(np.sum(np.stack(pdf["s"].to_list()), axis=0) / n).tolist()]})

    parts = df.select(F.col(group), *[F.col(c).cast("double") for c in [*features, y]]).mapInPandas(partial, f"`{group}` {kind}, basis int, n long, s array<double>")
    return parts.groupBy(group, "basis").applyInPandas(meet, f"`{group}` {kind}, basis int, n long, m array<double>")


def _fit(kind: str, m: np.ndarray, d: int, rows: int, alpha: float) -> np.ndarray:
    """Intercept and weights of the basis from the means of a training set."""
    x, xx, xy, y, yy = _unpack(m, d)
    sy = np.sqrt(max(yy - y * y, 0.0)) or 1.0
    if kind == "linear":
        cov, sx = xx - np.outer(x, x), np.sqrt(np.maximum(np.diag(xx) - x * x, 0.0))
        sx = np.where(sx > 0, sx, 1.0)
        w = np.linalg.solve(rows * cov / np.outer(sx, sx) + alpha * np.eye(d), rows * (xy - x * y) / sx / sy) * sy / sx
        return np.concatenate([[y - w @ x], w])
    w = np.linalg.solve(rows * xx + alpha * np.eye(d), rows * (xy - y * x) / sy) * sy
    return np.concatenate([[y], w])


def _squared_error(m: np.ndarray, d: int, coef: np.ndarray) -> float:
    x, xx, xy, y, yy = _unpack(m, d)
    b0, b = coef[0], coef[1:]
    return max(0.0, yy - 2 * b0 * y - 2 * b @ xy + b0 * b0 + 2 * b0 * (b @ x) + b @ xx @ b)


def _evaluate(group: str, families: list, dims: dict[int, int]):
    """The nested evaluation of some outer folds (``members``: outer, group,
    fold) on the sums of all conditions."""
    first, plan = 0, []
    for family in families:
        plan.append((family, [(first + b, p) for b, p in family.candidates()]))
        first += len(family.bases())

    def run(members: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        tables = {}
        for basis, t in sums.groupby("basis"):
            t = t.sort_values(group, kind="stable")
            tables[basis] = (t[group].to_list(), t["n"].to_numpy(), np.stack(t["m"].to_list()), np.stack(t["lo"].to_list()), np.stack(t["hi"].to_list()))
        out = []
        for outer, own in members.groupby("outer"):
            best = []
            for order, (family, candidates) in enumerate(plan):
                scored = []
                for number, (basis, p) in enumerate(candidates):
                    names, n, m, lo, hi = tables[basis]
                    at, d = {c: k for k, c in enumerate(names)}, dims[basis]
                    rest, rows, groups = m.sum(0) - m[at[outer]], n.sum() - n[at[outer]], len(names) - 1
                    errors = []
                    for _, fold in own.groupby("fold"):
                        held = [at[c] for c in fold[group]]
                        less = groups - len(held)
                        coef = _fit(family.name, (rest - m[held].sum(0)) / less, d, rows - n[held].sum(), p["alpha"])
                        errors += [_squared_error(m[k], d, coef) for k in held]
                    scored.append((float(np.sqrt(np.mean(errors))), number, basis, p))
                score, number, basis, p = min(scored, key=lambda s: s[:2])
                names, n, m, lo, hi = tables[basis]
                k = names.index(outer)
                others = np.arange(len(names)) != k
                coef = _fit(family.name, (m.sum(0) - m[k]) / others.sum(), dims[basis], n.sum() - n[k], p["alpha"])
                best.append((score, order))
                for s, c, b, q in scored:
                    win = c == number
                    out.append([outer, family.name, c, b, json.dumps(q, sort_keys=True), s, win, False, coef.tolist() if win else None,
                                lo[others].min(0).tolist() if win else None, hi[others].max(0).tolist() if win else None])
            chosen = families[min(best)[1]].name
            for row in out:
                row[7] |= row[0] == outer and row[1] == chosen and row[6]
        return pd.DataFrame(out, columns=["outer", "family", "candidate", "basis", "parameters", "score", "winner", "chosen", "coef", "lo", "hi"])
    return run


def inner_folds(sizes: DataFrame, group: str, k: int) -> DataFrame:
    """(outer, group, n, fold): condition folds of every outer training set."""
    outers = sizes.select(F.col(group).alias("outer"))
    pairs = sizes.select(group, "n").join(outers, F.col("outer") != F.col(group))
    return group_kfold(pairs.select("outer", group, "n"), group, k, by=["outer"])


def nested_families(df: DataFrame, group: str, features: list[str], y: str, families: list, inner: int = 3,
                    dependencies: list[str] = ()) -> dict[str, DataFrame]:
    """Nested leave-one-condition-out evaluation with the choice of the family
    inside each outer fold.

    Returns ``candidates`` (outer, family, candidate, parameters, inner_rmse,
    winner, chosen), ``folds`` (outer, group, fold: the inner folds), ``oof``
    (the rows once per family, predicted by the model of their own outer fold:
    pred, family, selected_by_inner, negative_prediction,
    outside_training_feature_range) and ``models`` (the refitted winners).
    Inner scores are condition-balanced; the first minimum in the order of
    candidates, then of families, wins.  Fewer than three conditions, or a
    value of ``dependencies`` that crosses conditions, are refused.

    Features share one scaling over all conditions (targets do not enter it);
    targets, and linear features, are standardised on each training set.
    Outer folds are dealt over blocks; each block reads the condition sums,
    whose size is that of the conditions times the basis squared.
    """
    if dependencies:
        leaks = leakage_audit(df, list(dependencies), group).where("n_leaked > 0").orderBy("key").collect()
        if leaks:
            raise ContractViolation("values cross conditions: " + "; ".join(f"{r['key']} ({r['n_leaked']}, e.g. {r['example']})" for r in leaks))
    spark = df.sparkSession
    conditions, mean, sd = _scaling(df, group, features, y)
    d = len(features)
    bases = [b for f in families for b in f.bases()]
    dims = {k: d if b[0] == "linear" else b[2] for k, b in enumerate(bases)}
    sums = stored(condition_sums(df, group, features, y, bases, mean, sd).join(conditions.drop("n"), group), "sums")
    folds = durable(inner_folds(conditions.select(group, "n"), group, inner))
    blocks = shuffle_width(spark)
    kind = df.schema[group].dataType.simpleString()
    members = folds.select("outer", group, "fold", F.pmod(F.xxhash64("outer"), F.lit(blocks)).cast("int").alias("block"))
    used = members.select("block").distinct()
    every = sums.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(used, "block", "left_semi")
    run = _evaluate(group, families, dims)
    found = members.groupBy("block").cogroup(every.groupBy("block")).applyInPandas(
        run, f"outer {kind}, family string, candidate int, basis int, parameters string, score double, winner boolean, chosen boolean, coef array<double>, lo array<double>, hi array<double>")
    found = stored(found.withColumn("inner_rmse", F.col("score") * sd[d]).drop("score"), "nested")
    models = found.where("winner").drop("winner")
    return {"candidates": found.drop("basis", "coef", "lo", "hi"), "folds": folds, "models": models,
            "oof": _predicted(df, group, features, models, bases, mean, sd)}


def _select(group: str, families: list, dims: dict[int, int]):
    """Candidates of all families scored on the folds of one training set, with
    the refitted winner; the sums carry their condition's fold."""
    def run(sums: pd.DataFrame) -> pd.DataFrame:
        out, first = [], 0
        for family in families:
            for number, (b, p) in enumerate(family.candidates()):
                t = sums[sums["basis"] == first + b].sort_values(group, kind="stable")
                n, m, fold, d = t["n"].to_numpy(), np.stack(t["m"].to_list()), t["fold"].to_numpy(), dims[first + b]
                errors = []
                for f in np.unique(fold):
                    coef = _fit(family.name, m[fold != f].mean(0), d, n[fold != f].sum(), p["alpha"])
                    errors += [_squared_error(v, d, coef) for v in m[fold == f]]
                out.append([family.name, number, first + b, json.dumps(p, sort_keys=True), float(np.sqrt(np.mean(errors))), _fit(family.name, m.mean(0), d, n.sum(), p["alpha"]).tolist()])
            first += len(family.bases())
        best = min(range(len(out)), key=lambda k: (out[k][4], k))
        return pd.DataFrame([[*r, k == best] for k, r in enumerate(out)], columns=["family", "candidate", "basis", "parameters", "score", "coef", "chosen"])
    return run


def holdout_evaluation(df: DataFrame, group: str, features: list[str], y: str, families: list, split: DataFrame, inner: int = 3) -> dict[str, DataFrame]:
    """Selection inside the training groups, one scoring of the winner on the others.

    ``split`` is (group, split: train or test).  A group in both, fewer than
    two test groups or than ``inner`` training groups are refused.  Returns
    ``candidates`` (family, candidate, parameters, cv_rmse, chosen), ``folds``
    of the training groups, ``test`` (the held-out rows with pred,
    negative_prediction and outside_training_feature_range) and ``report``: one
    row with the winner and its condition-balanced and row-weighted errors.
    Nothing of the test rows enters scaling, folds, selection or the fit.
    """
    sides = durable(split.select(group, "split").distinct())
    counts = sides.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("split")).agg(
        F.count_if(F.col("n") > 1).alias("both"), F.count_if(F.col("split") == "test").alias("test"), F.count_if(F.col("split") == "train").alias("train")).first()
    if counts["both"]:
        raise ContractViolation(f"{counts['both']} groups are in both splits")
    if counts["test"] < 2 or counts["train"] < max(inner, 3):
        raise ContractViolation(f"hold-out needs two test groups and {max(inner, 3)} training groups, got {counts['test']} and {counts['train']}")
    train, test = (df.join(sides.where(F.col("split") == s).select(group), group, "left_semi") for s in ("train", "test"))
    conditions, mean, sd = _scaling(train, group, features, y)
    d, bases = len(features), [b for f in families for b in f.bases()]
    dims = {k: d if b[0] == "linear" else b[2] for k, b in enumerate(bases)}
    folds = durable(group_kfold(conditions.select(group, "n"), group, inner))
    sums = condition_sums(train, group, features, y, bases, mean, sd).join(folds.select(group, "fold"), group)
    found = sums.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_select(group, families, dims), "family string, candidate int, basis int, parameters string, score double, coef array<double>, chosen boolean")
    found = stored(found.withColumn("cv_rmse", F.col("score") * sd[d]).drop("score"), "holdout")
    ends = conditions.agg(*[f(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(d)]).first()
    w = found.where("chosen").first()  # the winner: one row
    array = lambda values: F.array(*[F.lit(float(v)) for v in values])
    models = sides.where("split = 'test'").select(
        F.col(group).alias("outer"), F.lit(w["family"]).alias("family"), F.lit(True).alias("chosen"), F.lit(w["basis"]).alias("basis"), array(w["coef"]).alias("coef"),
        array([ends[f"lo{i}"] for i in range(d)]).alias("lo"), array([ends[f"hi{i}"] for i in range(d)]).alias("hi"))
    scored = _predicted(test, group, features, models, bases, mean, sd).drop("selected_by_inner")
    e = F.col("pred") - F.col(y)
    per = scored.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("s"), F.avg(e * e).alias("m"), F.sum(F.abs(e)).alias("a"), F.sum(e).alias("b"))
    report = per.agg(F.count(F.lit(1)).alias("n_conditions"), F.sum("n").alias("n_measurements"), F.sqrt(F.avg("m")).alias("condition_balanced_rmse"),
                     F.sqrt(F.sum("s") / F.sum("n")).alias("rmse"), (F.sum("a") / F.sum("n")).alias("mae"), (F.sum("b") / F.sum("n")).alias("bias"))
    report = report.select(F.lit(w["family"]).alias("family"), F.lit(w["candidate"]).alias("candidate"), F.lit(w["parameters"]).alias("parameters"), F.lit(w["cv_rmse"]).alias("cv_rmse"), "*")
    return {"candidates": found.drop("basis", "coef"), "folds": folds, "test": scored, "report": report}


def _predicted(df: DataFrame, group: str, features: list[str], models: DataFrame, bases: list[tuple], mean: list[float], sd: list[float]) -> DataFrame:
    d = len(features)

    @pandas_udf("double")
    def predict(coef: pd.Series, basis: pd.Series, *cols: pd.Series) -> pd.Series:
        z = (np.column_stack(cols) - mean[:d]) / sd[:d]
        out = np.full(len(coef), np.nan)
        for k in np.unique(basis):
            rows = (basis == k).to_numpy()
            c = np.stack(coef[rows].to_list())
            out[rows] = c[:, 0] + (basis_values(z[rows], bases[k]) * c[:, 1:]).sum(1)
        return pd.Series(out * sd[d] + mean[d])

    m = models.select(F.col("outer").alias(group), "family", F.col("chosen").alias("selected_by_inner"), "basis", "coef", "lo", "hi")
    out = df.join(m, group).withColumn("pred", predict("coef", "basis", *[F.col(c).cast("double") for c in features]))
    outside = reduce(lambda a, b: a | b, [(F.col(c) < F.get("lo", F.lit(i))) | (F.col(c) > F.get("hi", F.lit(i))) for i, c in enumerate(features)])
    return out.withColumns({"negative_prediction": F.col("pred") < 0, "outside_training_feature_range": outside}).drop("basis", "coef", "lo", "hi")


def save_evaluation(found: dict[str, DataFrame], group: str, path: str) -> str:
    """The evaluation's tables as one result, partitioned by outer fold."""
    from ..sources.sinks import write_bundle
    return write_bundle(found, path, {"candidates": ["outer"], "folds": ["outer"], "models": ["outer"], "oof": [group]})


def load_evaluation(found: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """The tables written by ``save_evaluation`` with the types of ``found``."""
    from ..sources.sinks import read_bundle
    spark = next(iter(found.values())).sparkSession
    return read_bundle(spark, path, {n: t.schema for n, t in found.items()})
