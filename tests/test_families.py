"""Nested evaluation over families against a row-wise version, and whole results."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from metrospan.operators import families as Z
from metrospan.operators.contracts import ContractViolation
from metrospan.operators.folds import group_kfold
from metrospan.sources.sinks import read_bundle, write_once

FEATURES = ["a", "b"]


def drawn(conditions=5):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(conditions):
        n = 6 + 3 * c
        a, b = rng.normal(c, 1, n), rng.uniform(-1, 1, n)
        rows += [(f"c{c}", float(x), float(z), float(2 * x + np.sin(3 * z) + rng.normal(0, 0.1)), f"s{c}") for x, z in zip(a, b)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(drawn(), "cond string, a double, b double, y double, batch string").repartition(3)


def fit_rows(x, y, w, basis, alpha):
    """Weighted ridge on rows; returns a prediction function of basis values."""
    b = Z.basis_values(x, basis)
    w = w / w.sum() * len(y)
    my = np.average(y, weights=w)
    sy = np.sqrt(np.average((y - my) ** 2, weights=w))
    mb = np.average(b, axis=0, weights=w) if basis[0] == "linear" else np.zeros(b.shape[1])
    sb = np.sqrt(np.average((b - mb) ** 2, axis=0, weights=w)) if basis[0] == "linear" else np.ones(b.shape[1])
    s = (b - mb) / sb
    beta = np.linalg.solve((s * w[:, None]).T @ s + alpha * np.eye(s.shape[1]), (s * w[:, None]).T @ ((y - my) / sy))
    return lambda v: (Z.basis_values(v, basis) - mb) / sb @ beta * sy + my


def by_rows(rows, folds, families):
    g = np.array([r[0] for r in rows])
    raw, y = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    names = sorted(set(g))
    mean = np.mean([raw[g == c].mean(0) for c in names], axis=0)
    sd = np.sqrt(np.mean([(raw[g == c] ** 2).mean(0) for c in names], axis=0) - mean ** 2)
    x, mass = (raw - mean) / sd, np.array([1.0 / (g == c).sum() for c in g])
    out = {}
    for outer in names:
        for f in families:
            scores = []
            for k, (b, p) in enumerate(f.candidates()):
                errors = []
                for fold in set(folds[outer].values()):
                    held = [c for c in folds[outer] if folds[outer][c] == fold]
                    tr = (g != outer) & ~np.isin(g, held)
                    model = fit_rows(x[tr], y[tr], mass[tr], f.bases()[b], p["alpha"])
                    errors += [np.mean((model(x[g == c]) - y[g == c]) ** 2) for c in held]
                scores.append((np.sqrt(np.mean(errors)), k))
            best, k = min(scores)
            b, p = f.candidates()[k]
            model = fit_rows(x[g != outer], y[g != outer], mass[g != outer], f.bases()[b], p["alpha"])
            out[outer, f.name] = (k, best, model(x[g == outer]))
    return out


def test_against_rows(spark, table):
    families = [Z.Linear(alphas=(0.1, 10.0)), Z.Fourier(size=12, gammas=(0.05, 0.5), alphas=(0.01, 0.1))]
    found = Z.nested_families(table, "cond", FEATURES, "y", families, dependencies=["batch"])
    folds = {}
    for r in found["folds"].collect():
        folds.setdefault(r.outer, {})[r.cond] = r.fold
    want = by_rows(drawn(), folds, families)
    winners = {(r.outer, r.family): r for r in found["candidates"].where("winner").collect()}
    oof = found["oof"].collect()
    for (outer, name), (k, score, pred) in want.items():
        assert winners[outer, name].candidate == k and winners[outer, name].inner_rmse == pytest.approx(score, rel=1e-6)
        assert sorted(r.pred for r in oof if (r.cond, r.family) == (outer, name)) == pytest.approx(sorted(pred), rel=1e-6, abs=1e-6)
        assert winners[outer, name].chosen == (score == min(s for (o, _), (_, s, _) in want.items() if o == outer))
    assert found["candidates"].count() == 5 * 6 and len(oof) == 2 * len(drawn())
    assert {r.cond for r in oof if r.outside_training_feature_range} >= {"c4"}


def test_refusals(spark, table):
    with pytest.raises(ContractViolation, match="three conditions"):
        Z.nested_families(table.where("cond < 'c2'"), "cond", FEATURES, "y", [Z.Linear()])
    with pytest.raises(ContractViolation, match="batch"):
        Z.nested_families(table.withColumn("batch", F.lit("one")), "cond", FEATURES, "y", [Z.Linear()], dependencies=["batch"])


def test_inner_folds_are_those_of_each_training_set(spark, table):
    sizes = table.groupBy("cond").agg(F.count("*").alias("n"))
    got = {(r.outer, r.cond): r.fold for r in Z.inner_folds(sizes, "cond", 2).collect()}
    for outer in ("c0", "c3"):
        alone = {r.cond: r.fold for r in group_kfold(sizes.where(F.col("cond") != outer), "cond", 2).collect()}
        assert alone == {c: f for (o, c), f in got.items() if o == outer}


def test_results_are_whole_or_refused(spark, table, tmp_path):
    found = Z.nested_families(table, "cond", FEATURES, "y", [Z.Linear()])
    path = Z.save_evaluation(found, "cond", str(tmp_path / "good"))
    back = Z.load_evaluation(found, path)
    assert sorted(map(str, back["folds"].collect())) == sorted(map(str, found["folds"].select(back["folds"].columns).collect()))
    assert back["oof"].count() == found["oof"].count() and {p.name for p in (tmp_path / "good" / "candidates").glob("outer=*")} == {f"outer=c{k}" for k in range(5)}
    with pytest.raises(FileExistsError):
        Z.save_evaluation(found, "cond", path)
    write_once(found["folds"], str(tmp_path / "broken" / "folds"))
    with pytest.raises(ContractViolation, match="not a whole result"):
        read_bundle(spark, str(tmp_path / "broken"))
    found["folds"].limit(1).write.mode("append").partitionBy("outer").parquet(f"{path}/folds")
    with pytest.raises(ContractViolation, match="differs"):
        Z.load_evaluation(found, path)


def test_holdout_scores_the_winner_once(spark, table):
    split = spark.createDataFrame([(f"c{k}", "test" if k in (1, 3) else "train") for k in range(5)], "cond string, split string")
    families = [Z.Linear(alphas=(0.1, 10.0)), Z.Fourier(size=12, gammas=(0.05,), alphas=(0.01,))]
    found = Z.holdout_evaluation(table, "cond", FEATURES, "y", families, split, inner=3)
    rows = drawn()
    g, raw, y = np.array([r[0] for r in rows]), np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    names = ["c0", "c2", "c4"]
    mean = np.mean([raw[g == c].mean(0) for c in names], axis=0)
    sd = np.sqrt(np.mean([(raw[g == c] ** 2).mean(0) for c in names], axis=0) - mean ** 2)
    x, mass, tr = (raw - mean) / sd, np.array([1.0 / (g == c).sum() for c in g]), np.isin(g, names)
    best = found["candidates"].where("chosen").first()
    family = {f.name: f for f in families}[best.family]
    b, p = family.candidates()[best.candidate]
    model = fit_rows(x[tr], y[tr], mass[tr], family.bases()[b], p["alpha"])
    e = model(x[~tr]) - y[~tr]
    r = found["report"].first()
    assert r.n_measurements == (~tr).sum() and r.rmse == pytest.approx(np.sqrt(np.mean(e ** 2)), rel=1e-6)
    assert r.condition_balanced_rmse == pytest.approx(np.sqrt(np.mean([np.mean(e[g[~tr] == c] ** 2) for c in ("c1", "c3")])), rel=1e-6)
    assert best.cv_rmse == found["candidates"].agg(F.min("cv_rmse")).first()[0] and {x.cond for x in found["folds"].collect()} == set(names)
    with pytest.raises(ContractViolation, match="both splits"):
        Z.holdout_evaluation(table, "cond", FEATURES, "y", families, split.union(spark.createDataFrame([("c1", "train")], "cond string, split string")))
    with pytest.raises(ContractViolation, match="two test groups"):
        Z.holdout_evaluation(table, "cond", FEATURES, "y", families, split.where("cond <> 'c3'"))
