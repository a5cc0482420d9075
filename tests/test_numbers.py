"""Regression, transport, pairing and draws against independent arithmetic."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames_help import rows
from metrospan.functions import transport as X
from metrospan.functions.errors import ratio_sd
from metrospan.functions.student import t_quantile_975, t_two_sided_p
from metrospan.operators import pairs as P
from metrospan.operators import resample as S
from metrospan.operators.grid import interpolate
from metrospan.operators.metrics import regression_metrics, weighted_metrics
from metrospan.operators.regression import calibration_table, fit_lines
from metrospan.params import StudyParameters

CFG = StudyParameters()
BY = ["T_C", "gly_pct", "substrate"]


def growth(spark, fn, copies=1, sd=None):
    data = []
    for t in (25.0, 65.0):
        for g in (10.0, 20.0):
            for s in ("glass", "pdms"):
                for i, m in enumerate((10.0, 20.0, 30.0, 40.0)):
                    for c in range(copies):
                        data.append((t, g, s, m, float(fn(m, i, c)), f"{s}{c}", sd))
    return spark.createDataFrame(data, "T_C double, gly_pct double, substrate string, t_min double, thickness_nm double, specimen_id string, sd double")


def test_exact_line_and_induction(spark):
    f = fit_lines(growth(spark, lambda m, i, c: 2 * (m - 5)), BY, "t_min", "thickness_nm").first()
    assert f.slope == pytest.approx(2) and f.t_ind == pytest.approx(5) and f.df == 2 and f.induction and f.flags == ""
    assert f.r2 == pytest.approx(1) and f.quadratic_p == 1.0 and f.fit_status == "FITTED"


def test_flags(spark):
    flat = fit_lines(growth(spark, lambda m, i, c: 7.0), BY, "t_min", "thickness_nm").first()
    assert "nonpositive_growth" in flat.flags and flat.r2 is None
    bent = fit_lines(growth(spark, lambda m, i, c: m * m), BY, "t_min", "thickness_nm").first()
    assert "nonlinear_growth" in bent.flags and bent.quadratic_p == 0.0


def test_cluster_and_known_sd_against_numpy(spark):
    rng = np.random.default_rng(1)
    noise = {(i, c): rng.normal() for i in range(4) for c in range(3)}
    d = growth(spark, lambda m, i, c: 2 * m + 3 + noise[i, c] + c, copies=3, sd=2.5)
    x = np.array([m for m in (10.0, 20, 30, 40) for _ in range(3)])
    y = np.array([2 * m + 3 + noise[i, c] + c for i, m in enumerate((10.0, 20, 30, 40)) for c in range(3)])
    g = np.tile(np.arange(3), 4)
    A = np.column_stack([np.ones(12), x])
    inv, beta = np.linalg.inv(A.T @ A), np.linalg.lstsq(A, y, rcond=None)[0]
    e = y - A @ beta
    meat = sum(np.outer(A[g == k].T @ e[g == k], A[g == k].T @ e[g == k]) for k in range(3))
    cov = inv @ meat @ inv * 3 / 2 * 11 / 10
    r = fit_lines(d, BY, "t_min", "thickness_nm", cluster="specimen_id").first()
    assert r.slope == pytest.approx(beta[1]) and r.df == 2 and r.standard_error == "cluster robust specimen"
    assert [r.intercept_se, r.slope_se] == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-9)
    known = inv @ (A.T @ (np.full(12, 2.5)[:, None] ** 2 * A)) @ inv
    w, v = np.linalg.eigh(known - cov)
    lifted = cov + (v * np.maximum(w, 0)) @ v.T
    r = fit_lines(d, BY, "t_min", "thickness_nm", cluster="specimen_id", known_sd="sd").first()
    assert [r.intercept_se, r.slope_se] == pytest.approx(np.sqrt(np.diag(lifted)).tolist(), rel=1e-8)
    assert r.metrology_status == "SUPPLIED_SD"


def test_zero_sd_is_not_missing_sd(spark):
    zero = fit_lines(growth(spark, lambda m, i, c: 2 * m + 3, sd=0.0), BY, "t_min", "thickness_nm", known_sd="sd").first()
    none = fit_lines(growth(spark, lambda m, i, c: 2 * m + 3), BY, "t_min", "thickness_nm").first()
    assert zero.metrology_status == "SUPPLIED_ZERO_SD" and none.metrology_status == "NOT_PROVIDED_RESIDUAL_ESTIMATE_ONLY"


def test_student(spark):
    # Published 0.975 quantiles and two-sided tail probabilities.
    quantiles = {1: 12.7062047, 2: 4.3026527, 3: 3.1824463, 5: 2.5705818, 10: 2.2281389, 30: 2.0422725, 100: 1.9839715, 200: 1.9718962, 1000: 1.9623391, 10000: 1.9602012}
    tails = {(1, 1.0): 0.5, (2, 2.0): 0.1835034, (10, 2.3): 0.04425431, (30, 8.5): 1.744039e-9, (1000, 9.0): 1.1129077e-18}
    df = spark.createDataFrame([(n, float(q)) for n, q in quantiles.items()], "df int, q double")
    for r in df.select("q", t_quantile_975("df").alias("t"), t_two_sided_p("q", "df").alias("p")).collect():
        assert r.t == pytest.approx(r.q, abs=1e-7) and r.p == pytest.approx(0.05, abs=5e-8)
    got = {(n, t): spark.range(1).select(t_two_sided_p(F.lit(t), F.lit(n))).first()[0] for n, t in tails}
    for key, p in tails.items():
        assert got[key] == pytest.approx(p, rel=2e-6)
    every = spark.range(1, 10001).select(F.col("id").cast("int").alias("df"), t_two_sided_p(F.lit(2.3), F.col("id").cast("int")).alias("p")).orderBy("df").collect()
    steps = [a.p - b.p for a, b in zip(every, every[1:])]
    assert all(0 < d for d in steps) and all(b <= a for a, b in zip(steps, steps[1:]))  # smooth: no switch anywhere


def test_calibration_scaling(spark):
    lines = fit_lines(growth(spark, lambda m, i, c: 2 * m), BY, "t_min", "thickness_nm")
    visc = spark.createDataFrame([(t, g, 0.001) for t in (25.0, 65.0) for g in (10.0, 20.0)], "T_C double, gly_pct double, eta_Pa_s double")
    c = calibration_table(lines, visc, ["T_C", "gly_pct"], CFG).orderBy("T_C", "gly_pct").collect()
    assert all(r.status == "OK" for r in c) and c[0].ks_pdms == pytest.approx(2e-9 / 60 / (50 * 1.45e-5))
    assert c[2].D / c[0].D == pytest.approx(338.15 / 298.15)
    part = calibration_table(lines.where("substrate = 'pdms'"), visc.where("T_C = 25"), ["T_C", "gly_pct"], CFG)
    assert rows(part, "T_C", "status")[0] == (25.0, "missing_substrate:glass")
    gone = calibration_table(lines, visc.where("T_C = 25"), ["T_C", "gly_pct"], CFG)
    assert (65.0, "missing_viscosity") in rows(gone, "T_C", "status")


def value(spark, text):
    return spark.range(1).select(F.expr(text)).first()[0]


@pytest.mark.parametrize("phi,bi", [(0.0, 0.0), (0.0, 2.0), (1.5, 0.0), (3.0, 0.4), (3.0, 50.0), (20.0, 1e9)])
def test_profile_against_quadrature(spark, phi, bi):
    def u(x):
        if phi == 0:
            return (1 + bi * (1 - x)) / (1 + bi)
        num = math.cosh(phi * (1 - x)) + bi / phi * math.sinh(phi * (1 - x))
        return num / (math.cosh(phi) + bi / phi * math.sinh(phi))
    for x in (0.0, 0.3, 1.0):
        assert value(spark, X.profile(x, phi * phi, bi)) == pytest.approx(u(x), rel=1e-10)
    xs = np.linspace(0.2, 0.7, 4001)
    us = np.array([u(x) for x in xs])
    simpson = (us[0] + us[-1] + 4 * us[1:-1:2].sum() + 2 * us[2:-1:2].sum()) * (xs[1] - xs[0]) / 3 / 0.5
    assert value(spark, X.window_log_mean(20.0, 70.0, 100.0, phi * phi, bi)) == pytest.approx(math.log(simpson), rel=1e-8, abs=1e-10)


def test_deep_channel_stays_finite(spark):
    deep = value(spark, X.log_mean(0.9, 0.95, 5000.0, 1.0))
    assert -4600 < deep < -4500


def test_crossing_statuses(spark):
    curve = lambda ar: f"exp(-0.01D * ({ar}))"
    r = value(spark, X.crossing(curve, 0.9, 0.0, 1e6))
    assert r["status"] == "root" and r["value"] == pytest.approx(-math.log(0.9) / 0.01, rel=1e-12)
    assert value(spark, X.crossing(curve, 0.9, 50.0, 1e6))["status"] == "below_target_at_lower_bound"
    assert value(spark, X.crossing(curve, 0.9, 0.0, 5.0)).asDict() == {"status": "no_boundary_within_domain", "value": None}


def test_interpolation_is_geometric_and_never_extrapolates(spark):
    cal = spark.createDataFrame([(t, g, 10.0 ** i, 0.0) for i, (t, g) in enumerate([(25.0, 0.0), (25.0, 10.0), (65.0, 0.0), (65.0, 10.0)])],
                                "T_C double, gly_pct double, eta_Pa_s double, ks_pdms double")
    pts = spark.createDataFrame([(45.0, 5.0), (25.0, 10.0), (70.0, 5.0)], "T_C double, gly_pct double")
    got = {(r.T_C, r.gly_pct): (r.in_domain, r.eta_Pa_s, r.ks_pdms) for r in interpolate(pts, cal, "T_C", "gly_pct", ["eta_Pa_s", "ks_pdms"]).collect()}
    assert got[45.0, 5.0] == (True, pytest.approx(10 ** 1.5), 0.0)
    assert got[25.0, 10.0] == (True, pytest.approx(10.0), 0.0) and got[70.0, 5.0] == (False, None, None)


def pair_rows(spark, **change):
    base = dict(trench="t", pos="top", condition="c", specimen="s", v=100.0, sd=1.0, lo=34.0, hi=66.0, role="cross_fitted")
    top, bot = dict(base), {**base, "pos": "bot", "v": 50.0, "lo": 200.0, "hi": 240.0}
    for k, x in change.items():
        side, field = k.split("_", 1)
        (top if side == "top" else bot)[field] = x
    keep = [r for r in (top, bot) if r["pos"]]
    if change.get("top_pos") == "twice":
        keep = [dict(base), dict(base), bot]
    schema = "trench string, pos string, condition string, specimen string, v double, sd double, lo double, hi double, role string"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in keep], schema)


@pytest.mark.parametrize("change,status,reason", [
    ({}, "PASS", ""), ({"bot_pos": None}, "EXCLUDED", "missing_top_or_bot"), ({"bot_role": "other"}, "EXCLUDED", "mixed_prediction_roles"),
    ({"bot_lo": 60.0}, "EXCLUDED", "overlapping_observation_windows"), ({"top_v": None}, "EXCLUDED", "missing_thickness"),
    ({"top_v": 0.5}, "EXCLUDED", "top_below_denominator_threshold"), ({"bot_v": -1.0}, "EXCLUDED", "negative_bot_thickness"),
    ({"top_pos": "twice"}, "FAULT", "duplicate_observation"), ({"bot_specimen": "x"}, "FAULT", "metadata_mismatch"),
    ({"bot_role": "other", "top_v": None}, "EXCLUDED", "mixed_prediction_roles")])
def test_pair_reasons(spark, change, status, reason):
    p = P.pair_ratio(pair_rows(spark, **change), "trench", "pos", "v", ["condition", "specimen"], min_top=1.0, z_lo="lo", z_hi="hi", role="role", sd="sd").first()
    assert (p.status, p.reason) == (status, reason)
    if status == "PASS":
        assert p.SC == 0.5 and p.SC_sd == pytest.approx(math.sqrt(0.000125)) and p.uncertainty_status == "AVAILABLE"
    s = P.pair_summary(P.pair_ratio(pair_rows(spark, **change), "trench", "pos", "v", ["condition", "specimen"], min_top=1.0, z_lo="lo", z_hi="hi", role="role"),
                       ["condition"], "specimen", "condition").first()
    assert s.n_available == 1 and s.n_valid == (status == "PASS") and s.SC_between_trench_sd is None


def test_ratio_sd_shared_error_cancels(spark):
    d = spark.createDataFrame([(100.0, 50.0, 2.0, 1.0)], "a double, b double, sa double, sb double")
    assert d.select(ratio_sd("a", "b", "sa", "sb", 1.0)).first()[0] == pytest.approx(0.0, abs=1e-12)
    assert d.select(ratio_sd("a", "b", "sa", "sb", 1.5)).first()[0] is None


def test_metrics_undefined_cases(spark):
    d = spark.createDataFrame([(1.0, 1.5)], "y double, p double")
    m = regression_metrics(d, "y", "p").first()
    assert m.r2 is None and m.relative_1sigma_pct is None and m.n_relative == 1
    c = regression_metrics(spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "y double, p double"), "y", "p").first()
    assert c.r2 is None and c.mape_pct is None and c.n_relative == 0 and c.rmse == pytest.approx(math.sqrt(2.5))
    rng = np.random.default_rng(0)
    y, p, g = rng.normal(5, 1, 60), rng.normal(5, 1, 60), rng.integers(0, 4, 60)
    w = np.array([1 / (g == k).sum() for k in g])
    got = weighted_metrics(spark.createDataFrame(list(zip(y.tolist(), p.tolist(), g.tolist())), "y double, p double, g int"), "y", "p", "g").first()
    mean = np.average(y, weights=w)
    assert got.r2 == pytest.approx(1 - np.average((p - y) ** 2, weights=w) / np.average((y - mean) ** 2, weights=w))


def test_draws_keep_means_and_correlation(spark):
    cond = spark.createDataFrame([("c", 100.0, 50.0)], "k string, top double, bot double")
    d = S.lognormal_draws(cond, "k", ["top", "bot"], [[0.04, 0.04], [0.04, 0.04]], 400, 3)
    r = d.agg(F.min(F.col("bot") / F.col("top")).alias("lo"), F.max(F.col("bot") / F.col("top")).alias("hi"), F.avg("top").alias("m")).first()
    assert r.lo == pytest.approx(0.5) and r.hi == pytest.approx(0.5) and r.m == pytest.approx(100, rel=0.05)
    again = S.lognormal_draws(cond.repartition(3), "k", ["top", "bot"], [[0.04, 0.04], [0.04, 0.04]], 400, 3)
    assert rows(d, "draw", "top") == rows(again, "draw", "top")
    for bad in ([[1.0, 2.0], [2.0, 1.0]], [[1.0, 0.0], [0.5, 1.0]], [[float("nan")]]):
        with pytest.raises(ValueError):
            S.covariance_factor(bad)


def test_noise_free_trials_are_perfect(spark):
    pts = spark.createDataFrame([(i, 0.3 + 0.02 * i) for i in range(27)], "k int, t double")
    t = S.noise_trials(pts, "k", "t", 5, 0.0, 1)
    assert all(r.fixed_theory_r2 == pytest.approx(1) and r.ols_slope == pytest.approx(1) for r in t.collect())
    s = S.trial_summary(t, "fixed_theory_r2", 0.95).first()
    assert s.successes == 5 and s.wilson_lo < 1 and s.wilson_hi == pytest.approx(1)


def test_batch_draws_equal_the_column_expression(spark):
    from metrospan.functions import draws as N
    keys = ["7", "1234567", "x" * 30, "a longer key " * 6, None, "é|ü"]
    d = spark.createDataFrame([(k, i) for k in keys for i in (0, 9, 10, 123456)], "k string, i int")
    one = d.select(F.array(*[N.normal(21, F.col("k"), F.col("i"), t) for t in (0, 10, "discrepancy")]).alias("a"), N.normals(21, [F.col("k"), F.col("i")], [0, 10, "discrepancy"]).alias("b")).collect()
    assert len(one) == 24 and all(r.a == pytest.approx(r.b, abs=1e-12) for r in one)


def test_end_crossing_is_the_searched_one(spark):
    from metrospan.functions import transport as X
    for phi1, bi1 in ((0.3, 0.01), (1e-6, 5.0), (2.0, 0.0), (0.0, 0.02)):
        curve = lambda x: f"CASE WHEN {x} = 0 THEN 1D ELSE {X.coverage(f'{phi1}D * ({x})', f'{bi1}D * ({x})')} END"
        for target, limit in ((0.9, 1e6), (0.5, 1e6), (0.999999, 1e6), (0.9, 1e-3), (1.0, 10.0), (1.5, 10.0), (-1.0, 10.0)):
            a, b = value(spark, X.crossing(curve, target, 0.0, limit)), value(spark, X.end_crossing(phi1, bi1, target, limit))
            assert a["status"] == b["status"] and b["value"] == (a["value"] if a["value"] is None else pytest.approx(a["value"], rel=1e-9, abs=1e-12)), (phi1, bi1, target, limit, a, b)
    assert value(spark, X.end_crossing(0.0, 0.0, 0.9, 5.0)).asDict() == {"status": "no_boundary_within_domain", "value": None}


def shuffled_rows(df):
    """Rows that the plan's exchanges moved, after a run."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if name == "Exchange":
            found += p.metrics().apply("shuffleRecordsWritten").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_repeats_do_not_move(spark):
    """Neither noisy copies nor draws pass through a shuffle."""
    pts = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") / 3000.0).alias("t"))
    assert shuffled_rows(S.noise_trials(pts, "k", "t", 64, 0.1, 1)) < 3000 * 64 / 2
    cond = spark.range(200).select("id", F.lit(1.0).alias("top"), F.lit(1.0).alias("bot"))
    assert shuffled_rows(S.lognormal_draws(cond, "id", ["top", "bot"], [[0.04, 0.0], [0.0, 0.04]], 100, 3)) <= 200


def test_noise_trials_match_plain_sums_of_the_same_draws(spark):
    from metrospan.functions import draws as N
    pts = spark.createDataFrame([(i, None if i == 3 else 5.0 + i / 7) for i in range(50)], "k long, t double")
    for kind, scale in (("additive", F.lit(0.3)), ("relative", 0.3 * F.col("t"))):
        rows_ = pts.crossJoin(spark.range(3).withColumnRenamed("id", "trial")).withColumn("o", F.col("t") + N.normal(9, F.col("trial"), F.col("k")) * scale).collect()
        got = {r.trial: r for r in S.noise_trials(pts, "k", "t", 3, 0.3, 9, kind).collect()}
        for j in range(3):
            t, o = (np.array([r[c] for r in rows_ if r.trial == j and r.t is not None]) for c in ("t", "o"))
            b = ((o - o.mean()) * (t - t.mean())).mean() / t.var()
            assert got[j + 1].n == 50 and got[j + 1].n_outside == int(((o < 0) | (o > 1)).sum())
            assert [got[j + 1].fixed_theory_r2, got[j + 1].ols_slope, got[j + 1].ols_in_sample_r2] == pytest.approx(
                [1 - ((o - t) ** 2).mean() / o.var(), b, b * b * t.var() / o.var()], rel=1e-10)
