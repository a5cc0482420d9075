"""Folds, splits, resampling, draws and model evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design as S
from ..operators import families as Z
from ..operators import folds as K
from ..operators import models as M
from ..operators import resample as R
from ..functions.draws import uniform
from ..operators.grid import explode_levels
from ..operators.metrics import balanced_rmse, regression_metrics
from ..session import durable
from .growth import STUDY, sql_normal, sql_u, sql_uniform
from .regression_queries import scored
from .registry import query, rounded, sr, table


@query("logo_folds", """
SELECT l_suppkey, count(*) AS n, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS outer_fold FROM lineitem GROUP BY 1""")
def logo_folds(spark, sf):
    return K.leave_one_group_out(table(spark, sf, "lineitem"), "l_suppkey")


def _greedy_sql(groups: str, key: str, k: int = 3, part: str | None = None) -> str:
    """Sequential greedy assignment, largest group first, to the lightest fold."""
    p = f"{part}, " if part else ""
    over = f"PARTITION BY {part} " if part else ""
    link = f"AND o.{part} = st.{part}" if part else ""
    first = f"SELECT DISTINCT {part}, " if part else "SELECT "
    frm = f" FROM {groups}" if part else ""
    pick = "CASE WHEN l0 <= l1 AND l0 <= l2 THEN 0 WHEN l1 <= l2 THEN 1 ELSE 2 END"
    sel = f"o.{part}, " if part else ""
    return f"""ord AS (SELECT {p}{key}, n, row_number() OVER ({over}ORDER BY n DESC, {key} DESC) AS rn FROM {groups}),
st AS ({first}0::BIGINT AS rn, 0::BIGINT AS l0, 0::BIGINT AS l1, 0::BIGINT AS l2, -1 AS fold{frm}
  UNION ALL SELECT {sel}o.rn, l0 + CASE WHEN {pick} = 0 THEN o.n ELSE 0 END, l1 + CASE WHEN {pick} = 1 THEN o.n ELSE 0 END, l2 + CASE WHEN {pick} = 2 THEN o.n ELSE 0 END, {pick}
  FROM st JOIN ord o ON o.rn = st.rn + 1 {link}),
folded AS (SELECT {'ord.' + part + ', ' if part else ''}ord.{key}, ord.n, st.fold FROM ord JOIN st ON ord.rn = st.rn {'AND ord.' + part + ' = st.' + part if part else ''})"""


@query("group_kfold", "WITH RECURSIVE g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), " + _greedy_sql("g", "l_suppkey")
       + " SELECT l_suppkey, n, fold FROM folded")
def group_kfold(spark, sf):
    return K.group_kfold(K.group_sizes(table(spark, sf, "lineitem"), "l_suppkey"), "l_suppkey", 3)


@query("group_holdout", f"""
WITH g AS (SELECT l_suppkey, count(*) AS n, {sql_uniform(1729, 'l_suppkey::VARCHAR')} AS u FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, CASE WHEN row_number() OVER (ORDER BY u, l_suppkey) <= greatest(2, ceil(0.25 * (SELECT count(*) FROM g))) THEN 'test' ELSE 'train' END AS split FROM g""")
def group_holdout(spark, sf):
    return K.group_holdout(table(spark, sf, "lineitem"), "l_suppkey", 0.25, 1729)


@query("three_way_split", f"""
WITH e AS (SELECT event_id, row_number() OVER (ORDER BY {sql_uniform(7, 'event_id::VARCHAR')}, event_id) AS r FROM events), n AS (SELECT ceil(count(*) * 0.2) AS t, count(*) AS n FROM events)
SELECT event_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil((n - t) * 0.25) THEN 'validation' ELSE 'train' END AS split FROM e, n""")
def three_way_split(spark, sf):
    return K.three_way_split(table(spark, sf, "events").select("event_id"), "event_id", 7)


@query("run_order", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {sql_uniform(11, 'o_orderkey::VARCHAR')}, o_orderkey) AS run_order FROM orders""")
def run_order(spark, sf):
    return K.run_order(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 11)


_BOUNDS = {"aspect_ratio": (1.0, 50.0), "viscosity_mpa_s": (1.0, 3.0), "temperature_c": (20.0, 60.0)}


@query("stratified_sample", "WITH n AS (SELECT count(*) AS n FROM events)" + f"""
SELECT event_id, {', '.join(sr(f"{lo} + {hi - lo} * ((row_number() OVER (ORDER BY {sql_uniform(5, chr(39) + c + chr(39), 'event_id::VARCHAR')}, event_id) - 1 + {sql_uniform(5, chr(39) + c + chr(39), chr(39) + 'jitter' + chr(39), 'event_id::VARCHAR')}) / n)", 8) + ' AS ' + c for c, (lo, hi) in _BOUNDS.items())} FROM events, n""")
def stratified_sample(spark, sf):
    s = K.stratified_sample(table(spark, sf, "events").select("event_id"), "event_id", _BOUNDS, 5)
    return rounded(s, {c: 8 for c in _BOUNDS})


_CAND = """WITH s AS (SELECT l_linestatus AS part, l_suppkey AS g, k AS candidate, f AS factor, pow(l_quantity * f - l_extendedprice / 1000, 2) AS e2
  FROM lineitem, (VALUES (0, 1.0), (1, 1.5), (2, 2.0), (3, 2.5)) c(k, f)), m AS (SELECT part, candidate, factor, g, avg(e2) AS m FROM s GROUP BY ALL),
b AS (SELECT part, candidate, factor, sqrt(avg(m)) AS rmse FROM m GROUP BY ALL)"""


@query("candidate_argmin", _CAND + f"""
SELECT part, candidate, factor::DOUBLE AS factor, {sr('rmse', 8)} AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY rmse, candidate) AS r FROM b) WHERE r = 1""")
def candidate_argmin(spark, sf):
    factors = [1.0, 1.5, 2.0, 2.5]
    s = explode_levels(table(spark, sf, "lineitem"), {"factor": factors})
    s = s.select(F.col("l_linestatus").alias("part"), F.col("l_suppkey").alias("g"), "factor",
                 (F.array_position(F.array(*[F.lit(f) for f in factors]), F.col("factor")) - 1).cast("int").alias("candidate"),
                 (F.col("l_quantity") * F.col("factor")).alias("pred"), (F.col("l_extendedprice") / 1000).alias("label"))
    scores = balanced_rmse(s, "label", "pred", "g", ["part", "candidate", "factor"]).withColumnRenamed("condition_balanced_rmse", "rmse")
    return rounded(M.candidate_argmin(scores, ["part"], "rmse", ["candidate"], ["factor"]), {"rmse": 8})


# --- resampling -----------------------------------------------------------------------

_BOOT = f"""WITH g AS (SELECT l_suppkey, sum(pow(l_quantity * 2.0 + l_tax - CASE WHEN l_quantity = 50 THEN 0.0 ELSE l_extendedprice / 1000 END, 2)) AS sse, count(*) AS n,
  row_number() OVER (ORDER BY l_suppkey) AS i FROM lineitem GROUP BY 1), c AS (SELECT count(*) AS c FROM g),
d AS (SELECT rep, floor({sql_uniform(3, 'rep::VARCHAR', 'slot::VARCHAR')} * c) + 1 AS i FROM c, range(500) r(rep), (SELECT i - 1 AS slot FROM g)),
b AS (SELECT rep, sqrt(sum(sse) / sum(n)) AS rmse FROM d JOIN g USING (i) GROUP BY 1)"""


@query("cluster_bootstrap", _BOOT + f" SELECT rep::INTEGER AS rep, {sr('rmse', 8)} AS rmse FROM b")
def cluster_bootstrap(spark, sf):
    return rounded(R.cluster_bootstrap(scored(spark, sf), "label", "pred", "condition_id", 500, 3), {"rmse": 8})


@query("bootstrap_interval", _BOOT + f" SELECT count(*) AS n, {sr('quantile_cont(rmse, 0.025)', 8)} AS lo, {sr('quantile_cont(rmse, 0.975)', 8)} AS hi FROM b")
def bootstrap_interval(spark, sf):
    b = R.cluster_bootstrap(scored(spark, sf), "label", "pred", "condition_id", 500, 3)
    return rounded(R.percentile_interval(b, "rmse"), {"lo": 8, "hi": 8})


def _noise_sql(scale: str) -> str:
    return f"""WITH p AS (SELECT p_partkey AS k, (p_retailprice - 900) / 100 AS t FROM part),
o AS (SELECT trial, t, t + {sql_normal(9, 'trial::VARCHAR', 'k::VARCHAR')} * {scale} AS o FROM p, range(4000) r(trial)),
f AS (SELECT trial, avg(o) AS mo, avg(t) AS mt, regr_slope(o, t) AS b FROM o GROUP BY 1),
m AS (SELECT trial, count(*) AS n, max(b) AS b, 1 - sum(pow(o - t, 2)) / sum(pow(o - mo, 2)) AS r2, 1 - sum(pow(o - mo - b * (t - mt), 2)) / sum(pow(o - mo, 2)) AS ols,
  count(*) FILTER (o < 0 OR o > 1) AS n_outside FROM o JOIN f USING (trial) GROUP BY 1)"""


def _points(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ((F.col("p_retailprice") - 900) / 100).alias("t"))


@query("noise_trials", _noise_sql("0.05") + f" SELECT trial + 1 AS trial, n, {sr('r2', 8)} AS fixed_theory_r2, {sr('ols', 8)} AS ols_in_sample_r2, {sr('b', 8)} AS ols_slope, n_outside FROM m")
def noise_trials(spark, sf):
    return rounded(R.noise_trials(_points(spark, sf), "p_partkey", "t", 4000, 0.05, 9), {"fixed_theory_r2": 8, "ols_in_sample_r2": 8, "ols_slope": 8})


def _summary_sql(c: str, name: str) -> str:
    p, z = f"(count(*) FILTER ({c} >= 0.98) / count(*)::DOUBLE)", "pow(1.959963984540054, 2)"
    half = f"1.959963984540054 * sqrt({p} * (1 - {p}) / count(*) + {z} / (4 * count(*) * count(*))) / (1 + {z} / count(*))"
    mid = f"({p} + {z} / (2 * count(*))) / (1 + {z} / count(*))"
    return f"""SELECT '{name}' AS measure, count(*) AS repeats, {sr(f'median({c})', 8)} AS r2_median, {sr(f'quantile_cont({c}, 0.05)', 8)} AS r2_q05, {sr(f'quantile_cont({c}, 0.95)', 8)} AS r2_q95,
  count(*) FILTER ({c} >= 0.98) AS successes, {sr(p, 8)} AS success_fraction, {sr(f'greatest(0, {mid} - {half})', 8)} AS wilson_lo, {sr(f'least(1, {mid} + {half})', 8)} AS wilson_hi,
  {sr(f'sqrt({p} * (1 - {p}) / count(*))', 8)} AS mc_standard_error, {sr('sum(n_outside) / sum(n)::DOUBLE', 9)} AS outside_fraction FROM m"""


@query("noise_summary", _noise_sql("0.07 * t") + " " + _summary_sql("r2", "fixed_theory_r2") + " UNION ALL " + _summary_sql("ols", "ols_in_sample_r2"))
def noise_summary(spark, sf):
    # Read by both measures: simulated once.
    t = durable(R.noise_trials(_points(spark, sf), "p_partkey", "t", 4000, 0.07, 9, kind="relative"))
    s = R.trial_summary(t, "fixed_theory_r2", 0.98).unionByName(R.trial_summary(t, "ols_in_sample_r2", 0.98))
    return rounded(s, {c: 8 for c in s.columns if c not in ("measure", "repeats", "successes", "outside_fraction")} | {"outside_fraction": 9})


# --- joint propagation ------------------------------------------------------------------

def _covariance():
    """Assumed log covariance: independent 2 % terms, top and bottom correlated."""
    n = len(R.PARAMETERS)
    cov = [[0.0] * n for _ in range(n)]
    for i in range(n):
        cov[i][i] = 4e-4 * (1 + i)
    cov[9][10] = cov[10][9] = 3e-3
    cov[3][4] = cov[4][3] = 1e-3
    return cov


def _draw_sql() -> str:
    cov, names = _covariance(), R.PARAMETERS
    # Two by two blocks, the larger variance (the later one) first: its own root, then the rest of the other.
    factor = [{i: f"sqrt({cov[i][i]!r})"} for i in range(len(names))]
    for p, q in ((3, 4), (9, 10)):
        factor[p] = {p: f"sqrt({cov[p][p]!r} - pow({cov[p][q]!r}, 2) / {cov[q][q]!r})", q: f"{cov[p][q]!r} / sqrt({cov[q][q]!r})"}
    z = ", ".join(f"{sql_normal(21, 'l_suppkey::VARCHAR', 'draw::VARCHAR', chr(39) + str(j) + chr(39))} AS z{j}" for j in range(len(names)))
    rows = ", ".join(
        f"exp(ln({n}) + ({-0.5 * cov[i][i]!r})" + "".join(f" + ({w}) * z{j}" for j, w in factor[i].items()) + f") AS d_{n}"
        for i, n in enumerate(names))
    return f"""WITH RECURSIVE c AS (SELECT l_suppkey, 30e-6 AS w_m, 30e-6 AS h_m, 30e-6 * avg(l_quantity) AS "L_m", 1e-11 * (2 + avg(l_tax)) AS "G_glass_m_s", 1e-11 * (3 + avg(l_discount)) AS "G_pdms_m_s",
  0.001 + avg(l_discount) / 100 AS "eta_Pa_s", 6e-10 AS "D_ref_m2_s", 50.0 AS "C0_mol_m3", 1.45e-5 AS "Vm_m3_mol", avg(l_extendedprice) / 1000 AS top_nm, 0.8 * avg(l_extendedprice) / 1000 AS bot_nm, 45.0 AS t_c
  FROM lineitem GROUP BY 1), zz AS (SELECT *, {z} FROM c, range(1000) r(draw)), dd AS (SELECT l_suppkey, draw, t_c, {rows} FROM zz),
k AS (SELECT *, "d_G_glass_m_s" / ("d_C0_mol_m3" * "d_Vm_m3_mol") AS kg, "d_G_pdms_m_s" / ("d_C0_mol_m3" * "d_Vm_m3_mol") AS kp, "d_D_ref_m2_s" * (t_c + 273.15) / 298.15 * 0.00089 / "d_eta_Pa_s" AS dif FROM dd),
u AS (SELECT *, sqrt((2 * d_h_m * kp + d_w_m * kg + d_w_m * kp) / (d_w_m * d_h_m) / dif) AS p, kp / dif AS b FROM k),
bis AS (SELECT l_suppkey, draw, p * d_w_m AS p1, b * d_w_m AS b1, 0.0::DOUBLE AS lo, 2000.0::DOUBLE AS hi, 0 AS it FROM u
  UNION ALL SELECT l_suppkey, draw, p1, b1, CASE WHEN v > 0.9 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN v > 0.9 THEN hi ELSE (lo + hi) / 2 END, it + 1
  FROM (SELECT *, {sql_u('1', '(p1 * (lo + hi) / 2)', '(b1 * (lo + hi) / 2)')} AS v FROM bis WHERE it < 70)),
o AS (SELECT u.l_suppkey, u.draw, {sql_u('1', '(p * "d_L_m")', '(b * "d_L_m")')} AS sc, d_bot_nm / d_top_nm AS meas, (lo + hi) / 2 AS ar,
  {sql_normal(21, 'u.l_suppkey::VARCHAR', 'u.draw::VARCHAR', chr(39) + 'discrepancy' + chr(39))} * 0.01 AS noise FROM u JOIN bis ON bis.l_suppkey = u.l_suppkey AND bis.draw = u.draw AND it = 70)"""


def draws(spark, sf):
    a = F.avg
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.lit(30e-6).alias("w_m"), F.lit(30e-6).alias("h_m"), (a("l_quantity") * 30e-6).alias("L_m"),
        ((a("l_tax") + 2) * 1e-11).alias("G_glass_m_s"), ((a("l_discount") + 3) * 1e-11).alias("G_pdms_m_s"),
        (a("l_discount") / 100 + 0.001).alias("eta_Pa_s"), F.lit(6e-10).alias("D_ref_m2_s"), F.lit(50.0).alias("C0_mol_m3"),
        F.lit(1.45e-5).alias("Vm_m3_mol"), (a("l_extendedprice") / 1000).alias("top_nm"), (a("l_extendedprice") * 0.8 / 1000).alias("bot_nm"),
        F.lit(45.0).alias("T_C"))
    return R.propagate(c, "l_suppkey", _covariance(), 1000, 21, STUDY, discrepancy_sd=0.01)


_DRAWS = _draw_sql()
_DRAW_COLS = {"SC_property": "sc", "SC_measurement": "meas", "SC_model_plus_assumed_discrepancy": "sc + noise", "AR_max": "ar"}


@query("propagate_draws", _DRAWS + " SELECT l_suppkey, draw::INTEGER AS draw, " + ", ".join(f'{sr(e, 7)} AS "{n}"' for n, e in _DRAW_COLS.items())
       + ", 'root' AS \"AR_max_status\" FROM o")
def propagate_draws(spark, sf):
    return rounded(draws(spark, sf), {c: 7 for c in _DRAW_COLS})


@query("draw_summary", _DRAWS + f""" SELECT l_suppkey, count(ar) AS n_defined, {sr('avg(ar)', 7)} AS mean, {sr('stddev_samp(ar)', 7)} AS sd, {sr('quantile_cont(ar, 0.025)', 7)} AS q025,
  {sr('quantile_cont(ar, 0.975)', 7)} AS q975, {sr('stddev_samp(ar) / sqrt(count(*))', 7)} AS mc_standard_error_of_mean FROM o GROUP BY 1""")
def draw_summary(spark, sf):
    s = R.draw_summary(draws(spark, sf), "AR_max", ["l_suppkey"])
    return rounded(s, {c: 7 for c in ("mean", "sd", "q025", "q975", "mc_standard_error_of_mean")})


# --- model evaluation -----------------------------------------------------------------------

def study_rows(spark, sf):
    """Growth rows as labelled regions; the condition is flag and status."""
    return table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("cond"), "l_quantity", "l_discount", "l_tax",
        (F.col("l_quantity") * 1.5 + F.col("l_extendedprice") / 5000 - F.col("l_discount") * 200).alias("y"))


@query("fold_scaling", """WITH g AS (SELECT l_linenumber AS k, avg(l_quantity) AS m1, var_pop(l_quantity) + avg(l_quantity) * avg(l_quantity) AS q1, avg(l_tax) AS m2, var_pop(l_tax) + avg(l_tax) * avg(l_tax) AS q2 FROM lineitem GROUP BY 1),
h AS (SELECT a.k AS held_out, avg(b.m1) AS m1, avg(b.q1) AS q1, avg(b.m2) AS m2, avg(b.q2) AS q2 FROM g a JOIN g b ON a.k <> b.k GROUP BY 1)
""" + f"SELECT held_out, 'l_quantity' AS feature, {sr('m1', 9)} AS mean, {sr('sqrt(q1 - m1 * m1)', 8)} AS scale FROM h UNION ALL SELECT held_out, 'l_tax', {sr('m2', 9)}, {sr('sqrt(q2 - m2 * m2)', 8)} FROM h")
def fold_scaling(spark, sf):
    return rounded(M.fold_scaling(table(spark, sf, "lineitem"), "l_linenumber", ["l_quantity", "l_tax"]), {"mean": 9, "scale": 8})


_ALPHAS = (10.0, 3000.0, 20000.0)
_NESTED = """WITH RECURSIVE d AS (SELECT l_returnflag || l_linestatus AS g, l_quantity AS x1, l_discount AS x2, l_quantity * 1.5 + l_extendedprice / 5000 - l_discount * 200 AS y FROM lineitem),
c AS (SELECT avg(x1) AS c1, avg(x2) AS c2, avg(y) AS cy FROM d),
s AS (SELECT g, count(*) AS n, avg(x1 - c1) AS m1, avg(x2 - c2) AS m2, avg(y - cy) AS my, avg(pow(x1 - c1, 2)) AS q11, avg((x1 - c1) * (x2 - c2)) AS q12, avg(pow(x2 - c2, 2)) AS q22,
  avg((x1 - c1) * (y - cy)) AS q1y, avg((x2 - c2) * (y - cy)) AS q2y, avg(pow(y - cy, 2)) AS qyy FROM d, c GROUP BY 1),
pairs AS (SELECT o.g AS outer_g, s.* FROM s JOIN s o ON o.g <> s.g),
""" + _greedy_sql("pairs", "g", 3, "outer_g") + """,
mem AS (SELECT p.*, f.fold FROM pairs p JOIN folded f ON p.outer_g = f.outer_g AND p.g = f.g),
tr AS (SELECT v.outer_g, v.fold, sum(n) AS n, avg(m1) AS m1, avg(m2) AS m2, avg(my) AS my, avg(q11) AS q11, avg(q12) AS q12, avg(q22) AS q22, avg(q1y) AS q1y, avg(q2y) AS q2y, avg(qyy) AS qyy
  FROM (SELECT DISTINCT outer_g, fold FROM mem UNION ALL SELECT DISTINCT outer_g, -1 FROM mem) v JOIN mem ON mem.outer_g = v.outer_g AND mem.fold <> v.fold GROUP BY 1, 2),
st2 AS (SELECT *, sqrt(q11 - m1 * m1) AS s1, sqrt(q22 - m2 * m2) AS s2, sqrt(qyy - my * my) AS sy, q11 - m1 * m1 AS c11, q12 - m1 * m2 AS c12, q22 - m2 * m2 AS c22, q1y - m1 * my AS c1y, q2y - m2 * my AS c2y FROM tr),
fit AS (SELECT outer_g, fold, k, alpha, n, s1, s2, sy, m1, m2, my, n + alpha AS ga, n * c12 / (s1 * s2) AS gb, n * c1y / (s1 * sy) AS r1, n * c2y / (s2 * sy) AS r2
  FROM st2, (VALUES (0, 10.0::DOUBLE), (1, 3000.0), (2, 20000.0)) a(k, alpha)),
co AS (SELECT outer_g, fold, k, alpha, (r1 * ga - r2 * gb) / (ga * ga - gb * gb) * sy / s1 AS b1, (r2 * ga - r1 * gb) / (ga * ga - gb * gb) * sy / s2 AS b2, m1, m2, my FROM fit),
cf AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM co),
sc AS (SELECT cf.outer_g, k, alpha, sqrt(avg(qyy - 2 * b0 * mem.my - 2 * b1 * q1y - 2 * b2 * q2y + b0 * b0 + 2 * b0 * (b1 * mem.m1 + b2 * mem.m2) + b1 * b1 * q11 + 2 * b1 * b2 * q12 + b2 * b2 * q22)) AS rmse
  FROM cf JOIN mem ON mem.outer_g = cf.outer_g AND mem.fold = cf.fold GROUP BY 1, 2, 3),
best AS (SELECT outer_g, k, alpha, rmse FROM (SELECT *, row_number() OVER (PARTITION BY outer_g ORDER BY rmse, k) AS r FROM sc) WHERE r = 1)"""


@query("nested_cv_ridge", _NESTED + f""", oof AS (SELECT d.g, d.y, cy + b0 + b1 * (x1 - c1) + b2 * (x2 - c2) AS p, b.alpha, b.rmse FROM d JOIN best b ON d.g = b.outer_g JOIN cf ON cf.outer_g = d.g AND cf.fold = -1 AND cf.k = b.k, c)
SELECT g AS cond, max(alpha) AS alpha, {sr('max(rmse)', 7)} AS inner_rmse, count(*) AS n, {sr('sqrt(avg(pow(p - y, 2)))', 7)} AS rmse, {sr('avg(p - y)', 7)} AS bias FROM oof GROUP BY 1""")
def nested_cv_ridge(spark, sf):
    d, f = study_rows(spark, sf), ["l_quantity", "l_discount"]
    _, chosen = M.nested_ridge(d, "cond", f, "y", list(_ALPHAS))
    oof = M.linear_predictions(d, chosen.select("outer", "alpha", "coef"), "cond", f, "y", d)
    e = F.col("pred") - F.col("y")
    m = oof.groupBy("cond").agg(F.max("alpha").alias("alpha"), F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
    m = m.join(chosen.select(F.col("outer").alias("cond"), "inner_rmse"), "cond")
    return rounded(m, {"inner_rmse": 7, "rmse": 7, "bias": 7})


@query("nested_scores", _NESTED + f" SELECT outer_g AS outer_cond, k AS candidate, alpha, {sr('rmse', 7)} AS inner_rmse FROM sc")
def nested_scores(spark, sf):
    scores, _ = M.nested_ridge(study_rows(spark, sf), "cond", ["l_quantity", "l_discount"], "y", list(_ALPHAS))
    return rounded(scores.withColumnRenamed("outer", "outer_cond"), {"inner_rmse": 7})


# --- choice between families ------------------------------------------------------------------

_FAMILIES = [Z.Linear(alphas=(10.0, 3000.0)), Z.Fourier()]


def _families_sql() -> str:
    """The nested evaluation in SQL: basis products summed as columns, every fit
    by elimination of its symmetric system, errors from the sums again."""
    size = _FAMILIES[1].size
    ctes = ["d AS (SELECT l_returnflag || l_linestatus AS g, l_quantity AS x0, l_discount AS x1, l_tax AS x2, l_quantity * 1.5 + l_extendedprice / 5000 - l_discount * 200 AS y, l_orderkey, l_linenumber FROM lineitem)",
            "g0 AS (SELECT g, count(*) AS n, " + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + avg({c}) * avg({c}) AS q_{c}" for c in ("x0", "x1", "x2", "y")) + " FROM d GROUP BY 1)",
            "sc AS (SELECT " + ", ".join(f"avg(m_{c}) AS c_{c}, sqrt(avg(q_{c}) - avg(m_{c}) * avg(m_{c})) AS s_{c}" for c in ("x0", "x1", "x2", "y")) + " FROM g0)",
            "z AS (SELECT g, " + ", ".join(f"(x{i} - c_x{i}) / s_x{i} AS z{i}" for i in range(3)) + ", (y - c_y) / s_y AS t, y FROM d, sc)"]
    bases = [["z0", "z1", "z2"]]
    for gamma in _FAMILIES[1].gammas:
        waves, phase = Z.fourier_waves(3, size, _FAMILIES[1].seed, gamma)
        bases.append([f"{(2.0 / size) ** 0.5!r} * cos(" + " + ".join(f"z{i} * {float(waves[i, j])!r}" for i in range(3)) + f" + {float(phase[j])!r})" for j in range(size)])
    for b, terms in enumerate(bases):
        k = len(terms)
        ctes.append(f"b{b} AS (SELECT g, t, y, " + ", ".join(f"{e} AS f{j}" for j, e in enumerate(terms)) + " FROM z)")
        products = ", ".join(f"avg(f{i} * f{j}) AS p_{i}_{j}" for i in range(k) for j in range(i, k))
        ctes.append(f"a{b} AS (SELECT g, count(*) AS n, avg(t) AS t, avg(t * t) AS tt, {products}, " + ", ".join(f"avg(f{j}) AS f_{j}, avg(f{j} * t) AS ft_{j}" for j in range(k)) + f" FROM b{b} GROUP BY 1)")
        lists = lambda e, n: "[" + ", ".join(e(j) for j in range(n)) + "]"
        ctes.append(f"s{b} AS (SELECT g, {b} AS basis, n, t, tt, {lists(lambda j: f'f_{j}', k)} AS f, {lists(lambda j: f'ft_{j}', k)} AS ft, "
                    + lists(lambda i: lists(lambda j: f"p_{min(i, j)}_{max(i, j)}", k), k) + f" AS ff FROM a{b})")
    cands = [(0, i, 0, a) for i, a in enumerate(_FAMILIES[0].alphas)] + [(1, i, 1 + b, p["alpha"]) for i, (b, p) in enumerate(_FAMILIES[1].candidates())]
    ctes += ["s AS (" + " UNION ALL ".join(f"SELECT * FROM s{b}" for b in range(len(bases))) + ")",
             "pairs AS (SELECT o.g AS outer_g, g0.g, g0.n FROM g0 JOIN g0 o ON o.g <> g0.g)", _greedy_sql("pairs", "g", 3, "outer_g"),
             "v AS (SELECT DISTINCT outer_g, fold FROM folded UNION ALL SELECT DISTINCT outer_g, -1 FROM folded)",
             # the long form of each training set's means
             "tr AS (SELECT v.outer_g, v.fold, s.basis, s.g, s.n, s.t, s.tt, s.f, s.ft, s.ff FROM v JOIN folded m ON m.outer_g = v.outer_g AND m.fold <> v.fold JOIN s ON s.g = m.g)",
             "t1 AS (SELECT outer_g, fold, basis, sum(n) AS n, avg(t) AS t, avg(tt) AS tt FROM tr GROUP BY ALL)",
             "t2 AS (SELECT outer_g, fold, basis, i, avg(f[i]) AS f, avg(ft[i]) AS ft FROM tr, range(1, 49) u(i) WHERE i <= len(f) GROUP BY ALL)",
             "t3 AS (SELECT outer_g, fold, basis, i, j, avg(ff[i][j]) AS ff FROM tr, range(1, 49) u(i), range(1, 49) w(j) WHERE i <= len(f) AND j <= len(f) GROUP BY ALL)",
             "cand(family, candidate, basis, alpha) AS (VALUES " + ", ".join(f"({f}, {c}, {b}, {a!r}::DOUBLE)" for f, c, b, a in cands) + ")",
             "w AS (SELECT t1.*, greatest(tt - t * t, 0) AS vy FROM t1)",
             "e AS (SELECT outer_g, fold, family, candidate, basis, i, list(v ORDER BY j) AS row FROM (SELECT t3.outer_g, t3.fold, family, candidate, cand.basis, t3.i, t3.j, "
             "CASE WHEN family = 0 THEN w.n * (ff - a.f * b.f) / sqrt((a2.ff - a.f * a.f) * (b2.ff - b.f * b.f)) ELSE w.n * t3.ff END + CASE WHEN t3.i = t3.j THEN alpha ELSE 0 END AS v"]
    ctes[-1] = ctes[-1].replace("w.n * (ff - a.f", "w.n * (t3.ff - a.f")
    ctes[-1] += (" FROM t3 JOIN cand ON cand.basis = t3.basis JOIN w ON w.outer_g = t3.outer_g AND w.fold = t3.fold AND w.basis = t3.basis"
                 " JOIN t2 a ON a.outer_g = t3.outer_g AND a.fold = t3.fold AND a.basis = t3.basis AND a.i = t3.i JOIN t2 b ON b.outer_g = t3.outer_g AND b.fold = t3.fold AND b.basis = t3.basis AND b.i = t3.j"
                 " JOIN t3 a2 ON a2.outer_g = t3.outer_g AND a2.fold = t3.fold AND a2.basis = t3.basis AND a2.i = t3.i AND a2.j = t3.i JOIN t3 b2 ON b2.outer_g = t3.outer_g AND b2.fold = t3.fold AND b2.basis = t3.basis AND b2.i = t3.j AND b2.j = t3.j"
                 " UNION ALL SELECT t2.outer_g, t2.fold, family, candidate, cand.basis, t2.i, 999 AS j, w.n * (ft - f * w.t) / sqrt(w.vy) / CASE WHEN family = 0 THEN sqrt(a2.ff - f * f) ELSE 1 END"
                 " FROM t2 JOIN cand ON cand.basis = t2.basis JOIN w ON w.outer_g = t2.outer_g AND w.fold = t2.fold AND w.basis = t2.basis JOIN t3 a2 ON a2.outer_g = t2.outer_g AND a2.fold = t2.fold AND a2.basis = t2.basis AND a2.i = t2.i AND a2.j = t2.i) GROUP BY ALL)")
    ctes += ["sys AS (SELECT outer_g, fold, family, candidate, basis, 1 AS k, list(row ORDER BY i) AS m FROM e GROUP BY ALL)",
             "el AS (SELECT * FROM sys UNION ALL SELECT outer_g, fold, family, candidate, basis, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) "
             "ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM el WHERE k <= len(m))",
             "so AS (SELECT outer_g, fold, family, candidate, basis, list_transform(m, lambda r: r[-1]) AS b FROM el WHERE k = len(m) + 1)",
             # weights in units of the scaled target, with the intercept
             "ws AS (SELECT so.outer_g, so.fold, so.family, so.candidate, so.basis, u.i, so.b[u.i] * sqrt(w.vy) / CASE WHEN family = 0 THEN sqrt(t3.ff - t2.f * t2.f) ELSE 1 END AS b, t2.f, w.t FROM so, range(1, 49) u(i) "
             "JOIN t2 ON t2.outer_g = so.outer_g AND t2.fold = so.fold AND t2.basis = so.basis AND t2.i = u.i JOIN t3 ON t3.outer_g = so.outer_g AND t3.fold = so.fold AND t3.basis = so.basis AND t3.i = u.i AND t3.j = u.i "
             "JOIN w ON w.outer_g = so.outer_g AND w.fold = so.fold AND w.basis = so.basis)",
             "cf AS (SELECT outer_g, fold, family, candidate, basis, list(b ORDER BY i) AS b, max(t) - sum(CASE WHEN family = 0 THEN b * f ELSE 0 END) AS b0 FROM ws GROUP BY ALL)",
             "er AS (SELECT cf.outer_g, family, candidate, s.g, tt - 2 * b0 * t - 2 * list_dot_product(b, ft) + b0 * b0 + 2 * b0 * list_dot_product(b, f) + list_dot_product(b, list_transform(ff, lambda r: list_dot_product(r, b))) AS mse "
             "FROM cf JOIN folded m ON m.outer_g = cf.outer_g AND m.fold = cf.fold JOIN s ON s.g = m.g AND s.basis = cf.basis)",
             "scores AS (SELECT outer_g, family, candidate, sqrt(avg(greatest(mse, 0))) AS score FROM er GROUP BY ALL)",
             "win AS (SELECT *, row_number() OVER (PARTITION BY outer_g ORDER BY score, family) = 1 AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY outer_g, family ORDER BY score, candidate) AS r FROM scores) WHERE r = 1)",
             "test AS (SELECT win.*, tt - 2 * b0 * t - 2 * list_dot_product(b, ft) + b0 * b0 + 2 * b0 * list_dot_product(b, f) + list_dot_product(b, list_transform(ff, lambda r: list_dot_product(r, b))) AS mse, b0 + list_dot_product(b, f) - t AS bias, s.n "
             "FROM win JOIN cf ON cf.outer_g = win.outer_g AND cf.family = win.family AND cf.candidate = win.candidate AND cf.fold = -1 JOIN s ON s.g = win.outer_g AND s.basis = cf.basis)"]
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"""
SELECT outer_g AS cond, CASE family WHEN 0 THEN 'linear' ELSE 'fourier' END AS family, candidate::INT AS candidate, chosen AS selected_by_inner, n AS n_measurements,
  {sr('score * s_y', 4)} AS inner_rmse, {sr('sqrt(greatest(mse, 0)) * s_y', 4)} AS rmse, {sr('bias * s_y', 4)} AS bias FROM test, sc"""


@query("nested_families", _families_sql())
def nested_families(spark, sf):
    """Two families in one nested evaluation, written as one result and read
    back: winners, and how they do on the condition they never saw."""
    from ..sources.sinks import scratch_path
    found = Z.nested_families(study_rows(spark, sf), "cond", ["l_quantity", "l_discount", "l_tax"], "y", _FAMILIES)
    found = Z.load_evaluation(found, Z.save_evaluation(found, "cond", scratch_path(spark, "evaluation")))
    e = F.col("pred") - F.col("y")
    t = found["oof"].groupBy("cond", "family", "selected_by_inner").agg(F.count(F.lit(1)).alias("n_measurements"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
    c = found["candidates"].where("winner").select(F.col("outer").alias("cond"), "family", "candidate", "inner_rmse")
    return rounded(t.join(c, ["cond", "family"]), {"inner_rmse": 4, "rmse": 4, "bias": 4})


_HOLDOUT = _NESTED.replace("d AS (SELECT l_returnflag || l_linestatus AS g, l_quantity", f"""hg AS (SELECT l_suppkey, count(*) AS n, {sql_uniform(1729, 'l_suppkey::VARCHAR')} AS u FROM lineitem GROUP BY 1),
hs AS (SELECT l_suppkey, row_number() OVER (ORDER BY u, l_suppkey) <= greatest(2, ceil(0.25 * (SELECT count(*) FROM hg))) AS held FROM hg),
every AS (SELECT l_suppkey::VARCHAR AS g, held, l_quantity""").replace("AS y FROM lineitem)", """AS y FROM lineitem JOIN hs USING (l_suppkey)),
d AS (SELECT * FROM every WHERE NOT held)""", 1).replace("pairs AS (SELECT o.g AS outer_g, s.* FROM s JOIN s o ON o.g <> s.g)", "pairs AS (SELECT 'all' AS outer_g, s.* FROM s)") + f""",
tt AS (SELECT e.g, cy + b0 + b1 * (x1 - c1) + b2 * (x2 - c2) - y AS e FROM every e, c, best b JOIN cf ON cf.fold = -1 AND cf.k = b.k WHERE held),
tg AS (SELECT g, avg(e * e) AS m FROM tt GROUP BY 1)
SELECT 'linear' AS family, (SELECT max(k) FROM best)::INT AS candidate, {sr('(SELECT max(rmse) FROM best)', 7)} AS cv_rmse, (SELECT count(*) FROM tg) AS n_conditions, count(*) AS n_measurements,
  {sr('(SELECT sqrt(avg(m)) FROM tg)', 7)} AS condition_balanced_rmse, {sr('sqrt(avg(e * e))', 7)} AS rmse, {sr('avg(abs(e))', 7)} AS mae, {sr('avg(e)', 7)} AS bias FROM tt"""


@query("holdout_scores", _HOLDOUT)
def holdout_scores(spark, sf):
    """Whole suppliers held out, selection inside the others, the winner scored once."""
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey"), F.col("l_suppkey").cast("string").alias("supplier"), "l_quantity", "l_discount",
                                            (F.col("l_quantity") * 1.5 + F.col("l_extendedprice") / 5000 - F.col("l_discount") * 200).alias("y"))
    split = K.group_holdout(d, "l_suppkey", 0.25, 1729).select(F.col("l_suppkey").cast("string").alias("supplier"), "split")
    found = Z.holdout_evaluation(d.drop("l_suppkey"), "supplier", ["l_quantity", "l_discount"], "y", [Z.Linear(alphas=_ALPHAS)], split)
    names = ("cv_rmse", "condition_balanced_rmse", "rmse", "mae", "bias")
    return rounded(found["report"].drop("parameters"), {c: 7 for c in names})


_PERM_Y = "(p_retailprice - 900) * 0.5 + p_size * 0.2"


def _shuffled_sql(feature: str) -> str:
    u = lambda way: sql_uniform(13, f"'{feature}'", "rep::VARCHAR", "p_partkey::VARCHAR", f"'{way}'")
    return f"""SELECT '{feature}' AS feature, a.rep, avg(abs({'b.v' if feature == 'p_size' else 'a.p_size'} * 0.3 + ({'b.v' if feature == 'p_retailprice' else 'a.p_retailprice'} - 900) * 0.45 - a.y)) AS mae FROM
  (SELECT p_partkey, p_size, p_retailprice, {_PERM_Y} AS y, rep, row_number() OVER (PARTITION BY rep ORDER BY {u('to')}, p_partkey) AS r FROM val, range(10) t(rep)) a
  JOIN (SELECT rep, {feature} AS v, row_number() OVER (PARTITION BY rep ORDER BY {u('from')}, p_partkey) AS r FROM val, range(10) t(rep)) b ON a.rep = b.rep AND a.r = b.r GROUP BY 2"""


@query("permutation_importance", f"""
WITH val AS (SELECT * FROM part WHERE {sql_uniform(17, 'p_partkey::VARCHAR')} < 0.5), m AS ({_shuffled_sql('p_size')} UNION ALL {_shuffled_sql('p_retailprice')}), b AS (SELECT avg(abs(p_size * 0.3 + (p_retailprice - 900) * 0.45 - ({_PERM_Y}))) AS b FROM val)
SELECT feature, {sr('avg(mae) - max(b)', 8)} AS mae_increase_mean, {sr('stddev_pop(mae)', 8)} AS mae_increase_std FROM m, b GROUP BY 1""")
def permutation_importance(spark, sf):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    p = table(spark, sf, "part").where(uniform(17, F.col("p_partkey")) < 0.5).select("p_partkey", size.alias("p_size"), "p_retailprice", ((price - 900) * 0.5 + size * 0.2).alias("y"))

    def score(df):
        return df.withColumn("pred", F.col("p_size") * 0.3 + (F.col("p_retailprice") - 900) * 0.45)

    t = M.permutation_importance(p, "p_partkey", ["p_size", "p_retailprice"], "y", score, 10, 13)
    return rounded(t, {"mae_increase_mean": 8, "mae_increase_std": 8})


_FP = 5


def _farthest_sql() -> str:
    steps = ["WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: (v::DOUBLE + 0.6) / 1.2) AS p FROM embeddings)",
             "c AS (SELECT vec_id, p, list_sum(list_transform(p, lambda v: pow(v - 0.5, 2))) AS dc FROM e)",
             "s1 AS (SELECT vec_id, p, NULL::DOUBLE AS d FROM c ORDER BY dc, vec_id LIMIT 1)"]
    for k in range(2, _FP + 1):
        dist = ", ".join(f"(SELECT list_sum(list_transform(list_zip(e.p, s.p), lambda z: pow(z[1] - z[2], 2))) FROM s{j} s)" for j in range(1, k))
        out = " AND ".join(f"vec_id <> (SELECT vec_id FROM s{j})" for j in range(1, k))
        least = f"least({dist})" if k > 2 else dist
        steps.append(f"s{k} AS (SELECT vec_id, p, d FROM (SELECT vec_id, p, {least} AS d FROM e) WHERE {out} ORDER BY d DESC, vec_id LIMIT 1)")
    union = " UNION ALL ".join(f"SELECT {k} AS selection_index, vec_id, {sr('d', 8)} AS squared_distance FROM s{k}" for k in range(1, _FP + 1))
    return ",\n".join(steps) + "\n" + union


@query("farthest_points", _farthest_sql())
def farthest_points(spark, sf):
    e = table(spark, sf, "embeddings")
    dims = 64
    scaled = e.select("vec_id", *[((F.get("embedding", i).cast("double") + 0.6) / 1.2).alias(f"s{i}") for i in range(dims)])
    picks = S.farthest_points(scaled, "vec_id", [f"s{i}" for i in range(dims)], [1.0] * dims, _FP)
    return rounded(picks, {"squared_distance": 8})


# --- families without a SQL counterpart ------------------------------------------------------

def _oof_summary(oof, by):
    return regression_metrics(oof, "y", "pred", by).select(*by, "n_measurements", "r2", "rmse", "mae")


@query("fourier_ridge_cv")
def fourier_ridge_cv(spark, sf):
    _, oof = M.fourier_nested(study_rows(spark, sf), "cond", ["l_quantity", "l_discount", "l_tax"], "y", size=16)
    return _oof_summary(oof, ["cond"])


@query("fourier_insensitive_cv")
def fourier_insensitive_cv(spark, sf):
    _, oof = M.fourier_nested(study_rows(spark, sf), "cond", ["l_quantity", "l_discount", "l_tax"], "y", gammas=(0.2,),
                              alphas=(0.1,), size=16, epsilon=0.05, rounds=4)
    return _oof_summary(oof, ["cond"])


def _priced_orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("cond"), (F.col("o_totalprice") / 1e5).alias("price"),
        (F.col("o_custkey") / 1000).alias("cust"), F.month("o_orderdate").cast("double").alias("month"),
        (F.sqrt(F.col("o_totalprice")) / 100 + F.month("o_orderdate") * 0.1).alias("y"))


@query("forest_cv")
def forest_cv(spark, sf):
    oof = M.forest_nested(_priced_orders(spark, sf), "cond", ["price", "cust", "month"], "y")
    return _oof_summary(oof, ["cond", "min_leaf"])


@query("forest_surrogate")
def forest_surrogate(spark, sf):
    """Forest surrogate of coverage on an exact three-way split."""
    from ..functions.transport import SlitParameters, profile, slit_coefficients
    e = table(spark, sf, "events").select("event_id")
    s = K.three_way_split(K.stratified_sample(e, "event_id", _BOUNDS, 5), "event_id", 7)
    c = slit_coefficients("aspect_ratio", "viscosity_mpa_s", "temperature_c", SlitParameters())
    features = list(_BOUNDS)
    # Each pass of the fit, and the prediction, would sample, split and solve again.
    s = durable(s.withColumn("y", F.expr(profile(1.0, c["da"], c["bottom_biot"]))).select("split", "y", *features))
    model = M.fit_forest(s.where("split = 'train'"), features, "y", 0, trees=20, leaf=2)
    return _oof_summary(M.forest_predict(model, s, features), ["split"])


_FINAL = _NESTED.replace("pairs AS (SELECT o.g AS outer_g, s.* FROM s JOIN s o ON o.g <> s.g)", "pairs AS (SELECT 'all' AS outer_g, s.* FROM s)") + f""",
rng AS (SELECT min(x1) AS l1, max(x1) AS h1, min(x2) AS l2, max(x2) AS h2, min(y) AS ly, max(y) AS hy FROM d),
fresh AS (SELECT l_quantity + l_tax * 50 AS x1, l_discount AS x2, l_quantity * 1.5 + l_extendedprice / 5000 - l_discount * 200 AS y, l_tax > 0.04 AS new FROM lineitem),
pr AS (SELECT f.*, cy + b0 + b1 * (f.x1 - c1) + b2 * (f.x2 - c2) AS p FROM fresh f, c, best b JOIN cf ON cf.outer_g = 'all' AND cf.fold = -1 AND cf.k = b.k),
fl AS (SELECT pr.*, x1 < l1 OR x1 > h1 OR x2 < l2 OR x2 > h2 AS outside, p < ly OR p > hy AS off FROM pr, rng)
SELECT outside AS outside_training_feature_range, CASE WHEN new THEN 'unverified_final_inference' ELSE 'training_reprediction' END AS prediction_role, count(*) AS n_measurements,
  count(*) FILTER (off) AS n_outside_target, count(*) FILTER (p < 0) AS n_negative, {sr('sqrt(avg(pow(p - y, 2)))', 7)} AS rmse, {sr('avg(abs(p - y))', 7)} AS mae FROM fl GROUP BY ALL"""


@query("final_fit", _FINAL)
def final_fit(spark, sf):
    """Final all-label ridge: saved with what inference checks, reloaded, applied to shifted rows some of which are new."""
    from ..sources.sinks import scratch_path
    f = ["l_quantity", "l_discount"]
    d = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("cond"), *f, "l_tax", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("measurement_id"),
        (F.col("l_quantity") * 1.5 + F.col("l_extendedprice") / 5000 - F.col("l_discount") * 200).alias("y"), F.lit(0.5).alias("um_per_px"), F.lit("SYNTHETIC").alias("origin"))
    path = M.save_final(M.final_ridge(d, "cond", f, "y", list(_ALPHAS)), d, f, "y", "measurement_id", "um_per_px", "origin", scratch_path(spark, "final-model"))
    fresh = d.withColumns({"l_quantity": F.col("l_quantity") + F.col("l_tax") * 50, "um_per_px": F.lit(0.501),
                           "measurement_id": F.concat(F.when(F.col("l_tax") > 0.04, "new-").otherwise(""), "measurement_id")})
    out = M.predict_final(fresh, path, "measurement_id", "um_per_px", "origin")
    e = F.col("pred") - F.col("y")
    t = out.groupBy("outside_training_feature_range", "prediction_role").agg(
        F.count(F.lit(1)).alias("n_measurements"), F.count_if("outside_training_target_range").alias("n_outside_target"), F.count_if("negative_prediction").alias("n_negative"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return rounded(t, {"rmse": 7, "mae": 7})
