"""Grouped regression, calibration and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as X
from ..operators import regression as R
from .growth import (CALIBRATION_SQL, COND, LINES_SQL, calibration, growth, growth_lines, sql_t975,
                     sql_t_two_sided)
from .registry import query, rnd, rounded, sr, table

GROUP = [*COND, "substrate"]
_HEAD = '"T_C", gly_pct, substrate'


@query("grouped_ols", LINES_SQL + f""", s AS (
  SELECT {_HEAD}, max(n) AS n, max(n_times) AS n_times, max(a) AS a, max(b) AS b, max(mx) AS mx, max(sxx) AS sxx, max(syy) AS syy, sum(e * e) AS rss,
         avg(y) FILTER (x = xmax) AS yend FROM res GROUP BY 1, 2, 3),
q AS (SELECT *, sqrt(rss / (n - 2) / sxx) AS sb, sqrt(rss / (n - 2) * (1 / n + mx * mx / sxx)) AS sa, {sql_t975('(n - 2)')} AS t FROM s)
SELECT {_HEAD}, n::BIGINT AS n, n_times, (n - 2)::BIGINT AS df, {sr('b', 8)} AS slope, {sr('sb', 8)} AS slope_se, {sr('b - t * sb', 7)} AS slope_lo, {sr('b + t * sb', 7)} AS slope_hi,
  {sr('a', 7)} AS intercept, {sr('sa', 7)} AS intercept_se, a + t * sa < 0 AND -a > 0.05 * yend AS induction,
  {sr('CASE WHEN a + t * sa < 0 AND -a > 0.05 * yend AND b > 0 THEN -a / b ELSE 0 END', 7)} AS t_ind, {sr('1 - rss / syy', 8)} AS r2 FROM q""")
def grouped_ols(spark, sf):
    t = growth_lines(spark, sf)
    return rounded(t.select(*GROUP, "n", "n_times", "df", "slope", "slope_se", "slope_lo", "slope_hi", "intercept", "intercept_se",
                            "induction", "t_ind", "r2"),
                   {"slope": 8, "slope_se": 8, "slope_lo": 7, "slope_hi": 7, "intercept": 7, "intercept_se": 7, "t_ind": 7, "r2": 8})


@query("ols_cluster_robust", LINES_SQL + f""", k AS (
  SELECT {_HEAD}, cl, max(n) AS n, max(mx) AS mx, max(sxx) AS sxx, max(b) AS b, max(a) AS a, sum(e) AS s0, sum(e * x) AS s1, count(*) AS z FROM res GROUP BY 1, 2, 3, 4),
m AS (SELECT {_HEAD}, max(n) AS n, max(mx) AS mx, max(sxx) AS sxx, max(b) AS b, count(*)::DOUBLE AS m, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM k GROUP BY 1, 2, 3),
v AS (SELECT *, (1 / n + mx * mx / sxx) AS i00, -mx / sxx AS i01, 1 / sxx AS i11, m / (m - 1) * (n - 1) / (n - 2) AS f FROM m)
SELECT {_HEAD}, m::BIGINT AS n_clusters_df_plus_one, {sr('b', 8)} AS slope,
  {sr('sqrt(f * (i01 * (m00 * i01 + m01 * i11) + i11 * (m01 * i01 + m11 * i11)))', 8)} AS slope_se,
  {sr('sqrt(f * (i00 * (m00 * i00 + m01 * i01) + i01 * (m01 * i00 + m11 * i01)))', 7)} AS intercept_se FROM v""")
def ols_cluster_robust(spark, sf):
    t = growth_lines(spark, sf, cluster="specimen_id")
    return t.select(*GROUP, (F.col("df") + 1).alias("n_clusters_df_plus_one"), rnd("slope", 8).alias("slope"),
                    rnd("slope_se", 8).alias("slope_se"), rnd("intercept_se", 7).alias("intercept_se"))


@query("ols_known_sd", LINES_SQL + f""", s AS (
  SELECT {_HEAD}, max(n) AS n, max(b) AS b, max(mx) AS mx, max(sxx) AS sxx, sum(e * e) AS rss, sum(sd * sd) AS k0, sum(sd * sd * x) AS k1, sum(sd * sd * x * x) AS k2 FROM res GROUP BY 1, 2, 3),
v AS (SELECT *, (1 / n + mx * mx / sxx) AS i00, -mx / sxx AS i01, 1 / sxx AS i11, rss / (n - 2) AS s2 FROM s),
d AS (SELECT *, i00 * (k0 * i00 + k1 * i01) + i01 * (k1 * i00 + k2 * i01) - s2 * i00 AS p, i00 * (k0 * i01 + k1 * i11) + i01 * (k1 * i01 + k2 * i11) - s2 * i01 AS o,
        i01 * (k0 * i01 + k1 * i11) + i11 * (k1 * i01 + k2 * i11) - s2 * i11 AS r FROM v),
e AS (SELECT *, (p + r) / 2 + sqrt(pow((p - r) / 2, 2) + o * o) AS l1, (p + r) / 2 - sqrt(pow((p - r) / 2, 2) + o * o) AS l2 FROM d),
w AS (SELECT *, o / sqrt(o * o + pow(l1 - p, 2)) AS x1, (l1 - p) / sqrt(o * o + pow(l1 - p, 2)) AS y1 FROM e)
SELECT {_HEAD}, {sr('b', 8)} AS slope, {sr('sqrt(s2 * i11 + greatest(l1, 0) * y1 * y1 + greatest(l2, 0) * x1 * x1)', 7)} AS slope_se,
  {sr('sqrt(s2 * i00 + greatest(l1, 0) * x1 * x1 + greatest(l2, 0) * y1 * y1)', 6)} AS intercept_se, 'SUPPLIED_SD' AS metrology_status FROM w""")
def ols_known_sd(spark, sf):
    t = growth_lines(spark, sf, known_sd="thickness_sd_nm")
    return t.select(*GROUP, rnd("slope", 8).alias("slope"), rnd("slope_se", 7).alias("slope_se"),
                    rnd("intercept_se", 6).alias("intercept_se"), "metrology_status")


@query("ols_lack_of_fit", LINES_SQL + f""", q AS (
  SELECT {_HEAD}, max(n) AS n, sum(e * e) AS sse, sum(c * c) AS s2, sum(c * c * c) AS s3, sum(c * c * c * c) AS s4, sum(c * c * e) AS qe FROM res GROUP BY 1, 2, 3),
f AS (SELECT *, qe * qe / (s4 - s2 * s2 / n - s3 * s3 / s2) AS gain FROM q), g AS (SELECT *, sqrt(gain / ((sse - gain) / (n - 3))) AS t FROM f)
SELECT {_HEAD}, {sr('sse', 6)} AS rss, {sr(sql_t_two_sided('t', '(n - 3)'), 8)} AS quadratic_p FROM g""")
def ols_lack_of_fit(spark, sf):
    return growth_lines(spark, sf).select(*GROUP, rnd("rss", 6).alias("rss"), rnd("quadratic_p", 8).alias("quadratic_p"))


@query("growth_flags", LINES_SQL + f""", s AS (SELECT {_HEAD}, max(n) AS n, max(b) AS b, max(sxx) AS sxx, sum(e * e) AS rss, sum(c * c) AS s2, sum(c * c * c) AS s3,
    sum(c * c * c * c) AS s4, sum(c * c * e) AS qe FROM res GROUP BY 1, 2, 3),
f AS (SELECT *, qe * qe / (s4 - s2 * s2 / n - s3 * s3 / s2) AS gain, {sql_t975('(n - 2)')} AS tq FROM s), g AS (SELECT *, sqrt(gain / ((rss - gain) / (n - 3))) AS t FROM f)
SELECT {_HEAD}, concat_ws(';', CASE WHEN b - tq * sqrt(rss / (n - 2) / sxx) <= 0 THEN 'positive_growth_not_resolved_at_95pct' END,
  CASE WHEN {sql_t_two_sided('t', '(n - 3)')} < 0.05 THEN 'nonlinear_growth' END, CASE WHEN gly_pct = 10 THEN 'concentration_change' END) AS flags, len(gone)::BIGINT AS n_missing, array_to_string(gone, '|') AS missing
FROM g JOIN (SELECT "T_C", gly_pct, substrate, list_filter([10.0, 20.0, 30.0, 40.0, 60.0], lambda v: NOT list_contains(list(x), v)) AS gone FROM growth GROUP BY 1, 2, 3) USING ("T_C", gly_pct, substrate)""")
def growth_flags(spark, sf):
    """The concentration record drifts in the first composition; no time of 60 was measured."""
    g = growth(spark, sf).withColumn("c0", F.lit(50.0) + F.when(F.col("gly_pct") == 10, (F.col("disc") - 0.05) * 16).otherwise(0.0))
    return R.annotated_lines(g, GROUP, "t_min", "thickness_nm", concentration="c0", nominal=50.0, levels=(10.0, 20.0, 30.0, 40.0, 60.0)).select(*GROUP, "flags", "n_missing", "missing")


@query("drift_flag", f"""
WITH g AS (SELECT l_orderkey, 50 + (l_discount - 0.05) * 16 AS c0 FROM lineitem)
SELECT l_orderkey, {sr('(max(c0) - min(c0)) / avg(c0)', 9)} AS relative_range, count(*) FILTER (abs(c0 - 50) > 1e-8 + 0.02 * 50) AS n_off_nominal,
  (max(c0) - min(c0)) / avg(c0) > 0.02 OR bool_or(abs(c0 - 50) > 1e-8 + 0.02 * 50) AS concentration_change FROM g GROUP BY 1""")
def drift_flag(spark, sf):
    g = table(spark, sf, "lineitem").select("l_orderkey", ((F.col("l_discount") - 0.05) * 16 + 50).alias("c0"))
    return rounded(R.drift_flags(g, ["l_orderkey"], "c0", 50.0), {"relative_range": 9})


@query("calibration_pivot", CALIBRATION_SQL + f"""
SELECT "T_C", gly_pct, {sr('ks_glass * 1e9', 7)} AS ks_glass, {sr('ks_pdms * 1e9', 7)} AS ks_pdms, {sr('eta * 1e3', 8)} AS eta_mpa_s, {sr('"D" * 1e10', 8)} AS "D",
  {sr('k_end * 1e9', 7)} AS k_end, {sr('ks_effective * 1e9', 7)} AS ks_effective, 'OK' AS status FROM calib""")
def calibration_pivot(spark, sf):
    c = calibration(spark, sf)
    return c.select(*COND, rnd(F.col("ks_glass") * 1e9, 7).alias("ks_glass"), rnd(F.col("ks_pdms") * 1e9, 7).alias("ks_pdms"),
                    rnd(F.col("eta_Pa_s") * 1e3, 8).alias("eta_mpa_s"), rnd(F.col("D") * 1e10, 8).alias("D"),
                    rnd(F.col("k_end") * 1e9, 7).alias("k_end"), rnd(F.col("ks_effective") * 1e9, 7).alias("ks_effective"), "status")


# --- metrics ----------------------------------------------------------------------

def scored(spark, sf):
    """Predictions next to labels, with model family and condition."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("condition_id"),
        F.when(F.col("l_quantity") == 50, 0.0).otherwise(F.col("l_extendedprice") / 1000).alias("label"),
        (F.col("l_quantity") * 2.0 + F.col("l_tax")).alias("pred"))


SCORED_SQL = """WITH s AS (SELECT l_returnflag AS model, l_suppkey AS condition_id, CASE WHEN l_quantity = 50 THEN 0.0 ELSE l_extendedprice / 1000 END AS y,
  l_quantity * 2.0 + l_tax AS p FROM lineitem)"""
_METRIC_COLS = f"""count(*) AS n_measurements, {sr('1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*))', 8)} AS r2, {sr('sqrt(avg((p - y) * (p - y)))', 8)} AS rmse,
  {sr('avg(abs(p - y))', 8)} AS mae, {sr('max(abs(p - y))', 8)} AS max_abs_error, {sr('avg(abs(100 * (p - y) / y)) FILTER (abs(y) >= 1e-6)', 6)} AS mape_pct,
  {sr('avg(100 * (p - y) / y) FILTER (abs(y) >= 1e-6)', 6)} AS relative_bias_pct, {sr('stddev_samp(100 * (p - y) / y) FILTER (abs(y) >= 1e-6)', 6)} AS relative_1sigma_pct,
  count(*) FILTER (abs(y) >= 1e-6) AS n_relative"""
_DIGITS = {"r2": 8, "rmse": 8, "mae": 8, "max_abs_error": 8, "mape_pct": 6, "relative_bias_pct": 6, "relative_1sigma_pct": 6}


@query("regression_metrics", SCORED_SQL + f" SELECT {_METRIC_COLS} FROM s")
def regression_metrics(spark, sf):
    return rounded(X.regression_metrics(scored(spark, sf), "label", "pred"), _DIGITS)


@query("metrics_by_model", SCORED_SQL + f" SELECT model, {_METRIC_COLS} FROM s GROUP BY 1")
def metrics_by_model(spark, sf):
    return rounded(X.regression_metrics(scored(spark, sf), "label", "pred", ["model"]), _DIGITS)


@query("balanced_rmse", SCORED_SQL + f""", w AS (SELECT model, (p - y) * (p - y) AS e2, 1.0 / count(*) OVER (PARTITION BY model, condition_id) AS w, condition_id FROM s)
SELECT model, count(DISTINCT condition_id) AS n_conditions, {sr('sqrt(sum(w * e2) / sum(w))', 8)} AS condition_balanced_rmse FROM w GROUP BY 1""")
def balanced_rmse(spark, sf):
    return rounded(X.balanced_rmse(scored(spark, sf), "label", "pred", "condition_id", ["model"]), {"condition_balanced_rmse": 8})


_WEIGHTED = ", w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY condition_id) AS w FROM s), m AS (SELECT sum(w * y) / sum(w) AS my FROM w)"


@query("weighted_metrics", SCORED_SQL + _WEIGHTED + f"""
SELECT count(*) AS n_measurements, {sr('sqrt(sum(w * (p - y) * (p - y)) / sum(w))', 8)} AS rmse, {sr('sum(w * abs(p - y)) / sum(w)', 8)} AS mae,
  {sr('1 - sum(w * (p - y) * (p - y)) / sum(w * (y - my) * (y - my))', 8)} AS r2,
  {sr('100 * sum(w * abs((p - y) / y)) FILTER (abs(y) >= 1e-6) / sum(w) FILTER (abs(y) >= 1e-6)', 6)} AS mape_pct FROM w, m""")
def weighted_metrics(spark, sf):
    return rounded(X.weighted_metrics(scored(spark, sf), "label", "pred", "condition_id"), {"rmse": 8, "mae": 8, "r2": 8, "mape_pct": 6})


@query("condition_weights", f"""
WITH g AS (SELECT l_suppkey, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey) AS ng, count(*) OVER () AS n FROM lineitem),
t AS (SELECT count(DISTINCT l_suppkey) AS g FROM lineitem)
SELECT l_orderkey, l_linenumber, {sr('n / g / ng', 9)} AS weight FROM g, t""")
def condition_weights(spark, sf):
    w = X.condition_weights(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey")
    return w.select("l_orderkey", "l_linenumber", rnd("weight", 9).alias("weight"))
