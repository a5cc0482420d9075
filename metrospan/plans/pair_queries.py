"""Pairing, theory scoring and condition-grid queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.errors import ratio_sd
from ..functions.transport import SlitParameters, da_at_coverage, profile, slit_coefficients
from ..operators import grid as G
from ..operators import pairs as P
from .growth import CALIBRATION_SQL, COND, STUDY, calibration, sql_mean_u, sql_u
from .registry import query, rnd, rounded, sr, table

STUDY2 = replace(STUDY, faces=2)


def observations(spark, sf):
    """Views and purchases of a user-day as top and bottom observations."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "purchase"))
    day = F.date_format("ts", "yyyy-MM-dd")
    top = F.col("pos") == "top"
    d = F.substring("day", 9, 2).cast("int")
    o = e.select(day.alias("day"), F.col("user_id").alias("specimen_id"), "value",
                 F.when(F.col("event_type") == "view", "top").otherwise("bot").alias("pos"),
                 (F.dayofweek("ts") - 1).alias("dow"))
    o = o.groupBy("day", "specimen_id", "pos", "dow").agg(F.avg("value").alias("v"))
    ar = F.when(d <= 7, 9.0).when(d <= 14, 13.0).when(d <= 21, 18.0).when(d <= 28, 25.0).otherwise(4.0)
    o = o.withColumn("AR", ar).withColumn("L_um", F.col("AR") * 30)
    return o.select(
        F.concat_ws("|", F.col("specimen_id").cast("string"), "day").alias("trench_id"), "specimen_id", F.col("day").alias("batch_id"), "pos",
        F.concat(F.lit("C"), F.col("dow").cast("string")).alias("condition_id"), "AR", "L_um",
        F.when(F.col("v") <= 200, F.when(top, F.col("v")).otherwise(F.col("v") - 3)).alias("label_nm"),
        (F.col("v") * 0.05).alias("label_sd_nm"),
        F.when(F.col("v") > 120, "training_reprediction").otherwise("cross_fitted").alias("prediction_role"),
        F.when(top, 34.0).otherwise(F.col("L_um") - 66).alias("observed_z_lo_um"),
        F.when(top, 66.0).otherwise(F.col("L_um") - 34).alias("observed_z_hi_um"),
        (F.lit(25.0) + 20 * (F.col("dow") % 3)).alias("T_C"), (F.lit(10.0) * (F.col("dow") + 1)).alias("gly_pct"))


def pairs(spark, sf):
    return P.pair_ratio(observations(spark, sf), "trench_id", "pos", "label_nm",
                        ["condition_id", "specimen_id", "batch_id", "AR", "L_um", "T_C", "gly_pct"],
                        min_top=STUDY.min_top_nm, sd="label_sd_nm")


OBS_SQL = """WITH o AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, CASE event_type WHEN 'view' THEN 'top' ELSE 'bot' END AS pos, dayofweek(ts) AS dow, avg(value) AS v
  FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL),
p AS (SELECT user_id || '|' || day AS trench_id, user_id AS specimen_id, day AS batch_id, 'C' || max(dow) AS condition_id, max(dow) AS dow,
  CASE WHEN right(day, 2)::INT <= 7 THEN 9.0::DOUBLE WHEN right(day, 2)::INT <= 14 THEN 13 WHEN right(day, 2)::INT <= 21 THEN 18 WHEN right(day, 2)::INT <= 28 THEN 25 ELSE 4 END AS ar,
  max(v) FILTER (pos = 'top') AS vt, max(v) FILTER (pos = 'bot') AS vb FROM o GROUP BY user_id, day),
r AS (SELECT *, CASE WHEN vt <= 200 THEN vt END AS a, CASE WHEN vb <= 200 THEN vb - 3 END AS b FROM p),
s AS (SELECT *, CASE WHEN vt IS NULL OR vb IS NULL THEN 'missing_top_or_bot' WHEN (vt > 120) <> (vb > 120) THEN 'mixed_prediction_roles'
  WHEN 66 >= ar * 30 - 66 THEN 'overlapping_observation_windows' WHEN a IS NULL OR b IS NULL THEN 'missing_thickness'
  WHEN a < 1 THEN 'top_below_denominator_threshold' WHEN b < 0 THEN 'negative_bot_thickness' ELSE '' END AS reason FROM r),
q AS (SELECT *, CASE WHEN reason = '' THEN b / a END AS sc, CASE WHEN reason = '' THEN sqrt(pow(0.05 * vb / a, 2) + pow(b * 0.05 * vt / (a * a), 2)) END AS sd FROM s)"""


@query("pair_ratio", OBS_SQL + f"""
SELECT trench_id, specimen_id, condition_id, ar AS "AR", CASE WHEN reason = '' THEN 'PASS' ELSE 'EXCLUDED' END AS status, reason, {sr('sc', 8)} AS "SC", {sr('sd', 8)} AS "SC_sd",
  CASE WHEN reason = '' THEN 'AVAILABLE' ELSE 'NOT_EVALUATED' END AS uncertainty_status FROM q""")
def pair_ratio(spark, sf):
    t = pairs(spark, sf).select("trench_id", "specimen_id", "condition_id", "AR", "status", "reason", "SC", "SC_sd", "uncertainty_status")
    return rounded(t, {"SC": 8, "SC_sd": 8})


@query("pair_summary", OBS_SQL + f"""
SELECT condition_id, ar AS "AR", count(*) AS n_available, count(sc) AS n_valid, count(*) - count(sc) AS n_excluded, count(DISTINCT specimen_id) FILTER (sc IS NOT NULL) AS n_specimens,
  count(DISTINCT batch_id) FILTER (sc IS NOT NULL) AS n_batches, {sr('avg(sc)', 7)} AS "SC_mean", {sr('stddev_samp(sc)', 7)} AS "SC_between_trench_sd" FROM q GROUP BY 1, 2""")
def pair_summary(spark, sf):
    return rounded(P.pair_summary(pairs(spark, sf), ["condition_id", "AR"], "specimen_id", "batch_id"),
                   {"SC_mean": 7, "SC_between_trench_sd": 7})


@query("ratio_sd", f"""
WITH t AS (SELECT event_id, value + 1 AS a, value * 0.7 AS b, 0.02 * value AS sa, 0.1 + 0.03 * value AS sb, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'error' THEN -0.4
  WHEN 'signup' THEN 2.0 ELSE 0.0 END AS rho FROM events)
SELECT event_id, CASE WHEN rho <= 1 THEN {sr('sqrt(greatest(0, pow(sb / a, 2) + pow(b * sa / (a * a), 2) - 2 * rho * b * sa * sb / pow(a, 3)))', 8)} END AS sd FROM t""")
def ratio_sd_query(spark, sf):
    v, kind = F.col("value"), F.col("event_type")
    rho = (F.when(kind == "view", 1.0).when(kind == "click", 0.5).when(kind == "error", -0.4).when(kind == "signup", 2.0).otherwise(0.0))
    e = table(spark, sf, "events").withColumns({"a": v + 1, "b": v * 0.7, "sa": 0.02 * v, "sb": 0.1 + 0.03 * v, "rho": rho})
    return e.select("event_id", rnd(ratio_sd("a", "b", "sa", "sb", "rho"), 8).alias("sd"))


_SCORED = OBS_SQL + ", " + CALIBRATION_SQL.removeprefix("WITH ") + f""",
x0 AS (SELECT q.*, phi1, bi1, CASE WHEN reason <> '' THEN 'not_a_passing_pair' WHEN vt > 120 THEN 'role_not_scorable' WHEN specimen_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN 'calibration_shares_id' WHEN phi1 IS NULL THEN 'calibration_missing' ELSE 'SCORED' END AS score_status
  FROM q LEFT JOIN unit ON "T_C" = CASE WHEN dow = 6 THEN 99 ELSE 25 + 20 * (dow % 3) END AND gly_pct = 10 * (dow + 1)),
x AS (SELECT trench_id, condition_id, ar, sc, score_status, CASE WHEN score_status = 'SCORED' THEN phi1 * ar END AS phi, bi1 * ar AS bi, ar * 30 AS len, CASE WHEN ar = 9 THEN ar * 30 - 40 ELSE ar * 30 - 34 END AS bhi FROM x0),
y AS (SELECT * REPLACE (CASE WHEN phi IS NOT NULL THEN bi END AS bi), {sql_mean_u('(len - 66) / len', 'bhi / len', 'phi', 'bi')} / {sql_mean_u('34 / len', '66 / len', 'phi', 'bi')} AS model, {sql_u('1', 'phi', 'bi')} AS endpoint FROM x)"""


def scored_pairs(spark, sf):
    length = F.col("L_um")

    def interval(lo, hi):
        return F.struct(F.lit(lo).cast("double").alias("lo") if isinstance(lo, float) else lo.alias("lo"),
                        F.lit(hi).cast("double").alias("hi") if isinstance(hi, float) else hi.alias("hi"))

    t = pairs(spark, sf)  # condition C6 has no calibration, some roles are not scorable
    t = t.withColumns({
        "T_C": F.when(F.col("condition_id") == "C6", 99.0).otherwise(F.col("T_C")),
        "w_um": F.lit(30.0), "h_um": F.lit(30.0), "faces": F.lit(4), "prediction_role": F.col("top_prediction_role"),
        **{f"{side}_material": F.lit(m) for side, m in zip(("left", "right", "floor", "ceiling"), STUDY.wall_materials)},
        "top_intervals": F.array(interval(34.0, 50.0), interval(50.0, 66.0)),
        "bot_intervals": F.when(F.col("AR") == 9, F.array(interval(length - 66, length - 40))).otherwise(
            F.array(interval(length - 66, length - 50), interval(length - 50, length - 34)))})
    used = table(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"))
    return P.theory_scores(t, calibration(spark, sf), COND, used, ["specimen_id"])


@query("theory_scores", _SCORED + f"""
SELECT trench_id, score_status, {sr('sc', 8)} AS "SC", {sr('model', 8)} AS "SC_model", {sr('phi', 8)} AS phi, {sr('bi', 8)} AS "Bi_end", {sr('endpoint', 8)} AS "SC_endpoint",
  {sr('100 * (endpoint - model) / model', 6)} AS endpoint_relative_error_pct FROM y""")
def theory_scores(spark, sf):
    t = scored_pairs(spark, sf).select("trench_id", "score_status", "SC", "SC_model", "phi", "Bi_end", "SC_endpoint", "endpoint_relative_error_pct")
    return rounded(t, {"SC": 8, "SC_model": 8, "phi": 8, "Bi_end": 8, "SC_endpoint": 8, "endpoint_relative_error_pct": 6})


_POINTS = _SCORED + ", pts AS (SELECT condition_id, ar, avg(sc) AS m, avg(model) AS t, avg(phi) AS phi, count(*) AS n FROM y WHERE score_status = 'SCORED' GROUP BY 1, 2)"


@query("theory_points", _POINTS + f"""
SELECT condition_id, ar AS "AR", {sr('m', 7)} AS "SC_measured", {sr('t', 8)} AS "SC_model", {sr('phi', 8)} AS phi, n AS n_trenches FROM pts""")
def theory_points(spark, sf):
    return rounded(P.theory_points(scored_pairs(spark, sf), ["condition_id", "AR"]), {"SC_measured": 7, "SC_model": 8, "phi": 8})


@query("theory_report", _POINTS + f"""
SELECT count(*) AS n_points, count(DISTINCT condition_id) AS n_conditions, CAST(sum(n) AS BIGINT) AS n_trenches,
  {sr('1 - sum((m - t) * (m - t)) / (count(*) * var_pop(m))', 7)} AS fixed_theory_r2, {sr('sqrt(avg((m - t) * (m - t)))', 7)} AS rmse_fraction FROM pts""")
def theory_report(spark, sf):
    r = P.theory_report(P.theory_points(scored_pairs(spark, sf), ["condition_id", "AR"]), "condition_id")
    return rounded(r, {"fixed_theory_r2": 7, "rmse_fraction": 7})


@query("interval_logmean", f"""
WITH i AS (SELECT user_id, hour(ts) * 10.0 AS lo, hour(ts) * 10.0 + 1 + value / 100 AS hi, 1.0 + (user_id % 5) AS phi, 0.3 AS bi FROM events),
m AS (SELECT user_id, hi - lo AS len, {sql_mean_u('lo / 300', 'hi / 300', 'phi', 'bi')} AS u FROM i)
SELECT user_id, count(*) AS n_intervals, {sr('sum(len)', 6)} AS length_um, {sr('ln(sum(len * u) / sum(len))', 8)} AS log_mean FROM m GROUP BY 1""")
def interval_logmean(spark, sf):
    lo = F.hour("ts") * F.lit(10.0)
    e = table(spark, sf, "events").select(
        "user_id", lo.alias("lo"), (lo + 1 + F.col("value") / 100).alias("hi"), F.lit(300.0).alias("length"),
        (F.lit(1.0) + F.col("user_id") % 5).alias("phi"), F.lit(0.3).alias("bi"))
    return rounded(P.interval_log_mean_rows(e, ["user_id"], "lo", "hi", "length", "phi", "bi"), {"length_um": 6, "log_mean": 8})


@query("interval_gaps", f"""
WITH d AS (SELECT DISTINCT conv_id, turn * 1.0 AS lo, turn + CASE role WHEN 'system' THEN 0.5 WHEN 'assistant' THEN 1.25 ELSE 1.0 END AS hi FROM conversations),
n AS (SELECT *, lead(lo) OVER (PARTITION BY conv_id ORDER BY lo, hi) - hi AS gap FROM d)
SELECT conv_id, count(*) AS n_intervals, count(*) FILTER (abs(gap) > 1e-8) AS n_gaps, {sr('max(abs(gap))', 6)}::DOUBLE AS max_gap FROM n GROUP BY 1""")
def interval_gaps(spark, sf):
    t = table(spark, sf, "conversations").select(
        "conv_id", (F.col("turn") * F.lit(1.0)).alias("lo"),
        (F.col("turn") + F.when(F.col("role") == "system", 0.5).when(F.col("role") == "assistant", 1.25).otherwise(1.0)).alias("hi"))
    return rounded(P.interval_gaps(t, "conv_id", "lo", "hi"), {"max_gap": 6})


# --- grids --------------------------------------------------------------------------

@query("grid_complete", """
WITH c AS (SELECT p_type, p_size, count(*) AS n, min(CASE WHEN p_retailprice < 900.5 THEN 0.0 ELSE p_retailprice - 901 END) AS v FROM part GROUP BY 1, 2)
SELECT count(DISTINCT p_type) AS n_t, count(DISTINCT p_size) AS n_g, count(*) AS n_cells, count(*) FILTER (n > 1) AS n_repeated, count(*) FILTER (v = 0) AS zero_v,
  count(*) FILTER (v < 0) AS negative_v, count(DISTINCT p_type) * count(DISTINCT p_size) - count(*) AS n_missing FROM c""")
def grid_complete(spark, sf):
    p = F.col("p_retailprice")
    t = table(spark, sf, "part").withColumn("v", F.when(p < 900.5, 0.0).otherwise(p - 901))
    return G.grid_completeness(t, "p_type", "p_size", ["v"])


@query("grid_missing_cells", """
SELECT p_type, p_size FROM (SELECT DISTINCT p_type FROM part) CROSS JOIN (SELECT DISTINCT p_size FROM part)
WHERE (p_type, p_size) NOT IN (SELECT p_type, p_size FROM part)""")
def grid_missing_cells(spark, sf):
    return G.missing_cells(table(spark, sf, "part"), "p_type", "p_size")


@query("factorial_grid", f"""
WITH b AS (SELECT p_brand, min(p_retailprice) AS p0, max(p_retailprice) AS p1, min(p_size)::DOUBLE AS s0, max(p_size)::DOUBLE AS s1 FROM part GROUP BY 1)
SELECT p_brand, {sr('p0 + (p1 - p0) * i / 3', 7)} AS price, {sr('s0 + (s1 - s0) * j / 3', 7)} AS size FROM b, range(4) a(i), range(4) c(j)""")
def factorial_grid(spark, sf):
    b = table(spark, sf, "part").groupBy("p_brand").agg(
        F.min("p_retailprice").alias("p0"), F.max("p_retailprice").alias("p1"), F.min("p_size").cast("double").alias("s0"), F.max("p_size").cast("double").alias("s1"))
    return rounded(G.factorial_grid(b, {"price": ("p0", "p1"), "size": ("s0", "s1")}, 4).select("p_brand", "price", "size"), {"price": 7, "size": 7})


_CELL = """, e0 AS (SELECT DISTINCT "T_C" AS t0 FROM unit), et AS (SELECT t0, lead(t0) OVER (ORDER BY t0) AS t1, lead(t0, 2) OVER (ORDER BY t0) IS NULL AS lt FROM e0),
f0 AS (SELECT DISTINCT gly_pct AS g0 FROM unit), eg AS (SELECT g0, lead(g0) OVER (ORDER BY g0) AS g1, lead(g0, 2) OVER (ORDER BY g0) IS NULL AS lg FROM f0)"""


def _sql_interp(col: str, axis: str, zero: bool = False) -> str:
    w = ('((1 / (p.t + 273.15) - 1 / (t0 + 273.15)) / (1 / (t1 + 273.15) - 1 / (t0 + 273.15)))' if axis == "k" else "((p.t - t0) / (t1 - t0))")
    wg = "((p.g - g0) / (g1 - g0))"
    ln = (lambda v: f"ln(nullif({v}, 0))") if zero else (lambda v: f"ln({v})")
    return (f"exp((1 - {w}) * ((1 - {wg}) * {ln('a.' + col)} + {wg} * {ln('b.' + col)}) + {w} * ((1 - {wg}) * {ln('c.' + col)} + {wg} * {ln('d.' + col)}))")


_CORNERS = """ FROM pts p JOIN et ON t1 IS NOT NULL AND p.t >= t0 AND (p.t < t1 OR (lt AND p.t <= t1)) JOIN eg ON g1 IS NOT NULL AND p.g >= g0 AND (p.g < g1 OR (lg AND p.g <= g1))
  JOIN unit a ON a."T_C" = t0 AND a.gly_pct = g0 JOIN unit b ON b."T_C" = t0 AND b.gly_pct = g1 JOIN unit c ON c."T_C" = t1 AND c.gly_pct = g0 JOIN unit d ON d."T_C" = t1 AND d.gly_pct = g1"""


_HOLED = """, whole AS (SELECT * FROM unit), holed AS (SELECT * REPLACE (CASE WHEN "T_C" = 65 AND gly_pct = 70 THEN 0.0::DOUBLE ELSE ks_pdms END AS ks_pdms) FROM whole
  WHERE NOT ("T_C" = 45 AND gly_pct = 40))"""


def holed_calibration(spark, sf):
    """The calibration without one inner condition and with one rate of zero."""
    cal = calibration(spark, sf).where("not (T_C = 45 and gly_pct = 40)")
    return cal.withColumn("ks_pdms", F.when((F.col("T_C") == 65) & (F.col("gly_pct") == 70), 0.0).otherwise(F.col("ks_pdms")))


@query("grid_interpolate", CALIBRATION_SQL + _CELL + _HOLED + """, pts AS (SELECT o_orderkey, 20 + 50 * o_totalprice / 500000 AS t, 10 + 0.04 * (o_custkey % 1600) AS g FROM orders),
  hit AS (SELECT o_orderkey, CASE WHEN a.eta IS NULL OR b.eta IS NULL OR c.eta IS NULL OR d.eta IS NULL THEN 'missing_corner' WHEN least(a.ks_pdms, b.ks_pdms, c.ks_pdms, d.ks_pdms) = 0 THEN 'zero_beside_positive' ELSE 'ok' END AS s, """
  + f"CASE WHEN s = 'ok' THEN {_sql_interp('ks_pdms', 'k', True)} END AS k, CASE WHEN s = 'ok' THEN {_sql_interp('eta', 't')} END AS eta" + _CORNERS.replace(" JOIN unit ", " LEFT JOIN holed ") + f""")
SELECT o.o_orderkey, s IS NOT NULL AS in_domain, coalesce(s, 'outside_domain') AS grid_status, {sr('k * 1e9', 7)} AS ks_pdms, {sr('eta * 1e3', 8)} AS "eta_Pa_s" FROM pts o LEFT JOIN hit USING (o_orderkey)""")
def grid_interpolate(spark, sf):
    pts = table(spark, sf, "orders").select(
        "o_orderkey", (F.lit(20.0) + 50 * F.col("o_totalprice") / 500000).alias("T_C"), (F.lit(10.0) + 0.04 * (F.col("o_custkey") % 1600)).alias("gly_pct"))
    t = G.interpolate(pts, holed_calibration(spark, sf), "T_C", "gly_pct", ["ks_pdms", "eta_Pa_s"])
    return t.select("o_orderkey", "in_domain", "grid_status", rnd(F.col("ks_pdms") * 1e9, 7).alias("ks_pdms"), rnd(F.col("eta_Pa_s") * 1e3, 8).alias("eta_Pa_s"))


def _bisect(source: str, key: str, phi: str, bi: str, target: float) -> str:
    """Recursive halving of the end-point curve on [0, 2000]."""
    return f"""bis AS (SELECT {key}, {phi} AS p1, {bi} AS b1, 0.0::DOUBLE AS lo, 2000.0::DOUBLE AS hi, 0 AS it FROM {source}
  UNION ALL SELECT {key}, p1, b1, CASE WHEN u > {target} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN u > {target} THEN hi ELSE (lo + hi) / 2 END, it + 1
  FROM (SELECT *, {sql_u('1', '(p1 * (lo + hi) / 2)', '(b1 * (lo + hi) / 2)')} AS u FROM bis WHERE it < 75))"""


_PROCESS = CALIBRATION_SQL.replace("WITH growth", "WITH RECURSIVE growth", 1) + _CELL + """,
pts AS (SELECT CASE WHEN i = 15 THEN t1 ELSE t0 + (t1 - t0) * i / 15 END AS t, CASE WHEN j = 20 THEN g1 ELSE g0 + (g1 - g0) * j / 20 END AS g
  FROM (SELECT min("T_C") AS t0, max("T_C") AS t1, min(gly_pct) AS g0, max(gly_pct) AS g1 FROM unit), range(16) a(i), range(21) b(j)),
hit AS (SELECT p.t, p.g, """ + f"{_sql_interp('ks_pdms', 'k')} AS kp, {_sql_interp('ks_glass', 'k')} AS kg, {_sql_interp('eta', 't')} AS eta" + _CORNERS + """),
prop AS (SELECT *, 6e-10 * ((t + 273.15) / 298.15) * 0.00089 / eta AS d FROM hit),
pu AS (SELECT *, sqrt((3 * kp + kg) / 30e-6 * 30e-6 * 30e-6 / d) AS phi1, kp * 30e-6 / d AS bi1 FROM prop),
""" + _bisect("pu", "t, g", "phi1", "bi1", 0.9) + f""", lim AS (SELECT t, g, (lo + hi) / 2 AS ar FROM bis WHERE it = 75),
grid AS (SELECT t, g, kp, kg, eta, d, {sql_u('1', '(49 * phi1)', '(49 * bi1)')} AS sc, pow(49 * phi1, 2) AS da, ar FROM pu JOIN lim USING (t, g))"""


@query("process_grid", _PROCESS + f"""
SELECT {sr('t', 8)} AS "T_C", {sr('g', 8)} AS gly_pct, {sr('kp * 1e9', 7)} AS ks_pdms, {sr('kg * 1e9', 7)} AS ks_glass, {sr('sc', 8)} AS "SC_AR49", {sr('da', 7)} AS "Da_AR49",
  {sr('ar', 7)} AS "AR_max", 'root' AS "AR_max_status" FROM grid""")
def process_grid(spark, sf):
    g = G.process_grid(calibration(spark, sf), STUDY)
    return g.select(rnd("T_C", 8).alias("T_C"), rnd("gly_pct", 8).alias("gly_pct"), rnd(F.col("ks_pdms") * 1e9, 7).alias("ks_pdms"),
                    rnd(F.col("ks_glass") * 1e9, 7).alias("ks_glass"), rnd("SC_AR49", 8).alias("SC_AR49"), rnd("Da_AR49", 7).alias("Da_AR49"),
                    rnd("AR_max", 7).alias("AR_max"), "AR_max_status")


@query("process_grid_gaps", CALIBRATION_SQL + _CELL + _HOLED + """,
pts AS (SELECT CASE WHEN i = 15 THEN t1 ELSE t0 + (t1 - t0) * i / 15 END AS t, CASE WHEN j = 20 THEN g1 ELSE g0 + (g1 - g0) * j / 20 END AS g
  FROM (SELECT min("T_C") AS t0, max("T_C") AS t1, min(gly_pct) AS g0, max(gly_pct) AS g1 FROM holed), range(16) a(i), range(21) b(j)),
hit AS (SELECT p.t, p.g, CASE WHEN a.eta IS NULL OR b.eta IS NULL OR c.eta IS NULL OR d.eta IS NULL THEN 'missing_corner'
  WHEN least(a.ks_pdms, b.ks_pdms, c.ks_pdms, d.ks_pdms) = 0 THEN 'zero_beside_positive' ELSE 'root' END AS s """ + _CORNERS.replace(" JOIN unit ", " LEFT JOIN holed ") + f""")
SELECT {sr('t', 8)} AS "T_C", {sr('g', 8)} AS gly_pct, s AS "AR_max_status", s = 'root' AS evaluated FROM hit""")
def process_grid_gaps(spark, sf):
    g = G.process_grid(holed_calibration(spark, sf), STUDY)
    return g.select(rnd("T_C", 8).alias("T_C"), rnd("gly_pct", 8).alias("gly_pct"), "AR_max_status",
                    (F.col("SC_AR49").isNotNull() & F.col("AR_max").isNotNull()).alias("evaluated"))


@query("grid_summary", _PROCESS + f"""
SELECT count(*) AS n_grid, CASE WHEN min(sc) < 0.3 AND max(sc) > 0.3 THEN 'boundary_in_domain' ELSE 'no_boundary_in_assumed_domain' END AS boundary_status,
  count(*) FILTER (sc >= 0.3) AS n_at_or_above_target, {sr('min(sc)', 8)} AS sc_min, {sr('max(sc)', 8)} AS sc_max, {sr('min(ar)', 7)} AS ar_min, {sr('max(ar)', 7)} AS ar_max FROM grid""")
def grid_summary(spark, sf):
    s = G.grid_summary(G.process_grid(calibration(spark, sf), STUDY), 0.3)
    return rounded(s, {"sc_min": 8, "sc_max": 8, "ar_min": 7, "ar_max": 7})


@query("design_grid", CALIBRATION_SQL + f""", x AS (SELECT "T_C", gly_pct, ar, phi1 * ar AS phi, bi1 * ar AS bi, ar * 30e-6 AS len FROM unit, unnest([9.0, 13.0, 18.0, 25.0, 35.0, 49.0]) v(ar)),
y AS (SELECT *, {sql_u('1', 'phi', 'bi')} AS ep, {sql_mean_u('1 - 66e-6 / len', '1 - 34e-6 / len', 'phi', 'bi')} / {sql_mean_u('34e-6 / len', '66e-6 / len', 'phi', 'bi')} AS win FROM x)
SELECT "T_C", gly_pct, ar::DOUBLE AS "AR", {sr('phi', 8)} AS phi, {sr('phi * phi', 7)} AS "Da", {sr('bi', 8)} AS "Bi_end", {sr('ep', 8)} AS "SC_endpoint", {sr('win', 8)} AS "SC_observed",
  {sr('100 * (ep - win) / win', 6)} AS endpoint_relative_error_pct FROM y""")
def design_grid(spark, sf):
    t = G.design_grid(calibration(spark, sf), STUDY).select(
        *COND, "AR", "phi", "Da", "Bi_end", "SC_endpoint", "SC_observed", "endpoint_relative_error_pct")
    return rounded(t, {"phi": 8, "Da": 7, "Bi_end": 8, "SC_endpoint": 8, "SC_observed": 8, "endpoint_relative_error_pct": 6})


def _partial_calibration(spark, sf):
    """The two-wall study: glass was not measured at 45 C."""
    from ..operators.regression import calibration_table
    from .growth import growth_lines, viscosity
    lines = growth_lines(spark, sf).where(~((F.col("T_C") == 45) & (F.col("substrate") == "glass")))
    return calibration_table(lines, viscosity(spark, sf), COND, STUDY2)


_PARTIAL = CALIBRATION_SQL.replace("WITH growth", "WITH RECURSIVE growth", 1) + """, part_cal AS (SELECT "T_C", gly_pct, ks_pdms AS kp, CASE WHEN "T_C" <> 45 THEN ks_glass END AS kg, "D" AS d FROM calib),
geo AS (SELECT *, h * 1e-6 AS hm, 30e-6 AS wm FROM part_cal, unnest([30.0, 50.0]) a(h), unnest([2, 4]) b(faces)),
gs AS (SELECT *, (2 * hm * kp + CASE WHEN faces = 4 THEN wm * kg + wm * kp ELSE 0 END) / (wm * hm) AS sink FROM geo)"""


@query("scenario_status", _PARTIAL + f""", s AS (SELECT *, sqrt(sink * 900e-12 / d) * ar AS phi, kp * ratio * 30e-6 / d * ar AS bi FROM gs, unnest([0.0, 1.0, 3.0]) c(ratio), unnest([1.0, 9.0, 49.0]) e(ar))
SELECT "T_C", gly_pct, h::DOUBLE AS h_um, faces, ratio::DOUBLE AS rate_ratio, ar::DOUBLE AS "AR", CASE WHEN phi IS NULL THEN 'NOT_EVALUATED' ELSE 'EVALUATED' END AS status,
  CASE WHEN phi IS NULL THEN 'glass' ELSE '' END AS missing_substrates, {sr('phi * phi', 7)} AS "Da", {sr('CASE WHEN phi IS NOT NULL THEN bi END', 8)} AS "Bi_end", {sr(sql_u('1', 'phi', 'bi'), 8)} AS "SC_endpoint" FROM s""")
def scenario_status(spark, sf):
    t = G.scenario_table(_partial_calibration(spark, sf), STUDY2, COND)
    return rounded(t, {"Da": 7, "Bi_end": 8, "SC_endpoint": 8})


@query("depth_limits", _PARTIAL + ", pu AS (SELECT *, sqrt(sink * 900e-12 / d) AS phi1, kp * 30e-6 / d AS bi1 FROM gs), "
       + _bisect("pu", '"T_C", gly_pct, faces, h', "phi1", "bi1", 0.01) + f"""
SELECT "T_C", gly_pct, faces, h::DOUBLE AS h_um, CASE WHEN p1 IS NULL THEN 'glass' ELSE '' END AS missing_substrates, {sr('CASE WHEN p1 IS NOT NULL THEN (lo + hi) / 2 * 30 END', 6)} AS depth_um,
  CASE WHEN p1 IS NULL THEN 'NOT_EVALUATED' ELSE 'root' END AS status FROM bis WHERE it = 75""")
def depth_limits(spark, sf):
    return rounded(G.depth_scenarios(_partial_calibration(spark, sf), STUDY2, COND), {"depth_um": 6})


@query("threshold_crossing", f"""
WITH h AS (SELECT l_suppkey, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_suppkey, x, 1 - sum(n) OVER (PARTITION BY l_suppkey ORDER BY x) / sum(n) OVER (PARTITION BY l_suppkey) AS y FROM h),
l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, row_number() OVER w AS r FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY x)),
f AS (SELECT l_suppkey, max(y) FILTER (r = 1) AS y0, max(x) FILTER (r = 1) AS x0, min(x) FILTER (y <= 0.98 AND py > 0.98) AS xh FROM l GROUP BY 1)
SELECT f.l_suppkey, CASE WHEN y0 < 0.98 THEN 'below_target_at_lower_bound' WHEN y0 = 0.98 THEN 'root' WHEN xh IS NULL THEN 'no_boundary_within_domain' ELSE 'root' END AS status,
  {sr('CASE WHEN y0 = 0.98 THEN x0 WHEN y0 > 0.98 THEN px + (py - 0.98) / (py - y) * (x - px) END', 7)} AS value FROM f LEFT JOIN l ON l.l_suppkey = f.l_suppkey AND l.x = f.xh""")
def threshold_crossing(spark, sf):
    from pyspark.sql import Window as W
    h = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_quantity").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("l_suppkey")
    c = h.withColumn("y", 1 - F.sum("n").over(w.orderBy("x")) / F.sum("n").over(w))
    return rounded(G.threshold_crossing(c, ["l_suppkey"], "x", "y", 0.98), {"value": 7})


@query("ladder_ratios", f"""
WITH d AS (SELECT DISTINCT p_size FROM part), l AS (SELECT p_size, lag(p_size) OVER (ORDER BY p_size) AS previous FROM d)
SELECT p_size, previous, {sr('p_size::DOUBLE / previous', 9)} AS ratio FROM l WHERE previous IS NOT NULL""")
def ladder_ratios(spark, sf):
    return rounded(G.ladder_ratios(table(spark, sf, "part"), "p_size"), {"ratio": 9})


@query("condition_scores", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity * 30e-6 AS len, 1 + l_discount * 20 AS eta, 20 + l_tax * 500 AS t FROM lineitem),
c AS (SELECT *, 6e-10 * ((t + 273.15) / 298.15) * (0.89 / eta) AS d, 2e-8 * exp(40000 / 8.31446261815324 * (1 / 298.15 - 1 / (t + 273.15))) AS k FROM t),
e AS (SELECT *, sqrt(2 * k / 30e-6 * len * len / d) AS phi, k * len / d AS bi FROM c)
SELECT l_orderkey, l_linenumber, {sr('phi * phi', 7)} AS da, {sr('bi', 8)} AS bottom_biot, {sr(sql_u('1', 'phi', 'bi'), 8)} AS sc_proxy FROM e""")
def condition_scores(spark, sf):
    t = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("ar"), (F.col("l_discount") * 20 + 1).alias("eta"), (F.col("l_tax") * 500 + 20).alias("t"))
    t = t.withColumns({k: F.expr(v) for k, v in slit_coefficients("ar", "eta", "t", SlitParameters()).items()})
    return t.select("l_orderkey", "l_linenumber", rnd("da", 7).alias("da"), rnd("bottom_biot", 8).alias("bottom_biot"),
                    rnd(F.expr(profile(1.0, "da", "bottom_biot")), 8).alias("sc_proxy"))


@query("da_at_sc", f"""
WITH t AS (SELECT event_id, value / 100 AS sc FROM events) SELECT event_id, {sr('CASE WHEN sc > 0 AND sc <= 1 THEN pow(ln(1 / sc + sqrt(1 / (sc * sc) - 1)), 2) END', 7)} AS da FROM t""")
def da_at_sc(spark, sf):
    return table(spark, sf, "events").select("event_id", rnd(F.expr(da_at_coverage("value / 100")), 7).alias("da"))
