"""The driver tables in the roles of the study tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..params import StudyParameters
from .registry import table

STUDY = StudyParameters(allow_flagged_growth=True)
COND = ["T_C", "gly_pct"]


def growth(spark, sf) -> DataFrame:
    """Line items as growth measurements: thickness over time per condition."""
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.when(flag == "A", 25.0).when(flag == "N", 45.0).otherwise(65.0).alias("T_C"),
        (F.col("l_linenumber") * F.lit(10.0)).alias("gly_pct"),
        F.when(F.col("l_linestatus") == "F", "glass").otherwise("pdms").alias("substrate"),
        F.col("l_quantity").alias("t_min"), (F.col("l_quantity") * 1.5 + F.col("l_extendedprice") / 5000 - F.col("l_linenumber") * 3).alias("thickness_nm"),
        (F.lit(0.5) + F.col("l_tax") * 100).alias("thickness_sd_nm"), F.col("l_suppkey").alias("specimen_id"),
        "l_orderkey", F.col("l_discount").alias("disc"))


GROWTH_SQL = """WITH growth AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 25.0::DOUBLE WHEN 'N' THEN 45.0 ELSE 65.0 END AS "T_C", l_linenumber * 10.0::DOUBLE AS gly_pct,
         CASE l_linestatus WHEN 'F' THEN 'glass' ELSE 'pdms' END AS substrate, l_quantity AS x, l_quantity * 1.5 + l_extendedprice / 5000 - l_linenumber * 3 AS y,
         0.5 + l_tax * 100 AS sd, l_suppkey AS cl, l_orderkey, l_discount AS disc FROM lineitem)"""

# Textbook line fit: slope, mean and residual sums by group, then a second pass.
LINES_SQL = GROWTH_SQL + """, fit AS (
  SELECT "T_C", gly_pct, substrate, count(*)::DOUBLE AS n, count(DISTINCT x) AS n_times, avg(x) AS mx, avg(y) AS my,
         regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, max(x) AS xmax
  FROM growth GROUP BY 1, 2, 3), res AS (
  SELECT g.*, f.n, f.n_times, f.a, f.b, f.mx, f.sxx, f.syy, f.xmax, g.y - f.a - f.b * g.x AS e, g.x - f.mx AS c
  FROM growth g JOIN fit f USING ("T_C", gly_pct, substrate))"""

def sql_t975(df: str) -> str:
    """Newton steps on the logarithms, over the Simpson sums of the density."""
    p, density = sql_t_two_sided("t", df, 600), f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * pow(1 + t * t / {df}, -({df} + 1) / 2)"
    start = "[2.0::DOUBLE, " + ", ".join(["0.0::DOUBLE"] * 12) + "]"
    return f"list_reduce({start}, lambda t, k: t * exp(ln(greatest(1e-12, {p}) / 0.05) * {p} / (2 * t * {density})))"


def sql_t_two_sided(t: str, df: str, steps: int = 2000) -> str:
    """Simpson integration of the density, independent of the series used in Spark."""
    f = (f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * "
         f"pow(1 + pow({t} * i / {steps}, 2) / {df}, -({df} + 1) / 2)")
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return (f"greatest(0, 1 - 2 * ({t} / {steps} / 3) * list_sum(list_transform(range(0, {steps} + 1), "
            f"lambda i: {weight} * {f})))")


def sql_mean_u(lo: str, hi: str, phi: str, bi: str) -> str:
    """Mean profile over [lo, hi] in the hyperbolic form."""
    top = (f"(sinh({phi} * (1 - ({lo}))) - sinh({phi} * (1 - ({hi}))) + ({bi}) / ({phi}) * "
           f"(cosh({phi} * (1 - ({lo}))) - cosh({phi} * (1 - ({hi})))))")
    return f"({top} / ({phi}) / (({hi}) - ({lo})) / (cosh({phi}) + ({bi}) / ({phi}) * sinh({phi})))"


def sql_u(x: str, phi: str, bi: str) -> str:
    return (f"((cosh({phi} * (1 - ({x}))) + ({bi}) / ({phi}) * sinh({phi} * (1 - ({x})))) / "
            f"(cosh({phi}) + ({bi}) / ({phi}) * sinh({phi})))")


def sql_uniform(seed: int, *keys: str) -> str:
    text = ", ".join([f"'{seed}'", *keys])
    return f"((('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


def sql_normal(seed: int, *keys: str) -> str:
    return (f"(sqrt(-2.0 * ln({sql_uniform(seed, *keys, chr(39) + 'a' + chr(39))})) * "
            f"cos(2 * pi() * {sql_uniform(seed, *keys, chr(39) + 'b' + chr(39))}))")


# Calibration per condition from the growth slopes and a viscosity column.
CALIBRATION_SQL = LINES_SQL + f""", visc AS (SELECT "T_C", gly_pct, 0.001 + avg(disc) / 100 AS eta FROM growth GROUP BY 1, 2),
cal AS (SELECT f."T_C", f.gly_pct, max(CASE WHEN substrate = 'glass' THEN b END) * 1e-9 / 60 / (50 * 1.45e-5) AS ks_glass,
  max(CASE WHEN substrate = 'pdms' THEN b END) * 1e-9 / 60 / (50 * 1.45e-5) AS ks_pdms, max(eta) AS eta FROM fit f JOIN visc v USING ("T_C", gly_pct) GROUP BY 1, 2),
calib AS (SELECT *, 6e-10 * (("T_C" + 273.15) / 298.15) * 0.00089 / eta AS "D", ks_pdms AS k_end,
  (3 * ks_pdms + ks_glass) / 4 AS ks_effective, (3 * ks_pdms + ks_glass) / 30e-6 AS sink FROM cal),
unit AS (SELECT *, sqrt(sink * 30e-6 * 30e-6 / "D") AS phi1, k_end * 30e-6 / "D" AS bi1 FROM calib)"""


def viscosity(spark, sf) -> DataFrame:
    return growth(spark, sf).groupBy(*COND).agg((F.avg("disc") / 100 + 0.001).alias("eta_Pa_s"))


def growth_lines(spark, sf, **options) -> DataFrame:
    from ..operators.regression import fit_lines
    return fit_lines(growth(spark, sf), [*COND, "substrate"], "t_min", "thickness_nm", **options)


def calibration(spark, sf) -> DataFrame:
    from ..operators.regression import calibration_table
    return calibration_table(growth_lines(spark, sf), viscosity(spark, sf), COND, STUDY)
