"""Grouped straight-line regression with three kinds of uncertainty.

Pass 1 finds means and slope with Spark's mergeable moment aggregates; pass 2
sums residual terms about those means.  Both combine on the map side, so a hot
group only ever shuffles one partial row per task.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.student import t_quantile_975, t_two_sided_p
from ..session import durable, stored
from .contracts import flags_text

OLS, CLUSTERED = "OLS independent specimen", "cluster robust specimen"


def line_moments(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pass 1: one row per group with slope and intercept."""
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(x).alias("n_times"),
        F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_cxy"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"),
        F.min(y).alias("y_min"), F.max(y).alias("y_max"), F.max(F.abs(F.col(y))).alias("_y_abs"))
    slope = F.when(F.col("n_times") >= 3, F.col("_cxy") / F.col("_vx"))
    return (agg.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
            .withColumn("sxx", F.col("n") * F.col("_vx")).withColumn("syy", F.col("n") * F.col("_vy"))
            .drop("_vx", "_vy", "_cxy"))


def residual_sums(df: DataFrame, moments: DataFrame, by: list[str], x: str, y: str,
                  cluster: str | None = None, known_sd: str | None = None) -> DataFrame:
    """Pass 2: residual, curvature, cluster and known-error sums per group."""
    centre = moments.select(*by, "mx", "my", "slope", "x_max")
    rows = df.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"),
                     *([F.col(cluster).alias("_cluster")] if cluster else []),
                     *([F.col(known_sd).alias("_sd")] if known_sd else []))
    rows = rows.join(centre, by)
    xc = F.col("_x") - F.col("mx")
    e = (F.col("_y") - F.col("my")) - F.col("slope") * xc
    rows = rows.withColumn("_xc", xc).withColumn("_e", e)
    c, r, q = F.col("_xc"), F.col("_e"), F.col("_xc") * F.col("_xc")
    at_end = F.col("_x") == F.col("x_max")
    terms = {
        "rss": r * r, "_q": q, "_q2": q * q, "_q3": q * c, "_qe": q * r,
        "_end_sum": F.when(at_end, F.col("_y")), "_end_n": F.when(at_end, 1.0),
    }
    if known_sd:
        v = F.col("_sd") * F.col("_sd")
        terms |= {"_k0": v, "_k1": v * c, "_k2": v * q}
    sums = [F.sum(t).alias(k) for k, t in terms.items()]
    if known_sd:
        sums.append(F.max("_sd").alias("_sd_max"))
    if not cluster:
        return rows.groupBy(*by).agg(*sums)
    sums += [F.sum(r).alias("_s0"), F.sum(c * r).alias("_s1"), F.count(F.lit(1)).alias("_size")]
    per_cluster = rows.groupBy(*by, "_cluster").agg(*sums)
    merged = [F.max(k).alias(k) if k == "_sd_max" else F.sum(k).alias(k)
              for k in [*terms, *(["_sd_max"] if known_sd else [])]]
    return per_cluster.groupBy(*by).agg(
        *merged,
        F.count(F.lit(1)).alias("n_clusters"), F.max("_size").alias("_largest"),
        F.sum(F.col("_s0") * F.col("_s0")).alias("_m00"),
        F.sum(F.col("_s0") * F.col("_s1")).alias("_m01"),
        F.sum(F.col("_s1") * F.col("_s1")).alias("_m11"))


def _to_line_basis(c00: Column, c01: Column, c11: Column, mx: Column) -> tuple[Column, Column, Column]:
    """Covariance of (centred level, slope) expressed for (intercept, slope)."""
    return c00 - 2 * mx * c01 + mx * mx * c11, c01 - mx * c11, c11


def fit_lines(df: DataFrame, by: list[str], x: str, y: str, *, cluster: str | None = None,
              known_sd: str | None = None, induction_fraction: float = 0.05,
              nonlinear_alpha: float = 0.05) -> DataFrame:
    """y ~ 1 + x per group with SE, CI, lack of fit, induction and flags.

    * residual covariance with df = n - 2, or CR1 over clusters with df = m - 1
      when a cluster repeats;
    * a known per-row SD lifts the covariance to at least its own propagation;
    * fewer than three distinct x leaves the slope NULL with a status.
    """
    # Group-sized and read twice: one pass over the rows, kept durably.
    moments = stored(line_moments(df, by, x, y))
    sums = residual_sums(df, moments, by, x, y, cluster, known_sd)
    t = moments.join(sums, by)
    n, sxx, mx = F.col("n").cast("double"), F.col("sxx"), F.col("mx")

    plain = [F.col("rss") / (n - 2) / n, F.lit(0.0), F.col("rss") / (n - 2) / sxx]
    dof, kind, level, cross, slope_var = n - 2, F.lit(OLS), *plain
    clusters_ok = F.lit(True)
    if cluster:
        m = F.col("n_clusters").cast("double")
        repeated = F.col("_largest") > 1
        clusters_ok = ~repeated | (m >= 3)
        scale = m / (m - 1) * (n - 1) / (n - 2)
        robust = [F.col("_m00") / (n * n) * scale, F.col("_m01") / (n * sxx) * scale,
                  F.col("_m11") / (sxx * sxx) * scale]
        level, cross, slope_var = (F.when(repeated, a).otherwise(b) for a, b in zip(robust, plain))
        dof = F.when(repeated, m - 1).otherwise(n - 2)
        kind = F.when(repeated, CLUSTERED).otherwise(OLS)
    t = t.withColumn("df", dof.cast("long"))
    v00, v01, v11 = _to_line_basis(level, cross, slope_var, mx)
    t = t.withColumn("_v00", v00).withColumn("_v01", v01).withColumn("_v11", v11)
    status = F.lit("NOT_PROVIDED_RESIDUAL_ESTIMATE_ONLY")
    if known_sd:
        k00, k01, k11 = _to_line_basis(
            F.col("_k0") / (n * n), F.col("_k1") / (n * sxx), F.col("_k2") / (sxx * sxx), mx)
        t = (t.withColumn("_p", k00 - F.col("_v00")).withColumn("_o", k01 - F.col("_v01"))
             .withColumn("_r", k11 - F.col("_v11")))
        t = lift_to_positive(t, "_p", "_o", "_r")
        t = t.withColumn("_v00", F.col("_v00") + F.col("_p")).withColumn("_v11", F.col("_v11") + F.col("_r"))
        status = F.when(F.col("_sd_max") > 0, "SUPPLIED_SD").otherwise("SUPPLIED_ZERO_SD")
        kind = F.concat(kind, F.lit("; supplied independent SD covariance floor"))

    t = t.withColumn("intercept_se", F.sqrt(F.greatest(F.lit(0.0), F.col("_v00"))))
    t = t.withColumn("slope_se", F.sqrt(F.greatest(F.lit(0.0), F.col("_v11"))))
    t = t.withColumn("_t", t_quantile_975("df"))
    half = F.col("_t") * F.col("slope_se")
    t = t.withColumn("slope_lo", F.col("slope") - half).withColumn("slope_hi", F.col("slope") + half)
    end_mean = F.col("_end_sum") / F.col("_end_n")
    late = ((F.col("intercept") + F.col("_t") * F.col("intercept_se") < 0)
            & (-F.col("intercept") > induction_fraction * end_mean))
    t = t.withColumn("induction", F.coalesce(late, F.lit(False)))
    t = t.withColumn("t_ind", F.when(F.col("induction") & (F.col("slope") > 0),
                                     -F.col("intercept") / F.col("slope")).otherwise(0.0))
    t = t.withColumn("r2", F.when(F.col("y_max") > F.col("y_min"), 1 - F.col("rss") / F.col("syy")))
    t = t.withColumn("quadratic_p", _curvature_p(n, sxx))

    eps = sys.float_info.epsilon
    floor = eps * F.greatest(F.lit(1.0), F.col("_y_abs")) / (F.col("x_max") - F.col("x_min")) * 100
    flags = {
        "nonpositive_growth": F.col("slope") <= floor,
        "positive_growth_not_resolved_at_95pct": F.col("slope_lo") <= 0,
        "nonlinear_growth": F.col("quadratic_p") < nonlinear_alpha,
    }
    fit_status = (F.when(F.col("n_times") < 3, "TOO_FEW_LEVELS").when(~clusters_ok, "TOO_FEW_CLUSTERS")
                  .otherwise("FITTED"))
    return t.select(
        *by, "n", "n_times", "df", "slope", "slope_se", "slope_lo", "slope_hi", "intercept", "intercept_se",
        "induction", "t_ind", "r2", "rss", "quadratic_p", flags_text(flags).alias("flags"),
        kind.alias("standard_error"), status.alias("metrology_status"), fit_status.alias("fit_status"))


def _curvature_p(n: Column, sxx: Column) -> Column:
    """P value of a centred quadratic term, from its part orthogonal to the line."""
    own = F.col("_q2") - F.col("_q") * F.col("_q") / n - F.col("_q3") * F.col("_q3") / sxx
    gain = F.col("_qe") * F.col("_qe") / own
    rest = F.greatest(F.lit(0.0), F.col("rss") - gain)
    t = F.sqrt(F.greatest(F.lit(0.0), gain / (rest / (n - 3))))
    p = (F.when(rest > 1e-20, t_two_sided_p(t, (n - 3).cast("long")))
         .when(F.col("rss") > 1e-15, 0.0).otherwise(1.0))
    return F.when((F.col("n_times") >= 4) & (n > 3), p)


def lift_to_positive(df: DataFrame, p: str, o: str, r: str) -> DataFrame:
    """Replace the symmetric matrix [[p, o], [o, r]] by its positive part."""
    a, b, c = F.col(p), F.col(o), F.col(r)
    half, spread = (a + c) / 2, F.sqrt(F.pow((a - c) / 2, 2) + b * b)
    big, small = half + spread, half - spread
    share = big / (big - small)

    def part(value: Column, diagonal: bool) -> Column:
        mixed = share * (value - small) if diagonal else share * value
        return F.when(small >= 0, value).when(big <= 0, 0.0).otherwise(mixed)

    return (df.withColumn("_np", part(a, True)).withColumn("_no", part(b, False)).withColumn("_nr", part(c, True))
            .withColumn(p, F.col("_np")).withColumn(o, F.col("_no")).withColumn(r, F.col("_nr"))
            .drop("_np", "_no", "_nr"))


def drift_flags(df: DataFrame, by: list[str], value: str, nominal, limit: float = 0.02) -> DataFrame:
    """Range over mean, or any value, off by more than ``limit``."""
    v = F.col(value)
    nominal = F.lit(float(nominal)) if isinstance(nominal, (int, float)) else F.col(nominal)
    far = F.abs(v - nominal) > 1e-8 + limit * F.abs(nominal)
    stats = df.where(v.isNotNull()).groupBy(*by).agg(
        ((F.max(v) - F.min(v)) / F.avg(v)).alias("relative_range"),
        F.count_if(far).alias("n_off_nominal"))
    return stats.withColumn(
        "concentration_change", (F.col("relative_range") > limit) | (F.col("n_off_nominal") > 0))


def annotated_lines(df: DataFrame, by: list[str], x: str, y: str, *, concentration: str | None = None, nominal: float = 0.0,
                    levels: tuple[float, ...] = (), **options) -> DataFrame:
    """``fit_lines`` whose flags also name a concentration that drifted, with
    the design levels never measured (n_missing, missing)."""
    from .contracts import missing_levels
    lines = fit_lines(df, by, x, y, **options)
    if concentration:
        drift = drift_flags(df, by, concentration, nominal).select(*by, "concentration_change")
        lines = lines.join(drift, by, "left").withColumn("flags", F.concat_ws(
            ";", F.nullif(F.col("flags"), F.lit("")), F.when(F.col("concentration_change"), "concentration_change"))).drop("concentration_change")
    return lines.join(missing_levels(df, by, x, list(levels)), by, "left") if levels else lines


def growth_violations(df: DataFrame, origin: str) -> DataFrame:
    """Rule table of the growth measurements before any line is fitted."""
    from ..functions.rules import is_blank, is_finite
    from .contracts import combine, row_rules, unique_rule
    number = {c: F.col(c).try_cast("double") for c in ("T_C", "gly_pct", "t_min", "thickness_nm")}
    rules = {
        "substrate": ("substrate", ~F.col("substrate").isin("glass", "pdms")),
        "provenance": ("specimen_id", is_blank("specimen_id") | is_blank("method") | is_blank("source")),
        "origin": ("origin", F.col("origin") != origin),
        "finite": ("thickness_nm", ~(is_finite("T_C") & is_finite("gly_pct") & is_finite("t_min") & is_finite("thickness_nm"))),
        "ranges": ("t_min", ~((number["thickness_nm"] >= 0) & (number["t_min"] > 0) & (number["T_C"] > -273.15) & number["gly_pct"].between(0, 100))),
    }
    if "thickness_sd_nm" in df.columns:
        rules["sd"] = ("thickness_sd_nm", ~(is_finite("thickness_sd_nm") & (F.col("thickness_sd_nm").try_cast("double") >= 0)))
    return combine(row_rules(df, rules, "measurement_id"), unique_rule(df, ["measurement_id"]))


def viscosity_violations(df: DataFrame, origin: str, basis: str) -> DataFrame:
    """Rule table of the viscosities."""
    from ..functions.rules import is_blank, is_finite
    from .contracts import combine, row_rules, unique_rule
    eta, sd = (F.col(c).try_cast("double") for c in ("eta_Pa_s", "eta_sd_Pa_s"))
    rules = {
        "unit": ("eta_unit", F.col("eta_unit") != "Pa_s"), "basis": ("gly_basis", F.col("gly_basis") != basis),
        "provenance": ("source", is_blank("source")), "origin": ("origin", F.col("origin") != origin),
        "value": ("eta_Pa_s", ~(is_finite("eta_Pa_s") & (eta > 0))), "sd": ("eta_sd_Pa_s", ~(is_finite("eta_sd_Pa_s") & (sd >= 0))),
    }
    return combine(row_rules(df, rules, "T_C"), unique_rule(df, ["T_C", "gly_pct"]))


def calibration_table(growth: DataFrame, viscosity: DataFrame, by: list[str], cfg) -> DataFrame:
    """Per-condition rates, diffusivity and end rate from fitted growth lines.

    ``growth`` has one row per condition and substrate (slope, slope_se,
    flags); ``viscosity`` exactly one row per condition.
    """
    from ..functions.transport import KELVIN, channel_coefficients, quoted, wall_perimeters
    from .joins import exactly_one

    molar = cfg.C0_mol_m3 * cfg.Vm_m3_mol
    rates = growth.groupBy(*by).pivot("substrate", ["glass", "pdms"]).agg(
        (F.max("slope") * 1e-9 / 60 / molar).alias("ks"),
        (F.max("slope_se") * 1e-9 / 60 / molar).alias("ks_se"),
        F.count(F.lit(1)).alias("fits"))
    flagged = growth.groupBy(*by).agg(
        F.bool_or(F.coalesce(F.col("flags"), F.lit("")) != "").alias("growth_assumptions_flagged"))
    t = rates.join(flagged, by)
    for s in ("glass", "pdms"):
        t = (t.withColumnRenamed(f"{s}_ks", f"ks_{s}").withColumnRenamed(f"{s}_ks_se", f"ks_se_{s}"))
    t = exactly_one(t, viscosity, by, ["eta_Pa_s"])
    d = (cfg.D_ref_m2_s * ((F.col(by[0]) + KELVIN) / (cfg.D_ref_T_C + KELVIN)) * cfg.eta_ref_Pa_s / F.col("eta_Pa_s"))
    inert = cfg.end_material == "inert" or cfg.end_rate_ratio == 0
    k_end = F.lit(0.0) if inert else F.col(f"ks_{cfg.end_material}") * cfg.end_rate_ratio
    w, h = cfg.w_um * 1e-6, cfg.h_um * 1e-6
    t = t.withColumns({"D": d, "k_end": k_end})
    walls = wall_perimeters(w, h, cfg.faces, quoted(cfg.wall_materials))
    shape = F.expr(channel_coefficients(w, h, w, walls, {s: f"ks_{s}" for s in walls}, "D", "k_end"))
    need = cfg.reactive_materials()
    missing = F.concat_ws("|", *[F.when(F.col(f"ks_{s}").isNull(), F.lit(s)) for s in need])
    repeated = F.concat_ws("|", *[F.when(F.col(f"{s}_fits") > 1, F.lit(s)) for s in ("glass", "pdms")])
    negative = F.coalesce(F.least(F.col("ks_glass"), F.col("ks_pdms")) < 0, F.lit(False))
    status = (F.when(missing != "", F.concat(F.lit("missing_substrate:"), missing))
              .when(repeated != "", F.concat(F.lit("repeated_substrate:"), repeated))
              .when(F.col("growth_assumptions_flagged") & F.lit(not cfg.allow_flagged_growth), "flagged_growth")
              .when(F.col("match_status") != "ok", F.concat(F.col("match_status"), F.lit("_viscosity")))
              .when(negative, "negative_rate").otherwise("OK"))
    return t.select(
        *by, "ks_glass", "ks_se_glass", "ks_pdms", "ks_se_pdms", "eta_Pa_s", "D", "k_end",
        shape["ks_effective"].alias("ks_effective"), "growth_assumptions_flagged", status.alias("status"))
