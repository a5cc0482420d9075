"""Condition grids: factorial levels, cell interpolation, scenarios, designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.transport import KELVIN, channel_coefficients, coverage, crossing, quoted, wall_perimeters
from ..session import durable
from .scalars import one_row
from .resample import observed_windows, window_fractions


def explode_levels(df: DataFrame, levels: dict[str, list[float]]) -> DataFrame:
    """Every row with every combination of fixed level lists (no join)."""
    for name, values in levels.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df


def linspace(lo: Column, hi: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.when(i == n - 1, hi).otherwise(lo + (hi - lo) * i / (n - 1)))


def factorial_grid(bounds: DataFrame, axes: dict[str, tuple[str, str]], n: int) -> DataFrame:
    """``n`` even levels per axis between two bound columns of each row."""
    for name, (lo, hi) in axes.items():
        bounds = bounds.withColumn(name, F.explode(linspace(F.col(lo), F.col(hi), n)))
    return bounds


def grid_completeness(cal: DataFrame, t: str, g: str, values: list[str]) -> DataFrame:
    """Counts that prove a grid holds every (t, g) exactly once and that no
    logged value mixes zero and positive: |cells| = |t levels| * |g levels|."""
    per_cell = cal.groupBy(t, g).agg(F.count(F.lit(1)).alias("_n"), *[F.min(v).alias(v) for v in values])
    checks = [F.count_if(F.col(v) == 0).alias(f"zero_{v}") for v in values]
    checks += [F.count_if(F.col(v) < 0).alias(f"negative_{v}") for v in values]
    s = per_cell.agg(F.count_distinct(t).alias("n_t"), F.count_distinct(g).alias("n_g"),
                     F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("_n") > 1).alias("n_repeated"), *checks)
    return s.withColumn("n_missing", F.col("n_t") * F.col("n_g") - F.col("n_cells"))


def missing_cells(cal: DataFrame, t: str, g: str) -> DataFrame:
    """The absent (t, g) combinations: per t level, all g levels minus its own."""
    every = one_row(cal.agg(F.collect_set(g).alias("g")))["g"]  # calibration levels
    own = cal.groupBy(t).agg(F.collect_set(g).alias("_own"))
    return own.select(t, F.explode(F.array_except(every, F.col("_own"))).alias(g))


def interpolate(points: DataFrame, cal: DataFrame, t: str, g: str, columns: list[str]) -> DataFrame:
    """Bilinear interpolation of ln(value) inside the calibration cell of a point.

    Rates (``ks_*``) are linear in inverse kelvin, other values in celsius; all
    are linear in composition.  ``grid_status`` is ok, outside_domain (nothing
    is extrapolated), missing_corner, negative_value or zero_beside_positive
    (the logarithm between them is not defined); only ok points have values,
    and a cell whose corners are all zero has the value zero.  The calibration
    becomes one sorted level array, so a point finds its cell by itself without
    a range join; the four corners are joined by their exact levels.  The
    calibration is one row per (T, composition).
    """
    # The calibration is used for its levels and its corners: fit it once.
    cells = durable(cal.select(F.col(t).alias("_t"), F.col(g).alias("_g"), *columns))
    ts = cells.agg(F.sort_array(F.collect_set("_t")).alias("_ts"), F.sort_array(F.collect_set("_g")).alias("_gs"))

    def place(levels: str, x: Column) -> Column:
        below = F.size(F.filter(F.col(levels), lambda v: v <= x))
        return F.greatest(F.lit(1), F.least(below, F.size(levels) - 1))

    levels = one_row(ts)
    p = points.withColumns({"_ts": levels["_ts"], "_gs": levels["_gs"]})
    x, y = F.col(t), F.col(g)
    inside = x.between(F.array_min("_ts"), F.array_max("_ts")) & y.between(F.array_min("_gs"), F.array_max("_gs"))
    p = p.withColumns({"_i": place("_ts", x), "_j": place("_gs", y)}).withColumns({
        "t0": F.element_at("_ts", F.col("_i")), "t1": F.element_at("_ts", F.col("_i") + 1),
        "g0": F.element_at("_gs", F.col("_j")), "g1": F.element_at("_gs", F.col("_j") + 1),
        "in_domain": F.coalesce(inside, F.lit(False))}).drop("_ts", "_gs", "_i", "_j")
    j = p.join(_cell_corners(cells, columns), ["t0", "g0", "t1", "g1"], "left")
    inv = lambda c: 1 / (c + KELVIN)
    wt = (x - F.col("t0")) / (F.col("t1") - F.col("t0"))
    wk = (inv(x) - inv(F.col("t0"))) / (inv(F.col("t1")) - inv(F.col("t0")))
    wg = (y - F.col("g0")) / (F.col("g1") - F.col("g0"))
    out, absent, negative, mixed = {}, F.lit(False), F.lit(False), F.lit(False)
    for c in columns:
        w = wk if c.startswith("ks_") else wt
        lo = F.ln(F.col(f"{c}_00")) * (1 - wg) + F.ln(F.col(f"{c}_01")) * wg
        hi = F.ln(F.col(f"{c}_10")) * (1 - wg) + F.ln(F.col(f"{c}_11")) * wg
        corners = [F.col(f"{c}_{k}") for k in ("00", "01", "10", "11")]
        out[c] = F.when(F.greatest(*corners) == 0, 0.0).otherwise(F.exp(lo * (1 - w) + hi * w))
        absent = absent | F.array_contains(F.transform(F.array(*corners), lambda v: v.isNull()), True)
        negative = negative | (F.least(*corners) < 0)
        mixed = mixed | ((F.least(*corners) == 0) & (F.greatest(*corners) > 0))
    status = (F.when(~F.col("in_domain"), "outside_domain").when(absent, "missing_corner").when(negative, "negative_value")
              .when(mixed, "zero_beside_positive").otherwise("ok"))
    j = j.withColumn("grid_status", status)
    return j.select(*points.columns, "in_domain", "grid_status", *[F.when(F.col("grid_status") == "ok", v).alias(c) for c, v in out.items()])


def _cell_corners(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row per pair of neighbouring levels with the values of its corners;
    an absent corner is NULL."""
    def neighbours(c: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(c) - 1)
        return F.zip_with(F.slice(c, F.lit(1), last), F.slice(c, F.lit(2), last), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))

    # The pairs of levels of the calibration's own axes: as many as it has cells.
    axes = cells.agg(F.sort_array(F.collect_set("_t")).alias("_a"), F.sort_array(F.collect_set("_g")).alias("_b"))
    frame = axes.withColumn("_t", F.explode(neighbours(F.col("_a")))).withColumn("_g", F.explode(neighbours(F.col("_b"))))
    frame = frame.select(F.col("_t.lo").alias("t0"), F.col("_t.hi").alias("t1"), F.col("_g.lo").alias("g0"), F.col("_g.hi").alias("g1"))
    for name, t, g in (("00", "t0", "g0"), ("01", "t0", "g1"), ("10", "t1", "g0"), ("11", "t1", "g1")):
        corner = cells.select(F.col("_t").alias(t), F.col("_g").alias(g), *[F.col(c).alias(f"{c}_{name}") for c in columns])
        frame = frame.join(corner, [t, g], "left")
    return frame


def with_properties(df: DataFrame, cfg) -> DataFrame:
    """D and k_end of interpolated conditions."""
    d = (cfg.D_ref_m2_s * (F.col("T_C") + KELVIN) / (cfg.D_ref_T_C + KELVIN) * cfg.eta_ref_Pa_s / F.col("eta_Pa_s"))
    inert = cfg.end_material == "inert" or cfg.end_rate_ratio == 0
    return df.withColumns({"D": d, "k_end": F.lit(0.0) if inert else F.col(f"ks_{cfg.end_material}") * cfg.end_rate_ratio})


def unit_depth(df: DataFrame, cfg, w_um=None, h_um=None, faces=None) -> DataFrame:
    """phi and Bi per unit aspect ratio: phi(AR) = phi1 * AR, Bi(AR) = bi1 * AR."""
    w = f"{w_um} * 1e-6D" if w_um else cfg.w_um * 1e-6
    h = f"{h_um} * 1e-6D" if h_um else cfg.h_um * 1e-6
    walls = wall_perimeters(w, h, faces or cfg.faces, quoted(cfg.wall_materials))
    c = F.expr(channel_coefficients(w, h, w, walls, {s: f"ks_{s}" for s in walls}, "D", "k_end"))
    return df.withColumn("_c", c).withColumns({
        "phi1": F.sqrt("_c.da"), "bi1": F.col("_c.biot"), "ks_effective": F.col("_c.ks_effective")}).drop("_c")


def aspect_curve(cfg):
    def curve(ar: str) -> str:
        windows = observed_windows(f"({ar}) * {cfg.w_um * 1e-6!r}D", cfg)
        return f"CASE WHEN {ar} = 0 THEN 1D ELSE {coverage(f'phi1 * ({ar})', f'bi1 * ({ar})', *windows)} END"
    return curve


def aspect_limit(cfg, target: float | None = None) -> Column:
    """Largest aspect ratio that still meets the target coverage."""
    lower = 0.0 if cfg.map_observable == "endpoints" else (
        2 * (cfg.top_offset_um + cfg.window_half_um) / cfg.w_um + 1e-8)
    return F.expr(crossing(aspect_curve(cfg), target or cfg.sc_target, lower, cfg.map_ar_limit))


def process_grid(cal: DataFrame, cfg, n_t: int = 16, n_g: int = 21, ar: float = 49.0) -> DataFrame:
    """Coverage and depth limit on an even grid over the calibrated domain.  A
    point whose calibration cell is incomplete keeps its row; its status says why."""
    cal = durable(cal)  # one row per condition, used for the domain and the cells
    domain = cal.agg(F.min("T_C").alias("_t0"), F.max("T_C").alias("_t1"),
                     F.min("gly_pct").alias("_g0"), F.max("gly_pct").alias("_g1"))
    cells = (domain.withColumn("T_C", F.explode(linspace(F.col("_t0"), F.col("_t1"), n_t)))
             .withColumn("gly_pct", F.explode(linspace(F.col("_g0"), F.col("_g1"), n_g)))
             .select("T_C", "gly_pct"))
    need = [f"ks_{s}" for s in cfg.reactive_materials()]
    g = interpolate(cells, cal, "T_C", "gly_pct", [*need, "eta_Pa_s"])
    for s in ("glass", "pdms"):
        if f"ks_{s}" not in need:
            g = g.withColumn(f"ks_{s}", F.lit(None).cast("double"))
    g = unit_depth(with_properties(g, cfg), cfg)
    g = g.withColumns({"SC_AR49": F.expr(aspect_curve(cfg)(f"{ar!r}D")), "Da_AR49": F.pow(F.col("phi1") * ar, 2),
                       "_l": aspect_limit(cfg)})
    ok = F.col("grid_status") == "ok"
    return g.withColumns({"AR_max": F.when(ok, F.col("_l.value")), "AR_max_status": F.when(ok, F.col("_l.status")).otherwise(F.col("grid_status"))}).drop(
        "_l", "phi1", "bi1", "in_domain", "grid_status")


def grid_summary(grid: DataFrame, target: float) -> DataFrame:
    sc = F.col("SC_AR49")
    boundary = F.when((F.min(sc) < target) & (F.max(sc) > target), "boundary_in_domain").otherwise(
        "no_boundary_in_assumed_domain")
    return grid.agg(
        F.count(F.lit(1)).alias("n_grid"), boundary.alias("boundary_status"),
        F.count_if(sc >= target).alias("n_at_or_above_target"), F.min(sc).alias("sc_min"), F.max(sc).alias("sc_max"),
        F.min("AR_max").alias("ar_min"), F.max("AR_max").alias("ar_max"))


def design_grid(cal: DataFrame, cfg) -> DataFrame:
    """Conditions by aspect-ratio ladder with end-point and window coverage."""
    t = explode_levels(unit_depth(cal, cfg), {"AR": list(cfg.ar_ladder)})
    t = t.withColumns({"L_um": F.col("AR") * cfg.w_um, "phi": F.col("phi1") * F.col("AR"), "Bi_end": F.col("bi1") * F.col("AR")})
    windows = window_fractions(f"AR * {cfg.w_um * 1e-6!r}D", cfg)
    t = t.withColumns({"Da": F.col("phi") * F.col("phi"), "SC_endpoint": F.expr(coverage("phi", "Bi_end")),
                       "SC_observed": F.expr(coverage("phi", "Bi_end", *windows))})
    return t.withColumn("endpoint_relative_error_pct",
                        100 * (F.col("SC_endpoint") - F.col("SC_observed")) / F.col("SC_observed"))


def scenario_table(cal: DataFrame, cfg, key: list[str], h_um=(30.0, 50.0), faces=(2, 4), ratios=(0.0, 1.0, 3.0),
                   ladder=(1.0, 9.0, 49.0)) -> DataFrame:
    """Hypothetical geometries; one lacking a measured rate stays as a row with
    status NOT_EVALUATED and the names of the missing materials."""
    t = unit_depth(cal, cfg).withColumn("_k_ref", F.col("ks_effective")).drop("phi1", "bi1", "ks_effective")
    t = explode_levels(t, {"s_h_um": list(h_um), "s_faces": list(faces), "s_ratio": list(ratios), "AR": list(ladder)})
    t = t.withColumn("s_faces", F.col("s_faces").cast("int")).withColumn("k_end", F.col("_k_ref") * F.col("s_ratio"))
    t = t.withColumn("s_w_um", F.lit(cfg.w_um))
    t = unit_depth(t, cfg, "s_w_um", "s_h_um", "s_faces")
    return _evaluated(t, cfg).select(
        *key, F.col("s_h_um").alias("h_um"), F.col("s_faces").alias("faces"), F.col("s_ratio").alias("rate_ratio"),
        "AR", "status", "missing_substrates",
        _if_evaluated(F.pow(F.col("phi1") * F.col("AR"), 2)).alias("Da"),
        _if_evaluated(F.col("bi1") * F.col("AR")).alias("Bi_end"),
        _if_evaluated(F.expr(coverage("phi1 * AR", "bi1 * AR"))).alias("SC_endpoint"))


def depth_scenarios(cal: DataFrame, cfg, key: list[str], target: float = 0.01, h_um=(30.0, 50.0), faces=(2, 4)) -> DataFrame:
    """Depth at which end-point coverage falls to ``target``, per geometry."""
    from dataclasses import replace
    t = explode_levels(cal, {"s_h_um": list(h_um), "s_faces": list(faces)})
    t = t.withColumn("s_faces", F.col("s_faces").cast("int")).withColumn("s_w_um", F.lit(cfg.w_um))
    t = _evaluated(unit_depth(t, cfg, "s_w_um", "s_h_um", "s_faces"), cfg)
    t = t.withColumn("_l", aspect_limit(replace(cfg, map_observable="endpoints"), target))
    return t.select(
        *key, F.col("s_faces").alias("faces"), F.col("s_h_um").alias("h_um"), "missing_substrates",
        _if_evaluated(F.col("_l.value") * cfg.w_um).alias("depth_um"),
        F.when(F.col("status") == "EVALUATED", F.col("_l.status")).otherwise("NOT_EVALUATED").alias("status"))


def _evaluated(t: DataFrame, cfg) -> DataFrame:
    """Status and missing materials of geometries in s_w_um, s_h_um, s_faces."""
    walls = wall_perimeters("s_w_um", "s_h_um", "s_faces", quoted(cfg.wall_materials))
    missing = F.concat_ws("|", *[F.when((F.expr(p) > 0) & F.col(f"ks_{s}").isNull(), F.lit(s)) for s, p in walls.items()])
    return (t.withColumn("missing_substrates", missing)
            .withColumn("status", F.when(missing != "", "NOT_EVALUATED").otherwise("EVALUATED")))


def _if_evaluated(c: Column) -> Column:
    return F.when(F.col("status") == "EVALUATED", c)


def threshold_crossing(curve: DataFrame, by: list[str], x: str, y: str, target: float) -> DataFrame:
    """First point where a tabulated curve falls to ``target``, by linear
    interpolation between neighbours; the curve of a group is its level table."""
    w = W.partitionBy(*by).orderBy(x)
    p = curve.withColumns({"_px": F.lag(x).over(w), "_py": F.lag(y).over(w)})
    down = (F.col(y) <= target) & (F.col("_py") > target)
    at = F.col("_px") + (F.col("_py") - target) / (F.col("_py") - F.col(y)) * (F.col(x) - F.col("_px"))
    s = p.groupBy(*by).agg(
        F.min_by(y, x).alias("_first"), F.min(x).alias("_x0"),
        F.min(F.when(down, F.struct(F.col(x).alias("o"), at.alias("v")))).alias("_hit"))
    status = (F.when(F.col("_first") < target, "below_target_at_lower_bound").when(F.col("_first") == target, "root")
              .when(F.col("_hit").isNull(), "no_boundary_within_domain").otherwise("root"))
    value = F.when(F.col("_first") == target, F.col("_x0")).otherwise(F.col("_hit.v"))
    return s.select(*by, status.alias("status"), F.when(status == "root", value).alias("value"))


def ladder_ratios(df: DataFrame, ladder: str) -> DataFrame:
    """Adjacent ratios of the distinct levels of a ladder."""
    w = W.orderBy(ladder)  # distinct design levels only
    return (df.select(ladder).distinct().withColumn("previous", F.lag(ladder).over(w))
            .where("previous is not null").withColumn("ratio", F.col(ladder) / F.col("previous")))
