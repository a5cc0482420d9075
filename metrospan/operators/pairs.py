"""Top/bottom pairing, pair summaries and scoring against the closed form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.errors import ratio_sd
from ..functions.rules import is_finite
from ..functions.transport import channel_coefficients, coverage, log_mean, wall_perimeters

SCORABLE_ROLES = ("cross_fitted", "independent_measurement", "independent_holdout")


def pair_ratio(df: DataFrame, unit: str, pos: str, value: str, shared: list[str], *, min_top: float,
               z_lo: str = "observed_z_lo_um", z_hi: str = "observed_z_hi_um", role: str | None = "prediction_role",
               sd: str | None = None, rho: str | None = None, carry: list[str] = ()) -> DataFrame:
    """One row per unit with the bottom/top ratio or the reason it has none.

    Both positions fold into one row by conditional aggregation, so a unit is a
    single map-side-combined group.  Repeated positions and unequal metadata
    are faults, not exclusions, and take a status of their own.  Reasons follow
    a fixed order of precedence.
    """
    def at(side: str, c: str) -> Column:
        return F.max(F.when(F.col(pos) == side, F.col(c)))

    fields = [value, z_lo, z_hi, *carry, *([role] if role else []), *([sd] if sd else []), *([rho] if rho else [])]
    aggs = [at(side, c).alias(f"{side}_{c}") for side in ("top", "bot") for c in fields]
    aggs += [F.count_if(F.col(pos) == side).alias(f"_n_{side}") for side in ("top", "bot")]
    aggs += [F.min(c).alias(c) for c in shared] + [F.max(c).alias(f"_max_{c}") for c in shared] + [F.count(c).alias(f"_seen_{c}") for c in shared]
    t = df.groupBy(unit).agg(*aggs, F.count(F.lit(1)).alias("_n"))

    top, bot = F.col(f"top_{value}"), F.col(f"bot_{value}")
    unequal = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_max_{c}")) | ((F.col(f"_seen_{c}") > 0) & (F.col(f"_seen_{c}") < F.col("_n"))) for c in shared], F.lit(False))
    mixed = ~F.col(f"top_{role}").eqNullSafe(F.col(f"bot_{role}")) if role else F.lit(False)
    incomplete = (F.col("_n_top") == 0) | (F.col("_n_bot") == 0) | (F.col("_n") > F.col("_n_top") + F.col("_n_bot"))
    reason = (
        F.when(incomplete, "missing_top_or_bot")
        .when(mixed, "mixed_prediction_roles")
        .when(F.col(f"top_{z_hi}") >= F.col(f"bot_{z_lo}"), "overlapping_observation_windows")
        .when(~is_finite(top) | ~is_finite(bot), "missing_thickness")
        .when(top < min_top, "top_below_denominator_threshold")
        .when(bot < 0, "negative_bot_thickness")
        .otherwise("")
    )
    fault = (F.when((F.col("_n_top") > 1) | (F.col("_n_bot") > 1), "duplicate_observation")
             .when((reason != "missing_top_or_bot") & unequal, "metadata_mismatch"))
    t = t.withColumn("reason", F.coalesce(fault, reason))
    ok = F.col("reason") == ""
    t = t.withColumn("status", F.when(fault.isNotNull(), "FAULT").when(ok, "PASS").otherwise("EXCLUDED"))
    t = t.withColumn("SC", F.when(ok, bot / top))
    if sd:
        rho_col = F.lit(0.0)
        if rho:
            rho_col = F.when(F.col(f"top_{rho}") == F.col(f"bot_{rho}"), F.col(f"top_{rho}"))
        t = t.withColumn("SC_sd", F.when(ok, ratio_sd(top, bot, f"top_{sd}", f"bot_{sd}", rho_col)))
        available = F.when(F.col("SC_sd").isNotNull(), "AVAILABLE").otherwise("INVALID_UNCERTAINTY")
    else:
        t = t.withColumn("SC_sd", F.lit(None).cast("double"))
        available = F.lit("NOT_AVAILABLE")
    t = t.withColumn("uncertainty_status", F.when(ok, available).otherwise("NOT_EVALUATED"))
    keep = [f"{side}_{c}" for side in ("top", "bot") for c in fields]
    return t.select(unit, *shared, *keep, "status", "reason", "SC", "SC_sd", "uncertainty_status")


def pair_summary(pairs: DataFrame, by: list[str], specimen: str, batch: str) -> DataFrame:
    """Counts and spread per point; points without a valid pair are kept."""
    ok = F.col("status") == "PASS"
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_available"), F.count_if(ok).alias("n_valid"),
        F.count_if(~ok).alias("n_excluded"),
        F.count_distinct(F.when(ok, F.col(specimen))).alias("n_specimens"),
        F.count_distinct(F.when(ok, F.col(batch))).alias("n_batches"),
        F.avg(F.when(ok, F.col("SC"))).alias("SC_mean"),
        F.stddev_samp(F.when(ok, F.col("SC"))).alias("SC_between_trench_sd"))


def interval_log_mean(intervals: str, length: str, phi: str, biot: str) -> str:
    """log of the mean profile over a union of [lo, hi] intervals.

    log(sum(len * exp(v)) / sum(len)), shifted by the largest v.
    """
    value = log_mean(f"i.lo / {length}", f"i.hi / {length}", phi, biot)
    parts = f"transform({intervals}, i -> named_struct('len', i.hi - i.lo, 'v', {value}))"
    return (f"transform(transform(array({parts}), p -> named_struct('p', p, 'top', array_max(p.v))), "
            "s -> s.top + ln(aggregate(s.p, 0D, (t, e) -> t + e.len * exp(e.v - s.top)) / aggregate(s.p, 0D, (t, e) -> t + e.len)))[0]")


def interval_log_mean_rows(df: DataFrame, by: list[str], lo: str, hi: str, length: str, phi: str, biot: str) -> DataFrame:
    """The same over interval rows: two mergeable aggregates, no list per region."""
    span = F.col(hi) - F.col(lo)
    v = F.expr(log_mean(f"{lo} / {length}", f"{hi} / {length}", phi, biot))
    rows = df.select(*by, span.alias("_len"), v.alias("_v"))
    peak = rows.groupBy(*by).agg(F.max("_v").alias("_peak"))
    mass = rows.join(peak, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_intervals"), F.first("_peak").alias("_peak"),
        F.sum(F.col("_len") * F.exp(F.col("_v") - F.col("_peak"))).alias("_mass"), F.sum("_len").alias("length_um"))
    return mass.select(*by, "n_intervals", "length_um",
                       (F.col("_peak") + F.ln(F.col("_mass") / F.col("length_um"))).alias("log_mean"))


def interval_gaps(df: DataFrame, key: str, lo: str, hi: str, tolerance: float = 1e-8) -> DataFrame:
    """Adjacent distinct intervals of one region that do not abut.

    Neighbours meet by (region, rank), which spreads even a region that holds
    most of the rows; no window has to see a whole region.
    """
    from .ranks import ordered_rank
    ranked = ordered_rank(df.select(key, lo, hi).distinct(), [lo, hi], [key], "_rank")
    after = ranked.select(F.col(key).alias("_key"), (F.col("_rank") - 1).alias("_at"), F.col(lo).alias("_next"))
    near = (F.col(key) == F.col("_key")) & (F.col("_rank") == F.col("_at"))
    gaps = ranked.join(after, near, "left").withColumn("gap", F.abs(F.col("_next") - F.col(hi)))
    return gaps.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_intervals"), F.count_if(F.col("gap") > tolerance).alias("n_gaps"),
        F.max("gap").alias("max_gap"))


def theory_scores(pairs: DataFrame, calibration: DataFrame, on: list[str], used: DataFrame | None = None, ids: list[str] = ()) -> DataFrame:
    """Observed ratio next to the closed-form ratio over the same intervals.

    ``pairs``: rows with geometry, ``top_intervals``/``bot_intervals`` (um) and
    ``prediction_role``; ``calibration``: ks_glass, ks_pdms, D, k_end;
    ``used``: the ``id`` values that went into the calibration, compared with
    the columns ``ids`` of the pairs.  Every row stays, with a ``score_status``:
    SCORED, or the first of not_a_passing_pair, role_not_scorable (final
    re-predictions are never scored), calibration_shares_id (circular),
    calibration_missing, calibration_ambiguous, calibration_incomplete.  Only
    SCORED rows have a model value; ``score_violations`` counts the others.
    """
    from ..session import durable
    from .joins import exactly_one

    calibration = durable(calibration.select(*on, "ks_glass", "ks_pdms", "D", "k_end"))
    t = exactly_one(pairs, calibration, on, ["ks_glass", "ks_pdms", "D", "k_end"], derived=True).withColumn("_circular", F.lit(False))
    for c in ids if used is not None else ():
        own = used.select(F.col("id").cast("string").alias("_id")).where("_id is not null").distinct()
        t = t.join(own, F.col(c).cast("string") == F.col("_id"), "left").withColumn("_circular", F.col("_circular") | F.col("_id").isNotNull()).drop("_id")
    status = (F.when(~F.col("status").eqNullSafe("PASS"), "not_a_passing_pair")
              .when(~F.coalesce(F.col("prediction_role").isin(*SCORABLE_ROLES), F.lit(False)), "role_not_scorable")
              .when(F.col("_circular"), "calibration_shares_id").when(F.col("match_status") == "ambiguous", "calibration_ambiguous")
              .when(F.col("match_status") != "ok", "calibration_missing"))
    w, h, length = "w_um * 1e-6D", "h_um * 1e-6D", "L_um * 1e-6D"
    walls = wall_perimeters(w, h, "faces", ["left_material", "right_material", "floor_material", "ceiling_material"])
    shape = channel_coefficients(w, h, length, walls, {"glass": "ks_glass", "pdms": "ks_pdms"}, "D", "k_end")
    t = t.withColumn("_c", F.expr(shape))
    status = F.coalesce(status, F.when(F.col("_c.da").isNull() | F.col("_c.biot").isNull(), "calibration_incomplete"), F.lit("SCORED"))
    t = t.withColumn("score_status", status).withColumn("_c", F.when(F.col("score_status") == "SCORED", F.col("_c"))).drop("match_status", "_circular")
    t = t.withColumns({"Da": F.col("_c.da"), "Bi_end": F.col("_c.biot"), "phi": F.sqrt("_c.da")}).drop("_c")
    below, above = (interval_log_mean(f"{side}_intervals", "L_um", "phi", "Bi_end") for side in ("bot", "top"))
    t = t.withColumns({"SC_model": F.expr(f"exp({below} - {above})"), "SC_endpoint": F.expr(coverage("phi", "Bi_end"))})
    return t.withColumn("endpoint_relative_error_pct", F.when(
        F.col("SC_model") > 0, 100 * (F.col("SC_endpoint") - F.col("SC_model")) / F.col("SC_model")))


def score_violations(scored: DataFrame) -> DataFrame:
    """Rows by score_status other than SCORED, with an example."""
    return scored.where("score_status <> 'SCORED'").groupBy("score_status").agg(F.count(F.lit(1)).alias("n"))


def theory_points(scored: DataFrame, by: list[str]) -> DataFrame:
    """Means of the scored rows of each point; the others are counted by ``score_violations``."""
    return scored.where("score_status = 'SCORED'").groupBy(*by).agg(
        F.avg("SC").alias("SC_measured"), F.avg("SC_model").alias("SC_model"), F.avg("phi").alias("phi"),
        F.count(F.lit(1)).alias("n_trenches"))


def theory_report(points: DataFrame, condition: str) -> DataFrame:
    """Fixed-theory R2 and RMSE over points; nothing is fitted."""
    e = F.col("SC_measured") - F.col("SC_model")
    n = F.count(F.lit(1))
    sst = n * F.var_pop("SC_measured")
    return points.agg(
        n.alias("n_points"), F.count_distinct(condition).alias("n_conditions"),
        F.sum("n_trenches").alias("n_trenches"),
        F.when((n > 1) & (sst > 1e-20), 1 - F.sum(e * e) / sst).alias("fixed_theory_r2"),
        F.sqrt(F.avg(e * e)).alias("rmse_fraction"))
