"""The study jobs: manifest, region features, and their end-to-end chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import (ACQUISITION_FIELDS, ORIENTATIONS, acquisition_faults, condition_key, is_contained_path, is_decimal_text, is_finite,
                               is_integer_valued, is_iso_date, parse_capture_name, same_field, with_capture_name, within)
from ..operators import pictures as A
from ..operators import pixels as P
from ..operators.contracts import ContractViolation, flags_text, inclusion
from ..operators.joins import exactly_one, optional_match, role_lookup

# Column groups of the data contract.
RUN_FIELDS = ("T_C", "gly_pct", "gly_basis", "rep", "date", "cycles", "dep_time_h")
LAYOUT_FIELDS = ("AR", "L_um", "w_um", "h_um", "faces", "left_material", "right_material", "floor_material",
                 "ceiling_material")
GROWTH_COLUMNS = ("T_C", "gly_pct", "substrate", "t_min", "thickness_nm", "measurement_id", "specimen_id", "method", "source", "origin")
VISCOSITY_COLUMNS = ("T_C", "gly_pct", "eta_Pa_s", "eta_sd_Pa_s", "eta_unit", "gly_basis", "source", "origin")
LABEL_FIELDS = ("run_id", "chip", "slot", "pos", "matched_region_id")


def count_manifest(d: DataFrame) -> DataFrame:
    """Distinct conditions, runs, replicates, chips, trenches and regions."""
    t = F.col("kind") == "trench"
    on = lambda *cols: F.count_distinct(*[F.when(t, F.col(c)) for c in cols])
    return d.agg(
        on("condition_id").alias("conditions"), on("run_id").alias("runs"),
        on("condition_id", "rep").alias("run_replicates"), on("run_id", "chip").alias("chips"),
        on("trench_id").alias("trenches_observed"), F.count(F.lit(1)).alias("images"),
        F.count_if(t & (F.col("pos") == "top")).alias("top_images"), F.count_if(t & (F.col("pos") == "bot")).alias("bot_images"),
        on("measurement_id").alias("measurements"), F.count_distinct("matched_region_id").alias("rois"))


def run_faults(basis: str) -> dict[str, Column]:
    """Faults of a row of the run table."""
    number = {c: F.col(c).try_cast("double") for c in ("T_C", "gly_pct", "rep", "cycles", "dep_time_h")}
    finite = reduce(lambda a, b: a & b, [is_finite(c) for c in number])
    return {
        "run_basis": ~F.coalesce(F.col("gly_basis") == basis, F.lit(False)),
        "run_ranges": ~F.coalesce(finite & number["gly_pct"].between(0, 100) & (number["T_C"] > -273.15)
                                  & (F.least(number["rep"], number["cycles"], number["dep_time_h"]) > 0), F.lit(False)),
        "run_counts": ~(is_integer_valued("rep") & is_integer_valued("cycles")),
        "run_date": ~is_iso_date("date"),
    }


def layout_faults() -> dict[str, Column]:
    """Faults of a row of the layout table."""
    ar, length, w, h = (F.col(c).try_cast("double") for c in ("AR", "L_um", "w_um", "h_um"))
    finite = reduce(lambda a, b: a & b, [is_finite(c) for c in ("AR", "L_um", "w_um", "h_um")])
    return {
        "layout_dimensions": ~F.coalesce(finite & (F.least(ar, length, w, h) > 0) & within(length, ar * w, 1e-6), F.lit(False)),
        "layout_slot": ~F.coalesce(is_integer_valued("slot") & (F.col("slot").try_cast("double") > 0), F.lit(False)),
        "layout_faces": ~F.coalesce(F.col("faces").try_cast("double").isin(2.0, 4.0), F.lit(False)),
    }


def mark_repeated(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Flag rows by key column: ``keys`` maps each to the name of its flag,
    true where the key's value occurs more than once.

    All keys are counted in one pass over (key, value) entries; only repeated
    values, usually very few, are written and joined back, so that the plan of
    ``df`` does not grow with the keys and the planner knows their size.
    """
    from ..session import stored
    entries = F.array(*[F.struct(F.lit(k).alias("_key"), F.col(k).cast("string").alias("_twice")) for k in keys])
    counted = df.select(F.inline(entries)).where("_twice is not null").groupBy("_key", "_twice").agg(F.count(F.lit(1)).alias("_n"))
    twice = stored(counted.where("_n > 1").drop("_n"), "repeated")
    for key, out in keys.items():
        own = twice.where(F.col("_key") == key).select("_twice")
        df = df.join(own, F.col(key).cast("string") == F.col("_twice"), "left").withColumn(out, F.col("_twice").isNotNull()).drop("_twice")
    return df


def manifest(images: DataFrame, runs: DataFrame, layout: DataFrame, frames: DataFrame, labels: DataFrame,
             origin: str, scale_sources: tuple[str, ...], gly_basis: str = "mass_pct") -> tuple[DataFrame, DataFrame]:
    """One row per image that is not excluded with everything it depends on.

    Returns (manifest, excluded images).  A row that breaks the contract keeps
    its place with the names of its ``faults``; an image whose ``include`` is
    neither yes nor no, or that is excluded without a reason, is such a row.
    Rows in are rows out of the two tables together.  ``images`` carries a
    ``content_sha256`` of its pixels (see pixel_digest).
    """
    excluded = images.limit(0)
    if "include" in images.columns:
        reason = "exclusion_reason" if "exclusion_reason" in images.columns else "include"
        marked = images.withColumn("_inclusion", inclusion("include", reason))
        excluded, images = marked.where("_inclusion = 'excluded'").drop("_inclusion"), marked.where("_inclusion <> 'excluded'")
    else:
        images = images.withColumn("_inclusion", F.lit("included"))
    m = with_capture_name(images, F.element_at(F.split("path", "/"), -1), "_name")
    m = m.withColumn("_asked", F.when(~F.col("measurement_id").rlike(r"^\s*$"), F.col("measurement_id")))
    m = mark_repeated(m, {key: f"_twice_{key}" for key in ("content_sha256", "image_id", "path", "matched_region_id", "_asked")})
    file_name = parse_capture_name(F.element_at(F.split("path", "/"), -1))
    frames = frames.select("*", file_name["kind"].alias("name_kind"), file_name["session_id"].alias("name_session"),
                           reduce(lambda a, b: a | b, acquisition_faults().values()).alias("acquisition_fault"))
    m = role_lookup(m, frames, {"ref_id": "REF", "dark_id": "DARK"}, "frame_id", "kind", list(ACQUISITION_FIELDS),
                    ["path", "name_kind", "name_session", "acquisition_fault"])
    # The condition key and the contract of a run belong to the run: built per run, not per image.
    run_side = runs.select("run_id", *RUN_FIELDS, F.col("session_id").alias("_run_session"), F.col("batch_id").alias("_run_batch"),
                           condition_key("T_C", "gly_pct", "gly_basis").alias("_run_key"), flags_text(run_faults(gly_basis)).alias("_run_faults"))
    m = exactly_one(m, run_side, ["run_id"], [*RUN_FIELDS, "_run_session", "_run_batch", "_run_key", "_run_faults"]).withColumnRenamed("match_status", "_run_status")
    plan = layout.select("slot", *LAYOUT_FIELDS, flags_text(layout_faults()).alias("_layout_faults"))
    m = exactly_one(m, plan, ["slot"], [*LAYOUT_FIELDS, "_layout_faults"]).withColumnRenamed("match_status", "_layout_status")
    lab = mark_repeated(labels, {"matched_region_id": "_l_twice"})
    lab = lab.select("measurement_id", *[F.col(c).alias(f"_l_{c}") for c in LABEL_FIELDS],
                     F.col("thickness_nm").alias("label_nm"), F.col("thickness_sd_nm").alias("label_sd_nm"),
                     F.col("z_lo_um").alias("label_z_lo_um"), F.col("z_hi_um").alias("label_z_hi_um"), "match_basis",
                     F.col("n_sites").alias("_sites"), "_l_twice")
    m = optional_match(m, lab, "_asked", "measurement_id", [c for c in lab.columns if c != "measurement_id"])

    trench, flat = F.col("kind") == "trench", F.col("kind") == "flat"
    name = F.col("_name")
    agree = reduce(lambda a, b: a & b, [same_field(c, name[c]) for c in ("run_id", "chip", "slot", "pos")])
    key = F.when(trench, F.col("_run_key")).when(flat, condition_key(name["T_C"], name["gly_pct"], F.lit(gly_basis)))
    flat_fields = [F.col(c).isNull() | same_field(c, name[c]) for c in ("T_C", "gly_pct", "substrate", "t_min") if c in images.columns]
    labelled = F.col("label_status") == "ok"
    registered = reduce(lambda a, b: a & b, [same_field(c, f"_l_{c}") for c in LABEL_FIELDS])
    numbers = reduce(lambda a, b: a & b, [is_finite(c) for c in ("label_nm", "label_sd_nm", "_sites", "label_z_lo_um", "label_z_hi_um")])
    valid_label = (numbers & (F.col("label_nm") > 0) & (F.col("label_sd_nm") >= 0) & (F.col("_sites") >= 1) & is_integer_valued("_sites")
                   & (F.col("label_z_lo_um") >= 0) & (F.col("label_z_lo_um") < F.col("label_z_hi_um"))
                   & (F.col("label_z_hi_um") <= F.col("L_um")) & (F.col("match_basis") == "validated_region_average"))
    no = lambda c: ~F.coalesce(c, F.lit(False))

    def frame_name(role: str, kind: str) -> Column:
        named = (F.col(f"{role}_name_kind") == kind) & (F.col(f"{role}_name_session") == F.col("session_id")) & ~F.col(f"{role}_acquisition_fault")
        return (F.col(f"{role}_status") == "ok") & no(named)

    required = ["condition_id", "batch_id", "specimen_id", "matched_region_id"]
    faults = {
        "include_text": F.col("_inclusion") == "include_text",
        "exclusion_reason": F.col("_inclusion") == "exclusion_reason",
        "image_id_text": no(F.col("image_id").rlike("^[A-Za-z0-9_.-]+$") & ~F.col("image_id").isin(".", "..")),
        "image_id_repeated": F.col("_twice_image_id"),
        "path_repeated": F.col("_twice_path"),
        "region_repeated": F.col("_twice_matched_region_id"),
        "missing_fields": reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required]),
        "path_outside_root": no(is_contained_path("path")),
        "origin_mismatch": no(F.col("origin") == origin),
        "kind_name_mismatch": no(F.col("kind") == name["kind"]),
        "acquisition": reduce(lambda a, b: a | b, acquisition_faults().values()),
        "ref_frame": F.col("ref_id_status") != "ok",
        "dark_frame": F.col("dark_id_status") != "ok",
        "ref_frame_name": frame_name("ref_id", "REF"),
        "dark_frame_name": frame_name("dark_id", "DARK"),
        "pixel_scale": ~is_decimal_text("um_per_px") | no(F.col("scale_source").isin(*scale_sources)),
        "orientation": no(F.col("orientation").isin(*ORIENTATIONS)),
        "roi_mode": no(F.col("roi_mode").isin("auto", "manual")),
        "name_fields": trench & no(agree),
        "flat_fields": flat & no(reduce(lambda a, b: a & b, flat_fields, F.lit(True))),
        "run_join": trench & (F.col("_run_status") != "ok"),
        "layout_join": trench & (F.col("_layout_status") != "ok"),
        "run_fields": trench & (F.col("_run_status") == "ok") & no((F.col("_run_session") == F.col("session_id")) & (F.col("_run_batch") == F.col("batch_id"))),
        "run_values": trench & (F.col("_run_faults") != ""),
        "layout_values": trench & (F.col("_layout_faults") != ""),
        "condition_id": (flat | (F.col("_run_status") == "ok")) & no(key == F.col("condition_id")),
        "label_join": trench & F.col("label_status").isin("missing_label", "ambiguous_label"),
        "label_region_repeated": trench & labelled & F.col("_l_twice"),
        "label_registration": trench & labelled & no(registered),
        "label_values": trench & labelled & no(valid_label),
        "label_shared": trench & labelled & F.col("_twice__asked"),
        "duplicate_content": F.col("_twice_content_sha256"),
    }
    trench_id = F.concat_ws("_", F.col("run_id"), F.concat(F.lit("C"), F.col("chip").cast("int").cast("string")),
                            F.concat(F.lit("T"), F.col("slot").cast("int").cast("string")))
    # As an array for the same reason as in role_lookup: small generated methods.
    named = F.filter(F.array(*[F.when(c, F.lit(fault)) for fault, c in faults.items()]), lambda v: v.isNotNull())
    m = m.withColumns({"faults": F.array_join(named, ";"), "trench_id": F.when(trench, trench_id), "um_per_px": F.col("um_per_px").try_cast("double")})
    extra = [f"{r}_{c}" for r in ("ref_id", "dark_id") for c in ("name_kind", "name_session", "acquisition_fault")]
    return m.drop(*[c for c in m.columns if c.startswith("_")], *extra), excluded


def manifest_dependencies(m: DataFrame, files: DataFrame) -> DataFrame:
    """(path, role, usage, sha256, image) of every file a manifest row uses.

    ``files`` is (path, sha256) relative to the study root; each role joins it
    once on the path, so a shared frame is hashed once and never copied.
    """
    roles = {"image_pixels": ("path", "numerical_input"), "reference_correction": ("ref_id_path", "numerical_input"),
             "dark_correction": ("dark_id_path", "numerical_input"), "roi_mask": ("mask_path", "numerical_input"),
             "scale_evidence": ("scale_record", "evidence_only")}
    entries = F.array(*[F.struct(F.col(c).cast("string").alias("path"), F.lit(role).alias("role"), F.lit(usage).alias("usage"))
                        for role, (c, usage) in roles.items() if c in m.columns])
    long = m.select(F.col("image_id").cast("string").alias("image_id"), F.inline(entries)).where(
        F.col("path").isNotNull() & ~F.col("path").rlike(r"^\s*$"))
    return long.join(files.select("path", "sha256"), "path", "left")


def region_boxes(images: DataFrame, edges: DataFrame, cfg) -> DataFrame:
    """Pixel box of each region with the reason when it has none.

    ``images`` has the ``height`` and ``width`` of each picture in canonical
    orientation, where boxes lie.  Manual coordinates must be whole numbers."""
    height, width = F.col("height"), F.col("width")
    b = images.join(edges.select("image_id", F.col("y0").alias("_e0"), F.col("y1").alias("_e1"), "ambiguous"), "image_id", "left")
    trench, manual = F.col("kind") == "trench", F.col("roi_mode") == "manual"
    half = cfg.window_half_um / F.col("um_per_px")
    expected = F.col("w_um") / F.col("um_per_px")
    lo_y, hi_y = (F.when(manual, F.col(f"roi_y{k}")).otherwise(F.col(f"_e{k}")) for k in (0, 1))
    x0, x1 = F.ceil(F.col("x_anchor_px") - half), F.floor(F.col("x_anchor_px") + half)
    y0, y1 = lo_y + cfg.wall_margin_px, hi_y - cfg.wall_margin_px
    given = [F.col(f"roi_{k}").cast("double") for k in ("x0", "x1", "y0", "y1")]
    whole = reduce(lambda a, c: a & c, [F.coalesce(g == F.floor(g), F.lit(False)) for g in given])

    def box(auto: Column, roi: str, f, free: int | Column) -> Column:
        free = F.when(manual, F.col(roi)).otherwise(F.lit(free) if isinstance(free, int) else free)
        return F.when(trench, F.when(manual, f(auto, F.col(roi))).otherwise(auto)).otherwise(free).cast("int")

    b = b.withColumns({"x0": box(x0, "roi_x0", F.greatest, 0), "x1": box(x1, "roi_x1", F.least, width),
                       "y0": box(y0, "roi_y0", F.greatest, 0), "y1": box(y1, "roi_y1", F.least, height)})
    z, anchor = F.col("z_anchor_um"), F.col("x_anchor_px")
    reason = (
        F.when(manual & ~whole, "roi_not_integer")
        .when(trench & ~manual & ~((expected > 0) & (expected < height)), "width_exceeds_picture")
        .when(trench & ~manual & F.col("_e0").isNull(), "channel_not_found")
        .when(trench & ~manual & F.col("ambiguous"), "ambiguous_channel")
        .when(trench & manual & ~((lo_y >= 0) & (lo_y < hi_y) & (hi_y <= height)), "manual_edges_outside")
        .when(trench & manual & ~(hi_y - lo_y).between(0.75 * expected, 1.25 * expected), "manual_width")
        .when(trench & ~F.coalesce(z.between(0, F.col("L_um")) & anchor.between(0, width), F.lit(False)), "invalid_anchor")
        .when(trench & ((z - cfg.window_half_um < 0) | (z + cfg.window_half_um > F.col("L_um"))), "window_crosses_boundary")
        .when((F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > width) | (F.col("y1") > height), "outside_image")
        .when(F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < cfg.tile_px, "tile_exceeds_region")
        .otherwise(""))
    return b.withColumn("box_reason", F.coalesce(reason, F.lit("missing_geometry"))).drop("_e0", "_e1", "ambiguous")


def extract_regions(pictures: DataFrame, images: DataFrame, ref: DataFrame, dark: DataFrame, cfg, mask: DataFrame | None = None,
                    contrast: tuple = ((8, 8), 2.0, 256)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pictures to region features: (regions, tiles, image QC).

    ``pictures`` is (image_id, height, width, raster), ``ref``/``dark`` are
    (ref_id / dark_id, height, width, raster) in the same raw orientation,
    ``mask`` (image_id, raster: 1 inside) too; an image without a mask row has
    no mask.  Pictures of any sizes may mix.  ``contrast`` holds grid, clip and
    bins of the texture.  A failing image keeps its row and reason; the others
    go on.  Pictures are corrected once and stored; what follows moves rows of
    images and tiles.
    """
    from ..session import durable
    grid, clip, bins = contrast
    raw = pictures.join(images.select("image_id", "orientation", "ref_id", "dark_id", (F.pow(F.lit(2.0), F.col("bit_depth")) - 1).alias("_top")), "image_id")
    if mask is not None:
        raw = raw.join(mask.select("image_id", F.col("raster").alias("_mask_raster")), "image_id", "left")
    corrected = durable(A.correct_pictures(raw, ref, dark, "image_id", "ref_id", "dark_id", "_top", cfg.t_min, cfg.t_max, cfg.invalid_pixel_fraction_max,
                                           "orientation", "_mask_raster" if mask is not None else None, grid, clip, bins))
    qc = corrected.select("image_id", *A.FAULTS, "invalid_pixels", "total_pixels", F.col("qc_status").alias("status"))
    widths = images.where("kind = 'trench' and roi_mode = 'auto'").select("image_id", (F.col("w_um") / F.col("um_per_px")).alias("_w"))
    edges = P.detect_channel(corrected.join(widths, "image_id"), "image_id", "texture", "_w")
    boxes = durable(region_boxes(images.join(corrected.select("image_id", "height", "width"), "image_id", "left"), edges, cfg).drop("height", "width"))
    inside = corrected.join(boxes.where("box_reason = ''").select("image_id", *[F.col(c).alias(f"_{c}") for c in ("x0", "x1", "y0", "y1")]), "image_id")
    tiles = durable(A.tile_features(inside, "image_id", cfg.tile_px, ["_x0", "_x1", "_y0", "_y1"]))

    base = boxes.drop("x0", "x1", "y0", "y1").join(qc.select("image_id", F.col("status").alias("qc_status")), "image_id", "left")
    base = base.withColumn("labelled", F.col("label_nm").isNotNull())
    regions = P.roi_features(tiles, base, "image_id", "labelled")
    um = F.col("z_anchor_um") + (F.col("x0") - F.col("x_anchor_px")) * F.col("um_per_px")
    um1 = F.col("z_anchor_um") + (F.col("x1") - F.col("x_anchor_px")) * F.col("um_per_px")
    spans = (tiles.where("complete and all_valid").join(images.where("kind = 'trench'").select("image_id", "z_anchor_um", "x_anchor_px", "um_per_px"), "image_id")
             .groupBy("image_id").agg(
                 F.sort_array(F.collect_set(F.struct(um.alias("lo"), um1.alias("hi")))).alias("observed_intervals"),
                 F.min(um).alias("observed_z_lo_um"), F.max(um1).alias("observed_z_hi_um")))
    regions = regions.join(spans, "image_id", "left")
    gaps = F.exists(F.zip_with(F.slice("observed_intervals", 2, F.greatest(F.lit(0), F.size("observed_intervals") - 1)),
                               F.slice("observed_intervals", 1, F.greatest(F.lit(0), F.size("observed_intervals") - 1)),
                               lambda b, a: F.abs(b["lo"] - a["hi"]) > 1e-8), lambda g: g)
    far = 0.51 * F.col("um_per_px")
    support = ((F.abs(F.col("observed_z_lo_um") - F.col("label_z_lo_um")) > far)
               | (F.abs(F.col("observed_z_hi_um") - F.col("label_z_hi_um")) > far))
    on_label = F.col("labelled") & (F.col("kind") == "trench") & (F.col("status") == "PASS")
    reason = (F.when(F.col("qc_status") == "FAIL", "invalid_pixels").when(F.col("box_reason") != "", F.col("box_reason"))
              .when(F.col("reason") != "", F.col("reason")).when(on_label & support, "label_support_differs")
              .when(on_label & gaps, "untiled_gaps_in_label_region").otherwise(""))
    regions = regions.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "PASS").otherwise("FAIL"))
    return regions.drop("box_reason", "labelled"), tiles, qc


def calibrate(thickness: DataFrame, viscosity: DataFrame, cfg) -> tuple[DataFrame, DataFrame]:
    """Growth lines and the per-condition calibration.  A table without the
    columns of its contract is refused, as is one that breaks a rule."""
    from ..operators.contracts import raise_on_violation, require_columns
    from ..operators.regression import annotated_lines, calibration_table, growth_violations, viscosity_violations
    sd = "thickness_sd_nm" if "thickness_sd_nm" in thickness.columns else None
    require_columns(thickness, GROWTH_COLUMNS)
    require_columns(viscosity, VISCOSITY_COLUMNS)
    raise_on_violation(growth_violations(thickness, cfg.origin))
    raise_on_violation(viscosity_violations(viscosity, cfg.origin, cfg.gly_basis))
    lines = annotated_lines(thickness, ["T_C", "gly_pct", "substrate"], "t_min", "thickness_nm", cluster="specimen_id", known_sd=sd,
                            concentration="C0_mol_m3" if "C0_mol_m3" in thickness.columns else None, nominal=cfg.C0_mol_m3, levels=(10.0, 20.0, 30.0, 40.0),
                            induction_fraction=cfg.induction_fraction, nonlinear_alpha=cfg.nonlinear_alpha)
    return lines, calibration_table(lines, viscosity, ["T_C", "gly_pct"], cfg)


FEATURES = tuple(f"feature_{f}" for f in P.TILE_FEATURES)
PAIR_FIELDS = ["condition_id", "specimen_id", "batch_id", "AR", "L_um", "w_um", "h_um", "faces", "left_material",
               "right_material", "floor_material", "ceiling_material", "T_C", "gly_pct"]


def score_source(regions: DataFrame, calibration: DataFrame, value: str, role: str | None, cfg, used: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pairs, pair summary, theory scores, points and report of one value
    column; ``used`` are the ids of the calibration's specimens and
    measurements, which no scored pair may share."""
    from ..operators import pairs as Q
    rows = regions.where("kind = 'trench'")
    if role is None:
        rows = rows.withColumn("prediction_role", F.lit("independent_measurement"))
    pairs = Q.pair_ratio(rows, "trench_id", "pos", value, PAIR_FIELDS, min_top=cfg.min_top_nm, sd="label_sd_nm" if role is None else None,
                         carry=["observed_intervals", "measurement_id"])
    pairs = pairs.withColumns({"prediction_role": F.col("top_prediction_role"), "top_intervals": F.col("top_observed_intervals"),
                               "bot_intervals": F.col("bot_observed_intervals")})
    scored = Q.theory_scores(pairs, calibration, ["T_C", "gly_pct"], used, ["specimen_id", "top_measurement_id", "bot_measurement_id"])
    points = Q.theory_points(scored, ["condition_id", "AR"])
    return {"pairs": pairs, "summary": Q.pair_summary(pairs, ["condition_id", "AR"], "specimen_id", "batch_id"),
            "scores": scored, "violations": Q.score_violations(scored), "points": points, "report": Q.theory_report(points, "condition_id")}


def refuse(bad: DataFrame, key: str | Column, reason: str, what: str) -> None:
    """Raise with the number of offending rows per reason and one example each;
    the rows themselves stay in the table that was given."""
    key = F.col(key) if isinstance(key, str) else key
    found = bad.groupBy(F.col(reason).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min(key.cast("string")).alias("e")).orderBy("r").collect()
    if found:
        raise ContractViolation(f"{sum(r['n'] for r in found)} {what}: " + "; ".join(f"{r['r']} ({r['n']}, e.g. {r['e']})" for r in found))


def run_study(m: DataFrame, pictures: DataFrame, ref: DataFrame, dark: DataFrame, thickness: DataFrame, viscosity: DataFrame,
              cfg, mask: DataFrame | None = None, alphas=(0.01, 0.1, 1.0)) -> dict[str, DataFrame]:
    """The whole chain on an accepted manifest; each stage is cut once where
    several later stages read it."""
    from ..operators import grid as G
    from ..operators import metrics as X
    from ..operators import models as M
    from ..session import durable
    refuse(m.where("faults <> ''"), "image_id", "faults", "images with faults")
    lines, cal = calibrate(thickness, viscosity, cfg)
    used = thickness.select(F.explode(F.array(*[F.col(c).cast("string") for c in ("specimen_id", "measurement_id") if c in thickness.columns])).alias("id")).distinct()
    cal = durable(cal)
    refuse(cal.where("status <> 'OK'"), F.concat_ws("/", "T_C", "gly_pct"), "status", "conditions without a calibration")
    regions, tiles, qc = extract_regions(pictures, m, ref, dark, cfg, mask)
    regions = durable(regions)
    labelled = regions.where("status = 'PASS' and label_nm is not null and kind = 'trench'")
    features = [f for f in FEATURES]
    scores, chosen = M.nested_ridge(labelled, "condition_id", features, "label_nm", list(alphas), cfg.inner_splits)
    oof = durable(M.linear_predictions(labelled, chosen.select("outer", "alpha", "coef"), "condition_id", features, "label_nm", labelled, "pred_nm")
                  .withColumn("prediction_role", F.lit("cross_fitted")))
    out = {"lines": lines, "calibration": cal, "design": G.design_grid(cal, cfg), "regions": regions, "tiles": tiles, "qc": qc,
           "candidates": scores, "oof": oof, "metrics": X.regression_metrics(oof, "label_nm", "pred_nm"),
           "balanced": X.balanced_rmse(oof, "label_nm", "pred_nm", "condition_id"), "process": G.process_grid(cal, cfg)}
    out |= {f"cross_fitted_{k}": v for k, v in score_source(oof, cal, "pred_nm", "prediction_role", cfg, used).items()}
    out |= {f"label_{k}": v for k, v in score_source(labelled, cal, "label_nm", None, cfg, used).items()}
    return out
