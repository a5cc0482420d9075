"""Manifest faults and the whole chain on a small drawn study."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames_help import rows
from metrospan.operators.contracts import ContractViolation
from metrospan.operators.provenance import provenance
from metrospan.params import StudyParameters
from metrospan.plans import study as S

CFG = StudyParameters(w_um=10.0, h_um=10.0, tile_px=8, wall_margin_px=2, window_half_um=8.0, top_offset_um=20.0, ar_ladder=(9, 13),
                      allow_flagged_growth=True, inner_splits=2, map_ar_limit=5000.0)
H, W, SCALE = 48, 64, 0.5
PICTURE = "height int, width int, raster array<double>"
CONDITIONS = [(25.0, 10.0), (25.0, 20.0), (65.0, 10.0), (65.0, 20.0)]
ACQ = dict(session_id="S1", exposure_ms=10.0, gain=1.0, illumination_id="L1", magnification=20.0, bit_depth=16, auto_exposure="false",
           gamma=1.0, white_balance="fixed", color_channel="mono")
MATERIALS = dict(left_material="pdms", right_material="pdms", floor_material="glass", ceiling_material="pdms")


def drawn():
    rng = np.random.default_rng(0)
    images, labels, pixels = [], [], []
    for c, (t, g) in enumerate(CONDITIONS):
        for slot, ar in ((1, 9.0), (2, 13.0)):
            for pos in ("top", "bot"):
                i = f"{c}{slot}{pos}"
                nm = (60 + 15 * c) * (1.0 if pos == "top" else 0.9 - 0.02 * slot)
                z = 20.0 if pos == "top" else ar * 10 - 20
                images.append(dict(
                    image_id=i, path=f"raw/R{c + 1:02d}_C1_T{slot}_{pos}.tif", kind="trench", run_id=f"R{c + 1:02d}", chip=1, slot=slot, pos=pos,
                    condition_id=f"{t:g}C_G{g:g}_mass_pct", batch_id=f"B{c}", specimen_id=f"P{c}{slot}", matched_region_id=f"region-{i}",
                    measurement_id=f"M{i}", z_anchor_um=z, x_anchor_px=32.0, um_per_px=SCALE, scale_source="SYNTHETIC", scale_record="scale.txt",
                    orientation="x+", roi_mode="auto", roi_x0=None, roi_x1=None, roi_y0=None, roi_y1=None, mask_path=None, ref_id="REF1",
                    dark_id="DARK1", origin="SYNTHETIC", include="true", exclusion_reason=None, content_sha256=f"hash-{i}", **ACQ))
                labels.append((f"M{i}", f"R{c + 1:02d}", 1, slot, pos, nm, 1.0, 3, f"region-{i}", z - 8, z + 8, "validated_region_average"))
                trans = np.full((H, W), 0.95)
                trans[14:34] = 10 ** (-nm / 200)
                counts = np.round(1000 + 39000 * trans * (1 + rng.normal(0, 0.004, (H, W))))
                pixels.append((i, H, W, counts.ravel().tolist()))
    return images, labels, pixels


@pytest.fixture(scope="module")
def tables(spark):
    images, labels, pixels = drawn()
    schema = ", ".join(f"{k} {'double' if k in ('z_anchor_um', 'x_anchor_px', 'um_per_px', 'exposure_ms', 'gain', 'magnification', 'gamma') else 'int' if k in ('chip', 'slot', 'bit_depth', 'roi_x0', 'roi_x1', 'roi_y0', 'roi_y1') else 'string'}" for k in images[0])
    frame = lambda kind: dict(frame_id=f"{kind}1", path=f"raw/{kind}_S1.tif", kind=kind, **ACQ)
    flat = lambda key, v: spark.createDataFrame([(f"{key.split('_')[0].upper()}1", H, W, [v] * (H * W))], f"{key} string, {PICTURE}")
    growth = [(t, g, s, m, (1.5 + 0.01 * t + 0.02 * g) * m * (1 if s == "pdms" else 0.8) + 0.01 * (m % 3), f"{s}{m}", f"G{t}{g}{s}{m}", "ellipsometry", "log", "SYNTHETIC") for t, g in CONDITIONS for s in ("glass", "pdms") for m in (10.0, 20.0, 30.0, 40.0)]
    return dict(
        images=spark.createDataFrame([tuple(r.values()) for r in images], schema),
        runs=spark.createDataFrame([(f"R{c + 1:02d}", t, g, "mass_pct", 1, "2024-01-01", "S1", 1, 2.0, f"B{c}") for c, (t, g) in enumerate(CONDITIONS)],
                                   "run_id string, T_C double, gly_pct double, gly_basis string, rep int, date string, session_id string, cycles int, dep_time_h double, batch_id string"),
        layout=spark.createDataFrame([dict(slot=s, AR=a, L_um=a * 10, w_um=10.0, h_um=10.0, faces=4, **MATERIALS) for s, a in ((1, 9.0), (2, 13.0))]),
        frames=spark.createDataFrame([frame("REF"), frame("DARK")]),
        labels=spark.createDataFrame(labels, "measurement_id string, run_id string, chip int, slot int, pos string, thickness_nm double, thickness_sd_nm double, n_sites int, matched_region_id string, z_lo_um double, z_hi_um double, match_basis string"),
        pixels=spark.createDataFrame(pixels, f"image_id string, {PICTURE}"), ref=flat("ref_id", 40000.0), dark=flat("dark_id", 1000.0),
        growth=spark.createDataFrame(growth, "T_C double, gly_pct double, substrate string, t_min double, thickness_nm double, specimen_id string, measurement_id string, method string, source string, origin string"),
        viscosity=spark.createDataFrame([(t, g, 0.001 + 1e-5 * g - 5e-6 * t, 1e-5, "Pa_s", "mass_pct", "table", "SYNTHETIC") for t, g in CONDITIONS],
                                         "T_C double, gly_pct double, eta_Pa_s double, eta_sd_Pa_s double, eta_unit string, gly_basis string, source string, origin string"))


def build(t, **change):
    images = t["images"].withColumns({k: F.when(F.col("image_id") == "01top", F.lit(v)).otherwise(F.col(k)).alias(k) for k, v in change.items()}) if change else t["images"]
    return S.manifest(images, t["runs"], t["layout"], t["frames"], t["labels"], "SYNTHETIC", ("SYNTHETIC",))


@pytest.mark.parametrize("change,fault", [
    ({}, ""), ({"path": "../R01_C1_T1_top.tif"}, "path_outside_root"), ({"path": "raw/R01_C1_T2_top.tif"}, "name_fields"), ({"origin": "REAL"}, "origin_mismatch"),
    ({"kind": "flat"}, "kind_name_mismatch"), ({"ref_id": "DARK1"}, "ref_frame"), ({"dark_id": "none"}, "dark_frame"), ({"um_per_px": -1.0}, "pixel_scale"),
    ({"orientation": "z"}, "orientation"), ({"batch_id": "other"}, "run_fields"), ({"condition_id": "25C_G99_mass_pct"}, "condition_id"),
    ({"measurement_id": "nobody"}, "label_join"), ({"measurement_id": "M01bot"}, "label_registration"), ({"content_sha256": "hash-01bot"}, "duplicate_content"),
    ({"gamma": 2.2}, "acquisition"), ({"include": "maybe"}, "include_text"), ({"include": None}, "include_text"), ({"include": "false"}, "exclusion_reason"),
    ({"image_id": "a b"}, "image_id_text"), ({"specimen_id": None}, "missing_fields"), ({"roi_mode": "free"}, "roi_mode"), ({"matched_region_id": "region-01bot"}, "region_repeated"),
    ({"path": "raw/R01_C1_T1_bot.tif"}, "path_repeated"), ({"session_id": "S2"}, "run_fields"), ({"measurement_id": "M01bot"}, "label_shared")])
def test_manifest_faults(tables, change, fault):
    m, excluded = build(tables, **change)
    got = m.where("image_id in ('01top', 'a b')").first().faults.split(";")
    assert fault in got and (fault or m.where("faults <> ''").isEmpty()) and excluded.isEmpty()


def test_exclusion_keeps_the_row_aside(tables):
    m, excluded = build(tables, include="0", exclusion_reason="scratch")
    assert m.count() == 15 and rows(excluded, "image_id", "exclusion_reason") == [("01top", "scratch")]
    c = S.count_manifest(build(tables)[0]).first()
    assert (c.conditions, c.runs, c.trenches_observed, c.images, c.top_images, c.rois) == (4, 4, 8, 16, 8, 16)


def test_dependencies_share_frames(spark, tables):
    m, _ = build(tables)
    files = m.select("path").union(spark.createDataFrame([("raw/REF_S1.tif",), ("raw/DARK_S1.tif",), ("scale.txt",)], "path string")).distinct().withColumn("sha256", F.md5(F.col("path").cast("binary")))
    p = provenance(S.manifest_dependencies(m, files))
    assert {(r.path, r.n_images) for r in p.where("role like '%correction'").collect()} == {("raw/REF_S1.tif", 16), ("raw/DARK_S1.tif", 16)}
    assert p.count() == 19 and p.where("conflict").isEmpty()


def test_whole_chain(tables):
    m, _ = build(tables)
    out = S.run_study(m, tables["pixels"], tables["ref"], tables["dark"], tables["growth"], tables["viscosity"], CFG)
    regions = out["regions"]
    assert {(r.status, r.n_tiles) for r in regions.collect()} == {("PASS", 8)}
    first = regions.where("image_id = '01top'").first()
    assert (first.observed_z_lo_um, first.observed_z_hi_um) == (12.0, 28.0) and first.feature_od_mean == pytest.approx(0.3, abs=0.01)
    assert out["metrics"].first().r2 > 0.99 and out["oof"].count() == 16
    for source in ("cross_fitted", "label"):
        pairs = out[f"{source}_pairs"]
        assert {r.status for r in pairs.collect()} == {"PASS"} and pairs.count() == 8
        assert out[f"{source}_report"].first().n_points == 8
    assert {r.uncertainty_status for r in out["label_pairs"].collect()} == {"AVAILABLE"}
    assert {r.uncertainty_status for r in out["cross_fitted_pairs"].collect()} == {"NOT_AVAILABLE"}
    assert out["design"].count() == 8 and out["process"].count() == 336
    with pytest.raises(ContractViolation, match="acquisition"):
        S.run_study(build(tables, gamma=2.2)[0], tables["pixels"], tables["ref"], tables["dark"], tables["growth"], tables["viscosity"], CFG)


@pytest.mark.parametrize("table, column", [("growth", "method"), ("growth", "measurement_id"), ("viscosity", "eta_unit"), ("viscosity", "eta_sd_Pa_s")])
def test_calibration_contract_is_obligatory(tables, table, column):
    given = {k: tables[k].drop(column) if k == table else tables[k] for k in ("growth", "viscosity")}
    with pytest.raises(ContractViolation, match=column):
        S.calibrate(given["growth"], given["viscosity"], CFG)


def test_calibration_rules(tables):
    with pytest.raises(ContractViolation, match="unit"):
        S.calibrate(tables["growth"], tables["viscosity"].withColumn("eta_unit", F.lit("cP")), CFG)


def test_faulty_geometry_has_its_own_reason(tables):
    m, _ = build(tables)
    m = m.where("image_id like '0%'")
    manual = F.col("image_id").isin("01bot", "02top")
    m = m.withColumns({"roi_mode": F.when(manual, "manual").otherwise(F.col("roi_mode")), "x_anchor_px": F.when(F.col("image_id") == "01top", 70.0).otherwise(F.col("x_anchor_px")),
                       "w_um": F.when(F.col("image_id") == "02bot", 30.0).otherwise(F.col("w_um")),
                       **{f"roi_{k}": F.when(manual, F.lit(float(v))) for k, v in (("x0", 0), ("x1", 64), ("y0", 14), ("y1", 34))}})
    m = m.withColumns({"roi_x0": F.when(F.col("image_id") == "01bot", 0.5).otherwise(F.col("roi_x0")), "roi_y1": F.when(F.col("image_id") == "02top", 49.0).otherwise(F.col("roi_y1"))})
    regions, _, _ = S.extract_regions(tables["pixels"], m, tables["ref"], tables["dark"], CFG)
    assert rows(regions, "image_id", "reason") == [("01bot", "roi_not_integer"), ("01top", "invalid_anchor"), ("02bot", "width_exceeds_picture"), ("02top", "manual_edges_outside")]


def test_failing_images_keep_their_reason(tables):
    m, _ = build(tables)
    px = tables["pixels"]
    dark_image = (F.col("image_id") == "01top")
    blank = (F.col("image_id") == "02top")
    px = px.withColumn("raster", F.transform("raster", lambda v: F.when(dark_image, 500.0).when(blank, 20000.0).otherwise(v)))
    m = m.withColumn("z_anchor_um", F.when(F.col("image_id") == "11top", 2.0).otherwise(F.col("z_anchor_um")))
    m = m.withColumn("label_z_hi_um", F.when(F.col("image_id") == "12top", 40.0).otherwise(F.col("label_z_hi_um")))
    regions, _, qc = S.extract_regions(px, m, tables["ref"], tables["dark"], CFG)
    bad = {r.image_id: r.reason for r in regions.where("status = 'FAIL'").collect()}
    assert bad == {"01top": "invalid_pixels", "02top": "channel_not_found", "11top": "window_crosses_boundary", "12top": "label_support_differs"}
    assert qc.where("status = 'FAIL'").count() == 1 and regions.count() == 16


def test_turned_and_masked_images(spark, tables):
    m, _ = build(tables)
    m = m.where("image_id in ('01top', '02top', '11top')").withColumn("orientation", F.when(F.col("image_id") == "01top", "y+").when(F.col("image_id") == "02top", "y-").otherwise("x+"))
    m = m.withColumn("x_anchor_px", F.when(F.col("orientation") != "x+", 24.0).otherwise(F.col("x_anchor_px")))
    px = tables["pixels"].where("image_id in ('01top', '02top', '11top')")
    picture = np.full((W, H), 40000.0)  # canonical: height 64, width 48, the channel in rows 20 to 40
    picture[20:40] = 1000 + 39000 * 10 ** -0.3
    noise = np.random.default_rng(1).normal(0, 40, picture.shape)
    raw = {"01top": np.rot90(picture + noise, -1), "02top": np.rot90(picture + noise)}
    turned = spark.createDataFrame([(i, *a.shape, np.round(np.minimum(a, 39999)).ravel().tolist()) for i, a in raw.items()], f"image_id string, {PICTURE}")
    px = px.where("image_id = '11top'").unionByName(turned)
    half = np.repeat(np.arange(H) < 24, W).astype(float)
    mask = spark.createDataFrame([("02top", half.tolist())], "image_id string, raster array<double>")
    regions, tiles, _ = S.extract_regions(px, m, tables["ref"], tables["dark"], CFG, mask)
    got = {r.image_id: r for r in regions.collect()}
    assert got["01top"].n_tiles == 8 and got["11top"].n_tiles == 8 and got["01top"].feature_od_mean == pytest.approx(0.3, abs=0.01)
    # y-: canonical x = height - 1 - y, so the mask keeps the right half of the window.
    kept = {(r.x0, r.x1) for r in tiles.where("image_id = '02top' and complete").collect()}
    assert kept == {(24, 32), (32, 40)} and got["02top"].n_tiles == 4
