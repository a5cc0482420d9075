import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames_help import rows
from metrospan.operators import pictures as A, pixels as P


def frame(spark, arrays, key="image_id"):
    data = [(k, y, x, float(a[y, x])) for k, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(data, f"{key} string, y int, x int, value double")


def grid(df, image, col, shape):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("image_id") == image).select("y", "x", F.col(col).alias("v")).collect():
        out[r.y, r.x] = np.nan if r.v is None else r.v
    return out


def picture(spark, arrays, key="image_id", out="raster"):
    data = [(k, *a.shape, [None if np.isnan(v) else float(v) for v in np.ravel(a)]) for k, a in arrays.items()]
    return spark.createDataFrame(data, f"{key} string, height int, width int, {out} array<double>")


def corrected(spark, image, ref=41000.0, dark=1000.0, maximum=65535, orientation=None, mask=None):
    r, d = (picture(spark, {"f": np.full(image.shape, v)}, kk) for v, kk in ((ref, "ref_id"), (dark, "dark_id")))
    p = picture(spark, {"a": image}).withColumns({"ref_id": F.lit("f"), "dark_id": F.lit("f"), "top": F.lit(maximum), "o": F.lit(orientation or "x+")})
    if mask is not None:
        p = p.withColumn("m", F.array(*[F.lit(float(v)) for v in mask.ravel()]))
    return A.correct_pictures(p, r, d, "image_id", "ref_id", "dark_id", "top", 1e-4, 2.0, 0.01, "o", "m" if mask is not None else None)


def field(df, image, col):
    r = df.where(F.col("image_id") == image).first()
    return np.array([np.nan if v is None else v for v in r[col]], float).reshape(r.height, r.width)


def test_half_transmission(spark):
    r = corrected(spark, np.full((4, 4), 21000.0)).first()
    assert set(r["T"]) == {0.5} and {round(v, 12) for v in r.od} == {round(math.log10(2), 12)} and r.qc_status == "PASS"


@pytest.mark.parametrize("change,count", [({"ref": 1000.0}, "zero_denominator_pixels"), ({"maximum": 20000}, "saturated_pixels"),
                                          ({"dark": 21000.0}, "nonpositive_signal_pixels"), ({"ref": 11000.0, "dark": 10999.0}, "high_t_pixels")])
def test_faulty_pixels_are_null_never_clipped(spark, change, count):
    r = corrected(spark, np.full((4, 4), 21000.0), **change).first()
    assert r[count] == 16 and r.qc_status == "FAIL" and set(r["T"]) == {None} and set(r.od) == {None}


def test_pictures_of_several_sizes_and_faulty_ones(spark):
    rng = np.random.default_rng(9)
    wide, tall = rng.uniform(2000, 30000, (3, 5)), rng.uniform(2000, 30000, (6, 2))
    p = picture(spark, {"wide": wide, "tall": tall, "gone": wide})
    p = p.withColumns({"raster": F.when(F.col("image_id") == "gone", F.slice("raster", 1, 4)).otherwise(F.col("raster")),
                       "ref_id": F.lit("f"), "dark_id": F.when(F.col("image_id") == "tall", "none").otherwise("f"), "top": F.lit(65535)})
    r, d = (picture(spark, {"f": np.full((3, 5), v)}, k) for v, k in ((41000.0, "ref_id"), (1000.0, "dark_id")))
    c = A.correct_pictures(p, r, d, "image_id", "ref_id", "dark_id", "top", 1e-4, 2.0, 0.01)
    assert np.allclose(field(c, "wide", "T"), (wide - 1000) / 40000)
    got = {x.image_id: (x.height, x.width, x.invalid_pixels, x.total_pixels, x.qc_status) for x in c.collect()}
    assert got == {"wide": (3, 5, 0, 15, "PASS"), "tall": (6, 2, 12, 12, "FAIL"), "gone": (0, 0, 0, 0, "FAIL")}


@pytest.mark.parametrize("o,turn", [("x+", lambda a: a), ("x-", lambda a: a[:, ::-1]), ("y+", np.rot90), ("y-", lambda a: np.rot90(a, -1))])
def test_corrected_pictures_turn_with_their_mask(spark, o, turn):
    a = np.arange(2000.0, 14000.0, 1000).reshape(3, 4)
    c = corrected(spark, a, orientation=o, mask=(a > 5000).astype(float))
    assert np.allclose(field(c, "a", "T"), turn((a - 1000) / 40000)) and np.array_equal(field(c, "a", "mask") == 1, turn(a > 5000))


def test_channel_of_an_interleaved_array(spark):
    df = spark.createDataFrame([("a", [1, 10, 100, 2, 20, 200], 1, 2)], "image_id string, v array<int>, h int, w int")
    assert A.pictures_from_array(df, "image_id", "v", "h", "w", channels=3, channel=1).first().raster == [10.0, 20.0]
    px = A.pixels_of(A.pictures_from_array(df, "image_id", "v", "h", "w", 3, 2), "image_id", ["raster"])
    assert rows(px, "y", "x", "raster") == [(0, 0, 100.0), (0, 1, 200.0)]


@pytest.mark.parametrize("o,turn", [("x+", lambda a: a), ("x-", lambda a: a[:, ::-1]), ("y+", np.rot90), ("y-", lambda a: np.rot90(a, -1))])
def test_orientations(spark, o, turn):
    a = np.arange(12.0).reshape(3, 4)
    t = P.canonical(frame(spark, {"a": a}).withColumn("o", F.lit(o)), "o", 3, 4)
    want = turn(a)
    got = grid(t.drop("y", "x").withColumnsRenamed({"cy": "y", "cx": "x"}), "a", "value", want.shape)
    assert np.array_equal(got, want)


def brute_equalize(v, grid_shape, clip, bins):
    h, w = v.shape
    ny, nx = min(grid_shape[0], h), min(grid_shape[1], w)
    ye, xe = [i * h // ny for i in range(ny + 1)], [i * w // nx for i in range(nx + 1)]
    q = [[min(int(v[y, x] * bins), bins - 1) for x in range(w)] for y in range(h)]
    table = {}
    for i in range(ny):
        for j in range(nx):
            cell = [q[y][x] for y in range(ye[i], ye[i + 1]) for x in range(xe[j], xe[j + 1])]
            cap = max(1.0, clip * len(cell) / bins)
            kept = [min(cell.count(b), cap) for b in range(bins)]
            extra = (len(cell) - sum(kept)) / bins
            table[i, j] = [sum(kept[: b + 1]) / len(cell) + (b + 1) * extra / len(cell) for b in range(bins)]

    def side(p, e, n):
        c = [(e[k] + e[k + 1] - 1) / 2 for k in range(n)]
        if p <= c[0]:
            return [(0, 1.0)]
        for k in range(n - 1):
            if p <= c[k + 1]:
                t = (p - c[k]) / (c[k + 1] - c[k])
                return [(k, 1 - t), (k + 1, t)]
        return [(n - 1, 1.0)]
    return np.array([[sum(a * b * table[i, j][q[y][x]] for i, a in side(y, ye, ny) for j, b in side(x, xe, nx)) for x in range(w)] for y in range(h)])


def test_equalisation_against_brute_force():
    rng = np.random.default_rng(2)
    a, flat = rng.random((11, 13)), np.full((11, 13), 0.4)
    assert np.allclose(A.equalize(a, (3, 4), 2.0, 32), brute_equalize(a, (3, 4), 2.0, 32), atol=1e-12)
    assert np.allclose(A.equalize(a[:2, :1], (3, 4), 2.0, 32), brute_equalize(a[:2, :1], (3, 4), 2.0, 32), atol=1e-12)
    assert np.array_equal(A.equalize(flat), flat)


def test_smoothing_mirrors_edges(spark):
    v = np.random.default_rng(3).random(9)
    d = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, i int, v double")
    w = P.gaussian_weights(0.6)
    padded = np.concatenate([v[:2][::-1], v, v[-2:][::-1]])
    want = [float(np.dot(w, padded[i:i + 5])) for i in range(9)]
    got = [r.s for r in P.smooth(d, ["k"], "i", "v", w, "s").orderBy("i").collect()]
    assert len(w) == 5 and got == pytest.approx(want)


def test_peaks_and_pairs_against_brute_force(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.random(60), 1)
    d = spark.createDataFrame([("a", i, float(x), 0.3) for i, x in enumerate(v)], "k string, i int, v double, h double")
    found, i = [], 1
    while i < 59:
        j = i
        while j < 59 and v[j + 1] == v[i]:
            j += 1
        if j < 59 and v[i - 1] < v[i] > v[j + 1] and v[i] >= 0.3:
            found.append((v[i], (i + j) // 2))
        i = j + 1
    kept = []
    for _, p in sorted(found, reverse=True):
        if all(abs(p - k) >= 3 for k in kept):
            kept.append(p)
    peaks = P.local_peaks(d, ["k"], "i", "v", "h")
    assert [r[0] for r in rows(peaks, "i")] == sorted(kept)
    want = sorted((a + 1, b + 1) for a in kept for b in kept if 0.85 * 10 <= b - a <= 1.15 * 10)
    assert rows(P.peak_pairs(peaks.withColumn("w", F.lit(10.0)), ["k"], "i", "v", "w"), "y0", "y1") == want


def test_channel_found_and_ambiguity(spark):
    a = np.full((40, 12), 0.2)
    a[12:26] = 0.8
    b = np.full((60, 9), 0.2)
    b[10:20], b[30:40] = 0.8, 0.8
    p = picture(spark, {"one": a, "two": b}).withColumn("w", F.when(F.col("image_id") == "one", 14.0).otherwise(10.0))
    assert rows(P.detect_channel(p, "image_id", "raster", "w"), "image_id", "y0", "y1", "ambiguous") == [("one", 12, 26, False), ("two", 30, 40, True)]


def ready(spark, arrays, bad=lambda k: None, mask=lambda k: 1.0):
    """Corrected picture rows made by hand."""
    out = []
    for k, a in arrays.items():
        t = a.copy()
        if bad(k):
            t[bad(k)] = np.nan
        out.append((k, *a.shape, *[[None if np.isnan(v) else float(v) for v in np.ravel(x)] for x in (t, -np.log10(t), np.isfinite(t).astype(float), np.full(a.shape, mask(k)), a)]))
    return spark.createDataFrame(out, "image_id string, height int, width int, " + ", ".join(f"{c} array<double>" for c in ("T", "od", "valid", "mask", "texture")))


def test_tile_features_match_numpy(spark):
    a = np.random.default_rng(5).random((9, 10)) + 0.1
    t = A.tile_features(ready(spark, {"a": a}), "image_id", 4).orderBy("ty", "tx").collect()
    assert [(r.x0, r.x1, r.y0, r.y1) for r in t] == [(1, 5, 0, 4), (5, 9, 0, 4), (1, 5, 4, 8), (5, 9, 4, 8)]  # centred
    tile = a[0:4, 1:5]
    gy, gx = np.gradient(tile)
    pad = np.pad(tile, 1, mode="symmetric")
    mean = sum(pad[i:i + 4, j:j + 4] for i in range(3) for j in range(3)) / 9
    od = -np.log10(tile)
    want = [od.mean(), od.std(), np.quantile(od, 0.1), np.quantile(od, 0.9), tile.mean(), np.hypot(gx, gy).mean(), np.abs(tile - mean).mean()]
    assert [t[0][f] for f in P.TILE_FEATURES] == pytest.approx(want)
    boxed = ready(spark, {"a": a}).withColumns({k: F.lit(v) for k, v in (("x0", 2), ("x1", 10), ("y0", 1), ("y1", 6))})
    assert rows(A.tile_features(boxed, "image_id", 4, ["x0", "x1", "y0", "y1"]), "x0", "y0") == [(2, 1), (6, 1)]
    assert A.tile_features(boxed.withColumn("x1", F.lit(11)), "image_id", 4, ["x0", "x1", "y0", "y1"]).isEmpty()


def test_region_statuses(spark):
    rng = np.random.default_rng(6)
    p = ready(spark, {k: rng.random((8, 8)) + 0.1 for k in ("good", "hole", "label", "cut")}, lambda k: (1, 1) if k in ("hole", "label") else None, lambda k: float(k != "cut"))
    tiles = A.tile_features(p, "image_id", 4)
    images = spark.createDataFrame([("good", True), ("hole", False), ("label", True), ("cut", False), ("gone", False)], "image_id string, labelled boolean")
    r = P.roi_features(tiles, images, "image_id", "labelled")
    assert rows(r, "image_id", "reason", "n_tiles", "rejected_tiles") == [
        ("cut", "no_complete_tile", 0, 0), ("gone", "no_complete_tile", 0, 0), ("good", "", 4, 0), ("hole", "", 3, 1),
        ("label", "invalid_pixels_in_labelled_region", 3, 1)]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_interior_is_the_city_block_ball(spark, radius):
    m = np.random.default_rng(7).random((9, 11)) > 0.08
    ball = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if abs(dy) + abs(dx) <= radius]
    want = [[all(0 <= y + dy < 9 and 0 <= x + dx < 11 and m[y + dy, x + dx] for dy, dx in ball) for x in range(11)] for y in range(9)]
    got = A.interior(picture(spark, {"a": m.astype(float)}), "image_id", "raster", radius)
    assert np.array_equal(field(got, "a", "interior") == 1, np.array(want))


def test_masked_pixels_stay_out_of_the_contrast(spark):
    rng = np.random.default_rng(10)
    a, ok = rng.random((6, 6)), np.ones((6, 6))
    ok[0, :] = 0
    b = a.copy()
    b[0, :] = rng.random(6)  # what a masked pixel shows changes nothing
    p = picture(spark, {"a": a, "b": b}, out="raw").withColumn("ok", F.array(*[F.lit(v) for v in ok.ravel()]))
    t = {(r.image_id, r.ty, r.tx): [r[f] for f in A.REGION_FEATURES] + [r.n_valid, r.n_interior, r.used] for r in A.region_tile_features(p, "image_id", "raw", "ok", 5, 0.25, 0.5).collect()}
    assert set(k[1:] for k in t) == {(0, 0), (0, 1), (1, 0), (1, 1)}  # smaller tiles at the far edges
    assert all(t["a", y, x] == pytest.approx(t["b", y, x], nan_ok=True) for _, y, x in t)
    assert t["a", 0, 0][0] == pytest.approx(a[1:5, :5].mean()) and t["a", 0, 0][-1] and not t["a", 1, 1][-1]
    fill = A.filled(a, ok == 1)
    assert np.array_equal(fill[0], a[1]) and np.array_equal(fill[1:], a[1:])


def test_a_pixel_beyond_the_scale_keeps_its_value_and_one_without_a_value_is_masked(spark):
    a, ok = np.random.default_rng(11).random((4, 4)), np.ones((4, 4))
    a[0, 0], a[3, 3] = 1.3, -0.2
    b, masked = a.copy(), ok.copy()
    b[1, 2], masked[1, 2] = np.nan, 0
    p = picture(spark, {"a": a, "b": b}, out="raw").withColumn("ok", F.array(*[F.lit(v) for v in ok.ravel()]))
    q = picture(spark, {"b": b}, out="raw").withColumn("ok", F.array(*[F.lit(v) for v in masked.ravel()]))
    get = lambda df: {r.image_id: r for r in A.region_tile_features(df, "image_id", "raw", "ok", 4, 0.25, 0.5, grid=(2, 2), bins=16).collect()}
    t, u = get(p), get(q)
    assert t["a"].raw_mean == pytest.approx(a.mean()) and (t["a"].n_valid, t["b"].n_valid) == (16, 15)
    assert t["b"] == u["b"] and t["b"].raw_mean == pytest.approx(np.nanmean(b))


@pytest.mark.parametrize("name", ["texture_features", "roi_features_weighted"])
def test_region_queries_on_bright_pictures(spark, tmp_path, name):
    import __spark_entry__ as entry
    import oracle
    source = "/root/testdata/sf0.001"
    for t in oracle.TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{source}/{t}.parquet")
    (tmp_path / "embeddings.parquet").unlink()
    wide = spark.read.parquet(f"{source}/embeddings.parquet").withColumn("embedding", F.transform("embedding", lambda v: (v * 1.8).cast("float")))
    wide.where("vec_id < 60").write.parquet(str(tmp_path / "wide"))
    (tmp_path / "embeddings.parquet").symlink_to(next((tmp_path / "wide").glob("*.parquet")))
    problem, n = oracle.compare(oracle.connect(str(tmp_path)), entry.queries()[name](spark, str(tmp_path)), entry.oracle_sql()[name])
    assert problem is None and n > 0


def test_texture_query_runs_with_the_sizes_of_the_study(spark, tmp_path):
    from metrospan.plans import QUERIES
    rng = np.random.default_rng(12)
    data = [(i, 3 if i % 16 == 5 and i < 64 else i % 3, rng.normal(0, 0.2, 64).astype(np.float32)) for i in range(300)]
    given = [(None if i == 0 else max(i, 2), label, v.tolist()) for i, label, v in data]  # a missing id comes first, one id comes twice
    spark.createDataFrame([given[i] for i in rng.permutation(300)], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.tile: r for r in QUERIES["texture_features"](spark, str(tmp_path)).collect()}
    data[1:3] = sorted(data[1:3], key=lambda r: (r[1], r[2].tolist()))
    raw, ok = np.zeros((128, 128)), np.ones((128, 128), bool)
    for place, (_, label, v) in enumerate(data[:256]):
        y, x = place // 16 * 8, place % 16 * 8
        raw[y: y + 8, x: x + 8] = ((np.floor(v.astype(float) * 200 + 128) + 5 * (0.2126 - 0.0722)) / 255).reshape(8, 8)
        ok[y: y + 8, x: x + 8] = label != 3
    ball = [(dy, dx) for dy in range(-8, 9) for dx in range(-8, 9) if abs(dy) + abs(dx) <= 8]
    wide = np.pad(ok, 8)
    core = np.all([wide[8 + dy: 136 + dy, 8 + dx: 136 + dx] for dy, dx in ball], axis=0)
    shown = A.equalize(A.filled(raw, ok))
    bell = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    wide = np.pad(shown, 8, mode="symmetric")
    low = sum(a * b * wide[j: j + 128, i: i + 128] for j, a in enumerate(bell) for i, b in enumerate(bell)) / bell.sum() ** 2
    r = got[0]
    assert set(got) == {0, 1} and r.used and not got[1].used and got[1].n_valid == 44 * 64
    assert (r.n_valid, r.n_interior) == (ok.sum(), core.sum()) and ok.sum() == 252 * 64
    assert r.raw_mean == pytest.approx(raw[ok].mean(), abs=1e-8) and r.equalized_variance == pytest.approx(shown[ok].var(), abs=1e-8)
    assert r.highpass_std == pytest.approx((shown - low)[core].std(), abs=1e-8) and r.highpass_std > 0.1


def test_filling_takes_the_nearest_valid_pixel(spark):
    rng = np.random.default_rng(13)
    for share in (0.1, 0.5, 0.95):
        a, ok = rng.random((17, 23)), rng.random((17, 23)) > share
        got = A.filled(a, ok)
        for y, x in np.argwhere(~ok):
            j, i = min(map(tuple, np.argwhere(ok)), key=lambda p: ((p[0] - y) ** 2 + (p[1] - x) ** 2, *p))
            assert got[y, x] == a[j, i]
        assert np.array_equal(got[ok], a[ok])
