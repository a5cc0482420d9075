"""Pixel, tile and profile queries; embeddings are read as 8 x 8 pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.errors import luminance
from ..operators import diff as D
from ..operators import pictures as A
from ..operators import pixels as P
from ..operators import provenance as V
from ..operators.ranks import ordered_rank
from ..params import StudyParameters
from . import study
from .registry import off_tie, query, rnd, rounded, sr, sr_off_tie, table

SIDE = 8


def pictures(spark, sf):
    v = F.floor(F.col("_v").cast("double") * 200 + 128).cast("int")
    return P.pixels_from_array(table(spark, sf, "embeddings"), "vec_id", "embedding", SIDE, v, ["label"])


PIX = """WITH pix AS (SELECT vec_id, label, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, floor(embedding[i]::DOUBLE * 200 + 128)::INT AS value FROM embeddings, range(1, 65) t(i))"""


@query("pixels_from_array", PIX + " SELECT vec_id, y, x, value FROM pix")
def pixels_from_array(spark, sf):
    return pictures(spark, sf).select("vec_id", "y", "x", "value")


@query("pixels_canonical", PIX + """, o AS (SELECT *, CASE WHEN label < 3 THEN 'x+' WHEN label < 5 THEN 'x-' WHEN label < 7 THEN 'y+' WHEN label < 9 THEN 'y-' ELSE 'z' END AS o FROM pix)
SELECT vec_id, value, CASE o WHEN 'x+' THEN y WHEN 'x-' THEN y WHEN 'y+' THEN 7 - x WHEN 'y-' THEN x END AS cy, CASE o WHEN 'x+' THEN x WHEN 'x-' THEN 7 - x WHEN 'y+' THEN y WHEN 'y-' THEN 7 - y END AS cx FROM o""")
def pixels_canonical(spark, sf):
    n = F.col("label")
    o = F.when(n < 3, "x+").when(n < 5, "x-").when(n < 7, "y+").when(n < 9, "y-").otherwise("z")
    return P.canonical(pictures(spark, sf).withColumn("o", o), "o", SIDE, SIDE).select("vec_id", "value", "cy", "cx")


def rasters(spark, sf):
    """The same pictures as array rows; one pixel of label 3 is masked."""
    e = table(spark, sf, "embeddings").withColumn("raster", F.transform("embedding", lambda v: F.floor(v.cast("double") * 200 + 128)))
    mask = F.when(F.col("label") == 3, F.concat(F.array(F.lit(0.0)), F.array_repeat(F.lit(1.0), SIDE * SIDE - 1)))
    e = e.withColumns({"hole": mask, "top": F.lit(255.0)})
    return A.pictures_from_array(e, "vec_id", "raster", SIDE, SIDE, keep=["label", "hole", "top"])


def corrected(spark, sf):
    """Pictures corrected by the frames of their label (its session)."""
    frames = pictures(spark, sf).groupBy("label", "y", "x").agg((F.max("value") + 5).alias("hi"), F.min("value").alias("lo"))
    ref, dark = (A.pictures_from_pixels(frames, "label", v) for v in ("hi", "lo"))
    return A.correct_pictures(rasters(spark, sf), ref, dark, "vec_id", "label", "label", "top", 0.02, 2.0, 0.02, mask="hole",
                              grid=(2, 2), clip=2.0, bins=16, keep=["label"])


COR = PIX + """, fr AS (SELECT label, y, x, max(value) + 5 AS r, min(value) AS d FROM pix GROUP BY 1, 2, 3),
co AS (SELECT vec_id, label, y, x, value, r - d <= 0 AS zero, value >= 255 OR r >= 255 OR d >= 255 AS sat, value - d <= 0 AS neg, CASE WHEN r > d THEN (value - d)::DOUBLE / (r - d) END AS t FROM pix JOIN fr USING (label, y, x)),
cv AS (SELECT *, coalesce(t < 0.02, false) AS low, coalesce(t > 2, false) AS high, NOT (zero OR sat OR neg OR coalesce(t < 0.02, false) OR coalesce(t > 2, false)) AS valid FROM co),
ct AS (SELECT *, CASE WHEN valid THEN t END AS tt, CASE WHEN valid THEN -log10(t) END AS od FROM cv)"""


@query("flat_field", COR + f" SELECT vec_id, y, x, valid, {sr('tt', 9)} AS \"T\", {sr('od', 9)} AS od FROM ct")
def flat_field(spark, sf):
    p = A.pixels_of(corrected(spark, sf), "vec_id", ["valid", "T", "od"]).withColumn("valid", F.col("valid") == 1)
    return rounded(p, {"T": 9, "od": 9})


@query("image_qc", COR + """ SELECT vec_id, count(*) FILTER (zero) AS zero_denominator_pixels, count(*) FILTER (sat) AS saturated_pixels, count(*) FILTER (neg) AS nonpositive_signal_pixels,
  count(*) FILTER (low) AS low_t_pixels, count(*) FILTER (high) AS high_t_pixels, count(*) FILTER (NOT valid) AS invalid_pixels, count(*) AS total_pixels,
  CASE WHEN count(*) FILTER (NOT valid) / 64.0 > 0.02 THEN 'FAIL' ELSE 'PASS' END AS status FROM ct GROUP BY 1""")
def image_qc(spark, sf):
    return corrected(spark, sf).select("vec_id", *A.FAULTS, "invalid_pixels", "total_pixels", F.col("qc_status").alias("status"))


def _clahe_sql(src: str, key: str, value: str, side: int, out: str) -> str:
    half, c0 = side // 2, side / 4 - 0.5
    cell = half * half
    return f"""{out}_q AS (SELECT *, least(floor({value} * 16), 15)::INT AS q, y // {half} AS cy, x // {half} AS cx FROM {src}),
{out}_h AS (SELECT {key}, cy, cx, q, count(*)::DOUBLE AS n FROM {out}_q GROUP BY 1, 2, 3, 4),
{out}_e AS (SELECT {key}, cy, cx, sum(greatest(n - greatest(1, 2.0 * {cell} / 16), 0)) AS excess FROM {out}_h GROUP BY 1, 2, 3),
{out}_l AS (SELECT e.{key}, e.cy, e.cx, b, (coalesce(sum(CASE WHEN n IS NOT NULL THEN least(n, greatest(1, 2.0 * {cell} / 16)) END), 0) + (b + 1) * max(excess) / 16) / {cell} AS lut
  FROM {out}_e e CROSS JOIN range(16) t(b) LEFT JOIN {out}_h h ON h.{key} = e.{key} AND h.cy = e.cy AND h.cx = e.cx AND h.q <= b GROUP BY 1, 2, 3, 4),
{out}_w AS (SELECT *, least(greatest((y - {c0}) / {half}, 0), 1) AS yi, least(greatest((x - {c0}) / {half}, 0), 1) AS xi FROM {out}_q),
{out} AS (SELECT w.* EXCLUDE (q, cy, cx, yi, xi), (1 - yi) * (1 - xi) * a.lut + (1 - yi) * xi * b.lut + yi * (1 - xi) * c.lut + yi * xi * d.lut AS texture FROM {out}_w w
  JOIN {out}_l a ON a.{key} = w.{key} AND a.cy = 0 AND a.cx = 0 AND a.b = q JOIN {out}_l b ON b.{key} = w.{key} AND b.cy = 0 AND b.cx = 1 AND b.b = q
  JOIN {out}_l c ON c.{key} = w.{key} AND c.cy = 1 AND c.cx = 0 AND c.b = q JOIN {out}_l d ON d.{key} = w.{key} AND d.cy = 1 AND d.cx = 1 AND d.b = q)"""


TEX = COR + """, md AS (SELECT vec_id, median(tt) AS m FROM ct GROUP BY 1), dp AS (SELECT ct.*, least(greatest(coalesce(tt, m) / 2.0, 0), 1) AS display FROM ct JOIN md USING (vec_id)),
""" + _clahe_sql("dp", "vec_id", "display", 8, "tx")


@query("local_equalize", TEX + f" SELECT vec_id, y, x, {sr('texture', 9)} AS texture FROM tx")
def local_equalize(spark, sf):
    return rounded(A.pixels_of(corrected(spark, sf), "vec_id", ["texture"]), {"texture": 9})


# --- profiles -----------------------------------------------------------------------

_PROFILE = ", pr AS (SELECT vec_id, y, avg(d) AS v FROM (SELECT vec_id, a.y, abs(b.texture - a.texture) AS d FROM tx a JOIN tx b USING (vec_id, x) WHERE b.y = a.y + 1) GROUP BY 1, 2)"


@query("edge_profile", TEX + _PROFILE + f" SELECT vec_id, y, {sr('v', 9)} AS profile FROM pr")
def edge_profile(spark, sf):
    return rounded(A.edge_profiles(corrected(spark, sf), "vec_id", "texture"), {"profile": 9})


def _gauss_sql(src: str, key: str, axis: str, value: str, out: str, sigma: float = 0.6) -> str:
    """Weighted sum over neighbours, positions mirrored with the edge repeated."""
    far = f"CAST(floor(4 * {sigma} + 0.5) AS BIGINT)"
    bell = f"exp(-0.5 * o * o / ({sigma} * {sigma}))"
    return f"""{out}_n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {axis}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS m FROM {src}),
{out} AS (SELECT a.{key}, a.{axis}, sum(w * b.{value}) AS s FROM {out}_n a CROSS JOIN (SELECT o, {bell} / sum({bell}) OVER () AS w FROM range(-{far}, {far} + 1) t(o)) k
  JOIN {out}_n b ON b.{key} = a.{key} AND b.i = CASE WHEN a.i + o < 0 THEN -1 - a.i - o WHEN a.i + o >= a.m THEN 2 * a.m - 1 - a.i - o ELSE a.i + o END GROUP BY 1, 2)"""


def _peaks_sql(src: str, key: str, axis: str) -> str:
    """Local maxima over the threshold, thinned greedily from the highest."""
    return f"""th_m AS (SELECT {key}, median(s) AS med FROM {src} GROUP BY 1), th AS (SELECT {key}, max(med) AS med, median(abs(s - med)) AS mad FROM {src} JOIN th_m USING ({key}) GROUP BY 1),
pk AS (SELECT {key}, {axis}, s, row_number() OVER (PARTITION BY {key} ORDER BY s DESC, {axis} DESC) AS r FROM
  (SELECT *, lag(s) OVER w AS pv, lead(s) OVER w AS nx FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY {axis})) JOIN th USING ({key})
  WHERE s > pv AND s > nx AND s >= greatest(0.003, med + 0.5 * mad)),
kp AS (SELECT DISTINCT {key}, 0::BIGINT AS r, []::BIGINT[] AS kept FROM pk
  UNION ALL SELECT kp.{key}, pk.r, CASE WHEN list_has_any(kept, [pk.{axis} - 2, pk.{axis} - 1, pk.{axis} + 1, pk.{axis} + 2]::BIGINT[]) THEN kept ELSE list_append(kept, pk.{axis}::BIGINT) END
  FROM kp JOIN pk ON pk.{key} = kp.{key} AND pk.r = kp.r + 1),
fin AS (SELECT k.{key}, unnest(kept) AS p FROM kp k JOIN (SELECT {key}, max(r) AS r FROM kp GROUP BY 1) m ON m.{key} = k.{key} AND m.r = k.r),
peaks AS (SELECT fin.{key}, fin.p, pk.s FROM fin JOIN pk ON pk.{key} = fin.{key} AND pk.{axis} = fin.p)"""


_EV = """WITH RECURSIVE ev AS (SELECT event_type, floor((epoch(ts) - 1704067200) / 21600)::BIGINT AS b, sum(value) AS v FROM events GROUP BY 1, 2),
""" + _gauss_sql("ev", "event_type", "b", "v", "sm")


def daily_profile(spark, sf):
    b = F.floor((F.unix_timestamp("ts") - 1704067200) / 21600)
    return table(spark, sf, "events").groupBy("event_type", b.alias("b")).agg(F.sum("value").alias("v"))


def smoothed(spark, sf):
    return P.smooth(daily_profile(spark, sf), ["event_type"], "b", "v", P.gaussian_weights(0.6), "s")


@query("gauss_smooth", _EV + f" SELECT event_type, b, {sr('s', 7)} AS s FROM sm")
def gauss_smooth(spark, sf):
    return smoothed(spark, sf).select("event_type", "b", rnd("s", 7).alias("s"))


@query("robust_threshold", _EV + f""", m AS (SELECT event_type, median(s) AS med FROM sm GROUP BY 1)
SELECT event_type, {sr('max(med)', 7)} AS median, {sr('median(abs(s - med))', 7)} AS mad, {sr('greatest(0.003, max(med) + 0.5 * median(abs(s - med)))', 7)} AS threshold FROM sm JOIN m USING (event_type) GROUP BY 1""")
def robust_threshold(spark, sf):
    return rounded(P.robust_threshold(smoothed(spark, sf), ["event_type"], "s", factor=0.5), {"median": 7, "mad": 7, "threshold": 7})


def event_peaks(spark, sf):
    s = P.with_threshold(smoothed(spark, sf), ["event_type"], "s", factor=0.5)
    return P.local_peaks(s, ["event_type"], "b", "s", "threshold")


_PK = _EV + ", " + _peaks_sql("sm", "event_type", "b")


@query("peaks", _PK + f" SELECT event_type, p AS b, {sr('s', 7)} AS s FROM peaks")
def peaks(spark, sf):
    return event_peaks(spark, sf).select("event_type", F.col("b").cast("long").alias("b"), rnd("s", 7).alias("s"))


_PP = _PK + ", pp AS (SELECT a.event_type, a.s + b.s AS score, a.p + 1 AS y0, b.p + 1 AS y1 FROM peaks a JOIN peaks b ON a.event_type = b.event_type AND b.p - a.p BETWEEN 0.85 * 12 AND 1.15 * 12)"


def event_pairs(spark, sf):
    return P.peak_pairs(event_peaks(spark, sf).withColumn("w", F.lit(12.0)), ["event_type"], "b", "s", "w")


@query("peak_pairs", _PP + f" SELECT event_type, {sr('score', 7)} AS score, y0, y1 FROM pp")
def peak_pairs(spark, sf):
    return rounded(event_pairs(spark, sf), {"score": 7})


@query("best_pair", _PP + f""", r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS s2, lead(y0) OVER w AS y2 FROM pp WINDOW w AS (PARTITION BY event_type ORDER BY score DESC, y0 DESC, y1 DESC))
SELECT event_type, {sr('score', 7)} AS score, y0, y1, coalesce(s2 > 0.95 * score AND abs(y0 - y2) > 3, false) AS ambiguous FROM r WHERE r = 1""")
def best_pair(spark, sf):
    return rounded(P.best_pair(event_pairs(spark, sf), ["event_type"]), {"score": 7})


_CH = TEX.replace("WITH pix", "WITH RECURSIVE pix", 1) + _PROFILE + ", " + _gauss_sql("pr", "vec_id", "y", "v", "sm") + ", " + _peaks_sql("sm", "vec_id", "y")


@query("channel_edges", _CH + f""", pp AS (SELECT a.vec_id, a.s + b.s AS score, a.p + 1 AS y0, b.p + 1 AS y1 FROM peaks a JOIN peaks b ON a.vec_id = b.vec_id AND b.p - a.p = 3),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS s2, lead(y0) OVER w AS y2 FROM pp WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, y0 DESC, y1 DESC))
SELECT vec_id, {sr('score', 8)} AS score, y0, y1, coalesce(s2 > 0.95 * score AND abs(y0 - y2) > 3, false) AS ambiguous FROM r WHERE r = 1""")
def channel_edges(spark, sf):
    t = corrected(spark, sf).withColumn("w", F.lit(3.0))
    return rounded(P.detect_channel(t, "vec_id", "texture", "w", factor=0.5), {"score": 8})


# --- tiles ----------------------------------------------------------------------------

_TILE = ", tl AS (SELECT *, y // 4 AS ty, x // 4 AS tx FROM tx)"
_GRAD = _TILE + """, gr AS (SELECT t.*, sqrt(pow((r.texture - l.texture) / (r.x - l.x), 2) + pow((d.texture - u.texture) / (d.y - u.y), 2)) AS gradient FROM tl t
  JOIN tl l ON l.vec_id = t.vec_id AND l.y = t.y AND l.x = greatest(t.x - 1, t.tx * 4) JOIN tl r ON r.vec_id = t.vec_id AND r.y = t.y AND r.x = least(t.x + 1, t.tx * 4 + 3)
  JOIN tl u ON u.vec_id = t.vec_id AND u.x = t.x AND u.y = greatest(t.y - 1, t.ty * 4) JOIN tl d ON d.vec_id = t.vec_id AND d.x = t.x AND d.y = least(t.y + 1, t.ty * 4 + 3)),
nb AS (SELECT t.vec_id, t.y, t.x, abs(max(t.texture) - avg(o.texture)) AS neighbor FROM tl t CROSS JOIN (VALUES (-1), (0), (1)) a(dy) CROSS JOIN (VALUES (-1), (0), (1)) b(dx)
  JOIN tl o ON o.vec_id = t.vec_id AND o.y = least(greatest(t.y + dy, t.ty * 4), t.ty * 4 + 3) AND o.x = least(greatest(t.x + dx, t.tx * 4), t.tx * 4 + 3) GROUP BY 1, 2, 3)"""


@query("tile_gradient", TEX + _GRAD + f" SELECT vec_id, y, x, {sr('gradient', 8)} AS gradient FROM gr")
def tile_gradient(spark, sf):
    return rounded(A.pixels_of(A.tile_fields(corrected(spark, sf), "vec_id", "texture", 4), "vec_id", ["gradient"]), {"gradient": 8})


@query("tile_neighbor", TEX + _GRAD + f" SELECT vec_id, y, x, {sr_off_tie('neighbor')} AS neighbor FROM nb")
def tile_neighbor(spark, sf):
    t = A.pixels_of(A.tile_fields(corrected(spark, sf), "vec_id", "texture", 4), "vec_id", ["neighbor"])
    return t.withColumn("neighbor", off_tie("neighbor"))


_FEATURES = _GRAD + """, tf AS (SELECT vec_id, ty, tx, avg(od) AS od_mean, stddev_pop(od) AS od_std, quantile_cont(od, 0.1) AS od_p10, quantile_cont(od, 0.9) AS od_p90, avg(tt) AS "T_mean", avg(gradient) AS texture_gradient,
  avg(neighbor) AS texture_neighbor, bool_and(NOT (y = 0 AND x = 0 AND label = 3)) AS complete, bool_and(valid) AS all_valid FROM gr JOIN nb USING (vec_id, y, x) GROUP BY 1, 2, 3)"""


def tiles(spark, sf):
    return A.tile_features(corrected(spark, sf), "vec_id", 4)


@query("tile_features", TEX + _FEATURES + " SELECT vec_id, ty::INT AS ty, tx::INT AS tx, " + ", ".join(f'{sr_off_tie(chr(34) + f + chr(34))} AS "{f}"' for f in P.TILE_FEATURES) + ", complete, all_valid FROM tf")
def tile_features(spark, sf):
    t = tiles(spark, sf).select("vec_id", "ty", "tx", *P.TILE_FEATURES, "complete", "all_valid")
    return t.withColumns({f: off_tie(f) for f in P.TILE_FEATURES})


@query("roi_features", TEX + _FEATURES + """, g AS (SELECT vec_id, """ + ", ".join(f'avg("{f}") FILTER (complete AND all_valid) AS "{f}"' for f in P.TILE_FEATURES) + """,
  count(*) FILTER (complete AND all_valid) AS n_tiles, count(*) FILTER (complete AND NOT all_valid) AS rejected_tiles, count(*) FILTER (complete) AS u FROM tf GROUP BY 1),
s AS (SELECT vec_id, label, g.* EXCLUDE (vec_id), CASE WHEN u = 0 THEN 'no_complete_tile' WHEN n_tiles = 0 THEN 'no_valid_tile' WHEN label > 4 AND rejected_tiles > 0 THEN 'invalid_pixels_in_labelled_region' ELSE '' END AS reason
  FROM embeddings JOIN g USING (vec_id))
SELECT vec_id, label > 4 AS labelled, CASE WHEN reason = '' THEN 'PASS' ELSE 'FAIL' END AS status, reason, n_tiles, rejected_tiles, """ + ", ".join(
    sr_off_tie(f"CASE WHEN reason = '' THEN \"{f}\" END") + f' AS "feature_{f}"' for f in P.TILE_FEATURES) + " FROM s")
def roi_features(spark, sf):
    images = table(spark, sf, "embeddings").select("vec_id", (F.col("label") > 4).alias("labelled"))
    r = P.roi_features(tiles(spark, sf), images, "vec_id", "labelled")
    return r.withColumns({f"feature_{f}": off_tie(f"feature_{f}") for f in P.TILE_FEATURES})


# --- masked texture ------------------------------------------------------------------------

@query("valid_interior", PIX + """ SELECT p.vec_id, p.y, p.x, count(*) FILTER (o.value > 90) = 13 AS interior FROM pix p CROSS JOIN range(-2, 3) a(dy) CROSS JOIN range(-2, 3) b(dx)
LEFT JOIN pix o ON o.vec_id = p.vec_id AND o.y = p.y + dy AND o.x = p.x + dx WHERE abs(dy) + abs(dx) <= 2 GROUP BY 1, 2, 3""")
def valid_interior(spark, sf):
    p = rasters(spark, sf).withColumn("ok", F.transform("raster", lambda v: F.when(v > 90, 1.0).otherwise(0.0)))
    p = A.pixels_of(A.interior(p, "vec_id", "ok", 2), "vec_id", ["interior"])
    return p.withColumn("interior", F.col("interior") == 1)


_SIGMA = 0.25


_REG = PIX + """, r0 AS (SELECT vec_id, vec_id * 4 + y // 4 * 2 + x // 4 AS tile, y % 4 AS y, x % 4 AS x, 0.2126 * ((value + 5) / 255.0::DOUBLE) + 0.7152 * (value / 255.0::DOUBLE) + 0.0722 * ((value - 5) / 255.0::DOUBLE) AS raw, value > 100 AS ok FROM pix),
rp AS (SELECT a.*, CASE WHEN a.ok OR n.fill IS NULL THEN a.raw ELSE n.fill END AS shown FROM r0 a LEFT JOIN (SELECT a.tile, a.y, a.x, arg_min(b.raw, (pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) * 100 + b.y * 4 + b.x) AS fill
  FROM r0 a JOIN r0 b ON a.tile = b.tile AND b.ok GROUP BY 1, 2, 3) n ON n.tile = a.tile AND n.y = a.y AND n.x = a.x),
""" + _clahe_sql("rp", "tile", "shown", 4, "rt")


def _region_sql() -> str:
    bell = lambda d: f"exp(-0.5 * {d * d} / pow({_SIGMA}, 2)) / (1 + 2 * exp(-0.5 / pow({_SIGMA}, 2)))"
    off = ", ".join(
        f"({dy}, {dx}, {(2 - abs(dy)) * dx / 8!r}, {(2 - abs(dx)) * dy / 8!r}, {bell(dy)} * {bell(dx)})" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return _REG + f""", cv AS (SELECT t.vec_id, t.tile, t.y, t.x, any_value(t.raw) AS raw, any_value(t.texture) AS tex, bool_or(t.ok) AS ok, sqrt(pow(sum(sx * o.texture), 2) + pow(sum(sy * o.texture), 2)) AS gradient,
  any_value(t.texture) - sum(g * o.texture) AS highpass, abs(any_value(t.texture) - avg(o.texture)) AS neighbor,
  bool_and(CASE WHEN abs(dy) + abs(dx) <= 1 THEN t.y + dy BETWEEN 0 AND 3 AND t.x + dx BETWEEN 0 AND 3 AND o.ok ELSE true END) AS interior
  FROM rt t CROSS JOIN (VALUES {off}) k(dy, dx, sx, sy, g) JOIN rt o ON o.tile = t.tile AND o.y = least(greatest(t.y + dy, 0), 3) AND o.x = least(greatest(t.x + dx, 0), 3) GROUP BY 1, 2, 3, 4),
tf AS (SELECT vec_id, tile, avg(raw) FILTER (ok) AS raw_mean, var_pop(raw) FILTER (ok) AS raw_variance, avg(tex) FILTER (ok) AS equalized_mean, var_pop(tex) FILTER (ok) AS equalized_variance,
  avg(gradient) FILTER (interior) AS gradient_mean, quantile_cont(gradient, 0.9) FILTER (interior) AS gradient_p90, stddev_pop(highpass) FILTER (interior) AS highpass_std, avg(neighbor) FILTER (interior) AS neighbor_mean,
  count(*) FILTER (ok) AS n_valid, count(*) FILTER (interior) AS n_interior FROM cv GROUP BY 1, 2)"""


_REGION = _region_sql()


def region_tiles(spark, sf):
    """Quarter pictures as tiles with a gray value, a mask and own contrast."""
    p = rasters(spark, sf)
    p = p.withColumns({"gray": F.transform("raster", lambda v: luminance(v + 5, v, v - 5, 255.0)),
                       "ok": F.transform("raster", lambda v: F.when(v > 100, 1.0).otherwise(0.0))})
    t = A.region_tile_features(p, "vec_id", "gray", "ok", 4, _SIGMA, 0.5, grid=(2, 2), bins=16)
    return t.withColumn("tile", F.col("vec_id") * 4 + F.col("ty") * 2 + F.col("tx"))


# Sheets of 16 x 16 pictures are one tile of the study: 128 pixels a side, 8 x 8 cells of 256 bins, sigma 2.
_SHEET = """WITH px AS (SELECT r // 256 AS tile, r % 256 // 16 * 8 + (i - 1) // 8 AS y, r % 16 * 8 + (i - 1) % 8 AS x, floor(embedding[i]::DOUBLE * 200 + 128)::INT AS value, label IS DISTINCT FROM 3 AS put
  FROM (SELECT *, row_number() OVER (ORDER BY vec_id NULLS FIRST, label NULLS FIRST, embedding NULLS FIRST) - 1 AS r FROM embeddings), range(1, 65) t(i)),
r0 AS MATERIALIZED (SELECT tile, y, x, 0.2126 * ((value + 5) / 255.0::DOUBLE) + 0.7152 * (value / 255.0::DOUBLE) + 0.0722 * ((value - 5) / 255.0::DOUBLE) AS raw, coalesce(put AND value IS NOT NULL, false) AS ok
  FROM (SELECT DISTINCT tile FROM px) CROSS JOIN range(128) a(y) CROSS JOIN range(128) b(x) LEFT JOIN px USING (tile, y, x)),
rim AS (SELECT tile, y, x, raw FROM r0 SEMI JOIN (SELECT tile, y + dy AS y, x + dx AS x FROM r0, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) k(dy, dx) WHERE NOT ok) USING (tile, y, x) WHERE ok),
fl AS (SELECT a.tile, a.y, a.x, arg_min(b.raw, (pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) * 16384 + b.y * 128 + b.x) AS fill FROM r0 a JOIN rim b ON a.tile = b.tile WHERE NOT a.ok GROUP BY 1, 2, 3),
sh AS MATERIALIZED (SELECT r0.*, CASE WHEN ok THEN raw ELSE fill END AS shown FROM r0 LEFT JOIN fl USING (tile, y, x)),
rq AS (SELECT *, greatest(least(floor(shown * 256), 255), 0)::INT AS q, y // 16 AS cy, x // 16 AS cx, least(greatest((y - 7.5) / 16, 0), 7) AS py, least(greatest((x - 7.5) / 16, 0), 7) AS px FROM sh),
rh AS (SELECT tile, cy, cx, q, count(*)::DOUBLE AS n FROM rq GROUP BY 1, 2, 3, 4),
re AS (SELECT tile, cy, cx, sum(greatest(n - 2, 0)) AS excess FROM rh GROUP BY 1, 2, 3),
rl AS MATERIALIZED (SELECT re.tile, re.cy, re.cx, b, (sum(least(coalesce(n, 0), 2)) OVER (PARTITION BY re.tile, re.cy, re.cx ORDER BY b) + (b + 1) * excess / 256) / 256 AS lut
  FROM re CROSS JOIN range(256) t(b) LEFT JOIN rh ON rh.tile = re.tile AND rh.cy = re.cy AND rh.cx = re.cx AND rh.q = b),
flat AS (SELECT tile, min(shown) = max(shown) AS flat FROM sh GROUP BY 1),
rt AS MATERIALIZED (SELECT w.tile, w.y, w.x, raw, ok, CASE WHEN flat THEN shown ELSE (1 - py % 1) * ((1 - px % 1) * a.lut + px % 1 * b.lut) + py % 1 * ((1 - px % 1) * c.lut + px % 1 * d.lut) END AS texture FROM rq w JOIN flat USING (tile)
""" + "\n".join(f"  JOIN rl {n} ON {n}.tile = w.tile AND {n}.cy = least(floor(py) + {dy}, 7) AND {n}.cx = least(floor(px) + {dx}, 7) AND {n}.b = q"
                 for n, dy, dx in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1))) + """),
bell AS (SELECT o, exp(-0.125 * o * o) / sum(exp(-0.125 * o * o)) OVER () AS w FROM range(-8, 9) t(o)),
bx AS MATERIALIZED (SELECT t.tile, t.y, t.x, sum(w * s.texture) AS v FROM rt t CROSS JOIN bell JOIN rt s ON s.tile = t.tile AND s.y = t.y AND s.x = CASE WHEN t.x + o < 0 THEN -1 - t.x - o WHEN t.x + o > 127 THEN 255 - t.x - o ELSE t.x + o END GROUP BY 1, 2, 3),
bl AS (SELECT t.tile, t.y, t.x, sum(w * s.v) AS low FROM bx t CROSS JOIN bell JOIN bx s ON s.tile = t.tile AND s.x = t.x AND s.y = CASE WHEN t.y + o < 0 THEN -1 - t.y - o WHEN t.y + o > 127 THEN 255 - t.y - o ELSE t.y + o END GROUP BY 1, 2, 3),
nk AS MATERIALIZED (SELECT tile, y, x, texture, dy, dx, least(greatest(y + dy, 0), 127) AS sy, least(greatest(x + dx, 0), 127) AS sx FROM rt CROSS JOIN range(-1, 2) a(dy) CROSS JOIN range(-1, 2) b(dx)),
nr AS (SELECT t.tile, t.y, t.x, sqrt(pow(sum((2 - abs(dy)) * dx / 8.0::DOUBLE * s.texture), 2) + pow(sum((2 - abs(dx)) * dy / 8.0::DOUBLE * s.texture), 2)) AS gradient, abs(any_value(t.texture) - avg(s.texture)) AS neighbor
  FROM nk t JOIN rt s ON s.tile = t.tile AND s.y = sy AND s.x = sx GROUP BY 1, 2, 3),
near AS (SELECT DISTINCT tile, y + dy AS y, x + dx AS x, true AS out FROM r0 CROSS JOIN range(-8, 9) a(dy) CROSS JOIN range(-8, 9) b(dx) WHERE NOT ok AND abs(dy) + abs(dx) <= 8),
cv AS (SELECT *, texture - low AS highpass, out IS NULL AND y BETWEEN 8 AND 119 AND x BETWEEN 8 AND 119 AS interior FROM rt JOIN bl USING (tile, y, x) JOIN nr USING (tile, y, x) LEFT JOIN near USING (tile, y, x)),
tf AS (SELECT tile, avg(raw) FILTER (ok) AS raw_mean, var_pop(raw) FILTER (ok) AS raw_variance, avg(texture) FILTER (ok) AS equalized_mean, var_pop(texture) FILTER (ok) AS equalized_variance,
  avg(gradient) FILTER (interior) AS gradient_mean, quantile_cont(gradient, 0.9) FILTER (interior) AS gradient_p90, stddev_pop(highpass) FILTER (interior) AS highpass_std, avg(neighbor) FILTER (interior) AS neighbor_mean,
  count(*) FILTER (ok) AS n_valid, count(*) FILTER (interior) AS n_interior FROM cv GROUP BY 1)"""


def sheets(spark, sf):
    """Pictures side by side in reading order, 16 x 16 on a sheet; those of label 3 are masked, as are empty places."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    e = ordered_rank(e, ["vec_id", "label", "embedding"])
    gray = F.transform("embedding", lambda v: F.floor(v * 200 + 128))
    e = e.select(F.expr("(rank - 1) div 256").alias("tile"), ((F.col("rank") - 1) % 256).alias("place"), (~F.col("label").eqNullSafe(3)).alias("put"),
                 F.transform(gray, lambda v: luminance(v + 5, v, v - 5, 255.0)).alias("gray"))
    laid = e.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("place", "put", "gray"))).alias("_p"))
    at = F.sequence(F.lit(0), F.lit(128 * 128 - 1))  # rows of 128 pixels; a picture has eight of eight
    picture = lambda i: F.get("_p", (F.shiftright(i, 10) * 16 + F.shiftright(i % 128, 3)).cast("int"))
    pixel = lambda i: (F.shiftright(i, 7) % 8 * 8 + i % 8).cast("int")
    return laid.select("tile", F.lit(128).alias("height"), F.lit(128).alias("width"), F.transform(at, lambda i: F.get(picture(i)["gray"], pixel(i))).alias("gray"),
                       F.transform(at, lambda i: F.when(picture(i)["put"], 1.0).otherwise(0.0)).alias("ok"))


@query("texture_features", _SHEET + " SELECT tile, " + ", ".join(f"{sr_off_tie(f)} AS {f}" for f in P.REGION_FEATURES) + ", n_valid, n_interior, n_valid / 16384.0 >= 0.8 AND n_interior >= 4 AS used FROM tf")
def texture_features(spark, sf):
    t = A.region_tile_features(sheets(spark, sf), "tile", "gray", "ok", 128, 2.0, 0.8, 16).select("tile", *P.REGION_FEATURES, "n_valid", "n_interior", "used")
    return t.withColumns({f: off_tie(f) for f in P.REGION_FEATURES})


@query("roi_features_weighted", _REGION + ", u AS (SELECT * FROM tf WHERE n_valid / 16.0 >= 0.5 AND n_interior >= 4), m AS (SELECT vec_id, " + ", ".join(
    f"sum(n_valid * {f}) / sum(n_valid) AS m_{f}" for f in P.REGION_FEATURES) + " FROM u GROUP BY 1) SELECT vec_id, " + ", ".join(
    f"{sr_off_tie(f'max(m_{f})')} AS feature_{f}_mean, {sr_off_tie(f'sqrt(sum(n_valid * pow({f} - m_{f}, 2)) / sum(n_valid))', 7)} AS feature_{f}_std" for f in P.REGION_FEATURES)
    + ", count(*) AS n_tiles, CAST(sum(n_valid) AS BIGINT) AS n_valid_pixels FROM u JOIN m USING (vec_id) GROUP BY 1")
def roi_features_weighted(spark, sf):
    t = P.weighted_roi_features(region_tiles(spark, sf), "vec_id")
    return t.withColumns({f"feature_{f}_{s}": off_tie(f"feature_{f}_{s}", n) for f in P.REGION_FEATURES for s, n in (("mean", 8), ("std", 7))})



# --- extraction job --------------------------------------------------------------------------

_CFG = StudyParameters(tile_px=4, window_half_um=4.0, wall_margin_px=0, invalid_pixel_fraction_max=0.1, t_min=0.02, t_max=2.0)
_EXTRACT = COR + """, cn AS (SELECT vec_id, label, tt, od, valid, CASE WHEN label < 5 THEN y WHEN label < 7 THEN 7 - x ELSE x END AS y, CASE WHEN label < 3 THEN x WHEN label < 5 THEN 7 - x WHEN label < 7 THEN y ELSE 7 - y END AS x FROM ct),
md AS (SELECT vec_id, median(tt) AS m, count(*) FILTER (NOT valid) / 64.0 > 0.1 AS dim FROM cn GROUP BY 1), dp AS (SELECT cn.*, dim, least(greatest(coalesce(tt, m, 0) / 2.0, 0), 1) AS display FROM cn JOIN md USING (vec_id)),
""" + _clahe_sql("dp", "vec_id", "display", 8, "tx") + """, bx AS (SELECT *, CASE WHEN label IN (3, 9) THEN 2 ELSE 0 END AS xs FROM tx WHERE label NOT IN (4, 6, 8)),
tl AS (SELECT *, y // 4 AS ty, (x - xs) // 4 AS tx FROM bx WHERE x >= xs AND (xs = 0 OR x < 6))""" + _GRAD.removeprefix(_TILE).replace("t.tx * 4", "t.xs + t.tx * 4") + """,
tf AS (SELECT vec_id, ty, tx, avg(od) AS od_mean, stddev_pop(od) AS od_std, quantile_cont(od, 0.1) AS od_p10, quantile_cont(od, 0.9) AS od_p90, avg(tt) AS "T_mean", avg(gradient) AS texture_gradient,
  avg(neighbor) AS texture_neighbor, bool_and(valid) AS all_valid, min(x) AS x0, max(x) + 1 AS x1 FROM gr JOIN nb USING (vec_id, y, x) GROUP BY 1, 2, 3),
g AS (SELECT vec_id, """ + ", ".join(f'avg("{f}") FILTER (all_valid) AS "{f}"' for f in P.TILE_FEATURES) + """, count(*) FILTER (all_valid) AS n_tiles, count(*) FILTER (NOT all_valid) AS rejected_tiles,
  min(16.0::DOUBLE + x0) FILTER (all_valid) AS lo, max(16.0::DOUBLE + x1) FILTER (all_valid) AS hi FROM tf GROUP BY 1),
s AS (SELECT e.vec_id, e.label, g.* EXCLUDE (vec_id, n_tiles, rejected_tiles), coalesce(n_tiles, 0) AS n_tiles, coalesce(rejected_tiles, 0) AS rejected_tiles,
  CASE WHEN dim THEN 'invalid_pixels' WHEN e.label = 4 THEN 'roi_not_integer' WHEN e.label = 8 THEN 'manual_edges_outside' WHEN e.label = 6 THEN 'window_crosses_boundary' WHEN n_tiles = 0 THEN 'no_valid_tile'
  WHEN e.label < 3 AND rejected_tiles > 0 THEN 'invalid_pixels_in_labelled_region' WHEN e.label = 0 THEN 'label_support_differs' ELSE '' END AS reason FROM embeddings e JOIN md USING (vec_id) LEFT JOIN g USING (vec_id))
SELECT vec_id, CASE WHEN reason = '' THEN 'PASS' ELSE 'FAIL' END AS status, reason, n_tiles, rejected_tiles, CASE WHEN label % 2 = 0 THEN lo END AS z_lo, CASE WHEN label % 2 = 0 THEN hi END AS z_hi, """ + ", ".join(
    sr_off_tie(f"CASE WHEN reason = '' THEN \"{f}\" END") + f' AS "feature_{f}"' for f in P.TILE_FEATURES) + " FROM s"


@query("extract_regions", _EXTRACT)
def extract_regions(spark, sf):
    """The extraction job: turned pictures, manual and free boxes, faulty geometry and labels."""
    n = F.col("label")
    pics = rasters(spark, sf).withColumnRenamed("vec_id", "image_id").drop("hole", "top")
    frames = pictures(spark, sf).groupBy("label", "y", "x").agg((F.max("value") + 5).alias("hi"), F.min("value").alias("lo"))
    ref, dark = (A.pictures_from_pixels(frames.withColumnRenamed("label", k), k, v) for k, v in (("ref_id", "hi"), ("dark_id", "lo")))
    trench = n % 2 == 0
    number = lambda v: F.lit(float(v))
    images = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), n.alias("ref_id"), n.alias("dark_id"), F.lit(8).alias("bit_depth"), F.when(trench, "trench").otherwise("flat").alias("kind"),
        F.when(n < 3, "x+").when(n < 5, "x-").when(n < 7, "y+").otherwise("y-").alias("orientation"), F.when(trench | (n % 3 == 0), "manual").otherwise("auto").alias("roi_mode"),
        F.when(n == 4, 0.5).when(~trench, 1.0).otherwise(0.0).alias("roi_x0"), number(8).alias("roi_x1"), number(0).alias("roi_y0"), F.when(n == 8, 9.0).otherwise(8.0).alias("roi_y1"),
        number(8).alias("w_um"), number(1).alias("um_per_px"), F.when(n == 6, 2.0).otherwise(20.0).alias("z_anchor_um"), number(4).alias("x_anchor_px"), number(40).alias("L_um"),
        F.when(n < 3, 1.0).alias("label_nm"), F.when(n == 0, 10.0).otherwise(16.0).alias("label_z_lo_um"), F.when(n == 0, 30.0).otherwise(24.0).alias("label_z_hi_um"))
    r, _, _ = study.extract_regions(pics, images, ref, dark, _CFG, contrast=((2, 2), 2.0, 16))
    passed = F.col("status") == "PASS"
    return r.select(F.col("image_id").alias("vec_id"), "status", "reason", "n_tiles", "rejected_tiles", F.col("observed_z_lo_um").alias("z_lo"), F.col("observed_z_hi_um").alias("z_hi"),
                    *[off_tie(F.when(passed, F.col(f"feature_{f}"))).alias(f"feature_{f}") for f in P.TILE_FEATURES])


# --- identity --------------------------------------------------------------------------------

@query("pixel_diff", PIX + """, b AS (SELECT vec_id, y, x + CASE WHEN label = 2 AND x = 7 THEN 1 ELSE 0 END AS x, CASE WHEN label = 4 AND value > 140 THEN value + 1 ELSE value END AS value FROM pix WHERE NOT (label = 5 AND y = 3))
SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, count(*) AS pixels, count(*) FILTER (a.value <> b.value) AS changed, count(*) FILTER (b.vec_id IS NULL) AS removed, count(*) FILTER (a.vec_id IS NULL) AS added
FROM pix a FULL JOIN b ON a.vec_id = b.vec_id AND a.y = b.y AND a.x = b.x GROUP BY 1""")
def pixel_diff(spark, sf):
    p = pictures(spark, sf)
    n = F.col("label")
    b = p.where(~((n == 5) & (F.col("y") == 3))).select(
        "vec_id", "y", (F.col("x") + F.when((n == 2) & (F.col("x") == 7), 1).otherwise(0)).alias("x"),
        F.when((n == 4) & (F.col("value") > 140), F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return D.pixel_diff(p, b, "vec_id")


@query("pixel_digest", PIX + """, r AS (SELECT vec_id, y, sha256(string_agg(value::VARCHAR, ',' ORDER BY x)) AS h FROM pix GROUP BY 1, 2)
SELECT vec_id, sha256('8x8,int,' || string_agg(h, ',' ORDER BY y)) AS content_sha256 FROM r GROUP BY 1""")
def pixel_digest(spark, sf):
    return V.pixel_digest(pictures(spark, sf), "vec_id")
