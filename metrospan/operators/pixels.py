"""Pixel tables, profiles of pictures, and features of regions.

Pixels themselves are worked on as array rows (``pictures``); windows here run
over profiles, whose rows are the lines of one picture.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .pictures import REGION_FEATURES, TILE_FEATURES, edge_profiles


def pixels_from_array(df: DataFrame, image: str, array: str, width: int, value: Column | None = None,
                      keep: list[str] = ()) -> DataFrame:
    """One row per pixel of a row-major array."""
    p = df.select(image, *keep, F.posexplode(array).alias("_i", "_v"))
    v = F.col("_v") if value is None else value
    return p.select(image, *keep, F.expr(f"_i div {width}").cast("int").alias("y"),
                    (F.col("_i") % width).cast("int").alias("x"), v.alias("value"))


def canonical(df: DataFrame, orientation: str, height: str | int, width: str | int) -> DataFrame:
    """Coordinates turned so that the channel runs along +x.

    x-: mirrored columns; y+ / y-: a quarter turn counter-clockwise / clockwise.
    An unknown orientation yields NULL coordinates.
    """
    o = F.col(orientation)
    h = F.lit(height) if isinstance(height, int) else F.col(height)
    w = F.lit(width) if isinstance(width, int) else F.col(width)
    y, x = F.col("y"), F.col("x")
    cy = F.when(o.isin("x+", "x-"), y).when(o == "y+", w - 1 - x).when(o == "y-", x)
    cx = F.when(o == "x+", x).when(o == "x-", w - 1 - x).when(o == "y+", y).when(o == "y-", h - 1 - y)
    return df.withColumns({"cy": cy, "cx": cx})


# --- profiles and channel edges ----------------------------------------------

def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [r / sum(raw) for r in raw]


def smooth(df: DataFrame, by: list[str], axis: str, value: str, weights: list[float], out: str) -> DataFrame:
    """1-D convolution along a dense axis with mirrored edges (d c b a | a b c d | d c b a)."""
    radius = len(weights) // 2
    w = W.partitionBy(*by).orderBy(axis)
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    whole = w.rowsBetween(-radius, radius)
    first = F.row_number().over(w) - 1
    d = df.withColumns({"_near": F.collect_list(value).over(whole), "_pos": first, "_len": n})
    start = F.greatest(F.lit(0), F.col("_pos") - radius)
    total = F.lit(0.0)
    for k, weight in enumerate(weights):
        i = F.col("_pos") + (k - radius)
        cycle = F.pmod(i, 2 * F.col("_len"))
        mirrored = F.when(cycle < F.col("_len"), cycle).otherwise(2 * F.col("_len") - 1 - cycle)
        total = total + weight * F.get("_near", (mirrored - start).cast("int"))
    return d.withColumn(out, total).drop("_near", "_pos", "_len")


def robust_threshold(df: DataFrame, by: list[str], value: str, floor: float = 0.003, factor: float = 6.0) -> DataFrame:
    """max(floor, median + factor * MAD) per profile."""
    t = with_threshold(df, by, value, floor, factor)
    return t.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("median", "mad", "threshold")])


def with_threshold(df: DataFrame, by: list[str], value: str, floor: float = 0.003, factor: float = 6.0) -> DataFrame:
    """Adds the threshold to every point; the profile is read once."""
    w = W.partitionBy(*by)
    d = df.withColumn("median", F.percentile(value, F.lit(0.5)).over(w))
    d = d.withColumn("_a", F.abs(F.col(value) - F.col("median"))).withColumn("mad", F.percentile("_a", F.lit(0.5)).over(w))
    return d.withColumn("threshold", F.greatest(F.lit(floor), F.col("median") + factor * F.col("mad"))).drop("_a")


def local_peaks(df: DataFrame, by: list[str], axis: str, value: str, height: str, distance: int = 3,
                keep: list[str] = ()) -> DataFrame:
    """Local maxima at or above ``height`` (middle of a plateau), thinned so
    that no two kept peaks lie closer than ``distance``: the higher one wins.

    Thinning is greedy from the highest peak down, resolved over the sorted
    peaks of one profile.
    """
    w = W.partitionBy(*by).orderBy(axis)
    change = F.coalesce((F.col(value) != F.lag(value).over(w)), F.lit(True)).cast("int")
    runs = df.withColumn("_run", F.sum(change).over(w))
    flat = runs.groupBy(*by, "_run").agg(
        F.min(axis).alias("_a"), F.max(axis).alias("_b"), F.first(value).alias(value), F.first(height).alias(height),
        *[F.first(c).alias(c) for c in keep])
    r = W.partitionBy(*by).orderBy("_run")
    flat = flat.withColumns({"_left": F.lag(value).over(r), "_right": F.lead(value).over(r)})
    peaks = flat.where((F.col(value) > F.col("_left")) & (F.col(value) > F.col("_right")) & (F.col(value) >= F.col(height)))
    at = F.floor((F.col("_a") + F.col("_b")) / 2).cast("int")
    # The peaks of one profile, highest first (the later one first among equals).
    listed = peaks.groupBy(*by).agg(F.sort_array(
        F.collect_list(F.struct(F.col(value).alias("v"), at.alias("p"))), asc=False).alias("_peaks"),
        *[F.first(c).alias(c) for c in keep])
    thin = F.pandas_udf(_thinner(distance), "array<boolean>")
    kept = listed.withColumn("_kept", thin(F.transform("_peaks", lambda k: k["p"])))
    return kept.select(*by, *keep, F.inline(F.arrays_zip("_peaks", "_kept"))).where("_kept").select(
        *by, *keep, F.col("_peaks.p").alias(axis), F.col("_peaks.v").alias(value))


def _thinner(distance: int):
    """Of positions in order of rank, those no nearer than ``distance`` to one kept before."""
    def thin(lists: pd.Series) -> pd.Series:
        out = []
        for positions in lists:
            taken: set[int] = set()
            marks = []
            for p in positions.tolist():
                marks.append(all(q not in taken for q in range(p - distance + 1, p + distance)))
                if marks[-1]:
                    taken.add(p)
            out.append(marks)
        return pd.Series(out)
    return thin


def peak_pairs(peaks: DataFrame, by: list[str], axis: str, value: str, width: str) -> DataFrame:
    """Ordered peak pairs whose distance is within 15 % of the expected width.

    Positions fall into bins of three tenths of the width; the partners of a
    peak lie in two of them at most, so that peaks meet only their neighbours.
    """
    size = F.greatest(F.lit(1.0), 0.3 * F.col(width))
    p = peaks.select(*by, F.col(axis).cast("long").alias("_p"), F.col(value).alias("_v"), F.col(width).alias("_w"), size.alias("_s"))
    low, high = F.floor((F.col("_p") + 0.85 * F.col("_w")) / F.col("_s")), F.floor((F.col("_p") + 1.15 * F.col("_w")) / F.col("_s"))
    a = p.where(F.col("_w") > 0).select(*by, F.col("_p").alias("_a"), F.col("_v").alias("_va"), "_w", F.explode(F.sequence(low, high)).alias("_bin"))
    b = p.select(*by, F.col("_p").alias("_b"), F.col("_v").alias("_vb"), F.floor(F.col("_p") / F.col("_s")).alias("_bin"))
    gap = F.col("_b") - F.col("_a")
    near = a.join(b, [*by, "_bin"]).where((gap >= F.col("_w") * 0.85) & (gap <= F.col("_w") * 1.15))
    return near.select(*by, (F.col("_va") + F.col("_vb")).alias("score"), (F.col("_a") + 1).alias("y0"), (F.col("_b") + 1).alias("y1"))


def best_pair(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Best pair per image and whether a rival makes it ambiguous."""
    w = W.partitionBy(*by).orderBy(F.desc("score"), F.desc("y0"), F.desc("y1"))
    r = pairs.withColumns({"_r": F.row_number().over(w), "_s2": F.lead("score").over(w), "_y2": F.lead("y0").over(w)})
    rival = (F.col("_s2") > 0.95 * F.col("score")) & (F.abs(F.col("y0") - F.col("_y2")) > 3)
    return r.where("_r = 1").select(*by, "score", "y0", "y1", F.coalesce(rival, F.lit(False)).alias("ambiguous"))


def detect_channel(pictures: DataFrame, image: str, array: str, width: str, factor: float = 6.0) -> DataFrame:
    """Channel edges from the smoothed edge profile of each picture."""
    prof = smooth(edge_profiles(pictures, image, array, [width]), [image], "y", "profile", gaussian_weights(0.6), "smoothed")
    prof = with_threshold(prof, [image], "smoothed", factor=factor)
    peaks = local_peaks(prof, [image], "y", "smoothed", "threshold", keep=[width])
    return best_pair(peak_pairs(peaks, [image], "y", "smoothed", width), [image])


# --- regions -------------------------------------------------------------------

def roi_features(tiles: DataFrame, images: DataFrame, image: str, labelled: str) -> DataFrame:
    """Unweighted tile means per region, with the reason when it has none.

    Regions start from the image table, so one without any tile is reported.
    """
    use = F.col("complete")
    ok = use & F.col("all_valid")
    g = tiles.groupBy(image).agg(
        *[F.avg(F.when(ok, F.col(f))).alias(f"feature_{f}") for f in TILE_FEATURES],
        F.count_if(ok).alias("n_tiles"), F.count_if(use & ~F.col("all_valid")).alias("rejected_tiles"),
        F.count_if(use).alias("_use"))
    r = images.join(g, image, "left")
    reason = (F.when(F.coalesce(F.col("_use"), F.lit(0)) == 0, "no_complete_tile")
              .when(F.col("n_tiles") == 0, "no_valid_tile")
              .when(F.col(labelled) & (F.col("rejected_tiles") > 0), "invalid_pixels_in_labelled_region")
              .otherwise(""))
    r = r.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "PASS").otherwise("FAIL"))
    ok_col = F.col("status") == "PASS"
    return r.select(
        *images.columns, "status", "reason", F.coalesce("n_tiles", F.lit(0)).alias("n_tiles"),
        F.coalesce("rejected_tiles", F.lit(0)).alias("rejected_tiles"),
        *[F.when(ok_col, F.col(f"feature_{f}")).alias(f"feature_{f}") for f in TILE_FEATURES])


def weighted_roi_features(tiles: DataFrame, image: str) -> DataFrame:
    """Valid-pixel-weighted mean and population SD of every tile feature."""
    u = tiles.where("used")
    w = F.col("n_valid")
    mean = {f: F.sum(w * F.col(f)) / F.sum(w) for f in REGION_FEATURES}
    m = u.groupBy(image).agg(*[c.alias(f"m_{f}") for f, c in mean.items()])
    d = u.join(m, image)
    return d.groupBy(image).agg(
        *[F.first(f"m_{f}").alias(f"feature_{f}_mean") for f in REGION_FEATURES],
        *[F.sqrt(F.sum(w * F.pow(F.col(f) - F.col(f"m_{f}"), 2)) / F.sum(w)).alias(f"feature_{f}_std")
          for f in REGION_FEATURES],
        F.count(F.lit(1)).alias("n_tiles"), F.sum(w).alias("n_valid_pixels"))
