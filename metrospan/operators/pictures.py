"""Pictures as array rows: one row per image with its height, width and values.

Correction, local contrast, edges and tile features are computed by vectorised
kernels on whole pictures, where neighbourhoods need no window and no shuffle.
A picture is what one camera frame holds; pictures of any sizes may mix.  Only
joins with the few frames and with one-row-per-image tables move data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Features of a tile of a corrected picture, and of a tile of a masked region.
TILE_FEATURES = ("od_mean", "od_std", "od_p10", "od_p90", "T_mean", "texture_gradient", "texture_neighbor")
REGION_FEATURES = ("raw_mean", "raw_variance", "equalized_mean", "equalized_variance",
                   "gradient_mean", "gradient_p90", "highpass_std", "neighbor_mean")
FAULTS = ("zero_denominator_pixels", "saturated_pixels", "nonpositive_signal_pixels", "low_t_pixels", "high_t_pixels")
#: Values that a kernel holds before it hands a batch on.
_BATCH_VALUES = 1 << 20
_SIZE = "height int, width int"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
          "array<double>": pa.list_(pa.float64())}


# --- array rows -----------------------------------------------------------------

def pictures_from_array(df: DataFrame, image: str, array: str, height: str | int, width: str | int, channels: int = 1,
                        channel: int = 0, keep: list[str] = (), out: str = "raster") -> DataFrame:
    """Picture rows of a row-major array; of interleaved channels one is taken."""
    size = [F.lit(v) if isinstance(v, int) else F.col(v) for v in (height, width)]
    values = F.col(array) if channels == 1 else F.filter(array, lambda _, i: i % channels == channel)
    return df.select(image, *keep, size[0].cast("int").alias("height"), size[1].cast("int").alias("width"), values.cast("array<double>").alias(out))


def pictures_from_pixels(pixels: DataFrame, image: str, value: str, keep: list[str] = (), out: str = "raster") -> DataFrame:
    """Picture rows of a pixel table (y, x from 0); ``keep`` is constant in an image."""
    listed = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).cast("double").alias("v"))))
    return pixels.groupBy(image).agg(
        *[F.first(c).alias(c) for c in keep], (F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"),
        F.transform(listed, lambda s: s["v"]).alias(out))


def pixels_of(pictures: DataFrame, image: str, arrays: list[str]) -> DataFrame:
    """One row per pixel (image, y, x) with the values of the arrays."""
    p = pictures.select(image, "width", F.posexplode(F.arrays_zip(*arrays)).alias("_i", "_v"))
    return p.select(image, F.expr("_i div width").cast("int").alias("y"), (F.col("_i") % F.col("width")).cast("int").alias("x"),
                    *[F.col(f"_v.{a}").alias(a) for a in arrays])


def _values(column: pa.Array) -> list[np.ndarray | None]:
    """One array of doubles per row; null entries are NaN, null rows None."""
    lengths = pc.list_value_length(column).to_pylist()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out, at = [], 0
    for n in lengths:
        out.append(None if n is None else flat[at: at + n])
        at += n or 0
    return out


def _column(values: list, kind: str) -> pa.Array:
    if kind != "array<double>":
        return pa.array(values, _ARROW[kind], from_pandas=True)
    flat = np.concatenate([np.ravel(v) for v in values]) if values else np.zeros(0)
    ends = np.cumsum([0] + [np.size(v) for v in values]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(flat, from_pandas=True))


def _kernel(df: DataFrame, keys: list[str], arrays: list[str], scalars: list[str], out: str, compute: Callable) -> DataFrame:
    """``keys`` with the rows that ``compute(arrays, scalars)`` gives for a
    picture: dictionaries by the names of ``out`` ("name kind, ...")."""
    picked = df.select(*keys, *scalars, *arrays)
    kinds = dict(f.rsplit(" ", 1) for f in out.split(", "))
    first, second = len(keys), len(keys) + len(scalars)

    def run(batches):
        for batch in batches:
            given = [_values(batch.column(second + k)) for k in range(len(arrays))]
            plain = [batch.column(first + k).to_pylist() for k in range(len(scalars))]
            rows, own, held = [], [], 0
            for i in range(batch.num_rows):
                found = compute([g[i] for g in given], [p[i] for p in plain])
                rows += found
                own += [i] * len(found)
                held += sum(np.size(v) for r in found for v in r.values())
                if held > _BATCH_VALUES or i == batch.num_rows - 1:
                    take = pa.array(own, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(k).take(take) for k in range(first)] + [_column([r[n] for r in rows], k) for n, k in kinds.items()],
                                                     names=[*keys, *kinds])
                    rows, own, held = [], [], 0

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:first])
    return picked.mapInArrow(run, types + out)


def _picture(values: np.ndarray | None, height: int | None, width: int | None) -> np.ndarray:
    """The values as rows and columns; none if they do not fill the picture."""
    if values is None or not height or not width or len(values) != height * width:
        return np.zeros((0, 0))
    return values.reshape(height, width)


def _like(values: np.ndarray | None, height, width, shape: tuple[int, int]) -> np.ndarray:
    """A frame on the picture's pixels; NaN where it has none."""
    out, frame = np.full(shape, np.nan), _picture(values, height, width)
    h, w = min(shape[0], frame.shape[0]), min(shape[1], frame.shape[1])
    out[:h, :w] = frame[:h, :w]
    return out


# --- kernels ----------------------------------------------------------------------

def turned(a: np.ndarray, orientation: str | None) -> np.ndarray | None:
    """The picture with its channel along +x; None for an unknown orientation."""
    how = {"x+": lambda v: v, "x-": np.fliplr, "y+": np.rot90, "y-": lambda v: np.rot90(v, -1)}.get(orientation)
    return None if how is None else how(a)


def equalize(values: np.ndarray, grid=(8, 8), clip: float = 2.0, bins: int = 256) -> np.ndarray:
    """Clipped local histogram equalisation with bilinear blending of cells.

    The histogram of a cell keeps at most ``clip`` times the mean bin count;
    the excess spreads evenly over all bins.  A constant picture is unchanged.
    """
    if not values.size or values.min() == values.max():
        return values.copy()
    level = np.clip(np.floor(values * bins), 0, bins - 1).astype(int)
    axes = []
    for n, cells in zip(values.shape, grid):
        cells = min(cells, n)
        edges = np.array([k * n // cells for k in range(cells + 1)])
        middle = (edges[:-1] + edges[1:] - 1) / 2
        place = np.interp(np.arange(n), middle, np.arange(cells))
        low = np.floor(place).astype(int)
        axes.append((cells, np.repeat(np.arange(cells), np.diff(edges)), low, np.minimum(low + 1, cells - 1), place - low))
    (ny, own_y, y0, y1, wy), (nx, own_x, x0, x1, wx) = axes
    cell = own_y[:, None] * nx + own_x[None]
    counts = np.bincount((cell * bins + level).ravel(), minlength=ny * nx * bins).reshape(ny, nx, bins).astype(float)
    size = counts.sum(2, keepdims=True)
    most = np.maximum(1.0, clip * size / bins)
    spread = np.maximum(counts - most, 0).sum(2, keepdims=True) / bins
    share = np.cumsum(np.minimum(counts, most) + spread, axis=2) / size
    wy, wx = wy[:, None], wx[None]
    at = lambda a, b: share[a[:, None], b[None], level]
    return (1 - wy) * ((1 - wx) * at(y0, x0) + wx * at(y0, x1)) + wy * ((1 - wx) * at(y1, x0) + wx * at(y1, x1))


def _correct(i, r, d, maximum: float, t_min: float, t_max: float):
    """Transmittance (NaN where invalid) and the fault masks of FAULTS."""
    with np.errstate(all="ignore"):
        zero, dark = ~(r - d > 0), ~(i - d > 0)
        t = np.where(zero, np.nan, (i - d) / (r - d))
        bright = np.fmax(np.fmax(i, r), d) >= maximum
        faults = (zero, bright, dark, t < t_min, t > t_max)
        return np.where(np.any(faults, axis=0), np.nan, t), faults


def _tiles(a: np.ndarray, size: int, box: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whole tiles of a centred run inside the box, with their corners (y, x)."""
    x0, x1, y0, y1 = box
    nx, ny = max(0, (x1 - x0) // size), max(0, (y1 - y0) // size)
    xs, ys = x0 + (x1 - x0 - nx * size) // 2, y0 + (y1 - y0 - ny * size) // 2
    stack = a[ys: ys + ny * size, xs: xs + nx * size].reshape(ny, size, nx, size).swapaxes(1, 2).reshape(-1, size, size)
    return stack, np.repeat(ys + size * np.arange(ny), nx), np.tile(xs + size * np.arange(nx), ny)


def gradients(tiles: np.ndarray) -> np.ndarray:
    """Central differences inside each tile, one-sided at its ends."""
    if min(tiles.shape[1:]) < 2:
        return np.full(tiles.shape, np.nan)
    return np.hypot(np.gradient(tiles, axis=2), np.gradient(tiles, axis=1))


def _edge(tiles: np.ndarray, by: int = 1) -> np.ndarray:
    return np.pad(tiles, ((0, 0), (by, by), (by, by)), mode="symmetric")


def neighbours(tiles: np.ndarray) -> np.ndarray:
    """|value - mean of its 3 x 3 neighbourhood|, edges mirrored inside the tile."""
    h, w = tiles.shape[1:]
    p = _edge(tiles)
    rows = p[:, :, :w] + p[:, :, 1: w + 1] + p[:, :, 2:]
    return np.abs(tiles - (rows[:, :h] + rows[:, 1: h + 1] + rows[:, 2:]) / 9)


def sobel(tiles: np.ndarray) -> np.ndarray:
    """Sobel gradient magnitude over 8, edges mirrored inside the tile."""
    h, w = tiles.shape[1:]
    p = _edge(tiles)
    side = lambda a, n: a[:, :n] + 2 * a[:, 1: n + 1] + a[:, 2:]
    gx = side(p, h)
    gy = side(p.swapaxes(1, 2), w).swapaxes(1, 2)
    return np.hypot(gx[:, :, 2:] - gx[:, :, :-2], gy[:, 2:] - gy[:, :-2]) / 8


def blurred(tiles: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian blur along both axes, edges mirrored as often as needed."""
    radius = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (1, 2):
        n = tiles.shape[axis]
        at = np.arange(-radius, n + radius) % (2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at)
        tiles = sum(w * np.take(tiles, at[k: k + n], axis=axis) for k, w in enumerate(weights))
    return tiles


def eroded(valid: np.ndarray, radius: int) -> np.ndarray:
    """Cross-shaped erosion, ``radius`` rounds; what lies outside a tile is invalid."""
    for _ in range(radius):
        p = np.pad(valid, ((0, 0), (1, 1), (1, 1)))
        valid = valid & p[:, :-2, 1:-1] & p[:, 2:, 1:-1] & p[:, 1:-1, :-2] & p[:, 1:-1, 2:]
    return valid


def filled(tile: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The tile with invalid values replaced by those of the nearest valid
    pixel (of equally near ones the first by row, then by column), which always
    has an invalid one beside it.  A tile without valid pixels is returned as it is."""
    if valid.all() or not valid.any():
        return tile
    ys, xs = np.nonzero(valid & ~eroded(valid[None], 1)[0])
    out = tile.copy()
    by, bx = np.nonzero(~valid)
    for a in range(0, len(by), 256):
        far = (by[a: a + 256, None] - ys) ** 2 + (bx[a: a + 256, None] - xs) ** 2
        near = far.argmin(1)
        out[by[a: a + 256], bx[a: a + 256]] = tile[ys[near], xs[near]]
    return out


# --- operators ----------------------------------------------------------------------

def correct_pictures(pictures: DataFrame, ref: DataFrame, dark: DataFrame, image: str, ref_key: str, dark_key: str, maximum: str,
                     t_min: float, t_max: float, invalid_limit: float, orientation: str | None = None, mask: str | None = None,
                     grid=(8, 8), clip: float = 2.0, bins: int = 256, keep: list[str] = ()) -> DataFrame:
    """Corrected pictures in canonical orientation, one row per picture.

    Adds T, od (null where invalid), valid and mask (1 or 0), texture, the
    counts of FAULTS, invalid_pixels, total_pixels and qc_status.  ``ref`` and
    ``dark`` are picture rows by ``ref_key`` / ``dark_key``; frame pixels that
    do not exist count as zero denominators.  ``texture`` is the equalised
    transmittance on a fixed [0, t_max] scale, invalid pixels at the picture's
    median: for texture only.  ``maximum`` is the column of the largest count.
    A picture whose values do not fill it, or of unknown orientation, has no
    pixels and fails.
    """
    frames = [f.select(k, F.struct("height", "width", "raster").alias(n)) for f, k, n in ((ref, ref_key, "_ref"), (dark, dark_key, "_dark"))]
    p = pictures.join(frames[0], ref_key, "left").join(frames[1], dark_key, "left")
    p = p.withColumns({"_r": F.col("_ref.raster"), "_d": F.col("_dark.raster"), "_rh": F.col("_ref.height"), "_rw": F.col("_ref.width"),
                       "_dh": F.col("_dark.height"), "_dw": F.col("_dark.width"),
                       "_o": F.col(orientation).cast("string") if orientation else F.lit("x+"), "_m": F.col(maximum).cast("double"),
                       "_mask": F.col(mask).cast("array<double>") if mask else F.lit(None).cast("array<double>")})

    def compute(arrays, scalars):
        (values, r, d, inside), (height, width, rh, rw, dh, dw, o, top) = arrays, scalars
        i = turned(_picture(values, height, width), o)
        if i is None:
            i = np.zeros((0, 0))
        raw = (height, width) if i.size else (0, 0)
        r, d = (turned(_like(v, h, w, raw), o) if i.size else i for v, h, w in ((r, rh, rw), (d, dh, dw)))
        t, faults = _correct(i, r, d, top if top is not None else np.inf, t_min, t_max)
        valid = np.isfinite(t)
        shown = np.where(valid, t, np.median(t[valid]) if valid.any() else 0.0)
        m = turned(_like(inside, height, width, raw), o) == 1 if inside is not None and i.size else np.ones(i.shape, bool)
        bad, total = int((~valid).sum()), i.size
        fail = bad == total or bad / total > invalid_limit
        with np.errstate(all="ignore"):
            od = -np.log10(t)
        return [dict(zip(FAULTS, (int(f.sum()) for f in faults))) | {
            "height": i.shape[0], "width": i.shape[1], "T": t, "od": od, "valid": valid.astype(float), "mask": m.astype(float),
            "texture": equalize(np.clip(shown / t_max, 0, 1), grid, clip, bins), "invalid_pixels": bad, "total_pixels": total,
            "qc_status": "FAIL" if fail else "PASS"}]

    out = _SIZE + ", T array<double>, od array<double>, valid array<double>, mask array<double>, texture array<double>, " + \
        ", ".join(f"{f} long" for f in FAULTS) + ", invalid_pixels long, total_pixels long, qc_status string"
    return _kernel(p, [image, *keep], ["raster", "_r", "_d", "_mask"], ["height", "width", "_rh", "_rw", "_dh", "_dw", "_o", "_m"], out, compute)


def edge_profiles(pictures: DataFrame, image: str, array: str, keep: list[str] = ()) -> DataFrame:
    """Mean absolute row difference, one row per (image, y) of each inner row edge."""
    def compute(arrays, scalars):
        a = _picture(arrays[0], *scalars)
        return [{"profile": np.abs(np.diff(a, axis=0)).mean(1) if a.shape[0] > 1 else np.zeros(0)}]
    p = _kernel(pictures, [image, *keep], [array], ["height", "width"], "profile array<double>", compute)
    return p.select(image, *keep, F.posexplode("profile").alias("y", "profile"))


def _box(scalars, shape) -> tuple[int, int, int, int] | None:
    if any(v is None for v in scalars):
        return None
    x0, x1, y0, y1 = map(int, scalars)
    return (x0, x1, y0, y1) if 0 <= x0 <= x1 <= shape[1] and 0 <= y0 <= y1 <= shape[0] else None


def _quantiles(values: np.ndarray, q: list[float]) -> np.ndarray:
    """Per row of ``values`` the quantiles of what is not NaN."""
    out = np.full((len(values), len(q)), np.nan)
    whole = np.isfinite(values).all(1)
    if whole.any():
        out[whole] = np.quantile(values[whole], q, axis=1).T
    for k in np.flatnonzero(~whole):
        some = values[k][np.isfinite(values[k])]
        if len(some):
            out[k] = np.quantile(some, q)
    return out


def _mean(values: np.ndarray, where: np.ndarray | None = None, power: int = 1, about: np.ndarray | None = None) -> np.ndarray:
    """Per row the mean of the finite values (in ``where``), NaN without any."""
    used = np.isfinite(values) & (True if where is None else where)
    many = used.sum(1)
    x = np.where(used, values if about is None else values - about[:, None], 0.0) ** power
    return np.where(many > 0, x.sum(1) / np.maximum(many, 1), np.nan)


def _spread(values: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """Population variance per row."""
    return _mean(values, where, 2, _mean(values, where))


def tile_features(pictures: DataFrame, image: str, size: int, box: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """Per-tile features of corrected pictures, one row per whole tile.

    ``box`` names x0, x1, y0, y1; without it the picture is the box, a box
    outside the picture has no tiles.  ``complete`` is false for tiles cut by
    the mask, ``all_valid`` for tiles with an invalid pixel; such tiles keep
    their row so their number is auditable.
    """
    def compute(arrays, scalars):
        t, od, valid, mask, texture = (_picture(a, *scalars[:2]) for a in arrays)
        found = _box(scalars[2:], t.shape) if box else (0, t.shape[1], 0, t.shape[0])
        if found is None:
            return []
        cut = lambda a: _tiles(a, size, found)
        shown, ys, xs = cut(texture)
        if not len(ys):
            return []
        flat = lambda a: a.reshape(len(ys), -1)
        t, od, ok, inside = (flat(cut(a)[0]) for a in (t, od, valid, mask))
        tens = _quantiles(od, [0.1, 0.9])
        columns = {"ty": np.searchsorted(np.unique(ys), ys), "tx": np.searchsorted(np.unique(xs), xs), "od_mean": _mean(od), "od_std": np.sqrt(_spread(od)),
                   "od_p10": tens[:, 0], "od_p90": tens[:, 1], "T_mean": _mean(t), "texture_gradient": _mean(flat(gradients(shown))),
                   "texture_neighbor": _mean(flat(neighbours(shown))), "x0": xs, "x1": xs + size, "y0": ys, "y1": ys + size,
                   "complete": (inside == 1).all(1), "all_valid": (ok == 1).all(1)}
        return [dict(zip(columns, row)) for row in zip(*(c.tolist() for c in columns.values()))]

    out = "ty int, tx int, " + ", ".join(f"{f} double" for f in TILE_FEATURES) + ", x0 int, x1 int, y0 int, y1 int, complete boolean, all_valid boolean"
    return _kernel(pictures, [image, *keep], ["T", "od", "valid", "mask", "texture"], ["height", "width", *(box or [])], out, compute)


def tile_fields(pictures: DataFrame, image: str, array: str, size: int) -> DataFrame:
    """Pictures of the gradient and the neighbour contrast inside each tile;
    null outside whole tiles."""
    def compute(arrays, scalars):
        a = _picture(arrays[0], *scalars)
        stack, ys, xs = _tiles(a, size, (0, a.shape[1], 0, a.shape[0]))
        out = {"height": a.shape[0], "width": a.shape[1]}
        for name, values in (("gradient", gradients(stack)), ("neighbor", neighbours(stack))) if len(ys) else (("gradient", []), ("neighbor", [])):
            field = np.full(a.shape, np.nan)
            for v, y, x in zip(values, ys, xs):
                field[y: y + size, x: x + size] = v
            out[name] = field
        return [out]
    return _kernel(pictures, [image], [array], ["height", "width"], _SIZE + ", gradient array<double>, neighbor array<double>", compute)


def interior(pictures: DataFrame, image: str, valid: str, radius: int) -> DataFrame:
    """Pictures of 1 where every pixel within ``radius`` steps is valid and inside."""
    def compute(arrays, scalars):
        a = _picture(arrays[0], *scalars)
        return [{"height": a.shape[0], "width": a.shape[1], "interior": eroded(a[None] == 1, radius)[0].astype(float)}]
    return _kernel(pictures, [image], [valid], ["height", "width"], _SIZE + ", interior array<double>", compute)


def region_tile_features(pictures: DataFrame, image: str, raw: str, valid: str, size: int, sigma: float, min_fraction: float, min_side: int = 2,
                         grid=(8, 8), clip: float = 2.0, bins: int = 256, box: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """Eight features of every tile of a masked gray region, tiles from its
    corner on and smaller ones at its far edges.

    Contrast is equalised inside the tile, with masked pixels at the value of
    their nearest valid one, so that what they show does not enter the
    histogram; a pixel without a value counts as masked.  Derivative features
    use pixels whose neighbourhood is valid.
    ``used`` tells tiles with enough valid and at least four interior pixels.
    """
    radius = max(1, math.ceil(4 * sigma))

    def compute(arrays, scalars):
        gray, ok = (_picture(a, *scalars[:2]) for a in arrays)
        if gray.shape != ok.shape:
            return []
        found = _box(scalars[2:], gray.shape) if box else (0, gray.shape[1], 0, gray.shape[0])
        if found is None:
            return []
        x0, x1, y0, y1 = found
        rows = []
        for ty, y in enumerate(range(y0, y1, size)):
            for tx, x in enumerate(range(x0, x1, size)):
                patch, inside = (a[y: min(y + size, y1), x: min(x + size, x1)] for a in (gray, (ok == 1) & np.isfinite(gray)))
                core = eroded(inside[None], radius)[0]
                n, many = int(inside.sum()), int(core.sum())
                used = min(patch.shape) >= min_side and n / inside.size >= min_fraction and many >= 4
                shown = equalize(filled(patch, inside), grid, clip, bins) if n else patch
                flat = lambda a: a.reshape(1, -1)
                i, c = flat(inside), flat(core)
                slope = flat(sobel(shown[None]))
                high = flat(shown - blurred(shown[None], sigma)[0])
                values = (_mean(flat(patch), i)[0], _spread(flat(patch), i)[0], _mean(flat(shown), i)[0], _spread(flat(shown), i)[0], _mean(slope, c)[0],
                          _quantiles(np.where(c, slope, np.nan), [0.9])[0, 0], math.sqrt(_spread(high, c)[0]) if many else math.nan, _mean(flat(neighbours(shown[None])), c)[0])
                rows.append({"ty": ty, "tx": tx, "n_valid": n, "n_interior": many, "n_pixels": inside.size, "used": bool(used)} | dict(zip(REGION_FEATURES, map(float, values))))
        return rows

    out = "ty int, tx int, " + ", ".join(f"{f} double" for f in REGION_FEATURES) + ", n_valid long, n_interior long, n_pixels long, used boolean"
    return _kernel(pictures, [image, *keep], [raw, valid], ["height", "width", *(box or [])], out, compute)
