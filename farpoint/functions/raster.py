"""Raster chips: relational forms over (chip, y, x, v), and array kernels where neighbourhoods make those too wide."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.config import DEFAULT, Settings


def cells(chips: DataFrame, width: Column | int, pixels: str = "pixels", chip: str = "chip_id") -> DataFrame:
    """(chip_id, y, x, v) from rows of pixels in row order."""
    w = F.lit(width) if isinstance(width, int) else width
    p = F.col("pos")
    return chips.select(F.col(chip).alias("chip_id"), w.alias("w"), F.posexplode(pixels).alias("pos", "v")).select("chip_id", F.floor(p / F.col("w")).cast("int").alias("y"), (p % F.col("w")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def stretch_bounds(c: DataFrame, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Per chip: two percentiles, mean and population deviation, and whether it is blank."""
    return c.groupBy("chip_id").agg(F.percentile("v", lo).alias("lo"), F.percentile("v", hi).alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).withColumn("blank", F.col("std") < 1e-4)


def stretched(c: DataFrame, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Cells between their chip's percentiles as 0 to 1."""
    b = stretch_bounds(c, lo, hi).select("chip_id", "lo", "hi")
    s = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6)
    return c.join(b, "chip_id").select("chip_id", "y", "x", F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)).alias("v"))


def moments(c: DataFrame) -> DataFrame:
    """Per chip: centroid, second moments, axes, circularity, ellipticity and orientation of what is darker than the median.

    Weights are (1 - v) less its median, 0 at least. Null shape where they sum to nothing.
    """
    inv = c.withColumn("i", 1.0 - F.col("v"))
    med = inv.groupBy("chip_id").agg(F.percentile("i", 0.5).alias("m"))
    w = inv.join(med, "chip_id").withColumn("w", F.greatest(F.col("i") - F.col("m"), F.lit(0.0)))
    s = lambda e: F.sum(F.col("w") * e)
    x, y = F.col("x"), F.col("y")
    g = w.groupBy("chip_id").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"))
    g = g.where((F.col("n") >= 25) & (F.col("sw") > 1e-8)).withColumns({"cx": F.col("sx") / F.col("sw"), "cy": F.col("sy") / F.col("sw")})
    g = g.withColumns({"cxx": F.col("sxx") / F.col("sw") - F.col("cx") * F.col("cx"), "cyy": F.col("syy") / F.col("sw") - F.col("cy") * F.col("cy"), "cxy": F.col("sxy") / F.col("sw") - F.col("cx") * F.col("cy")})
    half, mid = F.sqrt(F.pow((F.col("cxx") - F.col("cyy")) / 2.0, 2) + F.col("cxy") * F.col("cxy")), (F.col("cxx") + F.col("cyy")) / 2.0
    g = g.withColumns({"major": F.sqrt(F.greatest(mid + half, F.lit(0.0))), "minor": F.sqrt(F.greatest(mid - half, F.lit(0.0)))})
    circ = F.when(F.col("major") > 1e-12, F.col("minor") / F.col("major"))
    n_eff = F.greatest(F.col("sw") * F.col("sw") / F.col("sww"), F.lit(1.0))
    e = F.when(circ > 1e-6, 1.0 / F.when(circ > 1e-6, circ))
    theta = F.degrees((F.col("major") + F.col("minor")) / F.greatest(F.col("major") - F.col("minor"), F.lit(1e-6)) / F.sqrt(2.0 * n_eff))
    clip = lambda v, a, b: F.least(F.greatest(v, F.lit(a)), F.lit(b))
    return g.select("chip_id", "cx", "cy", "major", "minor", circ.alias("circularity"), e.alias("ellipticity"), F.degrees(0.5 * F.atan2(2.0 * F.col("cxy"), F.col("cxx") - F.col("cyy"))).alias("orientation_deg"), clip(theta, 0.1, 180.0).alias("orientation_unc_deg"), clip(e / F.sqrt(2.0 * n_eff), 0.001, 100.0).alias("ellipticity_unc"))


def rim_contrast(c: DataFrame, x0: Column, y0: Column, r: Column) -> DataFrame:
    """Per chip: (rim - floor) / deviation of the surroundings, 0 where a zone has too few cells or the surroundings are flat."""
    d = F.sqrt(F.pow(F.col("x") - x0, 2) + F.pow(F.col("y") - y0, 2))
    floor, rim, ground = d <= 0.5 * r, (d >= 0.8 * r) & (d <= 1.3 * r), (d >= 2.0 * r) & (d <= 3.0 * r)
    v = F.col("v")
    g = c.groupBy("chip_id").agg(F.avg(F.when(floor, v)).alias("f"), F.avg(F.when(rim, v)).alias("m"), F.stddev_pop(F.when(ground, v)).alias("s"), F.count_if(floor).alias("nf"), F.count_if(rim).alias("nm"), F.count_if(ground).alias("ng"))
    ok = (F.col("nf") >= 3) & (F.col("nm") >= 3) & (F.col("ng") >= 5) & (F.col("s") >= 1e-8)
    return g.select("chip_id", F.when(ok, (F.col("m") - F.col("f")) / F.when(ok, F.col("s"))).otherwise(F.lit(0.0)).alias("rcr"))


def slope(c: DataFrame) -> DataFrame:
    """Per chip: mean, population deviation, and the median length of the gradient (central differences, one-sided at edges)."""

    def gradient(along: str, across: str) -> Column:
        w = Window.partitionBy("chip_id", across).orderBy(along)
        a, b, v = F.lag("v").over(w), F.lead("v").over(w), F.col("v")
        return F.when(a.isNull(), b - v).when(b.isNull(), v - a).otherwise((b - a) / 2.0)

    g = c.withColumns({"gx": gradient("x", "y"), "gy": gradient("y", "x")})
    length = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return g.groupBy("chip_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile(length, 0.5).alias("slope"))


def depth_proxy(detections: DataFrame, chip: str = "chip_id") -> DataFrame:
    """``detections`` with their strength between their chip's least and most as 0 to 1."""
    per = detections.groupBy(chip).agg(F.min("strength").alias("__lo"), F.max("strength").alias("__hi"))
    return detections.join(per, chip).withColumn("depth_proxy", (F.col("strength") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-12)).drop("__lo", "__hi")


# Array kernels; each works on one chip.


def smoothed(image: np.ndarray, sigma: float, order: tuple[int, int]) -> np.ndarray:
    """Gaussian derivatives of order 0 or 2 along each axis; edges are mirrored, tails end at four sigma."""
    half = int(4.0 * sigma + 0.5)
    t = np.arange(-half, half + 1)
    g = np.exp(-0.5 * (t / sigma) ** 2)
    g /= g.sum()
    out = image.astype(float)
    for axis, k in enumerate(order):
        taps = g if k == 0 else (t**2 / sigma**4 - 1.0 / sigma**2) * g
        pad = np.pad(out, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        n = out.shape[axis]
        out = sum(w * np.take(pad, np.arange(i, i + n), axis=axis) for i, w in enumerate(taps))
    return out


def scale_space(image: np.ndarray, sigmas: np.ndarray) -> np.ndarray:
    """Rows x columns x scales: the negative Laplacian of Gaussian, scaled by sigma squared."""
    return np.stack([-(s**2) * (smoothed(image, s, (2, 0)) + smoothed(image, s, (0, 2))) for s in sigmas], axis=-1)


def peaks(cube: np.ndarray, threshold: float) -> np.ndarray:
    """(y, x, scale) of values at or above the threshold that are the largest of 5 x 5 places and 3 scales around."""
    top = cube
    for axis, half in ((0, 2), (1, 2), (2, 1)):
        pad = np.pad(top, [(half, half) if a == axis else (0, 0) for a in range(3)], mode="edge")
        n = cube.shape[axis]
        top = np.maximum.reduce([np.take(pad, np.arange(i, i + n), axis=axis) for i in range(2 * half + 1)])
    return np.argwhere((cube == top) & (cube >= threshold))


def suppressed(xy: np.ndarray, r: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Indices that stay, strongest first: those farther than max(3, 0.75 r) from every stronger one that stays."""
    kept: list[int] = []
    for i in np.argsort(-strength, kind="stable"):
        d = ((xy[kept] - xy[i]) ** 2).sum(1) if kept else np.array([np.inf])
        if d.min() > max(3.0, 0.75 * r[i]) ** 2:
            kept.append(int(i))
    return np.array(kept, dtype=int)


def shape_of(image: np.ndarray, x: float, y: float, r: float, confident: float = DEFAULT.confident_radius_px) -> tuple[float, float, float, bool, float, float]:
    """(circularity, ellipticity, orientation, reliable, orientation_unc, ellipticity_unc) of the dark patch around a peak; NaN where there is none."""
    none = (math.nan, math.nan, math.nan, False, math.nan, math.nan)
    half = max(3, math.ceil(2.5 * r))
    cx, cy = round(x), round(y)
    y0, x0 = max(cy - half, 0), max(cx - half, 0)
    patch = 1.0 - image[y0 : cy + half + 1, x0 : cx + half + 1]
    if patch.size < 25:
        return none
    w = np.maximum(patch - np.median(patch), 0.0)
    total = w.sum()
    if total <= 1e-8:
        return none
    yy, xx = np.mgrid[y0 : y0 + patch.shape[0], x0 : x0 + patch.shape[1]]
    mx, my = (w * xx).sum() / total, (w * yy).sum() / total
    a, b, c = (w * (xx - mx) ** 2).sum() / total, (w * (yy - my) ** 2).sum() / total, (w * (xx - mx) * (yy - my)).sum() / total
    mid, arm = (a + b) / 2, math.hypot((a - b) / 2, c)
    major, minor = math.sqrt(max(mid + arm, 0.0)), math.sqrt(max(mid - arm, 0.0))
    if major <= 1e-12:
        return none
    circ = minor / major
    e = 1.0 / circ if circ > 1e-6 else math.inf
    n = 2.0 * max(total**2 / (w**2).sum(), 1.0)
    turn = math.degrees((major + minor) / max(major - minor, 1e-6) / math.sqrt(n))
    return circ, e, math.degrees(0.5 * math.atan2(2 * c, a - b)), r >= confident, min(max(turn, 0.1), 180.0), min(max(e / math.sqrt(n), 0.001), 100.0)


def contrast_of(image: np.ndarray, x: float, y: float, r: float) -> float:
    half = math.ceil(3.0 * r) + 1
    y0, x0 = max(round(y) - half, 0), max(round(x) - half, 0)
    part = image[y0 : round(y) + half + 1, x0 : round(x) + half + 1]
    yy, xx = np.mgrid[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]]
    d = np.hypot(xx - x, yy - y)
    floor, rim, ground = part[d <= 0.5 * r], part[(d >= 0.8 * r) & (d <= 1.3 * r)], part[(d >= 2.0 * r) & (d <= 3.0 * r)]
    if len(floor) < 3 or len(rim) < 3 or len(ground) < 5 or ground.std() < 1e-8:
        return 0.0
    return float((rim.mean() - floor.mean()) / ground.std())


# Deviation of a blank chip, threshold of noise.
BLANK, NOISE_FLOOR = 1e-4, 0.01
COLUMNS = "x double, y double, radius_px double, radius_m double, strength double, depth_proxy double, circularity double, ellipticity double, orientation_deg double, shape_reliable boolean, orientation_unc_deg double, ellipticity_unc double, nls double, rcr double, freshness_index double, threshold double, row_in_chip int"


def sigmas_of(mpp: float, settings: Settings = DEFAULT) -> np.ndarray:
    """The scales of the smoothing for pixels of ``mpp`` metres, from the least radius to the largest, each by the same factor."""
    small = max(settings.radius_range_m[0] / mpp, 1.2)
    large = max(settings.radius_range_m[1] / mpp, 1.2 * small)
    s0 = max(small / math.sqrt(2), 0.55)
    return np.geomspace(s0, max(large / math.sqrt(2), 1.01 * s0), settings.n_scales)


def feature(image: np.ndarray, x: float, y: float, r: float, strength: float, depth: float, threshold: float, mpp: float, settings: Settings = DEFAULT) -> tuple | None:
    """COLUMNS but the last of a peak at (x, y) of ``image``; None where its shape is too long."""
    shape = shape_of(image, x, y, r, settings.confident_radius_px)
    if not math.isnan(shape[0]) and shape[0] < settings.min_circularity:
        return None
    nls, rcr = strength / max(threshold, 1e-30), contrast_of(image, x, y, r)
    fresh = settings.weight_strength * min(max((nls - 1.0) / (settings.nls_scale - 1.0), 0.0), 1.0) + settings.weight_contrast * min(max(rcr / settings.rcr_scale, 0.0), 1.0)
    return (x, y, r, r * mpp, strength, depth, *shape, nls, rcr, fresh, threshold)


def inspect(image: np.ndarray, mpp: float, settings: Settings = DEFAULT) -> tuple[str, float | None, list[tuple]]:
    """(status, threshold, rows of COLUMNS, strongest first): blank_chip and noise_floor have no rows, others are ok."""
    if image.std() < BLANK:
        return "blank_chip", None, []
    lo, hi = np.percentile(image, [1, 99])
    inverted = 1.0 - np.clip((image - lo) / (hi - lo + 1e-6), 0, 1)
    sigmas = sigmas_of(mpp, settings)
    cube = scale_space(inverted, sigmas)
    threshold = float(np.quantile(cube, settings.peak_quantile))
    if threshold < NOISE_FLOOR:
        return "noise_floor", threshold, []
    at = peaks(cube, threshold)
    if not len(at):
        return "ok", threshold, []
    r, strength = math.sqrt(2) * sigmas[at[:, 2]], cube[tuple(at.T)]
    keep = suppressed(at[:, 1::-1].astype(float), r, strength)
    keep = keep[r[keep] >= settings.min_radius_px]
    if not len(keep):
        return "ok", threshold, []
    s = strength[keep]
    depth = (s - s.min()) / (s.max() - s.min() + 1e-12)
    out = []
    for i, d in zip(keep, depth, strict=True):
        row = feature(image, float(at[i, 1]), float(at[i, 0]), float(r[i]), float(strength[i]), float(d), threshold, mpp, settings)
        if row is not None:
            out.append((*row, len(out)))
    return "ok", threshold, out


def detect(image: np.ndarray, mpp: float, settings: Settings = DEFAULT) -> list[tuple]:
    """Rows of COLUMNS for one chip, strongest first; none for a blank chip or one whose threshold is noise."""
    return inspect(image, mpp, settings)[2]


def terrain(chips: DataFrame, key: str, pixels: str = "pixels") -> DataFrame:
    """(key, terrain_mean_m, terrain_std_m, terrain_slope_proxy) of heights in row order; null where none is finite."""

    def run(h: pd.Series, w: pd.Series, values: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, p in zip(h, w, values, strict=True):
            z = np.asarray(p, float).reshape(int(a), int(b)) if p is not None else np.zeros((0, 0))
            if not np.isfinite(z).any():
                out.append((None, None, None))
                continue
            steps = [np.gradient(z, axis=k) if z.shape[k] > 1 else np.zeros_like(z) for k in (0, 1)]
            out.append((np.nanmean(z), np.nanstd(z), np.nanmedian(np.hypot(*steps))))
        return pd.DataFrame(out, columns=["mean", "std", "slope"])

    g = chips.select(key, F.pandas_udf(run, "struct<mean:double,std:double,slope:double>")("h", "w", pixels).alias("g"))
    return g.select(key, F.col("g.mean").alias("terrain_mean_m"), F.col("g.std").alias("terrain_std_m"), F.col("g.slope").alias("terrain_slope_proxy"))
