"""Features of large chips: overlapping tiles as rows, one threshold for each chip, suppression across tiles in rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.config import DEFAULT, Settings
from farpoint.functions import raster
from farpoint.operators.tables import saved

#: Pixels along a side of what a tile answers for; it sees a margin more.
TILE = 256
TILES = "chip_id long, h int, w int, mpp double, blank boolean, lo double, hi double, core array<int>, top int, left int, rows int, pixels array<float>"
PEAK = "y int, x int, scale int, strength double"
FOUND = "chip_id long, status string, threshold double, rows array<struct<" + ",".join(":".join(c.split()) for c in raster.COLUMNS.split(", ")) + ">>"
FEATURE = [c.split()[0] for c in raster.COLUMNS.split(", ")]


def margin(sigmas: np.ndarray) -> int:
    """What a tile sees beyond its core: the tails of the widest smoothing and the places around a peak, and the patches that describe a feature."""
    large = float(sigmas[-1])
    return max(int(4.0 * large + 0.5) + 2, math.ceil(3.0 * math.sqrt(2) * large) + 2, 4)


def top_values(h: int, w: int, scales: int, quantile: float) -> int:
    """How many of a chip's largest values hold its quantile and the next one below."""
    return math.ceil((1.0 - quantile) * (h * w * scales - 1)) + 2


def tiles(chips: DataFrame, settings: Settings = DEFAULT, size: int = TILE) -> DataFrame:
    """TILES of ``chips`` (chip_id, h, w, pixels, mpp): cores of ``size`` x ``size`` with their margin, cut at the chip's edges. Chips without pixels have none; blank ones one, which is empty."""
    src = chips.where("pixels IS NOT NULL").select(F.col("chip_id").cast("long").alias("chip_id"), "h", "w", F.col("mpp").cast("double").alias("mpp"), F.col("pixels").cast("array<float>").alias("pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in TILES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32())]
        for b in batches:
            for k in range(b.num_rows):
                chip, h, w, mpp = (b.column(i)[k].as_py() for i in range(4))
                image = np.asarray(b.column(4)[k].values, np.float32).reshape(h, w)
                blank = bool(image.astype(float).std() < raster.BLANK)
                lo, hi = np.percentile(image.astype(float), [1, 99])
                out, see = [], margin(raster.sigmas_of(mpp, settings))
                for y in range(0, h, size):
                    for x in range(0, w, size):
                        core = [y, x, min(y + size, h), min(x + size, w)]
                        top, left = max(y - see, 0), max(x - see, 0)
                        part = image[top : core[2] + see, left : core[3] + see]
                        out.append((chip, h, w, mpp, blank, float(lo), float(hi), core, top, left, part.shape[0], part.ravel()))
                out = [(chip, h, w, mpp, True, float(lo), float(hi), [0, 0, 0, 0], 0, 0, 0, np.zeros(0, np.float32))] if blank else out
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return src.mapInArrow(run, TILES)


def peaks_of(tile: dict, settings: Settings) -> tuple[list[float], list[tuple]]:
    """A tile's largest values, as many as its chip's threshold may need, and the peaks that are as large as these: (y, x, scale, strength) in the chip."""
    sigmas = raster.sigmas_of(tile["mpp"], settings)
    part = np.asarray(tile["pixels"], np.float32).astype(float).reshape(tile["rows"], -1)
    cube = raster.scale_space(1.0 - np.clip((part - tile["lo"]) / (tile["hi"] - tile["lo"] + 1e-6), 0, 1), sigmas)
    y0, x0, y1, x1 = tile["core"]
    ys, xs = slice(y0 - tile["top"], y1 - tile["top"]), slice(x0 - tile["left"], x1 - tile["left"])
    own = cube[ys, xs].ravel()
    n = min(top_values(tile["h"], tile["w"], len(sigmas), settings.peak_quantile), len(own))
    most = np.sort(np.partition(own, len(own) - n)[len(own) - n :])[::-1]
    at = raster.peaks(cube, float(most[-1]))
    at = at[(at[:, 0] >= ys.start) & (at[:, 0] < ys.stop) & (at[:, 1] >= xs.start) & (at[:, 1] < xs.stop)]
    return most.tolist(), [(int(y) + tile["top"], int(x) + tile["left"], int(k), float(cube[y, x, k])) for y, x, k in at]


def candidates(cut: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(chip_id, blank, threshold) of each chip and (chip_id, PEAK) of what reaches its threshold.

    The threshold is the chip's exact quantile over all places and scales: no more than ``top_values`` of them are as
    large, whichever tiles they lie in, so each tile gives so many and the chip's are read off these.
    """
    fields = ("h", "w", "mpp", "lo", "hi", "core", "top", "left", "rows", "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                tile = {f: b.column(b.schema.get_field_index(f))[k] for f in fields}
                tile = {f: v.values.to_numpy(zero_copy_only=False) if f == "pixels" else v.as_py() for f, v in tile.items()}
                most, at = peaks_of(tile, settings)
                peak = pa.array([dict(zip(("y", "x", "scale", "strength"), p, strict=True)) for p in at], pa.struct([("y", pa.int32()), ("x", pa.int32()), ("scale", pa.int32()), ("strength", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([tile["h"] * tile["w"]], pa.int64()), pa.array([most], pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array([0, len(peak)], pa.int32()), peak)], names=["chip_id", "cells", "most", "peaks"])

    seen = saved(cut.where("NOT blank").mapInArrow(run, "chip_id long, cells long, most array<double>, peaks array<struct<y:int,x:int,scale:int,strength:double>>"))
    per = seen.groupBy("chip_id").agg(F.first("cells").alias("cells"), F.sort_array(F.flatten(F.collect_list("most")), False).alias("most"))
    place = F.lit(settings.peak_quantile) * (F.col("cells") * settings.n_scales - 1)
    low = F.floor(place)
    at = lambda rank: F.get("most", (F.col("cells") * settings.n_scales - 1 - rank).cast("int"))
    threshold = at(low) + F.when(place > low, (at(low + 1) - at(low)) * (place - low)).otherwise(F.lit(0.0))
    limits = per.select("chip_id", F.lit(False).alias("blank"), threshold.alias("threshold"))
    peaks = seen.select("chip_id", F.explode("peaks").alias("p")).select("chip_id", "p.*").join(limits, "chip_id").where((F.col("strength") >= F.col("threshold")) & (F.col("threshold") >= raster.NOISE_FLOOR))
    blank = cut.where("blank").select("chip_id", "blank", F.lit(None).cast("double").alias("threshold"))
    return limits.unionByName(blank), peaks.drop("blank", "threshold")


def suppressed(peaks: DataFrame, reach: float, by: str = "chip_id") -> DataFrame:
    """Of ``peaks`` (by, id, y, x, apart, strength; ids unique in their group, smaller ones first among equal strengths) those that one keeps going down from the strongest, leaving out what is not farther than its ``apart`` from one kept. ``reach``: the largest ``apart``.

    A spatial hash of cells as wide as ``reach`` gives each peak's stronger neighbours once. Then, round by round, a
    peak stays if none of these is left, and goes if one of them stays: rounds are as many as the longest chain of
    neighbours that rise, whatever the number of peaks, and each is saved.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = peaks.withColumn("o", F.explode(around)).select(by, F.col("id"), "apart", F.col("y"), F.col("x"), "strength", (cell("y") + F.col("o.i")).alias("cy"), (cell("x") + F.col("o.j")).alias("cx"))
    b = peaks.select(by, F.col("id").alias("other"), F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("strength").alias("os"), cell("y").alias("cy"), cell("x").alias("cx"))
    stronger = (F.col("os") > F.col("strength")) | ((F.col("os") == F.col("strength")) & (F.col("other") < F.col("id")))
    gap = (F.col("oy") - F.col("y")) * (F.col("oy") - F.col("y")) + (F.col("ox") - F.col("x")) * (F.col("ox") - F.col("x"))
    links = saved(a.join(b, [by, "cy", "cx"]).where(stronger & (gap <= F.col("apart") * F.col("apart"))).select(by, "id", "other"))
    dropped = None
    while links.limit(1).count():
        # who has no link stays; what links to one that stays goes, with all its links
        held = links.select(by, "id").distinct()
        stays = links.join(held.select(by, F.col("id").alias("other")), [by, "other"], "left_anti")
        goes = saved(stays.select(by, "id").distinct())
        dropped = goes if dropped is None else dropped.union(goes)
        links = saved(links.join(goes, [by, "id"], "left_anti").join(goes.select(by, F.col("id").alias("other")), [by, "other"], "left_anti"))
    return peaks if dropped is None else peaks.join(dropped, [by, "id"], "left_anti")


def described(cut: DataFrame, kept: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The features of ``kept`` (chip_id, y, x, r, strength, depth, threshold), each described in the tile whose core holds it; those that are too long are left out."""
    size = F.col("core")
    names = ("y", "x", "r", "strength", "depth", "threshold")
    per = kept.groupBy("chip_id").agg(F.collect_list(F.struct(*names)).alias("all"))  # as many as peaks reach the threshold
    own = F.filter("all", lambda p: (p["y"] >= size[0]) & (p["x"] >= size[1]) & (p["y"] < size[2]) & (p["x"] < size[3]))
    src = cut.join(per, "chip_id").withColumn("own", own).where(F.size("own") > 0).select("chip_id", "mpp", "top", "left", "rows", "own", "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                chip, mpp, top, left, rows, own = (b.column(i)[k].as_py() for i in range(6))
                image = b.column(6)[k].values.to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)
                for p in own:
                    if (row := raster.feature(image, p["x"] - left, p["y"] - top, p["r"], p["strength"], p["depth"], p["threshold"], mpp, settings)) is not None:
                        out.append((chip, row[0] + left, row[1] + top, *row[2:]))
            frame = dict(zip(["chip_id", *FEATURE[:-1]], zip(*out, strict=True) if out else [[]] * len(FEATURE), strict=True))
            yield pa.RecordBatch.from_pydict(frame, schema=kind)

    kind = pa.schema([("chip_id", pa.int64()), *[(n, pa.bool_() if n == "shape_reliable" else pa.float64()) for n in FEATURE[:-1]]])
    return src.mapInArrow(run, "chip_id long, " + raster.COLUMNS.rpartition(", ")[0])


def found(chips: DataFrame, settings: Settings = DEFAULT, size: int = TILE) -> DataFrame:
    """FOUND: a row for each of ``chips`` (chip_id unique, h, w, pixels, mpp) with pixels: status, threshold and rows of ``raster.COLUMNS``, strongest first.

    The same as ``raster.inspect`` of the whole chip, in tiles: no task holds more than a tile's scales, and one chip is
    the work of many tasks. Tiles are saved, as they are read for peaks and again for the features' shapes.
    """
    cut = saved(tiles(chips, settings, size))
    limits, peaks = candidates(cut, settings)
    limits, peaks = saved(limits), saved(peaks)
    # a pixel is mpp metres wide, and the largest feature of a chip as many pixels as these settings say
    pixels = cut.select("chip_id", "mpp").distinct()
    radius = F.pandas_udf(lambda mpp, k: (mpp.combine(k, lambda m, i: math.sqrt(2) * float(raster.sigmas_of(m, settings)[int(i)]))), "double")
    sized = peaks.join(pixels, "chip_id").withColumn("r", radius(F.col("mpp"), F.col("scale").cast("double"))).withColumn("apart", F.greatest(F.lit(3.0), 0.75 * F.col("r")))
    # the order in which a chip's places are gone through: rows, columns, scales
    sized = saved(sized.withColumn("id", (F.col("y").cast("long") * (1 << 24) + F.col("x")) * 1024 + F.col("scale")))
    reach = sized.agg(F.max("apart")).first()[0] or 3.0
    kept = suppressed(sized, reach).where(F.col("r") >= settings.min_radius_px)
    chip = Window.partitionBy("chip_id")
    depth = (F.col("strength") - F.min("strength").over(chip)) / (F.max("strength").over(chip) - F.min("strength").over(chip) + 1e-12)
    kept = kept.withColumn("depth", depth).join(limits.select("chip_id", "threshold"), "chip_id")
    rows = described(cut, kept.select("chip_id", "y", "x", "r", "strength", "depth", "threshold"), settings)
    struct = F.struct(*[F.col(c) for c in FEATURE[:-1]])
    first = F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("s"), "y", "x", struct.alias("f"))))
    listed = rows.groupBy("chip_id").agg(first.alias("l"))
    numbered = F.transform("l", lambda e, i: F.struct(*[e["f"][c].alias(c) for c in FEATURE[:-1]], i.cast("int").alias(FEATURE[-1])))
    listed = listed.select("chip_id", numbered.alias("rows"))
    status = F.when(F.col("blank"), "blank_chip").when(F.col("threshold") < raster.NOISE_FLOOR, "noise_floor").otherwise("ok")
    none = F.array().cast(FOUND.rpartition("rows ")[2])
    return limits.join(listed, "chip_id", "left").select("chip_id", status.alias("status"), "threshold", F.coalesce("rows", none).alias("rows"))


def detections(chips: DataFrame, settings: Settings = DEFAULT, size: int = TILE) -> DataFrame:
    """chip_id and ``raster.COLUMNS`` of every feature of ``chips`` (see ``found``)."""
    return found(chips, settings, size).select("chip_id", F.explode("rows").alias("f")).select("chip_id", "f.*")
