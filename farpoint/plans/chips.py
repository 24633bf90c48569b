"""From a manifest to placed detections: boxes, images, terrain, guards, features, coordinates, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.config import DEFAULT, Settings
from farpoint.functions import geo, raster
from farpoint.operators import detection
from farpoint.operators.tables import saved
from farpoint.sources import imagery, service, survey
from farpoint.sources.files import CRATERS, METADATA, exists
from farpoint.streaming import monitor

#: Layers are names that the service gives; these stand for its images and its heights.
IMAGES, HEIGHTS = "images", "heights"


def lookup(manifest: DataFrame, wanted: DataFrame, index: str = "manifest_index") -> DataFrame:
    """The manifest's rows of ``wanted`` (with the index); what the manifest lacks gives none, repeats count once."""
    return manifest.join(wanted.select(index).distinct(), index)


def remaining(manifest: DataFrame, out: str) -> DataFrame:
    """The manifest's rows that have no result yet, or a failed one."""
    spark = manifest.sparkSession
    if not exists(spark, f"{out}/chips/*.parquet"):
        return manifest
    done = spark.read.parquet(f"{out}/chips").where(~F.col("status").isin(*monitor.FAILED) | (F.col("status") == "invalid_bbox"))
    return monitor.missing_chips(manifest, done)


def process(manifest: DataFrame, transport: service.Transport, out: str, settings: Settings = DEFAULT, layers: tuple[str, str] = (IMAGES, HEIGHTS), per_second: float = 2.0, terrain_px: int = 64) -> tuple[DataFrame, DataFrame]:
    """Works off what ``remaining`` says and appends to the tables ``out``/craters and ``out``/chips; returns both, whole.

    A chip's status is ok, invalid_bbox (its box crosses a pole or the date line), chip_download_failed, blank_chip or
    noise_floor; all but the first have no features. Answers are kept in ``out``/answers, so a second run asks only for
    what failed. Of a chip that failed before, the last row counts. Large chips are worked on in tiles.
    """
    spark, px = manifest.sparkSession, settings.chip_size_px
    todo = survey.chip_boxes(remaining(manifest, out).select("manifest_index", "product_id", "center_lon", "center_lat"), settings.chip_span_m)
    mpp = geo.metres_per_pixel(F.col("bbox"), px, px)
    todo = todo.withColumns({"mpp_x": mpp[0], "mpp_y": mpp[1]}).withColumn("mpp", (F.col("mpp_x") + F.col("mpp_y")) / 2.0)
    ask = lambda layer, kind, n: F.struct(F.lit(kind).alias("kind"), imagery.map_request(layer, F.col("bbox"), n, n, kind).alias("params"))
    asked = todo.withColumn("ask", F.explode(F.array(ask(layers[0], imagery.IMAGE, px), ask(layers[1], imagery.TERRAIN, terrain_px)))).select(*todo.columns, "ask.*")
    got = service.fetched(asked, transport, f"{out}/answers", per_second).drop("params")
    images, heights = got.where(F.col("kind") == imagery.IMAGE), got.where(F.col("kind") == imagery.TERRAIN)
    # pixels are read once, and once more in tiles; they are in no join
    pixels = saved(imagery.decoded(images, imagery.IMAGE).withColumnRenamed("manifest_index", "chip_id"))
    found = detection.found(pixels, settings).withColumnRenamed("status", "seen")
    ground = raster.terrain(imagery.decoded(heights, imagery.TERRAIN), "manifest_index")

    status = F.when(F.col("bbox").isNull(), "invalid_bbox").when(F.col("lacks"), "chip_download_failed").otherwise(F.col("seen"))
    done = pixels.withColumn("lacks", F.col("pixels").isNull()).drop("pixels").join(found, "chip_id", "left").withColumn("status", status)
    done = done.join(ground.withColumnRenamed("manifest_index", "chip_id"), "chip_id", "left")
    done.select(
        F.col("chip_id").cast("int").alias("chip_index"), "product_id", "center_lon", "center_lat", "bbox", "mpp_x", "mpp_y", F.col("mpp").alias("mpp_mean"), F.lit(px).alias("chip_size_px"), F.lit(settings.chip_span_m).alias("chip_span_m"),
        F.coalesce(F.size("rows"), F.lit(0)).alias("n_craters"), "threshold", "terrain_mean_m", "terrain_std_m", "terrain_slope_proxy", "status", F.current_timestamp().alias("written"), "rows",
    ).write.mode("append").parquet(f"{out}/chips")
    return results(spark, out, settings)


def results(spark, out: str, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(craters, chips) under ``out``: of each chip its last row; features with their coordinates, under the names of a catalogue."""
    every = spark.read.parquet(f"{out}/chips")
    row = F.struct(*every.columns)
    last = every.groupBy("chip_index").agg(F.max_by(row, F.struct("written", F.xxhash64("status"))).alias("r")).select("r.*")
    px = settings.chip_size_px
    features = last.select("chip_index", "product_id", "bbox", F.explode("rows").alias("f"))
    lon, lat = geo.pixel_lon_lat(F.col("f.x"), F.col("f.y"), F.col("bbox"), px, px)
    made = features.withColumns({"lon_deg": lon, "lat_deg": lat})
    own = {f.name: F.col(f"f.{f.name}") for f in CRATERS if f.name not in ("lon_deg", "lat_deg", "product_id", "chip_index")}
    return made.select(*[own.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CRATERS]), last.select(*[f.name for f in METADATA])
