"""A survey's map service as a source of products around grid points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.config import DEFAULT
from farpoint.functions import geo
from farpoint.sources import records
from farpoint.sources.service import Transport, fetched

# Fixed values of the service: the marker of an exception answer and where it stands, and a request for records.
MARKER, WITHIN = "ServiceExceptionReport", 1500
INFO = {
    "SERVICE": "WMS", "VERSION": "1.1.1", "REQUEST": "GetFeatureInfo", "SRS": "EPSG:4326", "WIDTH": "512", "HEIGHT": "512",
    "STYLES": "", "FORMAT": "image/png", "X": "256", "Y": "256", "INFO_FORMAT": "text/yaml",
}


def is_exception(body: Column) -> Column:
    return F.decode(F.substring(body, 1, WITHIN), "ISO-8859-1").contains(MARKER)  # any bytes can be read so


def search_radius(step: float) -> float:
    """Degrees around a grid point that a request covers: neighbours overlap."""
    return max(0.6 * step, 0.15)


def info_request(layer: str, lon: Column, lat: Column, radius_deg: float, feature_count: int = DEFAULT.feature_count) -> Column:
    """The parameters, as JSON, of a request for the records around a point; null where its box crosses the date line.

    Bounds in longitude are wrapped; latitudes beyond a pole are asked for as they are, as the service takes them.
    """
    west, east = geo.normalize_lon(lon - radius_deg), geo.normalize_lon(lon + radius_deg)
    bounds = F.concat_ws(",", *[x.cast("string") for x in (west, lat - radius_deg, east, lat + radius_deg)])
    own = {k: F.lit(v) for k, v in INFO.items()} | {"BBOX": bounds, "LAYERS": F.lit(layer), "QUERY_LAYERS": F.lit(layer), "FEATURE_COUNT": F.lit(str(feature_count))}
    return F.when((west <= east) & lat.isNotNull(), F.to_json(F.struct(*[own[k].alias(k) for k in sorted(own)])))


def answers(points: DataFrame, transport: Transport, store: str, layer: str, radius_deg: float = 0.15, feature_count: int = DEFAULT.feature_count, per_second: float = 2.0, partitions: int = 8) -> DataFrame:
    """(lon, lat, body) for ``points``: what the service answers around them, kept at ``store`` as ``service.fetched`` keeps it.

    body is null for points whose box crosses the date line, which are not asked for, and where all tries failed.
    """
    asked = points.select("lon", "lat", info_request(layer, F.col("lon"), F.col("lat"), radius_deg, feature_count).alias("params"))
    return fetched(asked, transport, store, per_second, partitions).drop("params")


def products(got: DataFrame, layer: str) -> DataFrame:
    """Raw product rows of the ``answers`` that are no exceptions; a place that a record lacks is its grid point's."""
    raw = records.records(got.where(~is_exception(F.col("body"))), layer)
    return raw.withColumns({c: F.when(F.expr(f"try_cast({c} AS DOUBLE)").isNotNull(), F.col(c)).otherwise(F.col(p).cast("string")) for c, p in (("center_lon", "lon"), ("center_lat", "lat"))}).drop("lon", "lat")


def chip_boxes(manifest: DataFrame, span_m: float) -> DataFrame:
    """``manifest`` with each chip's bbox; null where it would cross a pole or the date line."""
    return manifest.withColumn("bbox", geo.bbox(F.col("center_lon"), F.col("center_lat"), F.lit(float(span_m))))


def task_range(manifest: DataFrame, task: int, each: int, total: int) -> DataFrame:
    """The chips of one task."""
    return manifest.where((F.col("manifest_index") >= task * each) & (F.col("manifest_index") < min((task + 1) * each, total)))
