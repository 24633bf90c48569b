"""Catalogues: one row of each fingerprint, product, calibration twin or sky bin, and samples over bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.config import DEFAULT
from farpoint.functions import geo

FINGERPRINT = ("radius_m", "freshness_index", "ellipticity", "orientation_deg", "shape_reliable")


def first_of(df: DataFrame, keys: list[Column], by: list[Column]) -> DataFrame:
    """Of the rows with equal keys (null equals null) the first in the order of ``by``.

    An aggregate that is summed before its shuffle: a key with a third of all rows costs a row for each task.
    """
    row, best = F.struct(*df.columns), F.struct(*[b.alias(f"o{i}") for i, b in enumerate(by)])
    return df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, best).alias("__r")).select("__r.*")


def number(c: str) -> Column:
    """NaN as null, so that missing equals missing."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def dedup(craters: DataFrame, idx: str = "idx") -> DataFrame:
    """Of the rows with one fingerprint (whichever of its columns exist) the first by ``idx``."""
    keys = [F.col(c) if c == "shape_reliable" else number(c) for c in FINGERPRINT if c in craters.columns]
    return first_of(craters, keys, [F.col(idx)]) if keys else craters


def missing_last(c: str) -> list[Column]:
    return [F.col(c).isNull(), F.col(c)]


def best_products(products: DataFrame) -> DataFrame:
    """Of each product the row of finest resolution; ties by place."""
    return first_of(products, [F.col("product_id")], [*missing_last("resolution_mpp"), F.col("center_lat"), F.col("center_lon")])


def best_observations(products: DataFrame) -> DataFrame:
    """Of calibration twins (ids alike but for the last character) the one of finest resolution, then of smaller id."""
    stem = F.expr("substring(product_id, 1, length(product_id) - 1)")
    return first_of(products, [stem], [*missing_last("resolution_mpp"), F.col("product_id")])


def bin_key(size: float = 15.0) -> Column:
    cut = lambda c, lo: geo.grid_bin(F.col(c), lo, size).cast("int").cast("string")
    return F.concat_ws("_", cut("center_lat", -90.0), cut("center_lon", -180.0))


def stratified(products: DataFrame, n: int, size: float = 15.0) -> DataFrame:
    """``n`` products: first the best of each bin, bins in the order of their names, then the finest of the others.

    Only the best of each bin are numbered one by one; there are no more of them than bins.
    """
    rows = products.where(F.col("center_lon").isNotNull() & F.col("center_lat").isNotNull()).withColumn("__bin", bin_key(size))
    order = [*missing_last("resolution_mpp"), F.col("product_id")]
    best = first_of(rows, [F.col("__bin")], order).withColumn("__pass", F.lit(0))
    rest = rows.join(best.select("product_id"), "product_id", "left_anti").withColumn("__pass", F.lit(1))
    both = best.unionByName(rest.select(best.columns))
    name = F.when(F.col("__pass") == 0, F.col("__bin"))
    picked = both.orderBy("__pass", name, *order).limit(n)
    return picked.orderBy(*order).drop("__bin", "__pass")


def numbered(products: DataFrame) -> DataFrame:
    """With manifest_index from 0, by resolution and id. A manifest is a bounded sample, so one task may number it."""
    w = Window.partitionBy(F.lit(0)).orderBy(*missing_last("resolution_mpp"), "product_id")
    return products.withColumn("manifest_index", (F.row_number().over(w) - 1).cast("int"))


def in_lon_range(products: DataFrame, lo: float, hi: float) -> DataFrame:
    return products.where(geo.lon_in_range(F.col("center_lon"), lo, hi))


def clean_products(raw: DataFrame, max_resolution: float = DEFAULT.max_resolution_mpp) -> DataFrame:
    """Typed rows of what a survey answers: ids trimmed and not empty, resolution and latitude finite, longitude wrapped."""
    f = lambda c: F.nanvl(F.expr(f"try_cast({c} AS DOUBLE)"), F.lit(None).cast("double"))
    angles = {c: f(c) for c in ("incidence_angle_deg", "emission_angle_deg", "phase_angle_deg") if c in raw.columns}
    out = raw.withColumns({"product_id": F.trim("product_id"), "resolution_mpp": f("resolution_mpp"), "center_lon": geo.normalize_lon(f("center_lon")), "center_lat": f("center_lat"), **angles})
    finite = F.abs("resolution_mpp") < float("inf")
    return out.where((F.col("product_id") != "") & finite & (F.col("resolution_mpp") <= max_resolution) & (F.abs("center_lat") < float("inf")))


def grid(spark: SparkSession, step: float = DEFAULT.grid_step_deg, lat_min: float = -85.0, lat_max: float = 85.0, most: int = DEFAULT.max_grid_points) -> DataFrame:
    """(lon, lat): latitudes up to and with the last, longitudes from -180 to below 180; the first ``most``, row by row, or all if 0."""
    n_lat, n_lon = int((lat_max - lat_min + 1e-9) // step) + 1, -int(-360.0 // step)
    k = F.col("id")
    return spark.range(min(most, n_lat * n_lon) if most > 0 else n_lat * n_lon).select((-180.0 + (k % n_lon) * step).alias("lon"), (lat_min + F.floor(k / n_lon) * step).alias("lat"))


def coverage_km2(chips: DataFrame, span: float = DEFAULT.chip_span_m) -> DataFrame:
    """One row: the area of all chips; a span that is missing or 0 counts as the default."""
    s = F.coalesce(F.expr("nullif(chip_span_m, 0)"), F.lit(span))
    return chips.agg((F.sum(s * s) / 1e6).alias("coverage_km2"), F.count("*").alias("n_chips"))


def chips_with_craters(craters: DataFrame) -> DataFrame:
    """One row: craters and the chips that they come from."""
    return craters.agg(F.count("*").alias("n_craters"), F.count_distinct("chip_index").alias("n_chips"))


def status_counts(chips: DataFrame) -> DataFrame:
    """Per status: chips, those with craters, and their craters."""
    return chips.groupBy(F.coalesce("status", F.lit("missing_metadata")).alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("n_craters") > 0).alias("n_with_craters"), F.coalesce(F.sum("n_craters"), F.lit(0)).cast("long").alias("n_craters"))
