"""What a report draws, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.config import RADIUS_M, V_ESCAPE
from farpoint.functions import geo, score, stats, velocity
from farpoint.operators import catalog, significance
from farpoint.operators.ranks import percentiles

#: How far behind the limb, in radii, a point that lies on it may come by rounding (two micrometres).
LIMB = 1e-12


def arcs(pairs: DataFrame, top: int = 20, points: int = 60) -> DataFrame:
    """(idx_a, idx_b, shade, i, lon, lat): the great circles of the best pairs; shade is the score between their least and most."""
    best = pairs.orderBy(F.desc_nulls_last("score"), "idx_a", "idx_b").limit(top)
    ends = best.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    shade = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))
    a, b = geo.unit(F.col("lon_a"), F.col("lat_a")), geo.unit(F.col("lon_b"), F.col("lat_b"))
    return best.crossJoin(F.broadcast(ends)).select("idx_a", "idx_b", shade.alias("shade"), F.explode(geo.arc_points(a, b, points)).alias("p")).select("idx_a", "idx_b", "shade", "p.*")


def cone_panels(craters: DataFrame, half_angle: float, points: int = 72) -> DataFrame:
    """(idx, bearing, i, lon, lat): the rims of the caps where each crater's partner is looked for."""
    shaped = score.with_exits(craters.where(F.col("shape_reliable") & (F.col("ellipticity") >= 1.0)))
    ends = F.array(*[F.struct(F.lit(k).alias("bearing"), *[F.col(f"e{k + 1}{x}").alias(x) for x in "xyz"]) for k in (0, 1)])
    at = shaped.select("idx", F.explode(ends).alias("e"))
    rim = geo.cap_boundary(geo.Vec(F.col("e.x"), F.col("e.y"), F.col("e.z")), F.lit(half_angle), points)
    return at.select("idx", F.col("e.bearing").alias("bearing"), F.explode(rim).alias("p")).select("idx", "bearing", "p.*")


def outlines(detections: DataFrame) -> DataFrame:
    """Each feature's ellipse: half axes of the circle's area."""
    e = F.sqrt(F.coalesce("ellipticity", F.lit(1.0)))
    return detections.withColumns({"half_major": F.col("radius_px") * e, "half_minor": F.col("radius_px") / e})


def projected(craters: DataFrame, lon: Column, lat: Column) -> DataFrame:
    """(idx, right, up, visible): the side of the sphere that is seen from above a point, its limb with what rounding puts just behind it."""
    right, up, depth = geo.orthographic(geo.unit(F.col("lon_deg"), F.col("lat_deg")), geo.unit(lon, lat))
    return craters.select("idx", right.alias("right"), up.alias("up"), (depth >= -LIMB).alias("visible"))


def score_histogram(pairs: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n, density, p95, best) of the scores between 0 and 1."""
    ends = pairs.agg(F.max("score").alias("best"), F.count("score").alias("__all")).crossJoin(F.broadcast(percentiles(pairs, "score", {"p95": 0.95})))
    return stats.histogram(pairs, "score", 0.0, 1.0, bins).crossJoin(F.broadcast(ends)).withColumn("density", F.try_divide(F.col("n"), F.col("__all") * (F.col("hi") - F.col("lo")))).drop("__all")


def coverage_points(craters: DataFrame) -> DataFrame:
    """(idx, lon_deg, lat_deg, freshness_index): where craters lie and how fresh they are."""
    return craters.where("lon_deg is not null and lat_deg is not null").select("idx", "lon_deg", "lat_deg", "freshness_index")


def null_histogram(null: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n, density) of the null model's best scores, between 0 and 1."""
    h = stats.histogram(null, "score", 0.0, 1.0, bins)
    total = F.broadcast(null.agg(F.count("score").alias("__all")))
    return h.crossJoin(total).withColumn("density", F.try_divide(F.col("n"), F.col("__all") * (F.col("hi") - F.col("lo")))).drop("__all")


def scores_against_null(pairs: DataFrame, null: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n, threshold, above): the pairs' scores, the null model's three-sigma percentile, and how many pairs reach it."""
    limit = F.broadcast(percentiles(null, "score", {"threshold": 0.9987}))
    above = F.broadcast(pairs.crossJoin(limit).agg(F.count_if(F.col("score") >= F.col("threshold")).alias("above")))
    return stats.histogram(pairs, "score", 0.0, 1.0, bins).crossJoin(limit).crossJoin(above)


def pair_ends(pairs: DataFrame, craters: DataFrame, columns: tuple[str, ...] = ("lon_deg", "lat_deg", "radius_m"), idx: str = "idx") -> DataFrame:
    """``pairs`` with both ends' rows of the catalogue; pairs with an end that it lacks are left out."""
    side = lambda s: craters.select(F.col(idx).alias(f"idx_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return pairs.join(side("a"), "idx_a").join(side("b"), "idx_b")


def pairs_on_map(pairs: DataFrame, craters: DataFrame, top: int = 10) -> DataFrame:
    """(place, score, idx_a, idx_b, a_lon_deg ...): the best pairs in order, with the places of both ends."""
    best = pairs.orderBy(F.desc_nulls_last("score"), "idx_a", "idx_b").limit(top)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("score"), "idx_a", "idx_b")  # over the best
    ranked = best.select("idx_a", "idx_b", "score", F.row_number().over(w).alias("place"))
    return pair_ends(ranked, craters, ("lon_deg", "lat_deg"))


def curves(spark: SparkSession, n: int = 500) -> DataFrame:
    """(curve, i, x, y) of the method: the offset by the speed, the ellipticity by the separation, the survival by the radius."""
    even = lambda lo, hi: lo + F.col("id") * ((hi - lo) / (n - 1))
    of = lambda name, lo, hi, y: spark.range(n).select(F.lit(name).alias("curve"), F.col("id").alias("i"), even(lo, hi).alias("x"), y(even(lo, hi)).alias("y"))
    offset = of("offset_deg", 10.0, V_ESCAPE, lambda v: velocity.rotation_offset(F.lit(2.0 * RADIUS_M), v))
    shape = of("ellipticity", 30.0, 180.0, geo.expected_ellipticity)
    life = of("survival_myr", 1.0, 10.0, stats.survival_myr)
    return offset.union(shape).union(life)


def lines(section: str, row: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """(section, place, label, value) from a table of one row."""
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("label"), c.cast("double").alias("value")) for i, (n, c) in enumerate(labels.items())])
    return row.select(F.lit(section).alias("section"), F.explode(each).alias("l")).select("section", "l.*")


def console(craters: DataFrame, chips: DataFrame, pairs: DataFrame, null: DataFrame, assessed: DataFrame, top: int = 200) -> DataFrame:
    """(section, place, label, value): what a run prints about its catalogue, pairing, null model and results.

    A table without rows gives its counts as 0 and what it would measure as null.
    """
    c = catalog.chips_with_craters(craters).crossJoin(catalog.coverage_km2(chips).select("coverage_km2"))
    catalogue = lines("catalogue", c, {"chips with craters": F.col("n_chips"), "craters": F.col("n_craters"), "coverage in km2": F.col("coverage_km2"), "craters per chip": F.try_divide("n_craters", "n_chips")})
    pairing = lines("pairing", pairs.agg(F.count("*").alias("n")), {"raw pairs": F.col("n"), "pairs without common ends, at most": F.lit(top)})
    n = significance.percentiles(null)
    trials = lines("null model", n, {"trials": F.col("n_trials"), "50th percentile": F.col("p50"), "95th percentile": F.col("p95"), "99th percentile": F.col("p99"), "largest": F.col("best")})
    ends = ("lon_a", "lat_a", "lon_b", "lat_b")
    own = [x for x in ("p_value", "separation_deg", *ends) if x in assessed.columns]
    best = F.max_by(F.struct("score", *own), F.struct("score", -F.col("idx_a"), -F.col("idx_b")))
    r = assessed.where("score IS NOT NULL").agg(best.alias("best"), F.count_if("bh_significant").alias("found"))
    at = {x: F.col(f"best.{x}") for x in own}
    results = lines("results", r, {"best score": F.col("best.score"), **{x.replace("_", " "): c for x, c in at.items()}, "significant pairs": F.col("found")})
    return catalogue.union(pairing).union(trials).union(results)
