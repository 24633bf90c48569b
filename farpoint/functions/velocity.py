"""Transit speeds and the rotation that happens meanwhile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.config import OMEGA, RADIUS_M, V_CIRCULAR, V_ESCAPE

#: The speed grid of ``offset_probability``.
GRID, GRID_FROM = 2000, 0.01


def transit_time(chord_m: Column, speed: Column) -> Column:
    return chord_m / (speed * 1000.0)


def rotation_offset(chord_m: Column, speed: Column, omega: float = OMEGA) -> Column:
    """Degrees."""
    return F.degrees(omega * transit_time(chord_m, speed))


def max_rotation_offset(chord_m: Column, slowest: float = 50.0) -> Column:
    return rotation_offset(chord_m, F.lit(slowest))


def max_physical_offset(slowest: float = 50.0, radius: float = RADIUS_M) -> Column:
    return rotation_offset(F.lit(2.0 * radius), F.lit(slowest))


def speed_from_offset(offset_rad: Column, chord_m: Column, omega: float = OMEGA) -> Column:
    """km/s; infinite without an offset."""
    return F.when(offset_rad > 1e-15, omega * chord_m / F.when(offset_rad > 1e-15, offset_rad) / 1000.0).when(offset_rad.isNotNull(), F.lit(float("inf")))


def speed_grid(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    """(i, v): ``n`` even steps."""
    return spark.range(n).select(F.col("id").alias("i"), (lo + F.col("id") * ((hi - lo) / (n - 1))).alias("v"))


def raw_pdf(v: Column, v0: float = V_CIRCULAR, v_esc: float = V_ESCAPE) -> Column:
    return F.when((v > v_esc) | (v < 0.0), F.lit(0.0)).otherwise(v * v * F.exp(-(v * v) / (v0 * v0)))


def speed_distribution(grid: DataFrame, v0: float = V_CIRCULAR, v_esc: float = V_ESCAPE) -> DataFrame:
    """``grid`` (i, v) with pdf (its trapezoid integral over the grid is 1) and cdf (running sum times the local step, ends at 1).

    The window runs over one grid, whose size the caller sets; it never grows with data.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("i")
    whole = Window.partitionBy(F.lit(0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v, prev, nxt = F.col("v"), F.lag("v").over(w), F.lead("v").over(w)
    df = grid.withColumns({"r": raw_pdf(v, v0, v_esc), "prev": prev, "nxt": nxt})
    df = df.withColumn("rp", F.lag("r").over(w))
    area = F.sum((F.col("r") + F.col("rp")) / 2.0 * (v - F.col("prev"))).over(whole)
    df = df.withColumn("pdf", F.when(area > 0, F.col("r") / area).otherwise(F.col("r")))
    step = F.when(F.col("prev").isNull(), F.col("nxt") - v).when(F.col("nxt").isNull(), v - F.col("prev")).otherwise((F.col("nxt") - F.col("prev")) / 2.0)
    df = df.withColumn("c", F.sum("pdf").over(upto) * step)
    end = F.max_by("c", "i").over(whole)
    return df.select("i", "v", "pdf", F.when(end > 0, F.col("c") / end).otherwise(F.col("c")).alias("cdf"))


def offset_probability(df: DataFrame, offset_deg: str, chord_m: str, out: str = "probability", v0: float = V_CIRCULAR, v_esc: float = V_ESCAPE) -> DataFrame:
    """``df`` with the share of speeds up to the one that the offset implies.

    1 without an offset; 0 for speeds above escape; between grid points the cdf is linear. The grid has a fixed size,
    so its cdf is one row, broadcast as an array, and each lookup is by index.
    """
    spark = df.sparkSession
    cdf = speed_distribution(speed_grid(spark, GRID_FROM, v_esc, GRID), v0, v_esc)
    packed = cdf.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "cdf"))), lambda x: x["cdf"]).alias("__cdf"))
    rad = F.radians(F.col(offset_deg))
    v, step = F.col("__v"), (v_esc - GRID_FROM) / (GRID - 1)
    at = F.least(F.greatest(F.floor((v - GRID_FROM) / step), F.lit(0)), F.lit(GRID - 2)).cast("int")
    lo, hi = F.get("__cdf", at), F.get("__cdf", at + 1)
    part = F.greatest((v - (GRID_FROM + at * step)) / step, F.lit(0.0))
    joined = df.crossJoin(F.broadcast(packed)).withColumn("__v", speed_from_offset(rad, F.col(chord_m)))
    p = F.when(rad < 1e-15, F.lit(1.0)).when((v > v_esc) | (v < 0), F.lit(0.0)).otherwise(lo + (hi - lo) * part)
    return joined.withColumn(out, p).drop("__v", "__cdf")
