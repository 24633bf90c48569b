"""Report statistics: histograms, densities, rank correlation, survival and upper limits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.config import ANOMALOUS, AREA_KM2, FLUX_G_S, KAPPA, SECONDS_PER_MYR
from farpoint.operators.ranks import percentiles, running


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, lo, hi, n) of every bin, empty ones too; the last is closed on the right, values outside are left out."""
    x, size = F.col(column), (hi - lo) / bins
    at = F.least(F.floor((x - lo) / size), F.lit(bins - 1)).cast("int")
    got = df.where((x >= lo) & (x <= hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    b = F.col("bin")
    return every.join(got, "bin", "left").select("bin", (lo + b * size).alias("lo"), (lo + (b + 1) * size).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def latitude_density(df: DataFrame, column: str = "lat_deg", size: float = 10.0) -> DataFrame:
    """Rows per solid angle in bands of latitude, with the densest band at 1."""
    h = histogram(df, column, -90.0, 90.0, round(180.0 / size))
    angle = 2.0 * math.pi * (F.sin(F.radians("hi")) - F.sin(F.radians("lo")))
    h = h.withColumn("d", F.col("n") / angle)
    most = F.max("d").over(Window.partitionBy(F.lit(0)))  # over the bands
    return h.select("bin", "lo", "hi", "n", F.when(most > 0, F.col("d") / most).otherwise(F.lit(0.0)).alias("density"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: n, mean, sample deviation, least, exact quartiles, most."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.*").where("v is not null")
    quartiles = percentiles(each, "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ("column",))
    per = each.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return per.join(F.broadcast(quartiles), "column", "left").select("column", "n", "mean", "std", "min", "p25", "p50", "p75", "max")  # a row for each column


def mean_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """With each value's rank, ties at their mean rank. Ranks come from running counts of the distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    ranks = running(counts, column, "__n").select(column, (F.col("up_to") - (F.col("__n") - 1) / 2.0).alias(out))
    return df.join(ranks, column)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the correlation of mean ranks, and the rows that have both values."""
    both = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    ranked = mean_ranks(mean_ranks(both, "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def survival_myr(radius_m: Column, kappa: float = KAPPA) -> Column:
    """How long diffusion leaves a crater of the radius."""
    return radius_m * radius_m / (4.0 * kappa)


def survival_s(radius_m: Column, kappa: float = KAPPA, anomalous: bool = False) -> Column:
    """The same in seconds; ``anomalous``: at the diffusivity's anomalous multiple."""
    return survival_myr(radius_m, kappa * (ANOMALOUS if anomalous else 1.0)) * SECONDS_PER_MYR


def effective_radius(radius: Column) -> Column:
    """Aggregate: the root of the mean square."""
    return F.sqrt(F.avg(radius * radius))


def flux_limit(mass_g: Column, cross_section_cm2: float, seconds: float, share: float, flux: float = FLUX_G_S) -> Column:
    """The largest fraction of the flux that three expected events allow, for bodies of the mass."""
    return 3.0 * mass_g / (flux * cross_section_cm2 * seconds * share)


def limit_curve(spark: SparkSession, cross_section_cm2: float, seconds: float, share: float, flux: float = FLUX_G_S, lo: float = 14.0, hi: float = 22.0, n: int = 500) -> DataFrame:
    """(mass_g, limit) for even steps of the mass's logarithm."""
    m = F.pow(F.lit(10.0), F.lit(lo) + F.col("id") * ((hi - lo) / (n - 1)))
    return spark.range(n).select(F.col("id").alias("i"), m.alias("mass_g"), flux_limit(m, cross_section_cm2, seconds, share, flux).alias("limit"))


def covered_share(km2: Column, area: float = AREA_KM2) -> Column:
    return km2 / area


def component_means(pairs: DataFrame, terms: tuple[str, ...], top: int = 50) -> DataFrame:
    """Per term: mean and population deviation over the ``top`` best pairs."""
    best = pairs.orderBy(F.desc_nulls_last("score"), "idx_a", "idx_b").limit(top)
    each = best.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("v")) for t in terms])).alias("e")).select("e.*")
    return each.groupBy("term").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def hashed_sample(df: DataFrame, n: int, key: str = "idx", seed: int = 42) -> DataFrame:
    """The ``n`` rows whose hash comes first: the same at every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
