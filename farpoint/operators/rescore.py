"""Scores of given pairs under other settings: hypotheses, sweeps and what they do to the ranking."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.config import DEFAULT, Settings
from farpoint.functions import geo, score
from farpoint.operators.significance import p_values, with_discoveries
from farpoint.operators.tables import saved, staged

#: Rows of a report whose rows are compared with each other.
LONGEST = 1_000
#: A pair table's column of each end's value.
NAMES = {"lon_deg": "lon_{}", "lat_deg": "lat_{}", "radius_m": "radius_{}_m", "orientation_deg": "orientation_{}_deg", "orientation_unc_deg": "orientation_unc_{}_deg"}
DEFAULTS = {"orientation_deg": 0.0, "shape_reliable": False}


def end(pairs: DataFrame):
    """side(name, "a" or "b") for ``score.terms``; columns that lack are 0 (orientation), false or null."""

    def side(name: str, s: str):
        c = NAMES.get(name, name + "_{}").format(s)
        if c in pairs.columns:
            return F.col(c)
        return F.lit(DEFAULTS[name]) if name in DEFAULTS else F.lit(None).cast("double")

    return side


def parted(pairs: DataFrame) -> DataFrame:
    """``pairs`` without terms and score, but with all of which any sigmas make them (``score.with_parts``)."""
    df = pairs.drop(*NEW)
    at = end(df)
    for s in "ab":
        v = geo.unit(F.col(f"lon_{s}"), F.col(f"lat_{s}"))
        df = df.withColumns({f"{s}_v{x}": c for x, c in zip("xyz", v, strict=True)} | {f"{s}__e": at("ellipticity", s), f"{s}__o": at("orientation_deg", s)})
        df = staged(score.with_exits(df, f"lon_{s}", f"lat_{s}", f"{s}__e", f"{s}__o", f"{s}_e"))
    return score.with_parts(df, at, "separation_deg", {"a": "a_", "b": "b_"})


#: What a pair's score brings with it.
NEW = (*score.TERMS, "score", "chord_length_m", "expected_ellipticity")


def sigma_of(columns: list[str], base: Settings = DEFAULT):
    """The sigma of a name: the column that bears it, or that of ``base``."""
    return lambda n: F.col(n) if n in columns else F.lit(float(getattr(base, n)))


def rescored(pairs: DataFrame, settings: Settings | None = None, base: Settings = DEFAULT) -> DataFrame:
    """``pairs`` with terms and score anew. settings None: from the columns that bear the sigmas' names."""
    get = settings if settings is not None else sigma_of(pairs.columns, base)
    return score.with_product(parted(pairs), get).select(*[c for c in pairs.columns if c not in NEW], *NEW)


# A tolerance that lets everything pass, the tight tolerances, and the swept ones with their range of scales.
OPEN = 1e6
TIGHT = {"sigma_ellipticity": 0.02, "sigma_orientation_deg": 1.5, "sigma_position_deg": 0.25}
SWEPT = ("sigma_freshness", "sigma_radius", "sigma_ellipticity", "sigma_orientation_deg", "sigma_position_deg")
SCALES, SCALE_LOW, SCALE_HIGH, SWEEP_TOP = 60, 0.3, 3.0, 10


def hypotheses(base: Settings = DEFAULT) -> dict[str, Settings]:
    """All terms (H0); without radius (H1), shape (H2), position (H3), all three (H4); tight tolerances (H5)."""
    radius, shape, position = {"sigma_radius": OPEN}, {"sigma_ellipticity": OPEN, "sigma_orientation_deg": OPEN}, {"sigma_position_deg": OPEN}
    changes = {"H0": {}, "H1": radius, "H2": shape, "H3": position, "H4": radius | shape | position, "H5": TIGHT}
    return {name: replace(base, **change) for name, change in changes.items()}


def grid_of(spark: SparkSession, many: dict[str, Settings]) -> DataFrame:
    """(hypothesis, sigma_*): a row for each."""
    rows = [(n, *[float(getattr(s, c)) for c in score.SIGMAS]) for n, s in many.items()]
    return spark.createDataFrame(rows, "hypothesis string, " + ", ".join(f"{c} double" for c in score.SIGMAS))


def under(pairs: DataFrame, grid: DataFrame, least: str | None = None) -> DataFrame:
    """Every pair under every row of ``grid``, which is small and is broadcast: one scan of the pairs for all settings, and what no sigma changes is computed once for each pair.

    least: a column of ``grid``; pairs whose score there is surely lower are left out before their terms are computed.
    """
    many = parted(pairs)
    get = sigma_of(grid.columns)
    both = many.crossJoin(F.broadcast(grid))
    if least is not None:
        # first what is below it even with the largest sigmas of all rows, then row by row; nulls stay. Both are conditions of a join, as a filter of the pairs alone would be put with all its expressions into the join that makes them
        named = [c for c in grid.columns if c in score.SIGMAS]
        ends = saved(grid.agg(*[F.max(c).alias(f"__{c}") for c in named], F.min(least).alias("__least")))
        widest = lambda n: F.col(f"__{n}") if n in named else get(n)
        some = many.crossJoin(F.broadcast(ends)).where(F.coalesce(score.at_most(widest) >= F.col("__least"), F.lit(True)))
        both = staged(some).crossJoin(F.broadcast(grid)).where(F.coalesce(score.at_most(get) >= F.col(least), F.lit(True)))
    return score.with_product(staged(both), get).select(*[c for c in pairs.columns if c not in NEW], *grid.columns, *NEW)


def hypothesis_summary(pairs: DataFrame, grid: DataFrame, threshold: float) -> DataFrame:
    """Per hypothesis: the best score and its pair, the mean, and the pairs at or above ``threshold``."""
    s = under(pairs, grid)
    top = F.max_by(F.struct("score", "idx_a", "idx_b"), F.struct("score", -F.col("idx_a"), -F.col("idx_b")))
    per = s.groupBy("hypothesis").agg(top.alias("top"), F.avg("score").alias("mean_score"), F.count_if(F.col("score") >= threshold).alias("n_above"), F.count("*").alias("n_pairs"))
    best = F.when(F.col("top.score") > 0, F.col("top"))
    return per.select("hypothesis", "mean_score", "n_above", "n_pairs", F.coalesce(best["score"], F.lit(0.0)).alias("best_score"), best["idx_a"].alias("best_idx_a"), best["idx_b"].alias("best_idx_b"))


def scales(n: int = SCALES, lo: float = SCALE_LOW, hi: float = SCALE_HIGH) -> list[float]:
    return [lo + k * (hi - lo) / (n - 1) for k in range(n)]


def sweep(spark: SparkSession, parameters: tuple[str, ...] = SWEPT, factors: list[float] | None = None, base: Settings = DEFAULT) -> DataFrame:
    """(parameter, scale, sigma_*): each parameter by itself times each scale. A parameter that no term reads changes nothing."""
    rows = [(p, float(x), *[float(getattr(base, c)) * (x if c == p else 1.0) for c in score.SIGMAS]) for p in parameters for x in factors or scales()]
    return spark.createDataFrame(rows, "parameter string, scale double, " + ", ".join(f"{c} double" for c in score.SIGMAS))


#: Of so many parts of the pairs' first ends, one gives the sweep's lower bounds.
SLICES = 256


def sensitivity(pairs: DataFrame, grid: DataFrame, threshold: Column | float, top: int = SWEEP_TOP, places: int = 9, slices: int = SLICES) -> DataFrame:
    """Per parameter and scale: the best score, the pairs at or above ``threshold``, and Kendall's tau of the ``top`` best scores with those of ``pairs``, place by place.

    What is asked are scores from the least of ``threshold`` and the ``top``-th best on. The ``top``-th best among the
    pairs of a part of the first ends is no better than that of all, so whatever is surely below both is left out.
    """
    by = ("parameter", "scale")
    found = lambda df: df.withColumn("score", F.round("score", places))
    first = in_places(found(under(pairs.where(F.pmod(F.xxhash64("idx_a"), F.lit(slices)) == 0), grid)), by, top)
    bound = first.where(F.col("place") == top).select(*by, F.col("score").alias("bound"))
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    bound = saved(grid.join(bound, list(by), "left").withColumn("bound", F.coalesce("bound", F.lit(0.0))).withColumn("least", F.least("bound", limit) - 10.0**-places))
    s = found(under(pairs, bound, "least"))
    highest = F.slice(F.sort_array(F.collect_list(F.when(F.col("score") >= F.col("bound"), F.col("score"))), False), 1, top)
    per = saved(s.groupBy(*by).agg(F.max("score").alias("best_score"), F.count_if(F.col("score") >= limit).alias("n_above"), highest.alias("highest")))
    best = per.select(*by, F.posexplode("highest").alias("place", "score")).withColumn("place", F.col("place") + 1)
    base = in_places(found(pairs), (), top).select("place", F.col("score").alias("before"))
    tau = tau_b(best.join(F.broadcast(base), "place"), by, "before", "score")
    return per.drop("highest").join(tau, list(by), "left")


def in_places(df: DataFrame, by: tuple[str, ...], top: int) -> DataFrame:
    """(by, place from 1, score): the ``top`` best scores of each group."""
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy(F.desc_nulls_last("score"))
    few = df if by else df.select("score").orderBy(F.desc_nulls_last("score")).limit(top)
    return few.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(*by, "place", "score")


def tau_b(df: DataFrame, by: tuple[str, ...], x: str, y: str) -> DataFrame:
    """(by, tau): Kendall's tau-b of two columns over the places of each group; null if either is constant. Groups are reports of at most LONGEST places."""
    a = df.select(*by, F.col("place").alias("p"), F.col(x).alias("x"), F.col(y).alias("y"))
    b = df.select(*[F.col(c).alias(f"{c}__b") for c in by], F.col("place").alias("q"), F.col(x).alias("u"), F.col(y).alias("v"))
    on = F.col("p") < F.col("q")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}__b"))
    dx, dy = F.signum(F.col("x") - F.col("u")), F.signum(F.col("y") - F.col("v"))
    got = a.join(b, on).groupBy(*by).agg(F.sum(dx * dy).alias("t"), F.count_if(dx != 0).alias("nx"), F.count_if(dy != 0).alias("ny"))
    return got.select(*by, F.try_divide("t", F.sqrt(F.col("nx").cast("double") * F.col("ny"))).alias("tau"))


def rounds(pairs: DataFrame, grid: DataFrame, null: DataFrame | None, null_pairs: DataFrame | None = None, alpha: float = DEFAULT.alpha, top: int = 200, places: int = 9) -> DataFrame:
    """Per hypothesis: the best score of the ``top`` best pairs of ``pairs``, its p and percentile, discoveries, and Kendall's tau with H0, place by place.

    ``null_pairs`` (trial and a pair's columns, see ``nullmodel.best_pairs``): the null model's best pairs, scored anew
    under each hypothesis, which is held against its own; without them the scores of ``null`` serve for all. All
    hypotheses run together, as groups of one running count.
    """
    best = pairs.withColumn("score", F.round("score", places)).orderBy(F.desc_nulls_last("score"), "idx_a", "idx_b").limit(top)
    rounded = lambda df: df.withColumn("score", F.round("score", places))
    s = saved(rounded(under(best, grid)).select("hypothesis", "idx_a", "idx_b", "score"))
    if null_pairs is not None:
        own = saved(rounded(under(null_pairs, grid)).groupBy("hypothesis", "trial").agg(F.max("score").alias("score")))
        held = p_values(s, own, by=("hypothesis",))
    else:
        held = p_values(s, null)
    found = with_discoveries(held, alpha, by=("hypothesis",))
    per = found.groupBy("hypothesis").agg(F.max("score").alias("best_score"), F.min("p_value").alias("best_p"), F.max("percentile_score").alias("best_percentile"), F.count_if("bh_significant").alias("n_significant"))
    tau = tau_matrix(s).where(F.col("one") == "H0").select(F.col("other").alias("hypothesis"), "tau")
    return per.join(tau, "hypothesis", "left").select("hypothesis", "best_score", "best_p", "best_percentile", "n_significant", "tau")


def tau_matrix(scores: DataFrame, top: int = 200) -> DataFrame:
    """(one, other, tau) of every two hypotheses of ``scores`` (hypothesis, score): Kendall's tau-b of their ``top`` best scores, place by place."""
    p = in_places(scores, ("hypothesis",), top)
    x = p.select(F.col("hypothesis").alias("one"), "place", F.col("score").alias("x"))
    y = p.select(F.col("hypothesis").alias("other"), "place", F.col("score").alias("y"))
    return tau_b(x.join(y, "place"), ("one", "other"), "x", "y")


def kendall(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """One row: Kendall's tau-b, pairs, concordant and discordant ones. For reports of bounded length (a top-k): it compares rows with each other."""
    if df.limit(LONGEST + 1).count() > LONGEST:
        raise ValueError(f"more than {LONGEST} rows")
    a, b = df.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")), df.select(F.col(key).alias("l"), F.col(x).alias("u"), F.col(y).alias("v"))
    dx, dy = F.signum(F.col("x") - F.col("u")), F.signum(F.col("y") - F.col("v"))
    s = a.join(F.broadcast(b), F.col("k") < F.col("l")).select((dx * dy).alias("s"), dx.alias("dx"), dy.alias("dy"))
    got = s.agg(F.count("*").alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("t"), F.count_if(F.expr("dx = 0")).alias("tx"), F.count_if(F.expr("dy = 0")).alias("ty"), F.count_if(F.expr("s > 0")).alias("concordant"), F.count_if(F.expr("s < 0")).alias("discordant"))
    scale = F.sqrt((F.col("n") - F.col("tx")).cast("double") * (F.col("n") - F.col("ty")))
    return got.select(F.try_divide("t", scale).alias("tau"), F.col("n").alias("n_compared"), "concordant", "discordant")
