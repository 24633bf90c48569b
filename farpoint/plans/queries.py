"""Queries over views of the test tables, each with its SQL.

The views are one SQL text for both engines: whole-number arithmetic on keys, so that inputs are equal bit by bit.
Numbers that come from trigonometry are rounded to six places in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.config import AREA_KM2, DEFAULT, FLUX_G_S, KAPPA, OMEGA, RADIUS_M, V_CIRCULAR, V_ESCAPE
from farpoint.functions import geo, raster, score, stats, velocity
from farpoint.operators import catalog, conejoin, detection, matching, nullmodel, rescore, significance
from farpoint.plans import chips as chips_plan
from farpoint.plans import pipeline, report
from farpoint.sources import records, survey
from farpoint.streaming import monitor

# Views: name to (table, its columns as SQL that both engines read).
VIEWS = {
    "craters": ("part", """
        CAST(p_partkey AS BIGINT) AS idx,
        CAST((p_partkey * 7919) % 36000 AS DOUBLE) / 1e2 - 180e0 AS lon_deg, CAST((p_partkey * 104729) % 17000 AS DOUBLE) / 1e2 - 85e0 AS lat_deg,
        1e0 + CAST((p_partkey * 31) % 900 AS DOUBLE) / 1e2 AS radius_m, 2e0 + CAST((p_partkey * 43) % 100 AS DOUBLE) / 1e1 AS radius_px,
        1e0 + CAST((p_partkey * 37) % 300 AS DOUBLE) / 1e2 AS nls, CAST((p_partkey * 53) % 800 AS DOUBLE) / 1e2 AS rcr,
        CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1e0 + CAST((p_partkey * 17) % 80 AS DOUBLE) / 1e2 END AS ellipticity,
        CAST((p_partkey * 71) % 360 AS DOUBLE) - 180e0 AS orientation_deg, p_partkey % 3 <> 0 AS shape_reliable,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 1e0 + CAST((p_partkey * 13) % 50 AS DOUBLE) / 1e1 END AS orientation_unc_deg,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 1e-2 + CAST((p_partkey * 7) % 20 AS DOUBLE) / 1e2 END AS ellipticity_unc,
        CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST((p_partkey * 29) % 100 AS DOUBLE) / 1e2 END AS depth_proxy,
        CAST((p_partkey * 19) % 100 AS DOUBLE) / 1e2 AS freshness_index"""),
    "products": ("orders", """
        concat('M', CAST(o_orderkey % 4001 AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN 'LE' ELSE 'LC' END) AS product_id,
        5e-1 + CAST((o_orderkey * 37) % 200 AS DOUBLE) / 1e2 AS resolution_mpp,
        CAST((o_orderkey * 7919) % 36000 AS DOUBLE) / 1e2 - 180e0 AS center_lon, CAST((o_orderkey * 104729) % 17000 AS DOUBLE) / 1e2 - 85e0 AS center_lat"""),
    "observed": ("orders", """
        CAST(floor(o_orderkey / 20e0) AS BIGINT) AS point, concat('M', CAST(o_orderkey AS VARCHAR(20))) AS product_id, 5e-1 + CAST((o_orderkey * 37) % 200 AS DOUBLE) / 1e2 AS resolution,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST((o_orderkey * 7919) % 36000 AS DOUBLE) / 1e2 - 180e0 END AS lon, CAST((o_orderkey * 104729) % 17000 AS DOUBLE) / 1e2 - 85e0 AS lat,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST((o_orderkey * 31) % 900 AS DOUBLE) / 1e1 END AS incidence"""),
    "null_scores": ("orders", "CAST(o_orderkey AS BIGINT) AS trial, CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10007e0 AS score"),
    "graph": ("orders", "CAST(o_orderkey AS BIGINT) AS pair_id, CAST(o_custkey % 997 AS BIGINT) AS idx_a, CAST(1000 + (o_orderkey * 31) % 991 AS BIGINT) AS idx_b, CAST((o_orderkey * 7919) % 100003 AS DOUBLE) / 100003e0 AS score"),
    "status": ("events", """CAST(event_id AS INT) AS chip_index, CASE event_id % 7 WHEN 0 THEN 'no_data' WHEN 1 THEN 'blank_chip' WHEN 2 THEN 'noise_floor' WHEN 3 THEN NULL WHEN 4 THEN 'error' ELSE 'ok' END AS status,
        CAST(event_id % 9 AS INT) AS n_craters, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 4 AS DOUBLE) * 4e2 END AS chip_span_m"""),
}
#: 8 x 8 chips from the vectors.
CHIPS = "SELECT vec_id AS chip_id, CAST(pos // 8 AS INTEGER) AS y, CAST(pos % 8 AS INTEGER) AS x, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)"
S = 6
TRIALS = 3


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    parts, depth, start = [], 0, 0
    for i, c in enumerate(columns + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(columns[start:i].strip())
            start = i + 1
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*parts)


def sql(text: str, *views: str) -> str:
    """``text`` below the views that it reads."""
    names = list(dict.fromkeys(views))
    own = [f"{v} AS (SELECT {VIEWS[v][1]} FROM {VIEWS[v][0]})" for v in names if v in VIEWS]
    own += [f"cells AS ({CHIPS})"] * ("cells" in views)
    recursive = "RECURSIVE " if "walk AS (" in text else ""
    return f"WITH {recursive}{', '.join(own)}{',' if text.lstrip().startswith('+') else ''} {text.lstrip().removeprefix('+')}" if own else text


def rounded(df: DataFrame, places: int = S) -> DataFrame:
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle, *views)
        return f

    return add


def scalar(name: str, columns: Callable[[], dict[str, Column]], text: dict[str, str], base: str = "craters", key: str = "idx") -> None:
    QUERIES[name] = lambda spark, sf: rounded(view(spark, sf, base).select(key, *[c.alias(n) for n, c in columns().items()]))
    ORACLES[name] = sql(f"SELECT {key}, " + ", ".join(f"round({e}, {S}) + 0 AS {n}" for n, e in text.items()) + f" FROM {base}", base)


# Geometry.
LON = lambda: F.col("lon_deg")
LAT = lambda: F.col("lat_deg")
ELL = lambda: F.col("ellipticity")
ORI = lambda: F.col("orientation_deg")
V = lambda: geo.unit(LON(), LAT())
X, Y, Z = "cos(radians(lat_deg)) * cos(radians(lon_deg))", "cos(radians(lat_deg)) * sin(radians(lon_deg))", "sin(radians(lat_deg))"
scalar("geo_unit_vectors", lambda: dict(zip(("vx", "vy", "vz"), V(), strict=True)), {"vx": X, "vy": Y, "vz": Z})
scalar("geo_roundtrip", lambda: dict(zip(("lon", "lat"), geo.lon_lat(V()), strict=True)), {"lon": "lon_deg", "lat": "lat_deg"})
WIDE = lambda: F.col("lon_deg") * 3.0
scalar("geo_normalize_lon", lambda: {"lon": geo.normalize_lon(WIDE())}, {"lon": "(lon_deg * 3e0 + 180e0) - 360e0 * floor((lon_deg * 3e0 + 180e0) / 360e0) - 180e0"})
BOX = lambda: geo.bbox(LON(), LAT(), F.lit(1.0e5))
COS, HALF = "cos(radians(lat_deg))", f"degrees(1e5 / ({RADIUS_M!r} * cos(radians(lat_deg)))) / 2"
IN = f"CASE WHEN lon_deg - {HALF} >= -180 AND lon_deg + {HALF} <= 180 THEN "
scalar("geo_bbox", lambda: {k: BOX()[k] for k in ("lon_min", "lat_min", "lon_max", "lat_max")}, {"lon_min": f"{IN} lon_deg - {HALF} END", "lat_min": f"{IN} greatest(lat_deg - degrees(1e5 / {RADIUS_M!r}) / 2, -90) END", "lon_max": f"{IN} lon_deg + {HALF} END", "lat_max": f"{IN} least(lat_deg + degrees(1e5 / {RADIUS_M!r}) / 2, 90) END"})
MPP = lambda: geo.metres_per_pixel(BOX(), 1024, 512)
PIX = lambda: geo.pixel_lon_lat(F.lit(100.0), F.lit(50.0), BOX(), 1024, 512)
BLON, BLAT = f"degrees(1e5 / ({RADIUS_M!r} * {COS}))", f"degrees(1e5 / {RADIUS_M!r})"
scalar("geo_pixels", lambda: {"mpp_x": MPP()[0], "mpp_y": MPP()[1], "lon": PIX()[0], "lat": PIX()[1]}, {"mpp_x": f"{IN} abs({RADIUS_M!r} * cos(radians(lat_deg)) * radians({BLON})) / 1024 END", "mpp_y": f"{IN} abs({RADIUS_M!r} * radians({BLAT})) / 512 END", "lon": f"{IN} lon_deg - {HALF} + 1e2 / 1023 * {BLON} END", "lat": f"{IN} lat_deg + {BLAT} / 2 - 5e1 / 511 * {BLAT} END"})
scalar("geo_cap_fraction", lambda: {"fraction": geo.cap_fraction(F.abs(LAT())), "bin": geo.grid_bin(LAT(), -90.0, 15.0).cast("double")}, {"fraction": "(1 - cos(radians(abs(lat_deg)))) / 2", "bin": "floor((lat_deg + 90) / 15)"})
IMPACT = lambda: geo.impact_parameter(F.abs(LON()))
scalar("chord_geometry", lambda: {"chord": geo.chord_from_separation(F.abs(LON())), "impact": IMPACT(), "chord_b": geo.chord_length(IMPACT()), "incidence": geo.incidence(IMPACT()), "expected": F.when(F.abs(LON()) > 1, geo.expected_ellipticity(F.abs(LON())))}, {"chord": f"2 * {RADIUS_M!r} * sin(radians(abs(lon_deg)) / 2)", "impact": f"{RADIUS_M!r} * cos(radians(abs(lon_deg)) / 2)", "chord_b": f"CASE WHEN {RADIUS_M!r} * cos(radians(abs(lon_deg)) / 2) >= {RADIUS_M!r} THEN 0 ELSE 2 * sqrt({RADIUS_M!r} * {RADIUS_M!r} - {RADIUS_M!r} * cos(radians(abs(lon_deg)) / 2) * ({RADIUS_M!r} * cos(radians(abs(lon_deg)) / 2))) END", "incidence": f"degrees(asin(least(1, greatest(0, {RADIUS_M!r} * cos(radians(abs(lon_deg)) / 2) / {RADIUS_M!r}))))", "expected": "CASE WHEN abs(lon_deg) > 1 THEN 1 / sin(radians(abs(lon_deg)) / 2) END"})
scalar("ellipticity_inverse", lambda: {"incidence": F.when(ELL().isNotNull(), geo.incidence_from_ellipticity(ELL())), "chord": F.when(ELL().isNotNull(), geo.chord_from_ellipticity(ELL())), "sep": F.when(ELL().isNotNull(), geo.separation_from_ellipticity(ELL()))}, {"incidence": "degrees(acos(1 / ellipticity))", "chord": f"2 * {RADIUS_M!r} / ellipticity", "sep": "degrees(2 * asin(1 / ellipticity))"})


def dest(lat: str, lon: str, bearing: str, arc: str) -> tuple[str, str, str]:
    """The destination point's components as SQL; ``lat`` and ``lon`` in radians."""
    s = f"least(1, greatest(-1, sin({lat}) * cos({arc}) + cos({lat}) * sin({arc}) * cos({bearing})))"
    to = f"({lon} + atan2(sin({bearing}) * sin({arc}) * cos({lat}), cos({arc}) - sin({lat}) * {s}))"
    c = f"sqrt(1 - {s} * {s})"
    return f"{c} * cos({to})", f"{c} * sin({to})", s


ARC, BEAR = "2 * asin(1 / ellipticity)", "radians(90 - orientation_deg)"
EXIT = lambda: score.exits(V(), ELL(), ORI())[0]
scalar("exit_point", lambda: {n: F.when(ELL().isNotNull(), c) for n, c in zip("xyz", EXIT(), strict=True)}, dict(zip("xyz", [f"CASE WHEN ellipticity IS NOT NULL THEN {e} END" for e in dest("radians(lat_deg)", "radians(lon_deg)", BEAR, ARC)], strict=True)))
NORTH = lambda: geo.unit(F.lit(30.0), F.lit(40.0))
scalar("bearing_to_point", lambda: {"bearing": geo.bearing(V(), NORTH()), "sep": geo.separation(V(), NORTH())}, {"bearing": "degrees(atan2(cos(radians(40)) * sin(radians(30 - lon_deg)), cos(radians(lat_deg)) * sin(radians(40)) - sin(radians(lat_deg)) * cos(radians(40)) * cos(radians(30 - lon_deg))))", "sep": f"degrees(acos(least(1, greatest(-1, {X} * cos(radians(40)) * cos(radians(30)) + {Y} * cos(radians(40)) * sin(radians(30)) + {Z} * sin(radians(40))))))"})
SPEED = lambda: F.col("radius_m") * 50.0
CHORD = lambda: F.lit(3.0e6)
scalar("velocity_transit", lambda: {"t": velocity.transit_time(CHORD(), SPEED()), "offset": velocity.rotation_offset(CHORD(), SPEED()), "back": velocity.speed_from_offset(F.radians(velocity.rotation_offset(CHORD(), SPEED())), CHORD()), "most": velocity.max_rotation_offset(CHORD())}, {"t": "3e6 / (radius_m * 5e1 * 1e3)", "offset": f"degrees({OMEGA!r} * 3e6 / (radius_m * 5e1 * 1e3))", "back": "radius_m * 5e1", "most": f"degrees({OMEGA!r} * 3e6 / 5e4)"})
scalar("freshness_index", lambda: {"fi": score.freshness(F.col("nls"), F.col("rcr")), "survival": stats.survival_myr(F.col("radius_m")) + 1e-8}, {"fi": "0.7e0 * least(1, greatest(0, (nls - 1) / 2)) + 0.3e0 * least(1, greatest(0, rcr / 8))", "survival": f"radius_m * radius_m / (4 * {KAPPA!r}) + 1e-8"})


@query(f"+ g AS (SELECT range AS i, 0.01 + range * {(V_ESCAPE - 0.01) / 499!r} AS v FROM range(500)), p AS (SELECT *, v * v * exp(-(v * v) / {V_CIRCULAR**2!r}) AS r FROM g), q AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv, lag(r) OVER w AS pr FROM p WINDOW w AS (ORDER BY i)), a AS (SELECT sum((r + pr) / 2 * (v - pv)) AS area FROM q), d AS (SELECT i, v, r / area AS pdf, CASE WHEN pv IS NULL THEN nv - v WHEN nv IS NULL THEN v - pv ELSE (nv - pv) / 2 END AS step FROM q, a), c AS (SELECT i, v, pdf, sum(pdf) OVER (ORDER BY i) * step AS c FROM d) SELECT i, round(v, 6) AS v, round(pdf, 9) AS pdf, round(c / (SELECT c FROM c WHERE i = 499), 6) AS cdf FROM c", "craters")
def speed_distribution(spark, sf):
    d = velocity.speed_distribution(velocity.speed_grid(spark, 0.01, V_ESCAPE, 500))
    return d.select("i", F.round("v", 6).alias("v"), F.round("pdf", 9).alias("pdf"), F.round("cdf", 6).alias("cdf"))


STEP = (V_ESCAPE - velocity.GRID_FROM) / (velocity.GRID - 1)
GRID_CDF = f"g AS (SELECT range AS i, {velocity.GRID_FROM} + range * {STEP!r} AS v FROM range({velocity.GRID})), p AS (SELECT *, v * v * exp(-(v * v) / {V_CIRCULAR**2!r}) AS r FROM g), q AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv, lag(r) OVER w AS pr FROM p WINDOW w AS (ORDER BY i)), a AS (SELECT sum((r + pr) / 2 * (v - pv)) AS area FROM q), d AS (SELECT i, v, r / area AS pdf, CASE WHEN pv IS NULL THEN nv - v WHEN nv IS NULL THEN v - pv ELSE (nv - pv) / 2 END AS step FROM q, a), c AS (SELECT i, v, pdf, sum(pdf) OVER (ORDER BY i) * step AS c FROM d), f AS (SELECT i, c / (SELECT max_by(c, i) FROM c) AS cdf FROM c)"


@query(f"""+ {GRID_CDF}, o AS (SELECT idx, {OMEGA!r} * 3e6 / radians(radius_m / 1e3) / 1e3 AS v FROM craters), l AS (SELECT idx, v, CAST(least(greatest(floor((v - {velocity.GRID_FROM}) / {STEP!r}), 0), {velocity.GRID - 2}) AS BIGINT) AS place FROM o)
    SELECT idx, round(CASE WHEN v > {V_ESCAPE} THEN 0 ELSE x.cdf + (y.cdf - x.cdf) * greatest((v - ({velocity.GRID_FROM} + place * {STEP!r})) / {STEP!r}, 0) END, 6) + 0 AS probability FROM l JOIN f x ON x.i = place JOIN f y ON y.i = place + 1""", "craters")  # fmt: skip
def offset_probability(spark, sf):
    return rounded(velocity.offset_probability(view(spark, sf, "craters").select("idx", (F.col("radius_m") / 1e3).alias("o"), F.lit(3.0e6).alias("l")), "o", "l").select("idx", "probability"))


# Catalogues.
PRINT = "radius_m, freshness_index, ellipticity, orientation_deg, shape_reliable"
MANY = "SELECT *, idx AS id FROM craters UNION ALL SELECT * REPLACE (idx + 1000000 AS idx), idx AS id FROM craters WHERE idx % 4 = 0"


@query(f"+ m AS ({MANY}) SELECT idx, id FROM (SELECT *, row_number() OVER (PARTITION BY {PRINT} ORDER BY idx) AS k FROM m) WHERE k = 1", "craters")
def dedup_fingerprint(spark, sf):
    c = view(spark, sf, "craters").withColumn("id", F.col("idx"))
    return catalog.dedup(c.union(c.where("idx % 4 = 0").withColumn("idx", F.col("idx") + 1000000))).select("idx", "id")


@query("SELECT idx, depth_proxy FROM craters WHERE depth_proxy >= 0.22e0", "craters")
def depth_prefilter(spark, sf):
    return conejoin.qualifying(view(spark, sf, "craters")).select("idx", "depth_proxy")


BEST = "SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY {} ORDER BY resolution_mpp, {}) AS k FROM {}) WHERE k = 1"
ONE = BEST.format("product_id", "center_lat, center_lon", "products")
STEM = f"+ one AS ({ONE}) " + BEST.format("substring(product_id, 1, length(product_id) - 1)", "product_id", "one")


@query(ONE, "products")
def manifest_best_product(spark, sf):
    return catalog.best_products(view(spark, sf, "products"))


@query(STEM, "products")
def manifest_calibration_twins(spark, sf):
    return catalog.best_observations(catalog.best_products(view(spark, sf, "products")))


@query(f"""+ one AS ({ONE}), b AS (SELECT *, concat(CAST(CAST(floor((center_lat + 90) / 15) AS INT) AS VARCHAR), '_', CAST(CAST(floor((center_lon + 180) / 15) AS INT) AS VARCHAR)) AS bin FROM one),
    r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY resolution_mpp, product_id) AS k FROM b),
    o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, CASE WHEN k = 1 THEN bin END, resolution_mpp, product_id) AS n FROM r)
    SELECT product_id, resolution_mpp, CAST(row_number() OVER (ORDER BY resolution_mpp, product_id) - 1 AS INT) AS manifest_index FROM o WHERE n <= 400""", "products")  # fmt: skip
def manifest_stratified(spark, sf):
    return catalog.numbered(catalog.stratified(catalog.best_products(view(spark, sf, "products")), 400)).select("product_id", "resolution_mpp", "manifest_index")


@query("SELECT product_id, round(resolution, 6) AS resolution_mpp, round(coalesce(lon, CAST(point % 360 AS DOUBLE) - 180e0), 6) AS center_lon, round(lat, 6) AS center_lat, incidence AS incidence_angle_deg FROM observed WHERE point % 7 <> 0 AND point % 11 <> 0 AND resolution <= 2e0", "observed")
def survey_records(spark, sf):
    """Product rows read back from answers of up to 20 records each: every seventh answer is malformed, every eleventh an exception, records without a longitude lie at their grid point."""
    seen = view(spark, sf, "observed")
    text = records.record_text({"product_id": F.concat(F.lit("' "), "product_id", F.lit(" '")), "resolution": F.col("resolution"), "center_longitude": F.col("lon"), "center_latitude": F.col("lat"), "incidence_angle": F.col("incidence")})
    body = F.concat(F.lit("other: ~\nnac:\n"), F.array_join(F.collect_list(text), ""), F.when(F.col("point") % 7 == 0, " broken: [\n").otherwise(F.lit("")))
    body = F.when(F.col("point") % 11 == 0, F.lit("<ServiceExceptionReport/>")).otherwise(body)
    answers = seen.groupBy("point").agg(body.cast("binary").alias("body")).select(((F.col("point") % 360).cast("double") - 180.0).alias("lon"), F.lit(0.0).alias("lat"), "body")
    return rounded(catalog.clean_products(survey.products(answers, "nac")).select("product_id", "resolution_mpp", "center_lon", "center_lat", "incidence_angle_deg"))


@query("SELECT product_id, resolution_mpp, center_lon, center_lat FROM products WHERE center_lon >= 150 OR center_lon < -160", "products")
def lon_in_range(spark, sf):
    return catalog.in_lon_range(view(spark, sf, "products"), 150.0, 200.0)


@query("SELECT -180e0 + lo * 5e0 AS lon, -85e0 + la * 5e0 AS lat FROM (SELECT range AS lo FROM range(72)), (SELECT range AS la FROM range(35))")
def manifest_grid(spark, sf):
    return catalog.grid(spark, 5.0)


# Pairs.
CONE = "2 * sin(radians({}) / 2)"
D1, D2 = dest("asin(vz)", "atan2(vy, vx)", BEAR, ARC), dest("asin(vz)", "atan2(vy, vx)", f"({BEAR} + pi())", ARC)
DIRECTED = "(shape_reliable AND ellipticity IS NOT NULL AND ellipticity > 1)"


def pairs_sql(source: str, key: str = "") -> str:
    """CTEs up to ``pairs``: all that pass cone and cuts, by comparing every row with every other."""
    k, same = (f"{key}, ", f"AND a.{key} = b.{key}") if key else ("", "")
    one = ", ".join(f"{e} AS c{a}" for a, e in zip("xyz", D1, strict=True))
    two = ", ".join(f"{e} AS c{a}" for a, e in zip("xyz", D2, strict=True))
    return f"""q AS (SELECT *, {X} AS vx, {Y} AS vy, {Z} AS vz FROM {source} WHERE depth_proxy >= 0.22e0),
    cs AS (SELECT {k}idx, {one}, {CONE.format(2)} AS r FROM q WHERE {DIRECTED} UNION ALL SELECT {k}idx, {two}, {CONE.format(2)} FROM q WHERE {DIRECTED}
      UNION ALL SELECT {k}idx, {one}, {CONE.format(10)} FROM q WHERE shape_reliable AND ellipticity = 1
      UNION ALL SELECT {k}idx, -vx, -vy, -vz, {CONE.format(10)} FROM q WHERE NOT coalesce(shape_reliable AND ellipticity >= 1, false)),
    hit AS (SELECT DISTINCT {f'a.{key}, ' if key else ''}a.idx AS ia, b.idx AS ib FROM cs a JOIN q b ON b.idx > a.idx {same} AND (b.vx - a.cx) * (b.vx - a.cx) + (b.vy - a.cy) * (b.vy - a.cy) + (b.vz - a.cz) * (b.vz - a.cz) <= a.r * a.r),
    two AS (SELECT {f'a.{key}, ' if key else ''}a.idx AS idx_a, b.idx AS idx_b, degrees(acos(least(1, greatest(-1, a.vx * b.vx + a.vy * b.vy + a.vz * b.vz)))) AS sep, {', '.join(f'{s}.{c} AS {c}_{s}' for s in 'ab' for c in ('lon_deg', 'lat_deg', 'radius_m', 'nls', 'rcr', 'ellipticity', 'orientation_deg', 'shape_reliable', 'orientation_unc_deg', 'ellipticity_unc', 'vx', 'vy', 'vz'))}
      FROM hit h JOIN q a ON a.idx = h.ia {f'AND a.{key} = h.{key}' if key else ''} JOIN q b ON b.idx = h.ib {f'AND b.{key} = h.{key}' if key else ''}),
    pairs AS (SELECT * FROM two WHERE abs(nls_a - nls_b) <= 1.5 AND abs(rcr_a - rcr_b) <= 4 AND abs(radius_m_a - radius_m_b) <= 2 AND sep >= 30)"""


def gauss(d: str, s: str) -> str:
    return f"exp(-(({d}) / ({s})) * (({d}) / ({s})))"


def scored_sql(source: str = "pairs", sig: dict | None = None, keep: str = "") -> str:
    """The six terms and the score as SQL over ``pairs``."""
    g = {c: repr(float(getattr(DEFAULT, c))) for c in score.SIGMAS} | (sig or {})
    ok = {s: f"coalesce(shape_reliable_{s} AND ellipticity_{s} IS NOT NULL, false)" for s in "ab"}
    exp = "(1 / sin(radians(sep) / 2))"
    shape = " * ".join(f"CASE WHEN {ok[s]} THEN {gauss(f'ellipticity_{s} - {exp}', g['sigma_ellipticity'])} ELSE 1 END" for s in "ab")
    turn = {s: f"degrees(atan2(cos(radians(lat_deg_{t})) * sin(radians(lon_deg_{t} - lon_deg_{s})), cos(radians(lat_deg_{s})) * sin(radians(lat_deg_{t})) - sin(radians(lat_deg_{s})) * cos(radians(lat_deg_{t})) * cos(radians(lon_deg_{t} - lon_deg_{s}))))" for s, t in ("ab", "ba")}
    mod = {s: f"(orientation_deg_{s} - {turn[s]} - 180 * floor((orientation_deg_{s} - {turn[s]}) / 180))" for s in "ab"}
    aligned = " * ".join(gauss(f"least({mod[s]}, 180 - {mod[s]})", g["sigma_orientation_deg"]) for s in "ab")
    both = f"{ok['a']} AND {ok['b']} AND ellipticity_a > 1.05e0 AND ellipticity_b > 1.05e0"

    def position(s: str, t: str) -> str:
        arc, at = f"2 * asin(1 / ellipticity_{s})", f"radians(90 - orientation_deg_{s})"
        off = []
        for b in (at, f"({at} + pi())"):
            x, y, z = dest(f"asin(vz_{s})", f"atan2(vy_{s}, vx_{s})", b, arc)
            off.append(f"degrees(acos(least(1, greatest(-1, {x} * vx_{t} + {y} * vy_{t} + {z} * vz_{t}))))")
        f = f"greatest(ellipticity_{s}, 1.001e0)"
        across = f"radians(sep) * sin(least(radians(orientation_unc_deg_{s}), pi() / 2))"
        along = f"2 / ({f} * {f} * sqrt(greatest(1 - 1 / ({f} * {f}), 1e-12))) * ellipticity_unc_{s}"
        sigma = f"CASE WHEN orientation_unc_deg_{s} IS NOT NULL AND ellipticity_unc_{s} IS NOT NULL THEN degrees(greatest(sqrt(({across}) * ({across}) + ({along}) * ({along})), 1e-6)) ELSE {g['sigma_position_deg']} END"
        return f"CASE WHEN {ok[s]} AND ellipticity_{s} >= 1 THEN {gauss(f'least({off[0]}, {off[1]})', sigma)} END"

    return f"""terms AS (SELECT {keep} idx_a, idx_b, sep AS separation_deg, {gauss('radius_m_a - radius_m_b', g['sigma_radius'])} AS T_radius, {gauss('nls_a - nls_b', g['sigma_nls'])} AS T_nls, {gauss('rcr_a - rcr_b', g['sigma_rcr'])} AS T_rcr,
      {shape} AS T_ellipticity, CASE WHEN {both} THEN {aligned} ELSE 1 END AS T_orientation, {position('a', 'b')} AS pa, {position('b', 'a')} AS pb FROM {source}),
    scored AS (SELECT *, CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN sqrt(pa * pb) ELSE coalesce(pa, pb, 1) END AS T_position FROM terms),
    ranked AS (SELECT *, T_radius * T_nls * T_rcr * T_ellipticity * T_orientation * T_position AS score FROM scored)"""


PAIRS = pairs_sql("craters")
TERM_SQL = ", ".join(f"round({t}, 6) AS {t}" for t in score.TERMS)


def best(spark, sf, n):
    """The best of all pairs; scores to nine places, so that ties are ties in either engine."""
    return conejoin.top_pairs(view(spark, sf, "craters"), n, places=9)


@query(f"+ {PAIRS} SELECT idx_a, idx_b, round(sep, 6) AS separation_deg FROM pairs", "craters")
def cone_join(spark, sf):
    p = conejoin.candidate_pairs(conejoin.qualifying(view(spark, sf, "craters")), most=conejoin.CROWD)
    return p.select(F.col("p_idx").alias("idx_a"), F.col("b_idx").alias("idx_b"), F.round(geo.separation(geo.vec("p_v"), geo.vec("b_v")), 6).alias("separation_deg"))


@query(f"+ {PAIRS}, {scored_sql()} SELECT idx_a, idx_b, {TERM_SQL}, round(score, 6) AS score FROM ranked", "craters")
def pair_scores(spark, sf):
    return rounded(conejoin.build_pairs(view(spark, sf, "craters")).select("idx_a", "idx_b", *score.TERMS, "score"))


@query(f"+ {PAIRS}, {scored_sql()} SELECT idx_a, idx_b, round(score, 6) AS score FROM ranked ORDER BY round(ranked.score, 9) DESC, idx_a, idx_b LIMIT 50", "craters")
def pair_topn(spark, sf):
    return rounded(best(spark, sf, 50).select("idx_a", "idx_b", "score"))


@query(f"+ {PAIRS}, {scored_sql()} SELECT round(score, 6) AS score, idx_a, idx_b FROM ranked ORDER BY round(ranked.score, 9) DESC, idx_a, idx_b LIMIT 1", "craters")
def pair_max(spark, sf):
    return rounded(conejoin.max_pair(best(spark, sf, 1)).select("score", "pair.idx_a", "pair.idx_b"))


@query("""WITH RECURSIVE graph AS (SELECT {G} FROM orders), live AS (SELECT * FROM graph WHERE idx_a <> idx_b),
    w AS (SELECT 0 AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pair_id, CAST(NULL AS BIGINT) AS idx_a, CAST(NULL AS BIGINT) AS idx_b, CAST(NULL AS DOUBLE) AS score
      UNION ALL SELECT n + 1, list_concat(used, [r.idx_a, r.idx_b]), r.pair_id, r.idx_a, r.idx_b, r.score
      FROM (SELECT w.n, w.used, first(l ORDER BY l.score DESC, l.idx_a, l.idx_b) AS r FROM w, live l WHERE w.n < 200 AND NOT list_contains(w.used, l.idx_a) AND NOT list_contains(w.used, l.idx_b) GROUP BY ALL))
    SELECT pair_id, idx_a, idx_b, score FROM w WHERE n > 0""".replace("{G}", VIEWS["graph"][1]))
def nonoverlap_topk(spark, sf):
    """Its SQL is the sequential walk."""
    return matching.non_overlapping(view(spark, sf, "graph"), 200)


# The null model, with uniform numbers from whole-number arithmetic so that SQL can draw the same.
def modular(trial: Column, idx: Column, axis: int) -> Column:
    return ((idx * 7919 + trial * 104729 + (axis + 1) * 15485863) % 1000003).cast("double") / 1000003.0


U = "CAST((idx * 7919 + t * 104729 + {} * 15485863) % 1000003 AS DOUBLE) / 1000003e0"
DRAWN = f"one AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY {PRINT} ORDER BY idx) AS k FROM craters) WHERE k = 1), drawn AS (SELECT one.* REPLACE (degrees({U.format(2)} * 2 * pi()) - 180 AS lon_deg, degrees(asin({U.format(1)} * 2 - 1)) AS lat_deg), t AS trial FROM one, (SELECT range AS t FROM range({TRIALS})))"


@query(f"+ {DRAWN}, {pairs_sql('drawn', 'trial')}, {scored_sql(keep='trial,')} SELECT t.range AS trial, round(coalesce(max(score), 0), 6) AS score FROM range({TRIALS}) t LEFT JOIN ranked ON ranked.trial = t.range GROUP BY t.range", "craters")
def null_best_scores(spark, sf):
    return rounded(nullmodel.best_scores(view(spark, sf, "craters"), spark.range(TRIALS).withColumnRenamed("id", "trial"), uniform=modular).select("trial", "score"))


@query("SELECT c AS chunk, c * 142 + least(c, 6) AS first, c * 142 + least(c, 6) + 142 + CASE WHEN c < 6 THEN 1 ELSE 0 END AS last FROM (SELECT range AS c FROM range(7))")
def null_chunk_bounds(spark, sf):
    return nullmodel.chunk_bounds(spark, 1000, 7)


def up_to(df: DataFrame, column: str, more: int, name: str) -> DataFrame:
    """Whole numbers from 0 to ``more`` beyond the largest of a column, over as many tasks as a range takes."""
    most = df.agg(F.max(column).cast("long")).first()[0]
    return df.sparkSession.range(0 if most is None else most + more + 1).withColumnRenamed("id", name)


@query("SELECT trial FROM (SELECT unnest(range((SELECT max(trial) + 1001 FROM null_scores))) AS trial) WHERE trial NOT IN (SELECT trial FROM null_scores)", "null_scores")
def null_remaining(spark, sf):
    """All trials up to 1000 beyond the last one done."""
    null = view(spark, sf, "null_scores")
    return nullmodel.remaining(up_to(null, "trial", 1000, "trial"), null)


def assessed(spark, sf):
    return significance.p_values(view(spark, sf, "graph").withColumn("score", F.col("score") * 1.001), view(spark, sf, "null_scores"))


PV = "g AS (SELECT * REPLACE (score * 1.001e0 AS score) FROM graph), u AS (SELECT score, 0 AS n FROM g UNION ALL SELECT score, 1 FROM null_scores), c AS (SELECT DISTINCT score, sum(n) OVER (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above FROM u), pv AS (SELECT pair_id, idx_a, idx_b, g.score, (above + 1) / ((SELECT count(*) FROM null_scores) + 1e0) AS p_value FROM g JOIN c ON c.score = g.score)"


@query(f"+ {PV} SELECT pair_id, round(p_value, 9) AS p_value, round(1 - p_value, 9) AS percentile_score FROM pv", "null_scores", "graph")
def p_values(spark, sf):
    return rounded(assessed(spark, sf).select("pair_id", "p_value", "percentile_score"), 9)


BH = f"{PV}, r AS (SELECT *, row_number() OVER (ORDER BY p_value, pair_id) AS k, count(*) OVER () AS m FROM pv), e AS (SELECT max(k) AS k FROM r WHERE p_value <= 0.9e0 * k / m), a AS (SELECT r.*, 1 - p_value AS percentile_score, coalesce(r.k <= e.k, false) AS sig FROM r, e)"


@query(f"+ {BH} SELECT pair_id, round(p_value, 9) AS p_value, sig AS bh_significant FROM a", "null_scores", "graph")
def bh_fdr(spark, sf):
    return rounded(significance.with_discoveries(assessed(spark, sf), 0.9).select("pair_id", "p_value", "bh_significant"), 9)


@query(f"+ {BH} SELECT count(*) AS n_pairs, count(*) FILTER (sig) AS n_significant, round(max(score), 6) AS best_score, round(median(percentile_score), 6) AS percentile_median, round(avg(percentile_score), 6) AS percentile_mean, count(*) FILTER (percentile_score >= 0.95) AS n_above_95 FROM a", "null_scores", "graph")
def significance_summary(spark, sf):
    s = significance.summary(significance.with_discoveries(assessed(spark, sf), 0.9))
    return rounded(s.select("n_pairs", "n_significant", "best_score", "percentile_median", "percentile_mean", "n_above_95"))


@query("SELECT round(quantile_cont(score, 0.5), 9) AS p50, round(quantile_cont(score, 0.95), 9) AS p95, round(quantile_cont(score, 0.99), 9) AS p99, round(quantile_cont(score, 0.9987), 9) AS three_sigma, round(max(score), 9) AS best, count(*) AS n_trials FROM null_scores", "null_scores")
def null_percentiles(spark, sf):
    return rounded(significance.percentiles(view(spark, sf, "null_scores")), 9)


# Rescoring.
HYPO = rescore.hypotheses()
BASE_SIGMAS = ", ".join(score.SIGMAS)
GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', " + ", ".join(f"{float(getattr(s, c))!r}::DOUBLE" for c in score.SIGMAS) + ")" for n, s in HYPO.items()) + f") AS g(hypothesis, {BASE_SIGMAS})), under AS (SELECT * FROM pairs, grid)"
UNDER = f"+ {PAIRS}, {GRID_SQL}, {scored_sql('under', {c: c for c in score.SIGMAS}, 'hypothesis,')}"


@query(f"{UNDER} SELECT hypothesis, round(max(score), 6) AS best_score, round(avg(score), 6) AS mean_score, count(*) FILTER (score >= 0.05) AS n_above, count(*) AS n_pairs FROM ranked GROUP BY hypothesis", "craters")
def rescore_hypotheses(spark, sf):
    pairs = conejoin.build_pairs(view(spark, sf, "craters"))
    return rounded(rescore.hypothesis_summary(pairs, rescore.grid_of(spark, HYPO), 0.05).select("hypothesis", "best_score", "mean_score", "n_above", "n_pairs"))


SWEEP_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {x!r}::DOUBLE, " + ", ".join(f"{float(getattr(DEFAULT, c)) * (x if c == p else 1.0)!r}::DOUBLE" for c in score.SIGMAS) + ")" for p in rescore.SWEPT for x in rescore.scales()) + f") AS g(parameter, scale, {BASE_SIGMAS})), under AS (SELECT * FROM pairs, grid)"


@query(f"""+ {PAIRS}, {SWEEP_SQL}, {scored_sql('under', {c: c for c in score.SIGMAS}, 'parameter, scale,')}, base AS (SELECT round(score, 9) AS s0 FROM ({{BASE}})),
    t AS (SELECT parameter, scale, round(score, 9) AS s FROM ranked), lim AS (SELECT quantile_cont(score, 0.95) AS p95 FROM null_scores),
    top AS (SELECT parameter, scale, s, row_number() OVER (PARTITION BY parameter, scale ORDER BY s DESC) AS k FROM t QUALIFY k <= 10), b10 AS (SELECT s0, row_number() OVER (ORDER BY s0 DESC) AS k FROM base QUALIFY k <= 10),
    z AS (SELECT parameter, scale, k, s0, s FROM top JOIN b10 USING (k)),
    tau AS (SELECT x.parameter, x.scale, sum(sign(x.s0 - y.s0) * sign(x.s - y.s)) / nullif(sqrt(CAST(count(*) FILTER (x.s0 <> y.s0) AS DOUBLE) * count(*) FILTER (x.s <> y.s)), 0) AS tau FROM z x JOIN z y ON x.parameter = y.parameter AND x.scale = y.scale AND x.k < y.k GROUP BY 1, 2),
    per AS (SELECT parameter, scale, max(s) AS best_score, count(*) FILTER (s >= p95) AS n_above FROM t, lim GROUP BY 1, 2)
    SELECT per.parameter, round(per.scale, 6) AS scale, round(best_score, 6) AS best_score, n_above, round(tau, 6) AS tau FROM per LEFT JOIN tau ON tau.parameter = per.parameter AND tau.scale = per.scale""".replace("{BASE}", f"SELECT score FROM (WITH {scored_sql()} SELECT score FROM ranked)"), "craters", "null_scores")  # fmt: skip
def sigma_sweep(spark, sf):
    """Five parameters times sixty scales, against the null model's 95th percentile."""
    pairs = conejoin.build_pairs(view(spark, sf, "craters"))
    limit = significance.percentiles(view(spark, sf, "null_scores")).first()["p95"]
    return rounded(rescore.sensitivity(pairs, rescore.sweep(spark), limit))


@query(f"""+ {PAIRS}, {scored_sql()}, best AS (SELECT idx_a, idx_b FROM ranked ORDER BY round(ranked.score, 9) DESC, idx_a, idx_b LIMIT 200), {GRID_SQL.replace('FROM pairs, grid', 'FROM pairs JOIN best USING (idx_a, idx_b), grid')},
    h AS (SELECT hypothesis, round(score, 9) AS s FROM (WITH {scored_sql('under', {c: c for c in score.SIGMAS}, 'hypothesis,')} SELECT hypothesis, score FROM ranked)),
    pv AS (SELECT hypothesis, s, ((SELECT count(*) FROM null_scores n WHERE n.score >= h.s) + 1) / ((SELECT count(*) FROM null_scores) + 1e0) AS p FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY hypothesis ORDER BY p) AS k, row_number() OVER (PARTITION BY hypothesis ORDER BY s DESC) AS place, count(*) OVER (PARTITION BY hypothesis) AS m FROM pv),
    e AS (SELECT hypothesis, max(p) FILTER (p <= 0.05e0 * k / m) AS edge FROM r GROUP BY 1),
    tau AS (SELECT x.hypothesis, sum(sign(x0.s - y0.s) * sign(x.s - y.s)) / nullif(sqrt(CAST(count(*) FILTER (x0.s <> y0.s) AS DOUBLE) * count(*) FILTER (x.s <> y.s)), 0) AS tau FROM r x JOIN r y ON x.hypothesis = y.hypothesis AND x.place < y.place JOIN r x0 ON x0.hypothesis = 'H0' AND x0.place = x.place JOIN r y0 ON y0.hypothesis = 'H0' AND y0.place = y.place GROUP BY 1)
    SELECT r.hypothesis, round(max(s), 6) AS best_score, round(min(p), 9) AS best_p, round(1 - min(p), 9) AS best_percentile, count(*) FILTER (coalesce(p <= edge, false)) AS n_significant, round(max(tau), 6) AS tau FROM r JOIN e USING (hypothesis) LEFT JOIN tau USING (hypothesis) GROUP BY 1""", "craters", "null_scores")  # fmt: skip
def hypothesis_rounds(spark, sf):
    """The 200 best pairs under each hypothesis against the null scores."""
    r = rescore.rounds(best(spark, sf, 200), rescore.grid_of(spark, HYPO), view(spark, sf, "null_scores"))
    return r.select("hypothesis", F.round("best_score", 6).alias("best_score"), F.round("best_p", 9).alias("best_p"), F.round("best_percentile", 9).alias("best_percentile"), "n_significant", F.round("tau", 6).alias("tau"))


OWN_TRIALS = 12
DRAWN_OWN = DRAWN.replace(f"range({TRIALS})", f"range({OWN_TRIALS})")


@query(f"""+ {PAIRS}, {scored_sql()}, best AS (SELECT idx_a, idx_b FROM ranked ORDER BY round(ranked.score, 9) DESC, idx_a, idx_b LIMIT 200), {GRID_SQL.replace('FROM pairs, grid', 'FROM pairs JOIN best USING (idx_a, idx_b), grid')},
    h AS (SELECT hypothesis, round(score, 9) AS s FROM (WITH {scored_sql('under', {c: c for c in score.SIGMAS}, 'hypothesis,')} SELECT hypothesis, score FROM ranked)),
    nbest AS (SELECT * FROM (WITH {DRAWN_OWN}, {pairs_sql('drawn', 'trial')}, {scored_sql(keep='trial,')}, r AS (SELECT trial, idx_a, idx_b FROM ranked WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY trial ORDER BY score DESC, idx_a, idx_b) = 1) SELECT pairs.* FROM pairs JOIN r USING (trial, idx_a, idx_b))),
    nunder AS (SELECT * FROM nbest, grid), nh AS (SELECT hypothesis, trial, round(score, 9) AS s FROM (WITH {scored_sql('nunder', {c: c for c in score.SIGMAS}, 'hypothesis, trial,')} SELECT hypothesis, trial, score FROM ranked)),
    pv AS (SELECT hypothesis, s, ((SELECT count(*) FROM nh WHERE nh.hypothesis = h.hypothesis AND nh.s >= h.s) + 1) / ((SELECT count(*) FROM nh WHERE nh.hypothesis = h.hypothesis) + 1e0) AS p FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY hypothesis ORDER BY p) AS k, row_number() OVER (PARTITION BY hypothesis ORDER BY s DESC) AS place, count(*) OVER (PARTITION BY hypothesis) AS m FROM pv),
    e AS (SELECT hypothesis, max(p) FILTER (p <= 0.05e0 * k / m) AS edge FROM r GROUP BY 1)
    SELECT r.hypothesis, round(max(s), 6) AS best_score, round(min(p), 9) AS best_p, round(1 - min(p), 9) AS best_percentile, count(*) FILTER (coalesce(p <= edge, false)) AS n_significant FROM r JOIN e USING (hypothesis) GROUP BY 1""", "craters")  # fmt: skip
def hypothesis_own_null(spark, sf):
    """The 200 best pairs under each hypothesis against null pairs that are scored anew under it as well."""
    c = view(spark, sf, "craters")
    null = nullmodel.best_pairs(c, spark.range(OWN_TRIALS).withColumnRenamed("id", "trial"), uniform=modular)
    r = rescore.rounds(best(spark, sf, 200), rescore.grid_of(spark, HYPO), None, null)
    return r.select("hypothesis", F.round("best_score", 6).alias("best_score"), F.round("best_p", 9).alias("best_p"), F.round("best_percentile", 9).alias("best_percentile"), "n_significant")


@query("+ t AS (SELECT * FROM graph ORDER BY score DESC, pair_id LIMIT 100), s AS (SELECT sign(a.idx_a - b.idx_a) * sign(a.idx_b - b.idx_b) AS s, a.idx_a = b.idx_a AS tx, a.idx_b = b.idx_b AS ty FROM t a JOIN t b ON a.pair_id < b.pair_id) SELECT round(sum(s) / sqrt(CAST(count(*) FILTER (NOT tx) AS DOUBLE) * count(*) FILTER (NOT ty)), 6) AS tau, count(*) AS n_compared, count(*) FILTER (s > 0) AS concordant, count(*) FILTER (s < 0) AS discordant FROM s", "graph")
def kendall_tau(spark, sf):
    return rounded(rescore.kendall(view(spark, sf, "graph").orderBy(F.desc("score"), "pair_id").limit(100), "idx_a", "idx_b", "pair_id"))


@query("+ r AS (SELECT rank() OVER (ORDER BY radius_m) + (count(*) OVER (PARTITION BY radius_m) - 1) / 2.0 AS rx, rank() OVER (ORDER BY depth_proxy) + (count(*) OVER (PARTITION BY depth_proxy) - 1) / 2.0 AS ry FROM craters WHERE depth_proxy IS NOT NULL) SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r", "craters")
def spearman(spark, sf):
    return rounded(stats.spearman(view(spark, sf, "craters"), "radius_m", "depth_proxy"))


# Reports.
@query("SELECT b AS bin, round(1 + b * 0.45e0, 6) AS lo, round(1 + (b + 1) * 0.45e0, 6) AS hi, count(idx) AS n FROM (SELECT CAST(range AS INT) AS b FROM range(20)) LEFT JOIN craters ON least(floor((radius_m - 1) / 0.45e0), 19) = b AND radius_m BETWEEN 1 AND 10 GROUP BY b", "craters")
def hist_radius(spark, sf):
    return rounded(stats.histogram(view(spark, sf, "craters"), "radius_m", 1.0, 10.0, 20))


@query("+ h AS (SELECT b, -90 + b * 10 AS lo, -80 + b * 10 AS hi, count(idx) AS n FROM (SELECT CAST(range AS INT) AS b FROM range(18)) LEFT JOIN craters ON least(floor((lat_deg + 90) / 10), 17) = b GROUP BY b), d AS (SELECT *, n / (2 * pi() * (sin(radians(hi)) - sin(radians(lo)))) AS d FROM h) SELECT b AS bin, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, n, round(d / max(d) OVER (), 6) AS density FROM d", "craters")
def lat_density(spark, sf):
    return rounded(stats.latitude_density(view(spark, sf, "craters")))


@query("+ v AS (SELECT 'radius_m' AS c, radius_m AS v FROM craters UNION ALL SELECT 'depth_proxy', depth_proxy FROM craters) SELECT c AS column, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM v WHERE v IS NOT NULL GROUP BY c", "craters")
def summary_stats(spark, sf):
    return rounded(stats.describe(view(spark, sf, "craters"), ["radius_m", "depth_proxy"]))


@query(f"+ {PAIRS}, {scored_sql()}, top AS (SELECT * FROM ranked ORDER BY round(score, 9) DESC, idx_a, idx_b LIMIT 50) " + " UNION ALL ".join(f"SELECT '{t}' AS term, round(avg({t}), 6) AS mean, round(stddev_pop({t}), 6) AS std FROM top" for t in score.TERMS), "craters")
def component_star(spark, sf):
    return rounded(stats.component_means(best(spark, sf, 50), score.TERMS))


@query(f"SELECT range AS i, round(14 + range * {8 / 499!r}, 6) AS log_mass, round(log10(3 * pow(10, 14 + range * {8 / 499!r}) / ({FLUX_G_S!r} * 1e10 * 3e13 * 5e-4)), 6) AS log_limit FROM range(500)")
def flux_limit(spark, sf):
    d = stats.limit_curve(spark, 1e10, 3e13, 5e-4)
    return d.select("i", F.round(F.log10("mass_g"), 6).alias("log_mass"), F.round(F.log10("limit"), 6).alias("log_limit"))


@query(f"SELECT count(*) AS n, round(sqrt(avg(radius_m * radius_m)), 6) AS r_eff, round(count(*) FILTER (depth_proxy >= 0.5) / CAST(count(*) AS DOUBLE), 6) AS deep_share, round(count(*) * 1.44e0 / {AREA_KM2!r}, 9) AS covered FROM craters", "craters")
def shares(spark, sf):
    d = view(spark, sf, "craters").agg(F.count("*").alias("n"), F.round(stats.effective_radius(F.col("radius_m")), 6).alias("r_eff"), F.round(significance.hit_rate(F.col("depth_proxy"), 0.5), 6).alias("deep_share"))
    return d.withColumn("covered", F.round(stats.covered_share(F.col("n") * 1.44), 9))


ENDS = ", ".join(f"cos(radians(lat_deg_{s})) * cos(radians(lon_deg_{s})) AS {s}_x, cos(radians(lat_deg_{s})) * sin(radians(lon_deg_{s})) AS {s}_y, sin(radians(lat_deg_{s})) AS {s}_z" for s in "ab")
ALONG = ", ".join(f"sin((1 - t) * w) / sin(w) * a_{c} + sin(t * w) / sin(w) * b_{c} AS {c}" for c in "xyz")


@query(f"""+ {PAIRS}, {scored_sql()}, best AS (SELECT idx_a, idx_b, round(ranked.score, 9) AS score FROM ranked ORDER BY round(ranked.score, 9) DESC, idx_a, idx_b LIMIT 20), lim AS (SELECT min(score) AS lo, max(score) AS hi FROM best),
    e AS (SELECT idx_a, idx_b, CASE WHEN hi > lo THEN (best.score - lo) / (hi - lo) ELSE 1 END AS shade, {ENDS} FROM best JOIN pairs USING (idx_a, idx_b), lim),
    p AS (SELECT *, acos(least(1, greatest(-1, a_x * b_x + a_y * b_y + a_z * b_z))) AS w FROM e), s AS (SELECT *, range AS i, range / 59e0 AS t FROM p, range(60)), v AS (SELECT idx_a, idx_b, shade, i, {ALONG} FROM s)
    SELECT idx_a, idx_b, round(shade, 6) AS shade, CAST(i AS INTEGER) AS i, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(asin(least(1, greatest(-1, z / sqrt(x * x + y * y + z * z))))), 6) AS lat FROM v""", "craters")  # fmt: skip
def chord_arcs(spark, sf):
    return rounded(report.arcs(best(spark, sf, 20)))


# Chips.
def chips(spark, sf):
    return raster.cells(spark.read.parquet(f"{sf}/embeddings.parquet"), 8, "embedding", "vec_id")


BOUNDS = "b AS (SELECT chip_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, avg(v) AS mean, stddev_pop(v) AS std FROM cells GROUP BY chip_id), st AS (SELECT c.chip_id, y, x, least(1, greatest(0, (v - lo) / (hi - lo + 1e-6))) AS v FROM cells c JOIN b USING (chip_id))"


@query(f"+ {BOUNDS} SELECT chip_id, y, x, round(v, 6) AS v FROM st", "cells")
def chip_stretch(spark, sf):
    return rounded(raster.stretched(chips(spark, sf)))


@query(f"+ {BOUNDS} SELECT chip_id, round(mean, 6) AS mean, round(std, 6) AS std, std < 1e-4 AS blank FROM b", "cells")
def chip_blank_guard(spark, sf):
    return rounded(raster.stretch_bounds(chips(spark, sf)).select("chip_id", "mean", "std", "blank"))


@query(f"""+ {BOUNDS}, m AS (SELECT chip_id, median(1 - v) AS m FROM st GROUP BY chip_id), w AS (SELECT st.*, greatest(1 - v - m, 0) AS w FROM st JOIN m USING (chip_id)),
    g AS (SELECT chip_id, sum(w) AS sw, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy FROM w GROUP BY chip_id HAVING sum(w) > 1e-8),
    h AS (SELECT *, xx - cx * cx AS a, yy - cy * cy AS b, xy - cx * cy AS c FROM g), k AS (SELECT *, sqrt((a - b) / 2 * (a - b) / 2 + c * c) AS arm, (a + b) / 2 AS mid FROM h)
    SELECT chip_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt(mid - arm) / sqrt(mid + arm), 6) AS circularity, round(degrees(0.5 * atan2(2 * c, a - b)), 6) AS orientation_deg FROM k""", "cells")  # fmt: skip
def chip_moments(spark, sf):
    return rounded(raster.moments(raster.stretched(chips(spark, sf))).select("chip_id", "cx", "cy", "circularity", "orientation_deg"))


@query("""+ d AS (SELECT *, sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)) AS d FROM cells), z AS (SELECT chip_id, avg(v) FILTER (d <= 0.75) AS f, avg(v) FILTER (d >= 1.2 AND d <= 1.95) AS m, stddev_pop(v) FILTER (d >= 3 AND d <= 4.5) AS s FROM d GROUP BY chip_id)
    SELECT chip_id, round((m - f) / s, 6) AS rcr FROM z""", "cells")  # fmt: skip
def chip_rim_contrast(spark, sf):
    return rounded(raster.rim_contrast(chips(spark, sf), F.lit(3.5), F.lit(3.5), F.lit(1.5)))


@query("""+ g AS (SELECT *, lag(v) OVER wx AS xa, lead(v) OVER wx AS xb, lag(v) OVER wy AS ya, lead(v) OVER wy AS yb FROM cells WINDOW wx AS (PARTITION BY chip_id, y ORDER BY x), wy AS (PARTITION BY chip_id, x ORDER BY y)),
    h AS (SELECT chip_id, v, CASE WHEN xa IS NULL THEN xb - v WHEN xb IS NULL THEN v - xa ELSE (xb - xa) / 2 END AS gx, CASE WHEN ya IS NULL THEN yb - v WHEN yb IS NULL THEN v - ya ELSE (yb - ya) / 2 END AS gy FROM g)
    SELECT chip_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(sqrt(gx * gx + gy * gy)), 6) AS slope FROM h GROUP BY chip_id""", "cells")  # fmt: skip
def chip_terrain_slope(spark, sf):
    return rounded(raster.slope(chips(spark, sf)))


@query("SELECT chip_id, y, x, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-12), 6) AS depth_proxy FROM cells WINDOW w AS (PARTITION BY chip_id)", "cells")
def chip_depth_proxy(spark, sf):
    return rounded(raster.depth_proxy(chips(spark, sf).withColumnRenamed("v", "strength")).select("chip_id", "y", "x", "depth_proxy"))


@query()
def chip_detect(spark, sf):
    """Features of chips of 32 x 32 cells: each cell of an 8 x 8 chip becomes 4 x 4."""
    big = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda x: F.get("embedding", (F.floor(y / 4) * 8 + F.floor(x / 4)).cast("int")))))
    d = spark.read.parquet(f"{sf}/embeddings.parquet").where("size(embedding) >= 64").select(F.col("vec_id").alias("chip_id"), F.lit(32).alias("h"), F.lit(32).alias("w"), big.alias("pixels"), F.lit(1.0).alias("mpp"))
    return rounded(detection.detections(d))


# More of the reports.
HIST = "SELECT CAST(range AS INT) AS bin, round(range * 0.02e0, 6) AS lo, round((range + 1) * 0.02e0, 6) AS hi, count(score) AS n FROM range(50) LEFT JOIN {} ON least(floor(score / 0.02e0), 49) = range AND score BETWEEN 0 AND 1 GROUP BY range"


@query("SELECT idx, lon_deg, lat_deg, freshness_index FROM craters WHERE lon_deg IS NOT NULL AND lat_deg IS NOT NULL", "craters")
def coverage_points(spark, sf):
    return report.coverage_points(view(spark, sf, "craters"))


@query(f"+ h AS ({HIST.format('null_scores')}), c AS (SELECT count(*) AS c FROM null_scores) SELECT h.*, round(n / (c * 0.02e0), 6) AS density FROM h, c", "null_scores")
def null_histogram(spark, sf):
    return rounded(report.null_histogram(view(spark, sf, "null_scores")))


@query(f"+ h AS ({HIST.format('graph')}), c AS (SELECT count(*) AS c, round(quantile_cont(score, 0.95), 6) AS p95, round(max(score), 6) AS best FROM graph) SELECT h.*, p95, best, round(n / (c * 0.02e0), 6) AS density FROM h, c", "graph")
def score_histogram(spark, sf):
    return rounded(report.score_histogram(view(spark, sf, "graph")))


@query(f"+ h AS ({HIST.format('graph')}), l AS (SELECT quantile_cont(score, 0.9987) AS t FROM null_scores), a AS (SELECT count(*) AS above FROM graph, l WHERE score >= t) SELECT h.*, round(t, 6) AS threshold, above FROM h, l, a", "graph", "null_scores")
def scores_against_null(spark, sf):
    return rounded(report.scores_against_null(view(spark, sf, "graph"), view(spark, sf, "null_scores")))


@query("SELECT pair_id, g.idx_a, g.idx_b, g.score, a.lon_deg AS a_lon_deg, a.lat_deg AS a_lat_deg, a.radius_m AS a_radius_m, b.lon_deg AS b_lon_deg, b.lat_deg AS b_lat_deg, b.radius_m AS b_radius_m FROM graph g JOIN craters a ON a.idx = g.idx_a JOIN craters b ON b.idx = g.idx_b", "graph", "craters")
def pair_ends(spark, sf):
    return report.pair_ends(view(spark, sf, "graph"), view(spark, sf, "craters"))


@query("+ t AS (SELECT idx_a, idx_b, score, CAST(row_number() OVER (ORDER BY score DESC, idx_a, idx_b) AS INT) AS place FROM graph QUALIFY place <= 10) SELECT t.*, a.lon_deg AS a_lon_deg, a.lat_deg AS a_lat_deg, b.lon_deg AS b_lon_deg, b.lat_deg AS b_lat_deg FROM t JOIN craters a ON a.idx = t.idx_a JOIN craters b ON b.idx = t.idx_b", "graph", "craters")
def pairs_on_map(spark, sf):
    return report.pairs_on_map(view(spark, sf, "graph"), view(spark, sf, "craters"))


@query(f"+ g AS (SELECT range AS i, range / 499e0 AS t FROM range(500)) SELECT 'offset_deg' AS curve, i, round(10 + t * {V_ESCAPE - 10}, 6) AS x, round(degrees({OMEGA!r} * 2 * {RADIUS_M!r} / ((10 + t * {V_ESCAPE - 10}) * 1e3)), 6) AS y FROM g UNION ALL SELECT 'ellipticity', i, round(30 + t * 150, 6), round(1 / sin(radians(30 + t * 150) / 2), 6) FROM g UNION ALL SELECT 'survival_myr', i, round(1 + t * 9, 6), round((1 + t * 9) * (1 + t * 9) / (4 * {KAPPA!r}), 6) FROM g", "craters")
def method_curves(spark, sf):
    return rounded(report.curves(spark))


@query("SELECT -180e0 + (range % 72) * 5e0 AS lon, -85e0 + (range // 72) * 5e0 AS lat FROM range(1000)")
def manifest_grid_first(spark, sf):
    return catalog.grid(spark, 5.0, most=1000)


@query("+ d AS (SELECT CAST(idx % 997 AS INT) AS chip_index FROM craters) SELECT count(*) AS n_craters, count(DISTINCT chip_index) AS n_chips FROM d", "craters")
def chips_with_craters(spark, sf):
    return catalog.chips_with_craters(view(spark, sf, "craters").withColumn("chip_index", (F.col("idx") % 997).cast("int")))


@query(f"""+ cc AS (SELECT count(*) AS craters, count(DISTINCT idx % 997) AS chips FROM craters), kk AS (SELECT sum(coalesce(nullif(chip_span_m, 0), 1200) * coalesce(nullif(chip_span_m, 0), 1200)) / 1e6 AS km2 FROM status), nn AS (SELECT count(*) AS n, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.95) AS p95, quantile_cont(score, 0.99) AS p99, max(score) AS best FROM null_scores),
    {BH}, t AS (SELECT score, p_value FROM a ORDER BY score DESC, idx_a, idx_b LIMIT 1), v AS (SELECT unnest([
      {{'section': 'catalogue', 'place': 0, 'label': 'chips with craters', 'value': CAST(cc.chips AS DOUBLE)}}, {{'section': 'catalogue', 'place': 1, 'label': 'craters', 'value': cc.craters}}, {{'section': 'catalogue', 'place': 2, 'label': 'coverage in km2', 'value': km2}}, {{'section': 'catalogue', 'place': 3, 'label': 'craters per chip', 'value': cc.craters / cc.chips}},
      {{'section': 'pairing', 'place': 0, 'label': 'raw pairs', 'value': (SELECT count(*) FROM graph)}}, {{'section': 'pairing', 'place': 1, 'label': 'pairs without common ends, at most', 'value': 200}},
      {{'section': 'null model', 'place': 0, 'label': 'trials', 'value': nn.n}}, {{'section': 'null model', 'place': 1, 'label': '50th percentile', 'value': p50}}, {{'section': 'null model', 'place': 2, 'label': '95th percentile', 'value': p95}}, {{'section': 'null model', 'place': 3, 'label': '99th percentile', 'value': p99}}, {{'section': 'null model', 'place': 4, 'label': 'largest', 'value': best}},
      {{'section': 'results', 'place': 0, 'label': 'best score', 'value': t.score}}, {{'section': 'results', 'place': 1, 'label': 'p value', 'value': t.p_value}}, {{'section': 'results', 'place': 2, 'label': 'significant pairs', 'value': (SELECT count(*) FILTER (sig) FROM a)}}]) AS l FROM cc, kk, nn, t)
    SELECT l.section AS section, CAST(l.place AS INTEGER) AS place, l.label AS label, round(l.value, 6) AS value FROM v""", "craters", "status", "null_scores", "graph")  # fmt: skip
def run_summary(spark, sf):
    """What a run says about catalogue, pairing, null model and results."""
    c = view(spark, sf, "craters").withColumn("chip_index", (F.col("idx") % 997).cast("int"))
    found = significance.with_discoveries(assessed(spark, sf), 0.9)
    return rounded(report.console(c, view(spark, sf, "status"), view(spark, sf, "graph"), view(spark, sf, "null_scores"), found))


@query("SELECT s.chip_index AS manifest_index, s.status, s.n_craters FROM status s JOIN (SELECT DISTINCT CAST(idx_b AS INT) AS i FROM graph) w ON w.i = s.chip_index", "status", "graph")
def manifest_lookup(spark, sf):
    """The rows of the chips that pairs name."""
    wanted = view(spark, sf, "graph").select(F.col("idx_b").cast("int").alias("manifest_index"))
    return chips_plan.lookup(view(spark, sf, "status").withColumnRenamed("chip_index", "manifest_index").drop("chip_span_m"), wanted)


@query("+ k AS (SELECT c, (SELECT max(trial) + 1001 FROM null_scores) // 8 AS each, (SELECT max(trial) + 1001 FROM null_scores) % 8 AS more FROM (SELECT range AS c FROM range(8))), b AS (SELECT c, c * each + least(c, more) AS lo, c * each + least(c, more) + each + CASE WHEN c < more THEN 1 ELSE 0 END AS hi FROM k), n AS (SELECT c, hi - lo - count(DISTINCT trial) AS lacking FROM b LEFT JOIN null_scores ON trial >= lo AND trial < hi GROUP BY c, lo, hi) SELECT c AS chunk, lacking FROM n WHERE lacking > 0", "null_scores")
def missing_chunks(spark, sf):
    """Of eight chunks over the trials up to 1000 beyond the last one done, those that lack some."""
    null = view(spark, sf, "null_scores")
    trials = null.agg(F.max("trial")).first()[0] + 1001
    return pipeline.missing_chunks(nullmodel.chunk_bounds(spark, trials, 8), null)


# Progress.
@query("SELECT round(sum(coalesce(nullif(chip_span_m, 0), 1200) * coalesce(nullif(chip_span_m, 0), 1200)) / 1e6, 6) AS coverage_km2, count(*) AS n_chips FROM status", "status")
def coverage_area(spark, sf):
    return rounded(catalog.coverage_km2(view(spark, sf, "status")))


@query("SELECT coalesce(status, 'missing_metadata') AS status, count(*) AS n, count(*) FILTER (n_craters > 0) AS n_with_craters, CAST(sum(n_craters) AS BIGINT) AS n_craters FROM status GROUP BY 1", "status")
def status_breakdown(spark, sf):
    return catalog.status_counts(view(spark, sf, "status"))


@query("+ m AS (SELECT unnest(range((SELECT max(chip_index) + 2001 FROM status))) AS i), j AS (SELECT s.status, s.n_craters FROM m LEFT JOIN status s ON s.chip_index = m.i) SELECT CASE WHEN status IS NULL THEN 'missing' WHEN status = 'error' THEN 'failed' WHEN status IN ('no_data', 'blank_chip', 'noise_floor') OR n_craters = 0 THEN 'empty' ELSE 'ok' END AS state, count(*) AS n FROM j GROUP BY 1", "status")
def chip_progress(spark, sf):
    """All chips up to 2000 beyond the last one with a status."""
    status = view(spark, sf, "status")
    return monitor.chip_progress(up_to(status, "chip_index", 2000, "manifest_index"), status)


@query("SELECT i AS manifest_index FROM (SELECT unnest(range((SELECT max(chip_index) + 2001 FROM status))) AS i) WHERE i NOT IN (SELECT chip_index FROM status)", "status")
def missing_chips(spark, sf):
    status = view(spark, sf, "status")
    return monitor.missing_chips(up_to(status, "chip_index", 2000, "manifest_index"), status)


from farpoint.plans import queries_detect, queries_files  # noqa: E402, F401  their queries join those above
