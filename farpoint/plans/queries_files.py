"""Queries through files, requests, streams and reports: tables are written as a run writes them, read back and compared with the tables they came from."""

from __future__ import annotations

import math
import struct
import uuid
import zlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from farpoint.config import FLUX_G_S, KAPPA, OMEGA, RADIUS_M
from farpoint.functions import geo, score, stats, velocity
from farpoint.operators import catalog, nullmodel, significance
from farpoint.operators.tables import shared_dir
from farpoint.plans import pipeline, report
from farpoint.plans.queries import ARC, BEAR, BH, assessed, dest, query, rounded, view
from farpoint.sources import files, imagery, service, survey
from farpoint.streaming import monitor


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query("SELECT idx, CASE WHEN idx % 9 = 0 THEN NULL ELSE lon_deg END AS lon_deg, lat_deg, radius_m, nls, rcr, ellipticity, shape_reliable, CAST(NULL AS DOUBLE) AS strength FROM craters", "craters")
def csv_roundtrip(spark, sf):
    """A catalogue as CSV, where every ninth longitude is no number, one column is unknown and others lack."""
    path, c = scratch(spark), view(spark, sf, "craters")
    text = F.when(F.col("idx") % 9 == 0, F.lit("n/a")).otherwise(F.col("lon_deg").cast("string"))
    files.write_csv(c.select("lat_deg", text.alias("lon_deg"), F.lit("x").alias("unknown"), "radius_m", "nls", "rcr", "ellipticity", "shape_reliable", F.col("idx").alias("chip_index")), path)
    got = files.read_csv(spark, path, files.CRATERS)
    return got.select(F.col("chip_index").cast("long").alias("idx"), "lon_deg", "lat_deg", "radius_m", "nls", "rcr", "ellipticity", "shape_reliable", "strength")


@query("+ m AS (SELECT *, row_number() OVER (ORDER BY resolution_mpp, product_id) - 1 AS k FROM (SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY resolution_mpp, center_lat, center_lon) = 1)) SELECT CAST(k AS INTEGER) AS manifest_index, product_id, resolution_mpp, center_lon, center_lat, CAST(NULL AS DOUBLE) AS phase_angle_deg FROM m WHERE k >= 100 AND k < 200", "products")
def manifest_task(spark, sf):
    """The chips of the second task of a hundred, from a manifest in a file."""
    path = scratch(spark)
    files.write_csv(catalog.numbered(catalog.best_products(view(spark, sf, "products"))), path)
    manifest = files.read_manifest(spark, path)
    return survey.task_range(manifest, 1, 100, 1 << 30).select("manifest_index", "product_id", "resolution_mpp", "center_lon", "center_lat", "phase_angle_deg")


def folders(spark, sf) -> str:
    """Chip folders: the catalogue dealt over 60 chips; every seventh chip's metadata is broken, every eleventh's missing."""
    root, c = scratch(spark), view(spark, sf, "craters")
    chip = F.concat(F.lit("chip_"), F.lpad((F.col("idx") % 60).cast("string"), 6, "0"))
    rows = c.select(chip.alias("chip_dir"), F.col("idx").cast("double").alias("x"), F.lit(0.0).alias("y"), "radius_m", F.col("nls").alias("strength"), "lon_deg", "lat_deg")
    k = F.col("idx") % 60
    status = F.when(k % 5 == 0, "blank_chip").when(k % 5 == 1, "error").otherwise("ok")
    per = c.groupBy(chip.alias("chip_dir"), k.alias("k"), status.alias("status")).agg(F.count("*").alias("n"))
    text = F.when(F.col("k") % 7 == 0, "{").otherwise(F.to_json(F.struct(F.col("k").alias("chip_index"), "status", F.col("n").alias("n_craters"))))
    files.write_chips(rows, per.where("k % 11 <> 0").select("chip_dir", text.alias("value")), root)
    return root


CHIP = "concat('chip_', lpad(CAST(idx % 60 AS VARCHAR), 6, '0'))"


@query(f"+ r AS (SELECT *, {CHIP} AS chip_dir FROM craters) SELECT chip_dir, CAST(dense_rank() OVER (ORDER BY chip_dir) - 1 AS INTEGER) AS chip_index, row_number() OVER (ORDER BY chip_dir, nls DESC, idx) - 1 AS idx, CAST(idx AS DOUBLE) AS x, radius_m, lon_deg FROM r", "craters")
def chip_folder_rows(spark, sf):
    """All rows of all chip folders, numbered chip after chip; y is the same for all, so that x breaks ties."""
    return files.scan_chips(spark, folders(spark, sf)).select("chip_dir", "chip_index", "idx", "x", "radius_m", "lon_deg")


@query(f"+ r AS (SELECT idx % 60 AS k, {CHIP} AS chip_dir, count(*) AS n FROM craters GROUP BY ALL) SELECT chip_dir, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 THEN CAST(k AS INTEGER) END AS chip_index, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 THEN CASE k % 5 WHEN 0 THEN 'blank_chip' WHEN 1 THEN 'error' ELSE 'ok' END END AS status, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 THEN CAST(n AS INTEGER) END AS n_craters FROM r", "craters")
def chip_folder_metadata(spark, sf):
    """A row for each chip folder with results; broken or missing metadata are null."""
    return files.scan_metadata(spark, folders(spark, sf)).select("chip_dir", "chip_index", "status", "n_craters")


@query("+ r AS (SELECT idx % 60 AS k, count(*) AS n FROM craters GROUP BY ALL), s AS (SELECT CASE WHEN k % 7 = 0 THEN 'missing' WHEN k % 5 = 1 THEN 'failed' WHEN k % 5 = 0 THEN 'empty' ELSE 'ok' END AS state, CASE WHEN k % 7 <> 0 THEN n END AS n FROM r WHERE k % 11 <> 0) SELECT state, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_craters FROM s GROUP BY state", "craters")
def chip_stream(spark, sf):
    """The states of all chips from a stream over their metadata files, which ends with the files that are there."""
    root, out, name = folders(spark, sf), scratch(spark), f"chips_{uuid.uuid4().hex}"
    stream = monitor.watch_chips(spark, root, 20).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{out}/stream").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.table(name)


@query("SELECT trial, score, CAST(trial % 8 AS INTEGER) AS chunk FROM null_scores", "null_scores")
def null_parts(spark, sf):
    """Null scores as chunks leave them, one after the other, read as one table."""
    out, null = scratch(spark), view(spark, sf, "null_scores").withColumn("chunk", (F.col("trial") % 8).cast("int"))
    rows = null.select("trial", "score", "chunk", F.lit(None).cast("double").alias("runtime_s"), F.lit(None).cast("string").alias("pair"))
    for half in (rows.where("chunk < 3"), rows.where("chunk >= 3")):
        half.write.mode("append").parquet(f"{out}/null")
    return pipeline.done_trials(spark, out).select("trial", "score", "chunk")


@query(f"+ {BH} SELECT pair_id, idx_a, idx_b, round(score, 6) AS score, round(p_value, 9) AS p_value FROM a WHERE sig", "null_scores", "graph")
def significant_pairs(spark, sf):
    """The discoveries as a run writes them, read back."""
    out = scratch(spark)
    files.write_csv(significance.significant(significance.with_discoveries(assessed(spark, sf), 0.9)), out)
    got = spark.read.csv(out, header=True, schema="pair_id long, idx_a long, idx_b long, score double, p_value double, percentile_score double, bh_significant boolean", enforceSchema=False)
    return got.select("pair_id", "idx_a", "idx_b", F.round("score", 6).alias("score"), F.round("p_value", 9).alias("p_value"))


@query("+ p AS (SELECT trial % 10 AS chunk, count(*) AS trials, max(score) AS s FROM null_scores WHERE trial % 10 < 7 GROUP BY 1) SELECT (SELECT count(*) FROM p) AS done, 10 - (SELECT count(*) FROM p) AS missing, CAST((SELECT sum(trials) FROM p) AS BIGINT) AS n_trials, round((SELECT sum(s) FROM p), 6) AS runtime_s", "null_scores")
def chunk_progress(spark, sf):
    """Ten chunks, of which seven have trials; the score stands in for the seconds."""
    parts = view(spark, sf, "null_scores").select((F.col("trial") % 10).alias("chunk"), F.col("score").alias("runtime_s")).where("chunk < 7")
    return rounded(monitor.chunk_progress(spark.range(10).withColumnRenamed("id", "chunk"), parts))


@query("SELECT chip_index, concat('[', repeat('#', CAST(least((chip_index % 50) * 20 // 40, 20) AS INTEGER)), repeat('.', CAST(20 - least((chip_index % 50) * 20 // 40, 20) AS INTEGER)), ']') AS bar, CAST((chip_index + 6) // 7 AS BIGINT) AS tasks FROM status", "status")
def progress_bars(spark, sf):
    """Bars of 20, and how many tasks of seven chips each a number of chips takes."""
    return view(spark, sf, "status").select("chip_index", monitor.bar(F.col("chip_index") % 50, F.lit(40), 20).alias("bar"), F.ceil(F.col("chip_index") / 7).alias("tasks"))


@query("""+ b AS (SELECT product_id, resolution_mpp, center_lon, center_lat, CASE WHEN center_lon - 0.15e0 < -180 THEN NULL WHEN center_lon + 0.15e0 >= 180 THEN NULL ELSE 1 END AS ok FROM products)
    SELECT product_id, resolution_mpp, CASE WHEN ok = 1 THEN sha1('FORMAT=' || 'image%2Fpng' || '&LAYERS=nac%2Ca%2A~&X=' || replace(replace(product_id, ' ', '+'), '/', '%2F')) END AS key FROM b""", "products")
def request_keys(spark, sf):
    """Keys under which answers are kept: sorted and encoded parameters."""
    p = view(spark, sf, "products")
    params = F.to_json(F.struct(F.col("product_id").alias("X"), F.lit("image/png").alias("FORMAT"), F.lit("nac,a*~").alias("LAYERS")))
    asked = survey.info_request("nac", F.col("center_lon"), F.col("center_lat"), 0.15)
    return p.select("product_id", "resolution_mpp", F.when(asked.isNotNull(), service.key_of(params)).alias("key"))


@query("""+ g AS (SELECT CAST(floor((center_lon + 180) / 5) AS INTEGER) AS i, CAST(floor((center_lat + 85) / 5) AS INTEGER) AS j, product_id, resolution_mpp FROM products),
    n AS (SELECT i, j, count(*) AS n, min(resolution_mpp) AS finest FROM g GROUP BY ALL)
    SELECT -180e0 + lo * 5e0 AS lon, -85e0 + la * 5e0 AS lat, coalesce(n, 0) AS n, finest FROM (SELECT range AS lo FROM range(72)), (SELECT range AS la FROM range(35)) LEFT JOIN n ON i = lo AND j = la""", "products")
def grid_products(spark, sf):
    """What lies north-east of each grid point: products and their finest resolution."""
    seen = view(spark, sf, "products").groupBy((F.floor((F.col("center_lon") + 180) / 5) * 5.0 - 180.0).alias("lon"), (F.floor((F.col("center_lat") + 85) / 5) * 5.0 - 85.0).alias("lat")).agg(F.count("*").alias("n"), F.min("resolution_mpp").alias("finest"))
    return catalog.grid(spark, 5.0).join(seen, ["lon", "lat"], "left").select("lon", "lat", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "finest")


@query("""+ n AS (SELECT CAST(floor((center_lon + 180) / 5) AS INTEGER) AS i, CAST(floor((center_lat + 85) / 5) AS INTEGER) AS j, count(*) AS n FROM products GROUP BY ALL)
    SELECT -180e0 + (range % 72) * 5e0 AS lon, -85e0 + (range // 72) * 5e0 AS lat, n FROM range(1000) JOIN n ON i = range % 72 AND j = range // 72""", "products")
def grid_products_first(spark, sf):
    """Of the first thousand grid points those that have products."""
    seen = view(spark, sf, "products").groupBy((F.floor((F.col("center_lon") + 180) / 5) * 5.0 - 180.0).alias("lon"), (F.floor((F.col("center_lat") + 85) / 5) * 5.0 - 85.0).alias("lat")).agg(F.count("*").alias("n"))
    return catalog.grid(spark, 5.0, most=1000).join(seen, ["lon", "lat"]).select("lon", "lat", "n")


LIMIT = f"3 * pow(10, 14 + radius_m) / ({FLUX_G_S!r} * 1e10 * 3e13 * 5e-4)"


@query(f"SELECT idx, round(log10({LIMIT}), 6) AS log_limit, round(degrees({OMEGA!r} * 2 * {RADIUS_M!r} / ((10 + radius_m * 50) * 1e3)), 6) AS offset_deg, round(1 / sin(radians(30 + radius_m * 14) / 2), 6) AS ellipticity, round(radius_m * radius_m / (4 * {KAPPA!r}) + 1e-8, 6) AS survival_myr FROM craters", "craters")
def crater_curves(spark, sf):
    """The curves of the method and the limit on the flux, at each crater's own place on them."""
    r = F.col("radius_m")
    limit = stats.flux_limit(F.pow(F.lit(10.0), 14.0 + r), 1e10, 3e13, 5e-4)
    return rounded(view(spark, sf, "craters").select("idx", F.log10(limit).alias("log_limit"), velocity.rotation_offset(F.lit(2.0 * RADIUS_M), 10.0 + r * 50.0).alias("offset_deg"), geo.expected_ellipticity(30.0 + r * 14.0).alias("ellipticity"), (stats.survival_myr(r) + 1e-8).alias("survival_myr")))


@query("+ m AS (SELECT max(trial) + 1 AS n FROM null_scores) SELECT trial, CASE WHEN trial < (n % 7) * (n // 7 + 1) THEN trial // (n // 7 + 1) ELSE (n % 7) + (trial - (n % 7) * (n // 7 + 1)) // (n // 7) END AS chunk FROM null_scores, m", "null_scores")
def trial_chunks(spark, sf):
    """The chunk of each trial, of seven over all trials."""
    null = view(spark, sf, "null_scores").select("trial")
    n = null.agg(F.max("trial")).first()[0] + 1
    bounds = F.broadcast(nullmodel.chunk_bounds(spark, n, 7))
    return null.join(bounds, (F.col("trial") >= F.col("first")) & (F.col("trial") < F.col("last"))).select("trial", "chunk")


RIM = dest("asin(z)", "atan2(y, x)", "radians(b)", f"{math.radians(6.0)!r}")
ENDS = [dest("radians(lat_deg)", "radians(lon_deg)", b, ARC) for b in (BEAR, f"({BEAR} + pi())")]


@query(f"""+ e AS (SELECT idx, 0 AS bearing, {', '.join(f'{v} AS {n}' for n, v in zip('xyz', ENDS[0], strict=True))} FROM craters WHERE shape_reliable AND ellipticity >= 1 UNION ALL SELECT idx, 1, {', '.join(ENDS[1])} FROM craters WHERE shape_reliable AND ellipticity >= 1),
    p AS (SELECT idx, bearing, x, y, greatest(-1, least(1, z)) AS z, range AS i, range * 360e0 / 8 AS b FROM e, range(9)), r AS (SELECT idx, bearing, i, {', '.join(f'{v} AS {n}' for n, v in zip(('rx', 'ry', 'rz'), RIM, strict=True))} FROM p)
    SELECT idx, CAST(bearing AS INTEGER) AS bearing, CAST(i AS INTEGER) AS i, round(rx, 6) + 0 AS rx, round(ry, 6) + 0 AS ry, round(rz, 6) + 0 AS rz FROM r""", "craters")  # fmt: skip
def cone_panels(spark, sf):
    """Rims of the caps that shapes point to, as unit vectors."""
    got = report.cone_panels(view(spark, sf, "craters"), 6.0, 9)
    v = geo.unit(F.col("lon"), F.col("lat"))
    return rounded(got.select("idx", "bearing", "i", *[c.alias(f"r{a}") for a, c in zip("xyz", v, strict=True)]))


@query("SELECT idx, round(radius_px * sqrt(coalesce(ellipticity, 1)), 6) AS half_major, round(radius_px / sqrt(coalesce(ellipticity, 1)), 6) AS half_minor, round(nls / greatest(rcr, 1e-30), 6) AS relative FROM craters WHERE rcr > 0", "craters")
def crater_outlines(spark, sf):
    """Ellipses of features, and their strength relative to a threshold."""
    got = report.outlines(view(spark, sf, "craters").where("rcr > 0")).withColumn("relative", score.relative_strength(F.col("nls"), F.col("rcr")))
    return rounded(got.select("idx", "half_major", "half_minor", "relative"))


SEEN = {"right": "cos(radians(lat_deg)) * sin(radians(lon_deg - 40))", "up": "cos(radians(25)) * sin(radians(lat_deg)) - sin(radians(25)) * cos(radians(lat_deg)) * cos(radians(lon_deg - 40))", "depth": "sin(radians(25)) * sin(radians(lat_deg)) + cos(radians(25)) * cos(radians(lat_deg)) * cos(radians(lon_deg - 40))"}


@query(f"SELECT idx, round({SEEN['right']}, 6) + 0 AS \"right\", round({SEEN['up']}, 6) + 0 AS up, {SEEN['depth']} >= 0 AS visible FROM craters", "craters")
def projected_craters(spark, sf):
    """The side of the sphere that is seen from above 40 degrees east, 25 north."""
    return rounded(report.projected(view(spark, sf, "craters"), F.lit(40.0), F.lit(25.0)))


def drawn(params: dict) -> bytes:
    """What a service would answer: an image of one grey by its box's western bound, heights of the southern one, an exception for boxes south of -80."""
    west, south = map(float, params["BBOX"].split(",")[:2])
    n = int(params["WIDTH"])
    if south < -80:
        return b"<ServiceExceptionReport/>"
    if params["FORMAT"] == imagery.IMAGE:
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        head, rows = struct.pack(">IIBBBBB", n, n, 8, 0, 0, 0, 0), (b"\0" + bytes([int(west + 180) % 256]) * n) * n
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    body = struct.pack(f"<{n * n}f", *[south] * (n * n))
    tags = [(256, n), (257, n), (258, 32), (259, 1), (273, 8), (279, len(body)), (339, 3)]
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)


SPAN = 12_000.0
WEST, SOUTH = f"(center_lon - degrees({SPAN!r} / ({RADIUS_M!r} * cos(radians(center_lat)))) / 2)", f"(center_lat - degrees({SPAN!r} / {RADIUS_M!r}) / 2)"
BOXED = f"{WEST} >= -180 AND center_lon + degrees({SPAN!r} / ({RADIUS_M!r} * cos(radians(center_lat)))) / 2 <= 180 AND {SOUTH} >= -80"


@query(f"+ p AS (SELECT product_id, center_lon, center_lat, {BOXED} AS ok FROM products QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY resolution_mpp, center_lat, center_lon) = 1) SELECT product_id, CASE WHEN ok THEN 4 END AS h, round(CASE WHEN ok THEN floor({WEST} + 180) % 256 / 255 END, 5) AS grey, round(CASE WHEN ok THEN {SOUTH} END, 3) + 0 AS height FROM p", "products")
def service_chips(spark, sf):
    """Images and heights of each product's box, asked of a service whose answers are kept, and asked again: what is kept is the answer."""
    store, p = scratch(spark), catalog.best_products(view(spark, sf, "products")).select("product_id", "center_lon", "center_lat")
    boxes = survey.chip_boxes(p, SPAN)
    ask = lambda layer, kind: F.struct(F.lit(kind).alias("kind"), imagery.map_request(layer, F.col("bbox"), 4, 4, kind).alias("params"))
    asked = boxes.select("product_id", F.explode(F.array(ask("images", imagery.IMAGE), ask("heights", imagery.TERRAIN))).alias("a")).select("product_id", "a.*")
    service.fetched(asked, drawn, store, per_second=0, each=1 << 20)
    got = service.fetched(asked, drawn, store, per_second=0, each=1 << 20).drop("params")
    of = lambda kind, name: imagery.decoded(got.where(F.col("kind") == kind), kind).select("product_id", F.col("h").alias(f"h_{name}"), (F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x) / F.size("pixels")).alias(name))
    both = of(imagery.IMAGE, "grey").join(of(imagery.TERRAIN, "height"), "product_id")
    return both.select("product_id", F.col("h_grey").alias("h"), (F.round("grey", 5) + 0.0).alias("grey"), (F.round("height", 3) + 0.0).alias("height"))
