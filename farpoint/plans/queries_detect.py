"""Detection on the 8 x 8 chips of the vectors, with the whole method as SQL: scales, threshold, peaks, suppression, shapes, contrast."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from farpoint.config import DEFAULT
from farpoint.operators import detection
from farpoint.plans.queries import query, rounded

SMALL = replace(DEFAULT, radius_range_m=(1.2, 2.6), n_scales=4, peak_quantile=0.905, min_radius_px=1.5, min_circularity=0.4)
LEAST, MOST = (r / 2**0.5 for r in SMALL.radius_range_m)
FOLD = "CASE WHEN (({0}) % 16 + 16) % 16 < 8 THEN (({0}) % 16 + 16) % 16 ELSE 15 - (({0}) % 16 + 16) % 16 END"

SQL = f"""+ b AS (SELECT chip_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM cells GROUP BY chip_id HAVING stddev_pop(v) >= 1e-4),
    inv AS (SELECT chip_id, y, x, 1 - least(1, greatest(0, (v - lo) / (hi - lo + 1e-6))) AS v FROM cells JOIN b USING (chip_id)),
    sig AS (SELECT range AS k, {LEAST!r} * pow({MOST / LEAST!r}, range / {SMALL.n_scales - 1}e0) AS s FROM range({SMALL.n_scales})),
    tap AS (SELECT k, s, t, exp(-0.5 * (t / s) * (t / s)) AS g FROM (SELECT k, s, unnest(range(-CAST(floor(4 * s + 0.5) AS BIGINT), CAST(floor(4 * s + 0.5) AS BIGINT) + 1)) AS t FROM sig)),
    taps AS (SELECT k, s, t, g / sum(g) OVER (PARTITION BY k) AS g FROM tap), w AS (SELECT *, (t * t / pow(s, 4) - 1 / (s * s)) * g AS d FROM taps),
    spots AS (SELECT range AS p FROM range(8)),
    down AS (SELECT chip_id, k, s, p AS y, x, sum(g * v) AS g, sum(d * v) AS d FROM spots, w JOIN inv ON inv.y = {FOLD.format('p + t')} GROUP BY ALL),
    cube AS (SELECT chip_id, q.k, q.s, y, p AS x, -q.s * q.s * sum(w.g * q.d + w.d * q.g) AS v FROM spots, w JOIN down q ON q.k = w.k AND q.x = {FOLD.format('p + t')} GROUP BY chip_id, q.k, q.s, y, p),
    thr AS (SELECT chip_id, quantile_cont(v, {SMALL.peak_quantile!r}) AS t FROM cube GROUP BY chip_id),
    high AS (SELECT cube.*, t FROM cube JOIN thr USING (chip_id) WHERE t >= 0.01 AND v >= t),
    peak AS (SELECT h.*, sqrt(2) * h.s AS r FROM high h WHERE NOT EXISTS (SELECT 1 FROM high o WHERE o.chip_id = h.chip_id AND o.v > h.v AND abs(o.y - h.y) <= 2 AND abs(o.x - h.x) <= 2 AND abs(o.k - h.k) <= 1)),
    nth AS (SELECT *, row_number() OVER (PARTITION BY chip_id ORDER BY v DESC, y, x, k) AS n FROM peak),
    walk AS (SELECT chip_id, n, [{{'y': y, 'x': x}}] AS kept, true AS stays FROM nth WHERE n = 1
      UNION ALL SELECT chip_id, n, CASE WHEN free THEN list_append(kept, {{'y': y, 'x': x}}) ELSE kept END, free
      FROM (SELECT p.chip_id, p.n, p.y, p.x, kept, len(list_filter(kept, lambda o: (o.y - p.y) * (o.y - p.y) + (o.x - p.x) * (o.x - p.x) <= greatest(3, 0.75 * p.r) * greatest(3, 0.75 * p.r))) = 0 AS free FROM walk JOIN nth p ON p.chip_id = walk.chip_id AND p.n = walk.n + 1)),
    alone AS (SELECT nth.*, (v - min(v) OVER c) / (max(v) OVER c - min(v) OVER c + 1e-12) AS depth FROM nth JOIN walk USING (chip_id, n) WHERE stays AND r >= {SMALL.min_radius_px!r} WINDOW c AS (PARTITION BY nth.chip_id)),
    part AS (SELECT a.chip_id, a.n, c.y, c.x, 1 - c.v AS v FROM alone a JOIN cells c ON c.chip_id = a.chip_id AND abs(c.y - a.y) <= greatest(3, ceil(2.5 * r)) AND abs(c.x - a.x) <= greatest(3, ceil(2.5 * r))),
    dark AS (SELECT *, greatest(v - median(v) OVER (PARTITION BY chip_id, n), 0) AS m, count(*) OVER (PARTITION BY chip_id, n) AS many FROM part),
    mid AS (SELECT chip_id, n, sum(m) AS total, sum(m * m) AS squares, sum(m * x) / sum(m) AS mx, sum(m * y) / sum(m) AS my FROM dark WHERE many >= 25 GROUP BY ALL HAVING sum(m) > 1e-8),
    second AS (SELECT chip_id, n, total, squares, sum(m * (x - mx) * (x - mx)) / total AS a, sum(m * (y - my) * (y - my)) / total AS b, sum(m * (x - mx) * (y - my)) / total AS c FROM dark JOIN mid USING (chip_id, n) GROUP BY chip_id, n, total, squares),
    axes AS (SELECT *, sqrt(greatest((a + b) / 2 + sqrt((a - b) / 2 * (a - b) / 2 + c * c), 0)) AS major, sqrt(greatest((a + b) / 2 - sqrt((a - b) / 2 * (a - b) / 2 + c * c), 0)) AS minor, 2 * greatest(total * total / squares, 1) AS free FROM second),
    shape AS (SELECT chip_id, n, minor / major AS circularity, major / minor AS ellipticity, degrees(0.5 * atan2(2 * c, a - b)) AS orientation_deg, least(greatest(degrees((major + minor) / greatest(major - minor, 1e-6) / sqrt(free)), 0.1), 180) AS orientation_unc_deg, least(greatest(major / minor / sqrt(free), 0.001), 100) AS ellipticity_unc FROM axes),
    away AS (SELECT a.chip_id, a.n, a.r, c.v, sqrt((c.y - a.y) * (c.y - a.y) + (c.x - a.x) * (c.x - a.x)) AS d FROM alone a JOIN cells c ON c.chip_id = a.chip_id),
    zone AS (SELECT chip_id, n, avg(v) FILTER (d <= 0.5 * r) AS f, avg(v) FILTER (d >= 0.8 * r AND d <= 1.3 * r) AS m, stddev_pop(v) FILTER (d >= 2 * r AND d <= 3 * r) AS s, count(*) FILTER (d <= 0.5 * r) AS nf, count(*) FILTER (d >= 0.8 * r AND d <= 1.3 * r) AS nm, count(*) FILTER (d >= 2 * r AND d <= 3 * r) AS ns FROM away GROUP BY chip_id, n),
    told AS (SELECT a.*, h.* EXCLUDE (chip_id, n), CASE WHEN nf < 3 OR nm < 3 OR ns < 5 OR z.s < 1e-8 THEN 0 ELSE (m - f) / z.s END AS rcr, v / t AS nls FROM alone a JOIN shape h USING (chip_id, n) JOIN zone z USING (chip_id, n) WHERE circularity >= {SMALL.min_circularity!r})
    SELECT chip_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(r, 6) AS radius_px, round(v, 6) AS strength, round(depth, 6) AS depth_proxy, round(circularity, 6) AS circularity, round(ellipticity, 6) AS ellipticity, round(orientation_deg, 6) + 0 AS orientation_deg, round(orientation_unc_deg, 6) AS orientation_unc_deg,
      round(ellipticity_unc, 6) AS ellipticity_unc, round(nls, 6) AS nls, round(rcr, 6) + 0 AS rcr, round({SMALL.weight_strength!r} * least(1, greatest(0, (nls - 1) / {SMALL.nls_scale - 1!r})) + {SMALL.weight_contrast!r} * least(1, greatest(0, rcr / {SMALL.rcr_scale!r})), 6) AS freshness_index, round(t, 6) AS threshold, CAST(row_number() OVER (PARTITION BY chip_id ORDER BY v DESC, y, x) - 1 AS INTEGER) AS row_in_chip FROM told"""


@query(SQL, "cells")
def chip_features(spark, sf):
    """Features of the 8 x 8 chips, in tiles of 4 x 4."""
    chips = spark.read.parquet(f"{sf}/embeddings.parquet").where("size(embedding) >= 64").select(F.col("vec_id").alias("chip_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.slice("embedding", 1, 64).alias("pixels"), F.lit(1.0).alias("mpp"))
    got = detection.detections(chips, SMALL, size=4)
    return rounded(got.select("chip_id", "x", "y", "radius_px", "strength", "depth_proxy", "circularity", "ellipticity", "orientation_deg", "orientation_unc_deg", "ellipticity_unc", "nls", "rcr", "freshness_index", "threshold", "row_in_chip"))
