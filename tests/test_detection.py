"""Detection in tiles against the kernel over the whole chip."""

import math
from dataclasses import replace

import numpy as np
import pytest

from farpoint.config import DEFAULT
from farpoint.functions import raster
from farpoint.operators import detection
from farpoint.plans.queries import QUERIES
from tests.test_operators import bowl

CHIP = "chip_id long, h int, w int, pixels array<float>, mpp double"


def same(got, want, images):
    for r in got:
        status, threshold, rows = want(images[r["chip_id"]])
        assert r["status"] == status and len(r["rows"]) == len(rows), (r["chip_id"], len(r["rows"]), len(rows))
        assert (threshold is None and r["threshold"] is None) or r["threshold"] == pytest.approx(threshold, rel=1e-12)
        for a, b in zip(r["rows"], rows, strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == y or x == pytest.approx(y, rel=1e-9, nan_ok=True), (a, b)


def test_tiles_of_two_hundred_chips(spark):
    """Spots anywhere, many on the seams of tiles; blank and noisy chips; pixels of several widths."""
    rng = np.random.default_rng(30)
    images = {}
    for i in range(200):
        n = int(rng.integers(40, 75))
        spots = [(*rng.uniform(0, n, 2), rng.uniform(2, 7), rng.uniform(0.05, 0.4)) for _ in range(rng.integers(1, 7))]
        images[i] = np.full((n, n), 0.4) if i % 40 == 7 else bowl(n, spots, 0.02 if i % 3 else 0.002, i).astype(np.float32).astype(float)[:, : n - i % 5]
    s = replace(DEFAULT, radius_range_m=(2.0, 7.0), peak_quantile=0.99, min_circularity=0.3, min_radius_px=2.0, n_scales=6)
    rows = [(i, *x.shape, x.ravel().tolist(), 1.0 + i % 2 / 4) for i, x in images.items()] + [(999, 10, 10, None, 1.0)]
    got = detection.found(spark.createDataFrame(rows, CHIP).repartition(8), s, size=24).collect()
    assert {r["chip_id"] for r in got} == images.keys() and sum(len(r["rows"]) for r in got) > 400
    mpp = {id(x): 1.0 + i % 2 / 4 for i, x in images.items()}
    same(got, lambda x: raster.inspect(x, mpp[id(x)], s), images)


def test_suppression_in_rounds(spark):
    rng = np.random.default_rng(31)
    xy, r, strength = rng.uniform(0, 80, (400, 2)), rng.uniform(2, 12, 400), rng.integers(0, 60, 400) / 60
    chip = [(0, i, float(y), float(x), max(3.0, 0.75 * float(a)), float(s)) for i, ((x, y), a, s) in enumerate(zip(xy, r, strength, strict=True))]
    path = [(1, i, 0.0, 2.0 * i, 3.0, float(i)) for i in range(12)]  # each is in reach of the next, which is stronger
    df = spark.createDataFrame(chip + path, "chip_id long, id long, y double, x double, apart double, strength double")
    got = {(r_["chip_id"], r_["id"]) for r_ in detection.suppressed(df, 9.0).collect()}
    assert got == {(0, int(i)) for i in raster.suppressed(xy, r, strength)} | {(1, i) for i in range(1, 12, 2)}
    assert detection.suppressed(df.limit(0), 9.0).count() == 0


def test_detections_of_the_query(spark):
    """Of the given table, against the whole-chip kernel on what each vector is blown up to."""
    got = sorted(map(tuple, QUERIES["chip_detect"](spark, "/root/testdata/sf0.001").collect()), key=repr)
    want = []
    for v in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect():
        image = np.kron(np.asarray(v["embedding"], np.float32)[:64].reshape(8, 8), np.ones((4, 4))).astype(float)
        want += [(v["vec_id"], *(None if isinstance(x, float) and math.isnan(x) else round(x, 6) + 0.0 if isinstance(x, float) else x for x in row)) for row in raster.detect(image, 1.0)]
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[0] == b[0] and all((x is None and y is None) or x == y or x == pytest.approx(y, abs=2e-6, nan_ok=True) for x, y in zip(a, b, strict=True))
