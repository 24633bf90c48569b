"""From a manifest over a service without network to placed detections."""

import json
import os
import struct
import zlib
from dataclasses import replace

import numpy as np
import pytest

from farpoint.plans import chips
from farpoint.sources import imagery
from tests.test_operators import FEW, SPOTS, bowl

PX = 96


def png(px, color, filters=(0,)):
    """A PNG of 8 bits (h x w x channels), each line with the next of ``filters``."""
    h, w, c = px.shape
    raw, before = b"", np.zeros((w, c), np.uint8)
    for y in range(h):
        line, kind = px[y], filters[y % len(filters)]
        left = np.vstack([np.zeros((1, c), np.uint8), line[:-1]])
        corner = np.vstack([np.zeros((1, c), np.uint8), before[:-1]])
        a, b, d = (v.astype(int) for v in (left, before, corner))
        p = a + b - d
        paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - d)), a, np.where(abs(p - b) <= abs(p - d), b, d))
        guess = {0: 0 * a, 1: a, 2: b, 3: (a + b) // 2, 4: paeth}[kind]
        raw += bytes([kind]) + ((line.astype(int) - guess) & 255).astype(np.uint8).tobytes()
        before = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff(z, packed=1):
    body = z.astype("<f4").tobytes()
    body = body if packed == 1 else zlib.compress(body)
    tags = [(256, z.shape[1]), (257, z.shape[0]), (258, 32), (259, packed), (273, 8), (279, len(body)), (339, 3)]
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)


def test_images():
    rng = np.random.default_rng(1)
    for color, c in ((0, 1), (4, 2), (2, 3), (6, 4)):
        px = rng.integers(0, 256, (9, 7, c)).astype(np.uint8)
        got = imagery.png_pixels(png(px, color, (0, 1, 2, 3, 4)))
        grey = px[..., 0] if c < 3 else px[..., :3] @ [0.299, 0.587, 0.114]
        assert np.abs(got * 255 - grey).max() < 0.6
    z = rng.normal(0, 1000, (5, 8)).astype(np.float32)
    assert (imagery.tiff_pixels(tiff(z)) == z).all() and (imagery.tiff_pixels(tiff(z, 8)) == z).all()
    for broken in (b"", b"no image", png(px, 6)[:40]):
        with pytest.raises((ValueError, struct.error, zlib.error)):
            imagery.png_pixels(broken)


def test_chain(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()
    down = tmp_path / "down"
    down.touch()
    image = np.round(bowl(PX, SPOTS) * 255).astype(np.uint8)[..., None]
    heights = np.add.outer(2.0 * np.arange(8), 3.0 * np.arange(8))

    def transport(params):
        (log / f"{os.getpid()}-{len(os.listdir(log))}-{hash(json.dumps(params)) % 10**9}").touch()
        lon = float(params["BBOX"].split(",")[0])
        if lon > 70 and down.exists():
            raise OSError("down")
        if params["FORMAT"] == imagery.TERRAIN:
            return tiff(heights) if lon < 30 else b"<ServiceExceptionReport/>"
        return png(image if lon < 30 or lon > 70 else np.full_like(image, 90), 0, (4,))

    s = replace(FEW, chip_size_px=PX, chip_span_m=float(PX))
    rows = [(0, "M0", 10.0, 5.0), (1, "M1", 50.0, 5.0), (2, "M2", 80.0, 5.0), (3, "M3", 10.0, 90.0), (4, "M4", None, None)]
    manifest = spark.createDataFrame(rows, "manifest_index int, product_id string, center_lon double, center_lat double")
    out = str(tmp_path / "out")
    from farpoint.sources import service

    wait, service.TRIES = service.TRIES, 1
    try:
        craters, seen = chips.process(manifest, transport, out, s, per_second=0)
        states = {r["chip_index"]: r for r in seen.collect()}
        assert {i: r["status"] for i, r in states.items()} == {0: "ok", 1: "blank_chip", 2: "chip_download_failed", 3: "invalid_bbox", 4: "invalid_bbox"}
        assert states[0]["terrain_slope_proxy"] == pytest.approx(13**0.5) and states[0]["terrain_mean_m"] == pytest.approx(heights.mean()) and states[1]["terrain_mean_m"] is None
        placed = craters.collect()
        assert placed and {r["chip_index"] for r in placed} == {0} and states[0]["n_craters"] == len(placed)
        box = states[0]["bbox"]
        for r in placed:
            assert r["lon_deg"] == pytest.approx(box["lon_min"] + r["x"] / (PX - 1) * (box["lon_max"] - box["lon_min"]))
            assert r["lat_deg"] == pytest.approx(box["lat_max"] - r["y"] / (PX - 1) * (box["lat_max"] - box["lat_min"]))
        asked = len(os.listdir(log))
        down.unlink()
        craters, seen = chips.process(manifest, transport, out, s, per_second=0)
        assert {r["chip_index"]: r["status"] for r in seen.collect()}[2] == "ok" and {r["chip_index"] for r in craters.collect()} == {0, 2}
        assert len(os.listdir(log)) == asked + 2  # the image and the heights of the chip that failed
        assert chips.remaining(manifest, out).count() == 0
    finally:
        service.TRIES = wait


def test_lookup(spark):
    manifest = spark.range(5).withColumnRenamed("id", "manifest_index")
    wanted = spark.createDataFrame([(3,), (3,), (9,), (None,)], "manifest_index long")
    assert [r[0] for r in chips.lookup(manifest, wanted).collect()] == [3]

