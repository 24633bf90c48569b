"""Images and terrain of a map service: requests and pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.sources.survey import is_exception

#: Fixed values of the service's protocol.
MAP = {"SERVICE": "WMS", "VERSION": "1.1.1", "REQUEST": "GetMap", "SRS": "EPSG:4326", "STYLES": "", "TRANSPARENT": "TRUE"}
IMAGE, TERRAIN = "image/png", "image/tiff; mode=32bit"


def map_request(layer: str, box: Column, width: int, height: int, kind: str) -> Column:
    """The parameters of a map of ``box``, as JSON with sorted names; null without a box."""
    bounds = F.concat_ws(",", *[box[n].cast("string") for n in ("lon_min", "lat_min", "lon_max", "lat_max")])
    own = {k: F.lit(v) for k, v in MAP.items()} | {"BBOX": bounds, "WIDTH": F.lit(str(width)), "HEIGHT": F.lit(str(height)), "LAYERS": F.lit(layer), "FORMAT": F.lit(kind)}
    return F.when(box.isNotNull(), F.to_json(F.struct(*[own[k].alias(k) for k in sorted(own)])))


def png_pixels(data: bytes) -> np.ndarray:
    """Rows x columns from 0 to 1 of a PNG of 8 bits: grey as it is, colours as their luminance; alpha is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    w, h, depth, color, _, _, interlaced = head or (0,) * 7
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if not channels or depth != 8 or interlaced:
        raise ValueError("only PNGs of 8 bits without palette or interlacing")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    px = unfiltered(raw[:, 0], raw[:, 1:].reshape(h, w, channels)).astype(float)
    grey = px[..., 0] if channels < 3 else np.floor((px[..., :3] @ (19595, 38470, 7471) + 32768) / 65536)
    return grey / 255.0


def unfiltered(kinds: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """A PNG's lines (rows x columns x channels, each line with its kind of filter) as they were.

    A pixel needs those left of it, above, and above on the left; so all pixels of a diagonal are made at once.
    """
    h, w, channels = raw.shape
    out = np.zeros((h + 1, w + 1, channels), np.int16)  # with a line and a column of zeros
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        p = a + b - c
        to_a, to_b, to_c = abs(p - a), abs(p - b), abs(p - c)
        nearest = np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))
        guess = np.choose(kinds[y, None], [np.zeros_like(a), a, b, (a + b) // 2, nearest])
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:]


def tiff_pixels(data: bytes) -> np.ndarray:
    """Rows x columns of a TIFF of one 32-bit float a pixel, which is what the service's float format gives: in strips, plain or deflated, of either byte order. ValueError for other forms (tiles, LZW, predictors, other samples)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        raise ValueError("no TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        code = {3: "H", 4: "I"}.get(kind)
        if code:
            size = struct.calcsize(code) * n
            where = entry[8:] if size <= 4 else data[struct.unpack(order + "I", entry[8:])[0] :]
            tags[tag] = struct.unpack(f"{order}{n}{code}", where[:size])
    packed = tags.get(259, (1,))[0]
    if tags.get(258, (0,))[0] != 32 or tags.get(339, (3,))[0] != 3 or packed not in (1, 8, 32946):
        raise ValueError("only TIFFs of 32-bit floats, plain or deflated")
    strips = [data[a : a + n] for a, n in zip(tags[273], tags[279], strict=True)]
    flat = b"".join(s if packed == 1 else zlib.decompress(s) for s in strips)
    return np.frombuffer(flat, f"{order}f4").reshape(tags[257][0], tags[256][0]).astype(float)


def shape_and_pixels(body: bytes | None, kind: str) -> tuple:
    """(h, w, pixels in row order) of an image, or of heights; three times None for what is none."""
    try:
        x = (png_pixels if kind in (IMAGE, "images") else tiff_pixels)(body) if body is not None else None
    except (ValueError, KeyError, TypeError, struct.error, zlib.error):
        x = None
    return (None, None, None) if x is None else (*x.shape, x.ravel().astype(np.float32))


def pixel_lists(pixels: list[np.ndarray | None]) -> pa.Array:
    """Lists of floats from arrays, without a Python number for each pixel."""
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in pixels)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.float32), *(x for x in pixels if x is not None)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in pixels], pa.bool_()))


def pixel_batch(rows: list[tuple]) -> pa.RecordBatch:
    """(id, h, w, pixels) as a batch."""
    ids, h, w, px = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pixel_lists(px)], names=["id", "h", "w", "pixels"])


#: Bytes of pixels in a batch, about.
BATCH_BYTES = 32 << 20


def decoded(answers: DataFrame, kind: str, body: str = "body", out: str = "pixels") -> DataFrame:
    """``answers`` with h, w and the pixels (floats) in row order instead of the body; null where there is none, for exceptions, and for what is no image. Batches are bounded by the bytes that they decode to."""
    keep = [c for c in answers.columns if c not in (body, "h", "w", out)]
    src = answers.select(*[f"`{c}`" for c in keep], F.when(~is_exception(F.col(body)), F.col(body)).alias(body))
    schema = src.select(*[f"`{c}`" for c in keep], F.lit(None).cast("int").alias("h"), F.lit(None).cast("int").alias("w"), F.lit(None).cast("array<float>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, made, size = 0, [], 0
            for k in range(b.num_rows):
                made.append(shape_and_pixels(b.column(len(keep))[k].as_py(), kind))
                size += 0 if made[-1][2] is None else made[-1][2].nbytes
                if size >= BATCH_BYTES or k == b.num_rows - 1:
                    h, w, px = zip(*made, strict=True)
                    own = [b.column(i).slice(begin, len(made)) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(h, pa.int32()), pa.array(w, pa.int32()), pixel_lists(px)], names=[*keep, "h", "w", out])
                    begin, made, size = k + 1, [], 0

    return src.mapInArrow(run, schema)
