"""The null model: catalogues whose positions are drawn anew, and the best pair score of each."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.config import DEFAULT, Settings
from farpoint.functions import geo
from farpoint.operators.catalog import dedup
from farpoint.operators.conejoin import candidate_pairs, conform, max_pair, with_scores, with_vectors
from farpoint.operators.ranks import running
from farpoint.operators.tables import saved

Uniform = Callable[[Column, Column, int], Column]
HASH, STREAMS = "hash", "streams"


def hashed(seed: int) -> Uniform:
    """Uniform numbers in [0, 1) from a hash of seed, trial, row and axis: the same at every attempt of a task."""
    return lambda trial, idx, axis: F.pmod(F.xxhash64(F.lit(seed), trial, idx, F.lit(axis)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def on_sphere(u: Column, v: Column) -> tuple[Column, Column]:
    """(lon, lat) spread evenly over the sphere, from two uniform numbers."""
    return F.degrees(v * (2.0 * math.pi)) - 180.0, F.degrees(F.asin(geo.clip(u * 2.0 - 1.0, -1, 1)))


def scattered(craters: DataFrame, trials: DataFrame, uniform: Uniform) -> DataFrame:
    """Each trial's copy of the catalogue, its positions drawn anew; ``trials`` (trial) is small and is broadcast."""
    both = craters.crossJoin(F.broadcast(trials.select("trial")))
    lon, lat = on_sphere(uniform(F.col("trial"), F.col("idx"), 0), uniform(F.col("trial"), F.col("idx"), 1))
    return both.withColumns({"lon_deg": lon, "lat_deg": lat})


#: Rows of a trial that one task draws.
BLOCK = 1 << 16


def streams(trials: DataFrame, rows: int, seed: int = DEFAULT.seed, block: int = BLOCK) -> DataFrame:
    """(trial, row, lon_deg, lat_deg) of ``rows`` rows: numpy's streams, one child of ``seed`` for each trial; all heights first, then all angles.

    A trial's numbers depend on seed and trial alone, so chunks of trials give what one run over all would give. Each
    block of rows is drawn by itself: the generator jumps to the block's first height, and again to its first angle, so
    one trial is the work of many tasks.
    """
    blocks = -(-rows // block)
    src = trials.select("trial", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("block")).repartition("trial", "block") if rows else trials.select("trial", F.lit(0).alias("block")).limit(0)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first, n = k * block, min(block, rows - k * block)

                def drawn(at: int, lo: float, hi: float) -> np.ndarray:
                    bits = np.random.PCG64(np.random.SeedSequence(seed, spawn_key=(t,)))  # noqa: B023
                    return np.random.Generator(bits.advance(at)).uniform(lo, hi, n)  # noqa: B023

                z, phi = drawn(first, -1.0, 1.0), drawn(rows + first, 0.0, 2.0 * np.pi)
                columns = [np.full(n, t, np.int64), np.arange(first, first + n), np.degrees(phi) - 180.0, np.degrees(np.arcsin(z))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["trial", "row", "lon_deg", "lat_deg"])

    return src.mapInArrow(draw, "trial long, row long, lon_deg double, lat_deg double")


def streamed(rows: DataFrame, trials: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """Each trial's copy of the catalogue with the positions of ``streams``, dealt to the rows in the order of idx."""
    place = running(rows.select("idx").withColumn("n", F.lit(1)), "idx", out="upto").select("idx", (F.col("upto") - 1).alias("row"))
    numbered = rows.drop("lon_deg", "lat_deg").join(place, "idx")
    return numbered.join(streams(trials, rows.count(), seed, block), "row").drop("row").select("trial", *rows.columns)


def deep(craters: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return conform(craters).where(F.col("depth_proxy") >= settings.min_depth_proxy)


def trial_pairs(craters: DataFrame, trials: DataFrame, settings: Settings = DEFAULT, uniform: Uniform | None = None, distinct: bool = True, positions: str = HASH) -> DataFrame:
    """trial and the columns of every scored pair of each trial's catalogue.

    Trials are one more key of the cone join, so all run in one job. ``distinct``: drop repeated fingerprints first, as
    the pairing of the real catalogue does. positions: "hash" draws by ``uniform`` (by default a hash of seed, trial and
    row), "streams" as numpy does (``streams``).
    """
    rows = deep(dedup(craters) if distinct else craters, settings)
    if positions == STREAMS:
        drawn = streamed(saved(rows), trials, settings.seed)
    else:
        drawn = scattered(rows, trials, uniform or hashed(settings.seed))
    return with_scores(candidate_pairs(with_vectors(drawn), settings, ("trial",)), settings, ("trial",))


def best_scores(craters: DataFrame, trials: DataFrame, settings: Settings = DEFAULT, uniform: Uniform | None = None, distinct: bool = True, positions: str = HASH) -> DataFrame:
    """(trial, score, pair): the best pair score of each trial, 0 and no pair where a trial has none."""
    top = max_pair(trial_pairs(craters, trials, settings, uniform, distinct, positions), ("trial",))
    return trials.select("trial").join(top, "trial", "left").select("trial", F.coalesce("score", F.lit(0.0)).alias("score"), "pair")


def best_pairs(craters: DataFrame, trials: DataFrame, settings: Settings = DEFAULT, uniform: Uniform | None = None, distinct: bool = True, positions: str = HASH) -> DataFrame:
    """trial and all columns of its best pair, to be scored again under other settings; trials without a pair have no row."""
    pairs = trial_pairs(craters, trials, settings, uniform, distinct, positions)
    top = max_pair(pairs, ("trial",), tuple(c for c in pairs.columns if c not in ("trial", "score")))
    return top.select("trial", "score", "pair.*")


def chunk_bounds(spark: SparkSession, trials: int, chunks: int) -> DataFrame:
    """(chunk, first, last): trials dealt in order; the first ``trials % chunks`` chunks have one more. ``last`` is exclusive."""
    each, more = divmod(trials, chunks)
    c = F.col("id")
    first = c * each + F.least(c, F.lit(more))
    return spark.range(chunks).select(c.alias("chunk"), first.alias("first"), (first + each + (c < more).cast("long")).alias("last"))


def remaining(trials: DataFrame, done: DataFrame) -> DataFrame:
    """Trials that have no score yet."""
    return trials.join(done.select("trial").distinct(), "trial", "left_anti")


def tasks(total: int, each: int) -> int:
    return -(-total // each)
