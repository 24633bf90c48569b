"""Runs over a catalogue: pairs, resumable chunks of null trials, and the final tables."""

from __future__ import annotations

import json
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.config import DEFAULT, Settings
from farpoint.operators import conejoin, matching, nullmodel, significance
from farpoint.operators.catalog import dedup
from farpoint.sources.files import exists, hadoop_path, write_csv, write_json

TRIAL = "trial long, score double, chunk int, runtime_s double, pair string"


def fingerprint(craters: DataFrame) -> str:
    """Of a catalogue: its rows and their hashes, in whatever order they come."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(craters.columns)])
    n, a, b = craters.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.pmod(h, F.lit(1_000_003))), F.lit(0))).first()
    return f"{n}-{a & (1 << 64) - 1:016x}-{b}"


def marks(settings: Settings, top: int, chunks: int, source: str, positions: str = nullmodel.HASH, catalogue: str | None = None) -> dict:
    """What a run must share with the checkpoint that it goes on with: all settings, and the catalogue."""
    own = {"top": top, "chunks": chunks, "source": source, "positions": positions} | ({"catalogue": catalogue} if catalogue else {})
    return json.loads(json.dumps(asdict(settings) | own))


def guard(spark: SparkSession, out: str, wanted: dict, force: bool = False) -> bool:
    """Whether ``out`` has a checkpoint of this run. One of other settings is an error, or with ``force`` no checkpoint."""
    if not exists(spark, f"{out}/meta/*"):
        return False
    have = json.loads(spark.read.text(f"{out}/meta").first()[0])
    differ = [f"{k} (checkpoint {have[k]}, now {v})" for k, v in wanted.items() if k in have and have[k] != v]
    if differ and not force:
        raise ValueError("the checkpoint has other settings: " + "; ".join(differ))
    return not differ


def clear(spark: SparkSession, out: str) -> None:
    """Drop the tables of a run."""
    for name in ("meta", "craters", "pairs", "top", "null", "null_meta", "assessed", "summary", "significant_csv", "all_pairs_csv", "null_pairs_json"):
        fs, path = hadoop_path(spark, f"{out}/{name}")
        fs.delete(path, True)


def prepare(craters: DataFrame, out: str, settings: Settings = DEFAULT, top: int = 200) -> None:
    """The catalogue without repeated fingerprints, its scored pairs and the best that share no end, as tables under ``out``."""
    spark = craters.sparkSession
    dedup(craters).write.mode("overwrite").parquet(f"{out}/craters")
    rows = spark.read.parquet(f"{out}/craters")
    conejoin.best_pairs(conejoin.build_pairs(rows, settings), settings.max_pairs).write.mode("overwrite").parquet(f"{out}/pairs")
    matching.non_overlapping(spark.read.parquet(f"{out}/pairs"), top).write.mode("overwrite").parquet(f"{out}/top")


def state(spark: SparkSession, out: str, wanted: dict, force: bool = False) -> dict:
    """What a run under ``out`` has done: prepared, the chunks that lack trials (ids), finished."""
    ready = guard(spark, out, wanted, force)
    if not ready:
        return {"prepared": False, "missing_chunks": list(range(wanted["chunks"])), "finished": False}
    bounds = nullmodel.chunk_bounds(spark, wanted["trials"], wanted["chunks"])
    missing = [r[0] for r in missing_chunks(bounds, done_trials(spark, out)).orderBy("chunk").collect()]
    return {"prepared": True, "missing_chunks": missing, "finished": not missing and exists(spark, f"{out}/summary/_SUCCESS")}


def missing_chunks(bounds: DataFrame, done: DataFrame) -> DataFrame:
    """(chunk, lacking): the chunks that lack trials, and how many."""
    got = done.select("trial").distinct().join(F.broadcast(bounds), (F.col("trial") >= F.col("first")) & (F.col("trial") < F.col("last"))).groupBy("chunk").agg(F.count("*").alias("n"))
    lacking = F.col("last") - F.col("first") - F.coalesce("n", F.lit(0))
    return bounds.join(got, "chunk", "left").select("chunk", lacking.alias("lacking")).where("lacking > 0")


def done_trials(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(TRIAL).parquet(f"{out}/null") if exists(spark, f"{out}/null/*.parquet") else spark.createDataFrame([], TRIAL)


def run_chunk(spark: SparkSession, out: str, chunk: int, chunks: int, settings: Settings = DEFAULT, positions: str = nullmodel.HASH) -> int:
    """Scores of the chunk's trials that have none yet, appended to ``out``/null; how many those were."""
    at = nullmodel.chunk_bounds(spark, settings.trials, chunks).where(F.col("chunk") == chunk).first()
    trials = nullmodel.remaining(spark.range(at["first"], at["last"]).withColumnRenamed("id", "trial"), done_trials(spark, out))
    n = trials.count()
    if n:
        began = time.time()
        got = nullmodel.best_scores(spark.read.parquet(f"{out}/craters"), trials, settings, distinct=False, positions=positions)
        got.select("trial", "score", F.lit(chunk).alias("chunk"), F.lit(None).cast("double").alias("runtime_s"), F.to_json("pair").alias("pair")).write.mode("append").parquet(f"{out}/null")
        write_json(spark, {"chunk": chunk, "trials": n, "runtime_s": time.time() - began}, f"{out}/null_meta/{chunk:04d}")
    return n


def finish(spark: SparkSession, out: str, settings: Settings = DEFAULT) -> DataFrame:
    """Assesses the top pairs against all trials and writes assessed pairs, discoveries and a summary. Missing trials are an error."""
    null = done_trials(spark, out).dropDuplicates(["trial"])
    missing = settings.trials - null.count()
    if missing > 0:
        raise ValueError(f"{missing} trials have no score")
    assessed = significance.assess(spark.read.parquet(f"{out}/top"), null, settings.alpha)
    assessed.write.mode("overwrite").parquet(f"{out}/assessed")
    assessed = spark.read.parquet(f"{out}/assessed")
    write_csv(significance.significant(assessed), f"{out}/significant_csv")
    write_csv(spark.read.parquet(f"{out}/pairs"), f"{out}/all_pairs_csv")
    null.where(F.col("pair").isNotNull()).select("trial", "score", "pair").write.mode("overwrite").json(f"{out}/null_pairs_json")
    summary = significance.summary(assessed).crossJoin(significance.percentiles(null))
    summary.write.mode("overwrite").parquet(f"{out}/summary")
    return spark.read.parquet(f"{out}/summary")


def run(craters: DataFrame, out: str, settings: Settings = DEFAULT, chunks: int = 8, top: int = 200, source: str = "", force: bool = False, positions: str = nullmodel.HASH) -> DataFrame:
    """All of it. A second run of the same catalogue and settings goes on where the first stopped: it keeps the tables
    and does only the trials that lack; another catalogue or other settings are an error, or with ``force`` a new start.
    ``source`` names the catalogue.

    positions: "hash" draws those of null trials by a hash of seed, trial and row, "streams" by numpy's streams.
    """
    spark, wanted = craters.sparkSession, marks(settings, top, chunks, source, positions, fingerprint(craters))
    now = state(spark, out, wanted, force)
    if not now["prepared"]:
        clear(spark, out)
        prepare(craters, out, settings, top)
        write_json(spark, wanted, f"{out}/meta")
    for c in now["missing_chunks"]:
        run_chunk(spark, out, c, chunks, settings, positions)
    return spark.read.parquet(f"{out}/summary") if now["finished"] else finish(spark, out, settings)
