"""Progress of a run: states of chips and of null chunks, at once or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.sources.files import METADATA

# The statuses of chips without results.
NOTHING, FAILED = ("no_data", "blank_chip", "noise_floor"), ("invalid_bbox", "chip_download_failed", "error")


def state(status: Column, n_craters: Column) -> Column:
    """ok, empty, failed or missing."""
    return F.when(status.isNull(), "missing").when(status.isin(*FAILED), "failed").when(status.isin(*NOTHING) | (F.coalesce(n_craters, F.lit(0)) == 0), "empty").otherwise("ok")


def chip_progress(manifest: DataFrame, chips: DataFrame) -> DataFrame:
    """(state, n) of the manifest's chips; those without metadata are missing."""
    both = manifest.select("manifest_index").join(chips.select(F.col("chip_index").alias("manifest_index"), "status", "n_craters"), "manifest_index", "left")
    return both.groupBy(state(F.col("status"), F.col("n_craters")).alias("state")).agg(F.count("*").alias("n"))


def missing_chips(manifest: DataFrame, chips: DataFrame) -> DataFrame:
    return manifest.join(chips.select(F.col("chip_index").alias("manifest_index")).distinct(), "manifest_index", "left_anti")


def chunk_progress(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: chunks done and missing, trials and seconds of those done."""
    got = parts.groupBy("chunk").agg(F.count("*").alias("trials"), F.max("runtime_s").alias("s"))
    return chunks.select("chunk").join(got, "chunk", "left").agg(F.count("trials").alias("done"), F.count_if(F.col("trials").isNull()).alias("missing"), F.coalesce(F.sum("trials"), F.lit(0)).cast("long").alias("n_trials"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("runtime_s"))


def watch_chips(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (state, n, n_craters) over the chip folders: each new metadata file is read once, the counts are the state.

    Write it in complete or update mode; the query's checkpoint says what was read, so a restart goes on where it was.
    """
    new = spark.readStream.schema(METADATA).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(f"{root.rstrip('/')}/chip_*/metadata.json")
    return new.groupBy(state(F.col("status"), F.col("n_craters")).alias("state")).agg(F.count("*").alias("n"), F.sum("n_craters").alias("n_craters"))


def bar(done: Column, total: Column, width: int = 30) -> Column:
    """A text bar of the share done."""
    filled = F.least(F.floor(done * width / F.greatest(total, F.lit(1))), F.lit(width)).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled), F.lit("]"))
