"""Catalogue files: tolerant readers, the scan over chip folders, and sinks for results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"double": T.DoubleType(), "string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "box": T.StructType([T.StructField(n, T.DoubleType()) for n in ("lon_min", "lat_min", "lon_max", "lat_max")])}


def schema_of(text: str) -> T.StructType:
    return T.StructType([T.StructField(*c.split()[:1], KINDS[c.split()[1]]) for c in text.split(", ")])


CRATERS = schema_of(
    "x double, y double, radius_px double, radius_m double, strength double, depth_proxy double, circularity double, ellipticity double, orientation_deg double, shape_reliable boolean, "
    "orientation_unc_deg double, ellipticity_unc double, nls double, rcr double, freshness_index double, lon_deg double, lat_deg double, product_id string, chip_index int"
)
MANIFEST = schema_of("manifest_index int, product_id string, resolution_mpp double, center_lon double, center_lat double, incidence_angle_deg double, emission_angle_deg double, phase_angle_deg double")
METADATA = schema_of(
    "chip_index int, product_id string, center_lon double, center_lat double, bbox box, mpp_x double, mpp_y double, mpp_mean double, "
    "chip_size_px int, chip_span_m double, n_craters int, threshold double, terrain_mean_m double, terrain_std_m double, terrain_slope_proxy double, status string"
)


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches the path or pattern, in whichever store Spark reads."""
    fs, p = hadoop_path(spark, path)
    return bool(fs.globStatus(p))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def typed(raw: DataFrame, schema: T.StructType) -> list[Column]:
    """The columns of ``schema`` by name, null where ``raw`` lacks them or a value does not parse."""
    return [(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns by name: those that the files lack are null. A missing path or an empty file gives no rows, values that don't parse are null."""
    if not exists(spark, path):
        return empty(spark, schema)
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True)
    return raw.select(*typed(raw, schema))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    if exists(spark, path) and "manifest_index" not in spark.read.csv(path, header=True).columns:
        raise ValueError("a manifest needs manifest_index")
    return read_csv(spark, path, MANIFEST)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One document a file; one that can't be read is a row of nulls."""
    if schema is None:
        return spark.read.json(path, multiLine=True)
    return spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else empty(spark, schema)


def folder(name: Column) -> Column:
    """The chip folder of a file."""
    return F.regexp_extract(name, r"/(chip_[^/]*)/[^/]*$", 1)


def scan_chips(spark: SparkSession, root: str) -> DataFrame:
    """All rows of ``root``/chip_*/craters.csv, with chip_dir, chip_index (folders in the order of their names) and idx.

    Rows of a file keep their order (strongest first, then by place). idx counts chip after chip: a rank within each
    chip, from its rows' order, on top of the rows of the chips before, so that no task sees all rows.
    """
    pattern = f"{root.rstrip('/')}/chip_*/craters.csv"
    if not exists(spark, pattern):
        return empty(spark, CRATERS).withColumn("chip_dir", F.lit("")).withColumn("idx", F.lit(0).cast("long"))
    raw = spark.read.option("ignoreCorruptFiles", True).csv(pattern, header=True)
    rows = raw.select(*typed(raw, CRATERS), folder(F.col("_metadata.file_path")).alias("chip_dir")).where(F.col("chip_dir") != "")
    return numbered(rows)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with chip_index and idx by chip_dir, then strength (strongest first) and place."""
    from pyspark.sql.window import Window

    per = rows.groupBy("chip_dir").agg(F.count("*").alias("n"))
    # a row for each chip: as many as the manifest has, which is bounded
    w = Window.partitionBy(F.lit(0)).orderBy("chip_dir")
    base = per.select("chip_dir", (F.row_number().over(w) - 1).cast("int").alias("chip_index"), (F.sum("n").over(w) - F.col("n")).alias("__base"))
    at = F.row_number().over(Window.partitionBy("chip_dir").orderBy(F.desc_nulls_last("strength"), "y", "x"))
    return rows.drop("chip_index").join(base, "chip_dir").withColumn("idx", F.col("__base") + at - 1).drop("__base")


def scan_metadata(spark: SparkSession, root: str) -> DataFrame:
    """A row for each chip folder that has results: chip_dir and its metadata, all null where that is missing or broken."""
    top = root.rstrip("/")
    dirs = spark.read.format("binaryFile").load(f"{top}/chip_*/craters.csv").select(folder(F.col("path")).alias("chip_dir")) if exists(spark, f"{top}/chip_*/craters.csv") else empty(spark, schema_of("chip_dir string"))
    path = f"{top}/chip_*/metadata.json"
    meta = spark.read.schema(METADATA).json(path, multiLine=True).withColumn("chip_dir", folder(F.col("_metadata.file_path"))) if exists(spark, path) else empty(spark, METADATA).withColumn("chip_dir", F.lit(""))
    return dirs.join(meta, "chip_dir", "left")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, also where there are no rows."""
    df.write.mode("overwrite").csv(path, header=True)


def write_json(spark: SparkSession, what: dict, path: str) -> None:
    """One small document."""
    spark.createDataFrame([(json.dumps(what, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_chips(craters: DataFrame, metadata: DataFrame, root: str) -> None:
    """``root``/<chip_dir>/craters.csv and metadata.json for each chip_dir of ``craters`` and ``metadata`` (with METADATA's columns, as text what is no document).

    Each chip's rows go to one task, which writes its file; the driver then moves the files to their names, one for
    each chip. A chip_dir has to begin with "chip_".
    """
    spark, aside = craters.sparkSession, f"{root.rstrip('/')}/_aside"
    craters.repartition("chip_dir").write.mode("overwrite").partitionBy("chip_dir").csv(f"{aside}/craters", header=True)
    metadata.repartition("chip_dir").write.mode("overwrite").partitionBy("chip_dir").text(f"{aside}/metadata")
    for kind, name in (("craters", "craters.csv"), ("metadata", "metadata.json")):
        fs, pattern = hadoop_path(spark, f"{aside}/{kind}/chip_dir=*/part-*")
        for status in fs.globStatus(pattern):
            chip = status.getPath().getParent().getName().split("=", 1)[1]
            _, to = hadoop_path(spark, f"{root.rstrip('/')}/{chip}/{name}")
            fs.mkdirs(to.getParent())
            fs.rename(status.getPath(), to)
    fs, path = hadoop_path(spark, aside)
    fs.delete(path, True)
