"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where none is set: a temporary folder on a local master, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="farpoint-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: More partitions than any table has.
ANY = 1 << 20


def staged(df: DataFrame) -> DataFrame:
    """``df`` with its partitions as they are; generated code is cut here. What is computed before and after goes into methods of its own: the JVM never compiles one of more than 8,000 bytes, and runs it fifty times slower."""
    return df.coalesce(ANY)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as run at once: a small file is one task, however much is made of each row."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
