"""Helpers that several operators share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one call of a native library gets at a time.
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset: a temporary one on a local master, an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="farpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` through a table in the shared folder, so that lost executors never send the plan above to run again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/farpoint-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/farpoint-" in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pieces(rows: int, each: int) -> int:
    """How many pieces of about ``each`` rows hold ``rows`` rows; at least one."""
    return max(1, math.ceil(rows / each))


def bucket(key: Column, n: int | Column, seed: int = 0) -> Column:
    """A bucket from 0 to ``n - 1``, the same for the same key at every attempt."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.xxhash64(key, F.lit(seed)), n.cast("long")).cast("int")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until no column is called so (whatever its case)."""
    used, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


#: A key is hot from so many rows on, and from more on in large tables: at most HOT keys are.
HOT, HOT_ROWS = 1_000, 2_000


def spread_join(rows: DataFrame, labels: DataFrame, on: list[str], sizes: DataFrame, salt: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``labels`` (one row for each key at most), the rows of hot keys dealt over many tasks.

    ``sizes``: the keys with the number n of their rows, a table; smaller keys may lack. A key is hot if it has more
    than a HOT-th of those rows and more than HOT_ROWS, so there are at most HOT hot keys: these are broadcast, their
    rows dealt by the hash of ``salt``, and their labels repeated for each part.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT)
    hot = F.broadcast(sizes.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("__parts")))
    part = F.coalesce(F.pmod(F.xxhash64(*salt), F.col("__parts").cast("long")).cast("int"), F.lit(0))
    left = rows.join(hot, on, "left").withColumn("__salt", part).drop("__parts")
    right = labels.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*on, "__salt"], how).drop("__salt")


#: 64-bit words of a filter: 8 MB whatever the table's size.
SIEVE = 1 << 20


def spot(h: Column) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(17)), F.lit(SIEVE << 6))


def sieve(table: DataFrame, column: str) -> np.ndarray:
    """A filter of SIEVE words that knows each hash in ``column``; the driver gets at most these words."""
    x = spot(F.col(f"`{column}`"))
    words = table.select(F.shiftright(x, 6).alias("w"), F.expr("1L").alias("one"), (x % 64).cast("int").alias("s")).select("w", F.expr("shiftleft(one, s)").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(SIEVE, np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out


def maybe_in(bits: np.ndarray, column: str) -> Column:
    """False only for rows whose ``column`` the filter does not know. A full filter knows all: then every row is joined, which is slower and gives the same."""
    held = SparkSession.getActiveSession().sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def known(x: pd.Series) -> pd.Series:
        v = x.to_numpy()
        return pd.Series((held.value[v >> 6] >> (v & 63)) & 1 == 1)

    return known(spot(F.col(f"`{column}`")))


#: Bytes of an Arrow batch of texts.
ARROW_BYTES = 8 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, and from now on no Arrow batch of its session holds more than about ARROW_BYTES (one longer row is a batch of its own): a worker's memory does not depend on how long the texts are."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key)) > ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))
    return df


def slices(b: pa.RecordBatch, at: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of ``b`` with about ``limit`` bytes of the text column ``at`` each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit)))
        yield b.slice(i, j - i)
        i = j


def by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of ``texts`` of about ``limit`` bytes of UTF-8 each; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        n = len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def with_columns(batch: pa.RecordBatch, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """``batch`` cut or grown to ``schema``: columns not given are taken from the batch by name."""
    out = []
    for f in schema:
        x = columns[f.name] if f.name in columns else batch.column(batch.schema.get_field_index(f.name))
        out.append(x if isinstance(x, (pa.Array, pa.ChunkedArray)) and x.type == f.type else pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)
