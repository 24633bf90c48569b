"""Sharding: contiguous shards of nearly equal bytes, cut from a global prefix sum of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.llm.common import cut, drop, pieces
from farpoint.llm.sqltext import crc32

SHARDS = 8
#: Rows of a range that one task sums.
RANGE_ROWS = 100_000


def shards(docs: DataFrame, n: int = SHARDS, doc_id: str = "doc_id", text: str = "text", each: int = RANGE_ROWS) -> DataFrame:
    """One row for each of ``docs``: its id, size, text_crc32, law, shard, slot and grown_shard.

    Documents stand in the order of their ids (null first); those of equal ids in that of digest, size and place in
    the table. size: bytes of the text as UTF-8 (null: none) plus 1, for the line end. The law is ``bytes``: with T
    bytes in all, shard s takes the documents whose middle byte lies in the s-th of ``n`` equal parts of T. So shards
    are contiguous, no shard is further than one document's size from T / n, and a document larger than T / n fills a
    shard of its own while others may be empty. slot: the place in the shard, from 0, without gaps. grown_shard is null:
    only a law by key has one. text_crc32: unsigned, of the UTF-8 text (null: of no bytes).

    Texts are read once, for sizes and digests; these 32 bytes a row are written to a table in the shared folder, dealt
    into ranges of about ``each`` rows, and summed range by range; the total of each range gives the next one its start.
    The place in the table breaks ties, so a million rows of one id are dealt over ranges as well. Equal rows are any
    order apart; an empty table gives an empty one. Other columns of ``docs`` are not read, whatever their names.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("at"))
    rows = cut(rows)
    order = ["id", "crc", "size", "at"]
    dealt = rows.repartitionByRange(pieces(rows.count(), each), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # its upper bits are the range, the lower ones the row's place in it
    ranges = cut(dealt.withColumn("range", F.shiftright(place, 33)).withColumn("k", place.bitwiseAND((1 << 33) - 1)))
    drop(rows)

    totals = ranges.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))  # a row for each range
    over = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")], F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("all_bytes"))
    inside = Window.partitionBy("range").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranges.withColumn("end", F.sum("size").over(inside)).join(starts, "range")
    # twice the middle byte against twice all bytes, in whole numbers
    shard = F.expr(f"cast(least({n - 1}, cast(2 * (bytes_before + end) - size as decimal(27, 0)) * cast({n} as decimal(10, 0)) div (2 * all_bytes)) as int)")
    placed = cut(summed.select("id", "size", "crc", shard.alias("shard"), (F.col("rows_before") + F.col("k")).alias("row")))
    drop(ranges)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("first")))  # a row for each shard
    return placed.join(first, "shard").select(
        F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, n: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as JSON lines below ``path``, a folder shard=<s> for each shard, files in order of the slot; returns the manifest: shard, rows, bytes, first and last id.

    The shard's bounds are joined to the documents, so whole texts are shuffled once, to where they are written.
    Ids must be unique and not null here: they say which text is whose; anything else is an error.
    """
    plan = cut(shards(docs, n, doc_id, text))
    if plan.groupBy(doc_id).count().where(f"count > 1 or `{doc_id}` is null").limit(1).count():
        raise ValueError("write_shards needs ids that are unique and not null")
    manifest = plan.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min(doc_id).alias("first_id"), F.max(doc_id).alias("last_id")).orderBy("shard")
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(*[f"`{c}`" for c in keep]).join(plan.select(doc_id, "shard", "slot"), doc_id)
    tasks = pieces(plan.agg(F.sum("size")).first()[0] or 0, 128 << 20)
    rows.repartitionByRange(max(n, tasks), "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").json(path)
    return manifest


def shards_sql(n: int = SHARDS) -> str:
    """The same as SQL over ``documents``."""
    return f"""
    WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) + 1 AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
    s AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto,
                 CAST(sum(size) OVER () AS BIGINT) AS total FROM d),
    c AS (SELECT *, CAST(least({n} - 1, ((2 * upto - size) * {n}) // (2 * total)) AS INTEGER) AS shard FROM s)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM c
    """
