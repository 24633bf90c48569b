"""Line dedup: windows of three lines that repeat anywhere go, but for their first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with all its rows and columns; from ``text`` the lines are gone that later windows cover.

    Lines end at line feeds; windows are ``window`` consecutive lines, compared as they are. Of equal windows anywhere
    in the table the first occurrence is kept, by doc_id and then by line; a line goes if any later occurrence covers
    it. Texts with fewer lines than a window, null and empty texts stay as they are. A text whose lines all go becomes
    empty. Null ids come last; rows of one id are told apart by their texts (the smaller hash is first), and whole
    repeats of a row (same id and text) share one decision: they are one document written twice. An empty table gives
    an empty table; a column n_removed is added, replacing one of that name.

    Only hashes are shuffled, 16 bytes of two functions for each window; equal ones are summed before the shuffle, so a
    window in a third of all rows costs a row for each task. No row is joined by its hash: the first occurrences go to
    their own document by id, and the windows that a document did not get back are its later ones.
    """
    keep = [c for c in docs.columns if c != "n_removed"]
    # apart from the columns made here, whatever they are called
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{doc_id}`").alias("i"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h"))
    lines, n = F.split(F.coalesce(F.col("row")[text], F.lit("")), "\n", -1), F.size("l")

    at = F.sequence(F.lit(0), n - window)
    each = lambda p, *more: F.xxhash64(*more, *[F.get("l", p + k) for k in range(window)])
    found = (
        base.select("i", "h", lines.alias("l"))
        .where(n >= window)
        .select("i", "h", F.explode(F.transform(at, lambda p: F.struct(p.alias("p"), each(p).alias("a"), each(p, F.lit("second")).alias("b")))).alias("w"))
    )
    # the first occurrence: the least of (null ids last, id, text's hash, line)
    order = F.struct(F.col("i").isNull().alias("z"), "i", "h", F.col("w.p").alias("p"))
    first = found.groupBy("w.a", "w.b").agg(F.min(order).alias("f"))
    own = first.groupBy(F.col("f.i").alias("i2"), F.col("f.h").alias("h2")).agg(F.collect_list("f.p").alias("own"))

    joined = base.join(own, F.col("i").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left").withColumn("l", lines)
    later = F.array_except(at, F.coalesce("own", F.array().cast("array<int>")))
    gone = F.array_distinct(F.flatten(F.transform(later, lambda p: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: p + k))))
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    new = F.when(F.size("gone") > 0, F.array_join(F.transform(F.col("left"), lambda p: F.get("l", p)), "\n")).otherwise(F.col("row")[text])
    out = joined.withColumn("gone", F.when(n >= window, gone).otherwise(F.array().cast("array<int>"))).withColumn("left", left)
    return out.select(*[new.alias(text) if c == text else F.col("row")[c].alias(c) for c in keep], F.size("gone").cast("long").alias("n_removed"))


def dedup_lines_sql(window: int = WINDOW) -> str:
    """The same as SQL over ``documents`` whose ids are unique: doc_id, n_lines, n_removed and the new text's digest."""
    assert window == 3
    return """
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS x
          FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d WHERE len(l) >= 3)),
    r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS k FROM w),
    g AS (SELECT DISTINCT doc_id, p + o AS q FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1),
    n AS (SELECT d.doc_id, unnest(d.l) AS line, unnest(range(1, len(d.l) + 1)) AS q FROM d),
    t AS (SELECT n.doc_id, count(g.q) AS n_removed, string_agg(CASE WHEN g.q IS NULL THEN n.line END, chr(10) ORDER BY n.q) AS kept
          FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.q = n.q GROUP BY n.doc_id)
    SELECT doc_id, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(coalesce(kept, '')) AS BIGINT) AS n_chars, md5(coalesce(kept, '')) AS text_md5 FROM t
    """
