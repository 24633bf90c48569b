"""Greedy matching: the best pairs that share no end."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.operators.tables import saved

#: Rows that one task walks down, at most.
WALK = 200_000
#: Of the rows, the share that a round has to settle for the next one to be of the same kind.
SETTLED = 0.125


def order(score: str = "score", a: str = "idx_a", b: str = "idx_b") -> Column:
    """Ascending in what is better: null scores last, ties to smaller indices."""
    return F.struct(F.col(score).isNotNull().alias("ok"), F.col(score).alias("s"), (-F.col(a)).alias("a"), (-F.col(b)).alias("b"))


def dominant(live: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) of the pairs that are the best ones left at both of their ends. The best of an end is summed before its shuffle."""
    best = live.select(F.explode(F.array(a, b)).alias("__v"), "__o").groupBy("__v").agg(F.max("__o").alias("__m"))
    at = lambda c, n: best.select(F.col("__v").alias(c), F.col("__m").alias(n))
    return live.join(at(a, "__x"), a).join(at(b, "__y"), b).where((F.col("__o") == F.col("__x")) & (F.col("__o") == F.col("__y"))).select(a, b)


def walked(live: DataFrame, a: str, b: str, rows: int) -> DataFrame:
    """(a, b) of the pairs that the walk takes among the ``rows`` best ones: one task, which sees these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = set()
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if x not in used and y not in used:
                    used.update((x, y))
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    best = live.orderBy(F.desc("__o")).limit(rows).select(a, b, "__o")
    return best.coalesce(1).sortWithinPartitions(F.desc("__o")).select(a, b).mapInArrow(run, live.select(a, b).schema)


def non_overlapping(pairs: DataFrame, k: int | None = None, score: str = "score", a: str = "idx_a", b: str = "idx_b", walk: int = WALK) -> DataFrame:
    """What one gets by going down the pairs from the best score and taking each whose ends are both free; the first ``k``.

    With ``k``: the best 4k pairs are walked in order, then twice as many of those whose ends are still free, and so
    on, until k are taken. Without: a round takes every pair that is the best one left at both of its ends, over all
    tasks at once, since no better pair can block it. Where such a round settles few pairs (scores that rise along a
    path settle one a round), the ``walk`` best ones are walked by one task before the next round; so there are at most
    the logarithm of the rows and rows / walk rounds. Both take what the whole walk takes. Rounds are checkpointed.

    Null ends and loops take no part; of rows that repeat a pair at most one is taken; an empty table gives an empty
    one.
    """
    cols = pairs.columns
    o = order(score, a, b)
    some = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    plain = [F.col(f"`{c}`") for c, kind in pairs.dtypes if "map<" not in kind and kind != "variant"]
    # of rows of one pair the walk takes the best, of equal ones one: chosen by a hash of all columns
    one = some.groupBy(F.least(a, b).alias("__lo"), F.greatest(a, b).alias("__hi")).agg(F.max_by(F.struct(*[f"`{c}`" for c in cols]), F.struct(o.alias("o"), F.xxhash64(*plain).alias("h"))).alias("__r"))
    live = saved(one.select("__r.*").withColumn("__o", o))
    taken, n, size, in_order = None, live.count(), min(walk, 4 * (k or walk)), k is not None
    while n and (k is None or k > 0):
        won = saved(live.join(walked(live, a, b, size) if in_order else dominant(live, a, b), [a, b]).select(*cols, "__o"))
        taken = won if taken is None else taken.unionByName(won)
        if k is not None and taken.count() >= k:
            break
        used = won.select(F.explode(F.array(a, b)).alias("__v"))
        gone = lambda c: used.select(F.col("__v").alias(c))  # noqa: E731, B023
        live = saved(live.join(gone(a), a, "left_anti").join(gone(b), b, "left_anti").select(*cols, "__o"))
        left = live.count()
        in_order = k is not None or (not in_order and n - left < SETTLED * n)
        n, size = left, min(walk, 2 * size)
    out = (taken if taken is not None else live.limit(0)).orderBy(F.desc("__o")).select(*cols)
    return out if k is None else out.limit(k)
