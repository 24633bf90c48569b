"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted lists, one for each dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from farpoint.llm.common import bucket, pieces

#: Candidates of a shard (its lists fit in a task), and queries that a task walks its lists for.
SHARD, BLOCK = 16_384, 4_096
#: Queries of a block that are scored in one product.
CHUNK = 512


def usable(vector: Column, zero: bool = True) -> Column:
    """Neither null nor holding null or non-finite components; with ``zero=False`` not of length 0 either."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    ok = vector.isNotNull() & F.coalesce(finite, F.lit(False))
    return ok if zero else ok & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def stacked(column: pa.ChunkedArray, width: int, kind: type = np.float64) -> np.ndarray:
    """Lists as the rows of a matrix of ``width`` columns; shorter ones end in zeros."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.diff(np.asarray(x.offsets))
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(ends) and (ends == width).all():
        return flat.reshape(len(ends), width)
    out = np.zeros((len(ends), width), kind)
    out[np.repeat(np.arange(len(ends)), ends), np.concatenate([np.arange(n) for n in ends]) if len(ends) else []] = flat
    return out


def depths(n: int) -> list[int]:
    """How far the lists are read before each look at the bound."""
    out, t = [], 64
    while t < n:
        out.append(t)
        t *= 2
    return [*out, n]


def best(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query's number, id, score) of each query's k best rows of ``x`` (whole numbers) other than its own; ties go to smaller ids.

    Each dimension's list holds the rows by that component, and is read from both ends by all queries together. A query
    reads it from the end that its own component favours, so no row that it has not met down to some depth scores above
    the sum of the lists' next entries times its components: it stops when that bound is below its kth score (at
    equality it reads on, as a tie may have a smaller id), or when all rows are met. Products are doubles where no score
    can reach 2**53, else Python's whole numbers; both are exact.
    """
    n, d = x.shape
    top = [abs(int(m)) for a in (x, q) if a.size for m in (a.min(), a.max())]
    if (max(top, default=0) + 1) ** 2 * max(d, 1) < 1 << 53:
        x, q = x.astype(np.float64), q.astype(np.float64)
    else:
        x, q = x.astype(object), q.astype(object)
    order = np.argsort(x, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, 0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], (n, d)), 0)
    met_at = np.minimum(rank, n - 1 - rank).min(1) if d else np.zeros(n, np.int64)
    by_depth = np.lexsort((ids, met_at))
    met_at = met_at[by_depth]
    at_id = np.argsort(ids)
    out = []
    for first in range(0, len(q), CHUNK):
        mine, me = q[first : first + CHUNK], own[first : first + CHUNK]
        place = np.searchsorted(ids[at_id], me)
        place = np.where((place < n) & (ids[at_id[np.minimum(place, n - 1)]] == me), at_id[np.minimum(place, n - 1)], -1)
        kept = [(np.zeros(0, x.dtype), np.zeros(0, ids.dtype)) for _ in mine]
        active, start = np.arange(len(mine)), 0
        for t in depths(n):
            stop = int(np.searchsorted(met_at, t))
            new = by_depth[start:stop]
            start = stop
            scores = mine[active].dot(x[new].T)
            more = t < n and stop < n
            bound = np.maximum(mine[active], 0).dot(lists[n - 1 - t]) + np.minimum(mine[active], 0).dot(lists[t]) if more else None
            left = []
            for r, i in enumerate(active):
                s = scores[r]
                ok = new != place[i]
                high, who = kept[i]
                if len(high) == k:
                    ok &= s >= high[-1]
                elif len(s) > 4 * k and s.dtype != object:
                    ok &= s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]  # one more than k, for the own row
                high, who = np.concatenate([high, s[ok]]), np.concatenate([who, ids[new[ok]]])
                at = np.lexsort((who, -high))[:k]
                kept[i] = high, who = high[at], who[at]
                if more and not (len(high) == k and high[-1] > bound[r]):
                    left.append(i)
            active = np.array(left, dtype=int)
            if not len(active):
                break
        for i, (high, who) in enumerate(kept):
            out += [(first + i, int(a), max(-(1 << 63), min((1 << 63) - 1, int(b)))) for a, b in zip(who, high, strict=True)]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k best other rows by integer inner product, all if fewer.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components take no part, nor do
    rows with a null id. Vectors of different lengths are compared as if the shorter ended in zeros. Of rows that repeat
    an id the smallest vector counts, as query and as candidate; a query's own row is the one with its id. Ties go to
    smaller ids. Components and scores beyond 64 bits become the nearest number of 64 bits. Empty tables give an empty
    result; other columns are not read.

    Candidates are dealt by the hash of their id into shards, queries into blocks, and each pair of shard and block is
    one task, so copies of one vector don't meet. A shard's k best per query are merged by rank. The shuffle moves
    each candidate once for each block of queries.
    """
    kind = T.ArrayType(T.LongType())

    def whole(df: DataFrame) -> DataFrame:
        v, i = F.col(f"`{vector}`"), F.col(f"`{vec_id}`").cast("long")
        part = df.where(i.isNotNull() & usable(v)).select(i.alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).cast(kind).alias("v"))
        return part.groupBy("id").agg(F.min("v").alias("v"))

    base, asked = whole(vectors), whole(queries)
    size = F.max(F.size(F.col(f"`{vector}`")))
    rows, wide = vectors.agg(F.count("*"), size).first()
    asking, wider = queries.agg(F.count("*"), size).first()
    shards, blocks, width = pieces(rows, SHARD), pieces(asking, BLOCK), max(wide or 0, wider or 0, 0)
    left = base.withColumns({"s": bucket(F.col("id"), shards), "b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = asked.withColumns({"b": bucket(F.col("id"), blocks, 1), "s": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        got = []
        own = b.column("id").to_numpy()
        if a.num_rows and b.num_rows:
            got = best(a.column("id").to_numpy(), stacked(a.column("v"), width, np.int64), own, stacked(b.column("v"), width, np.int64), k)
        return pa.table({"query_id": pa.array([int(own[i]) for i, _, _ in got], pa.int64()), "vec_id": pa.array([x for _, x, _ in got], pa.int64()), "score": pa.array([x for _, _, x in got], pa.int64())})

    found = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(k: int = 20, every: int = 20) -> str:
    """The same as SQL over ``embeddings`` for the queries whose vec_id is divisible by ``every``."""
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}
    """
