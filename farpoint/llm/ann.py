"""Approximate nearest neighbours: an adaptive dimension scan of the probed lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.llm.common import bucket, cut
from farpoint.llm.topk import stacked, usable

#: The index is fitted on the TRAIN vectors whose hash comes first; it has at most LISTS lists.
TRAIN, LISTS = 20_000, 1_024
#: A list is dealt into parts of about PART vectors, its queries into blocks of BLOCK.
PART, BLOCK = 16_384, 4_096
#: Columns of a block, and how sure a test must be before it abandons a candidate.
COLUMNS, SURE = 16, 2.1


def unit(x: np.ndarray) -> np.ndarray:
    """Rows on the unit sphere; their largest component comes to 1 first, so that no square overflows or vanishes."""
    top = np.abs(x).max(1, keepdims=True, initial=0)
    x = x / np.where(top > 0, top, 1)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


@dataclass(frozen=True)
class Index:
    """Centres of the lists, and the rotation that spreads each vector's length evenly over its columns."""

    width: int
    centres: np.ndarray
    rotation: np.ndarray

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The numbers of the ``probes`` nearest lists of each row of unit vectors."""
        near = x @ self.centres.T
        probes = min(probes, len(self.centres))
        return np.argpartition(-near, probes - 1, axis=1)[:, :probes]


def fit(x: np.ndarray, rows: int, rounds: int = 8, seed: int = 11) -> Index:
    """k-means on the sphere; about as many lists as half the square root of all rows."""
    width = x.shape[1]
    rng = np.random.default_rng(seed)
    x = unit(x)
    k = max(1, min(LISTS, round(rows**0.5 / 2), len(np.unique(x, axis=0)) if len(x) else 1))
    centres = x[rng.permutation(len(x))[:k]] if len(x) else np.zeros((1, width))
    for _ in range(rounds if len(x) else 0):
        at = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where((np.bincount(at, minlength=len(centres)) > 0)[:, None], unit(total), centres)
    return Index(width, centres, np.linalg.qr(rng.standard_normal((width, width)))[0] if width else np.zeros((0, 0)))


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision and row by row, so that equal vectors score equal wherever they stand."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def scan(ids: np.ndarray, x: np.ndarray, turned: np.ndarray, q: np.ndarray, own: int, k: int, rotation: np.ndarray, columns: int = COLUMNS, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a list: (ids, cosines), nearest first.

    ``turned``: the list's rotated unit vectors, in blocks of columns. The squared distance over the first d of D
    columns, times D/d, estimates the whole; a candidate whose estimate is beyond (1 + sure/sqrt(d)) times the kth
    distance is abandoned. The kth distance is that of the k candidates that lie nearest after the first block.
    """
    width = turned.shape[1]
    alive = np.flatnonzero(ids != own)
    t = (unit(q[None, :]) @ rotation)[0]
    partial = np.zeros(len(alive))
    limit = np.inf
    for c in range(0, width, columns):
        e = min(c + columns, width)
        diff = turned[alive, c:e] - t[c:e]
        partial = partial + (diff * diff).sum(1)
        if e == width or len(alive) <= k:
            continue
        if c == 0:
            first = alive[np.argpartition(partial, k - 1)[:k]]
            diff = turned[first] - t
            limit = np.sqrt((diff * diff).sum(1).max())
        ok = np.sqrt(partial * (width / e)) <= limit * (1 + sure / np.sqrt(e)) + 1e-9
        if ok.sum() >= k:
            alive, partial = alive[ok], partial[ok]
    if len(alive) > k:
        ok = partial <= np.partition(partial, k - 1)[k - 1] + 1e-9
        alive = alive[ok]
    score = cosine(x[alive], q)
    at = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][at], score[at]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, probes: float = 0.8, vec_id: str = "vec_id", vector: str = "embedding", train: int = TRAIN) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest other rows found for each query, by cosine.

    probes: the share of the lists that each query scans (all, if 1; one at least). Every row is indexed; only centres
    and rotation are fitted on a sample. Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows with a null id. Vectors of different lengths are compared as if the shorter ended in zeros. Of
    rows that repeat an id the smallest vector counts. Ties go to smaller ids. A query whose lists hold fewer than k
    others gets the rest from all lists. Empty tables give an empty result; other columns are not read.

    Lists and queries are dealt into parts by the hash of their ids, so a list that holds a third of all rows is many
    tasks. The driver gets the sample, the lists' sizes (at most LISTS) and nothing else.
    """

    def whole(df: DataFrame) -> DataFrame:
        v, i = F.col(f"`{vector}`"), F.col(f"`{vec_id}`").cast("long")
        part = df.where(i.isNotNull() & usable(v, zero=False)).select(i.alias("id"), v.cast("array<double>").alias("v"))
        return part.groupBy("id").agg(F.min("v").alias("v"))

    base, asked = whole(vectors), whole(queries)
    rows, wide = base.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(wide or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0, 0)
    sample = base.orderBy(F.xxhash64("id"), "id").limit(train).toArrow()
    index = fit(stacked(sample.column("v"), width), rows or 0)
    lists = len(index.centres)
    near = max(1, min(lists, round(lists * probes)))

    def assigned(df: DataFrame, n: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = index.nearest(unit(stacked(b.column(1), width)), n).astype(np.int32)
                ends = np.arange(0, at.size + 1, at.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(at.ravel()))], names=["id", "v", "l"])

        return df.mapInArrow(run, "id long, v array<double>, l array<int>").select("id", "v", F.explode("l").alias("l"))

    def run(df: DataFrame, asked: DataFrame, n: int) -> DataFrame:
        held, wanted = assigned(df, 1), assigned(asked, n)
        sizes = {r[0]: r[1] for r in held.groupBy("l").count().where(F.col("count") > PART).collect()}
        blocks = {r[0]: r[1] for r in wanted.groupBy("l").count().where(F.col("count") > BLOCK).collect()}

        def many(by: dict[int, int], each: int):
            """How many pieces a list's rows make, looked up by its number: one case within another for each list would be too deep to plan."""
            return F.get(F.lit([-(-by.get(x, 1) // each) for x in range(lists)]), F.col("l"))

        parts, cuts = many(sizes, PART), many(blocks, BLOCK)
        left = held.withColumns({"p": bucket(F.col("id"), parts), "b": F.explode(F.sequence(F.lit(0), cuts - 1))})
        right = wanted.withColumns({"b": bucket(F.col("id"), cuts, 1), "p": F.explode(F.sequence(F.lit(0), parts - 1))})

        def one(a: pa.Table, b: pa.Table) -> pa.Table:
            q_ids, ids_, scores = [], [], []
            if a.num_rows and b.num_rows:
                ids, x, own, q = a.column("id").to_numpy(), stacked(a.column("v"), width), b.column("id").to_numpy(), stacked(b.column("v"), width)
                turned = unit(x) @ index.rotation
                for o, v in zip(own, q, strict=True):
                    i, s = scan(ids, x, turned, v, o, k, index.rotation)
                    q_ids += [o] * len(i)
                    ids_ += i.tolist()
                    scores += s.tolist()
            return pa.table({"query_id": pa.array(q_ids, pa.int64()), "vec_id": pa.array(ids_, pa.int64()), "score": pa.array(scores, pa.float64())})

        key = ("l", "p", "b")
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(one, "query_id long, vec_id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = run(base, asked, near)
    if near == lists:
        return found
    # queries whose lists hold fewer than k others
    found = cut(found)
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    few = cut(asked.join(full, asked.id == full.query_id, "left_anti").select("id", "v"))
    if few.isEmpty():
        return found
    return found.join(full.select("query_id"), "query_id", "left_semi").select(*found.columns).union(run(base, few, lists))


def nearest_exact(vectors: dict[int, np.ndarray], query: int, k: int = 5) -> list[tuple[int, float]]:
    """Brute force for one query, for measuring recall."""
    ids = np.array(sorted(i for i in vectors if i != query))
    s = cosine(np.stack([vectors[i] for i in ids]), vectors[query])
    at = np.lexsort((ids, -s))[:k]
    return [(int(ids[i]), float(s[i])) for i in at]
