"""Connected components: forests of parts of the edges, then of the edges between their roots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import cut, drop, pieces

#: Edges that a task takes.
EDGES = 500_000


def forest(a: list, b: list, x: np.ndarray, y: np.ndarray) -> tuple[list, list]:
    """(nodes, roots): of the graph's nodes, each with the one of least hash that it is linked to. x, y: the hashes of a and b; equal ones go by name."""
    names, first, at = np.unique(np.array([*a, *b], dtype=object), return_index=True, return_inverse=True)
    by = np.argsort(np.concatenate([x, y])[first], kind="stable")  # names are in order
    rank = np.empty(len(names), np.int64)
    rank[by] = np.arange(len(names))
    up = list(range(len(names)))  # by rank

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    at = rank[at]
    for p, q in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        p, q = root(p), root(q)
        up[max(p, q)] = min(p, q)
    return names.tolist(), [names[by[root(r)]] for r in rank.tolist()]


def forests(edges: DataFrame) -> DataFrame:
    """(node, root) of each partition's edges (a, b and their hashes x, y)."""
    kind = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [b for b in batches if b.num_rows]
        if t:
            node, root = forest(*([v for b in t for v in b.column(c).to_pylist()] for c in (0, 1)), *(np.concatenate([b.column(c).to_numpy() for b in t]) for c in (2, 3)))
            yield pa.RecordBatch.from_arrays([pa.array(node, t[0].column(0).type), pa.array(root, t[0].column(0).type)], names=["node", "root"])

    return edges.select("a", "b", "x", "y").mapInArrow(run, kind)


def ordered(edges: DataFrame, level: int) -> DataFrame:
    """``edges`` (a, b) with the hashes x, y of their ends at this level, and b the end of smaller hash."""
    x, y = F.xxhash64(F.lit(level), "a"), F.xxhash64(F.lit(level), "b")
    swap = (x < y) | ((x == y) & (F.col("a") < F.col("b")))
    return edges.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest(x, y).alias("x"), F.least(x, y).alias("y"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one type): root is the least node it is linked to.

    Edges are dealt into parts of about EDGES; a task finds the forest of its part. Nodes that have several roots, in
    several parts, link those: these links are the edges of the next level, until they are one part or none. At each
    level nodes have a new order, by a hash of level and name: an edge lies with its smaller end, and the smallest node
    of a tree is its root. So a node that is smaller than none of its neighbours is in no further level, which on a path
    is a third of them in the mean, in whatever order their names rise: levels grow with the logarithm of the nodes. No
    task or group sees more than a part, or one node's roots. Each level is a table in the shared folder; the driver
    sees counts. Edges with a null end and loops are left out; repeated edges count once.
    """
    level = 0
    e = cut(ordered(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), level))
    levels: list[DataFrame] = []
    while True:
        parts = pieces(e.count(), EDGES)
        if parts == 1:
            named = cut(forests(e.coalesce(1)))
            break
        stars = cut(forests(e.repartition(parts, "b")))
        per = cut(stars.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")))
        level += 1
        links = cut(ordered(per.where(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("root").alias("b")).where("a <> b").distinct(), level))
        levels.append(cut(per.select("node", "root")))
        drop(e, stars, per)
        e = links
    drop(e)
    for below in reversed(levels):
        above = named.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = cut(below.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        drop(named, below)
        named = new
    least = named.groupBy("root").agg(F.min("node").alias("least"))
    out = cut(named.join(least, "root").select("node", F.col("least").alias("root")))
    drop(named)
    return out
