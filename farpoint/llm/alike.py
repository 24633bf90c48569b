"""Similarity join of sets: all pairs at a Jaccard similarity are linked, directly or over others, by prefixes and exact counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import bucket, cut, drop, pieces, slices, text_batches

#: Sets, and elements of sets, that a part of a home holds; a task compares parts two by two.
PART, ELEMENTS = 2_000, 2_000_000
#: Texts whose elements are counted to learn which are frequent, and how many of these are known: they order the elements, no pair depends on it.
LOOKED, FREQUENT = 4_000, 200_000
#: Members of homes that a group of small homes has.
ROWS = 2_000
#: Elements that a prefix holds beyond the shortest, as a share of its set: so many more are shared by a pair, and sets that share fewer drop out early.
MORE = 0.05
#: Elements in more sets than that are counted as columns of a matrix.
DENSE = 48


def frequent(texts: DataFrame, count: int, hashes: Callable[[str], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent elements (sorted) and their counts among about LOOKED different texts of ``texts`` (h, t). They only put elements in an order: rare ones first, which few sets share."""
    some = texts.where(F.pmod("h", F.lit(max(1, count // LOOKED))) == 0).groupBy("h").agg(F.first("t").alias("t")).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0):
                for t in b.column(0).to_pylist():
                    got = hashes(t)
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(got)).view(np.int64))], names=["x"])

    seen = text_batches(some).mapInArrow(run, "x long").groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") > 4)
    got = seen.orderBy(F.desc("n"), "x").limit(FREQUENT).toArrow()
    x, n = got.column("x").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(x)
    return x[order], n[order]


def prefixes(h: np.ndarray, counts: np.ndarray, known: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, how many for each set, sizes of the sets) of the prefixes of sets that lie in ``h`` one after the other, repeats included.

    All sets have their elements in one order, the frequent ones last. Of a set of n elements the prefix is the first
    n - ceil(similarity * n) + k, k = 1 + floor(MORE * n): two sets at the similarity share as many elements of their
    prefixes as the lesser k, whatever the order.
    """
    which = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, which))
    h, which = h[order], which[order]
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (which[1:] != which[:-1])])[: len(h)]
    h, which = h[once], which[once]
    n = np.bincount(which, minlength=len(counts))
    values, often = known
    if len(values):
        at = np.minimum(np.searchsorted(values, h), len(values) - 1)
        rank = np.where(values[at] == h, often[at], 0)
        if rank.any():
            h = h[np.lexsort((h, rank, which))]
    length = np.minimum(n, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1 + np.floor(MORE * n).astype(np.int64))
    return h[np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(length, n)], length, n


def shared_by(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sets ``a`` shares with each of ``b``."""
    na, nb = len(a), len(b)
    out = np.zeros((na, nb), np.int64)
    every, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    split = sum(map(len, a))
    x, y = at[:split], at[split:]
    i, j = np.repeat(np.arange(na), list(map(len, a))), np.repeat(np.arange(nb), list(map(len, b)))
    in_a, in_b = np.bincount(x, minlength=len(every)), np.bincount(y, minlength=len(every))
    both = (in_a > 0) & (in_b > 0)
    dense = both & (in_a + in_b > DENSE)
    few = both & ~dense
    # rare ones: each place in a with all places in b
    order = np.argsort(y, kind="stable")
    start = np.cumsum(in_b) - in_b
    p = np.flatnonzero(few[x])
    step = max(1, (1 << 22) // DENSE)
    for k in range(0, len(p), step):
        q = p[k : k + step]
        many = in_b[x[q]]
        place = np.repeat(start[x[q]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        np.add.at(out.reshape(-1), np.repeat(i[q], many) * nb + j[order[place]], 1)
    # frequent ones: as a product of matrices, some columns at a time
    columns = np.full(len(every), -1)
    columns[dense] = np.arange(dense.sum())
    cx, cy = columns[x], columns[y]
    for k in range(0, int(dense.sum()), 2048):
        u, v = (cx >= k) & (cx < k + 2048), (cy >= k) & (cy < k + 2048)
        m, w = np.zeros((na, 2048), np.float32), np.zeros((nb, 2048), np.float32)
        m[i[u], cx[u] - k] = 1
        w[j[v], cy[v] - k] = 1
        out += (m @ w.T).astype(np.int64)
    return out


def forest_of(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest with the components of the graph whose matrix is ``near`` (symmetric)."""
    todo, out = np.ones(len(near), bool), []
    for first in np.flatnonzero(near.any(1)).tolist():
        if not todo[first]:
            continue
        todo[first] = False
        stack = [first]
        while stack:
            u = stack.pop()
            new = np.flatnonzero(near[u] & todo).tolist()
            todo[new] = False
            out += [(u, v) for v in new]
            stack += new
    return out


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges of a forest of the links between the sets ``left`` and ``right`` (both all, or disjoint): all pairs are compared."""
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    if not len(a) or not len(b):
        return []
    size = np.array([len(s) for s in sets])
    both = shared_by([sets[i] for i in a], [sets[i] for i in b])
    ok = both >= (similarity - 1e-9) * (size[a][:, None] + size[b][None, :] - both)
    near = np.zeros((len(sets), len(sets)), bool)
    near[np.ix_(a, b)] = ok
    near |= near.T
    np.fill_diagonal(near, False)
    return forest_of(near)


def homes(sets: DataFrame, similarity: float) -> DataFrame:
    """(x, t, z, m): the homes (t, z) where sets (x: hash of the key) meet, and the number m of elements of each; ``sets``: key, n (size) and c (prefix), of which rows may repeat. Two sets at the similarity have a home in common.

    Sets meet in an element of both prefixes, if their sizes are of one class or of neighbouring ones, and if each shares
    so many elements with others as a pair shares at least. A set that many
    elements share with many others would meet these time and again; so elements share homes: each set names its most
    frequent element, and each element's home is the most frequent of those that its sets name.
    """
    base = 1 / similarity
    size = F.log(F.col("n").cast("double")) / math.log(base)
    # classes of sizes by powers of the largest ratio: those of a pair are equal or neighbours
    classes = F.sequence(F.floor(size - 1e-9).cast("int"), F.floor(size + 1e-9).cast("int") + 1)
    # what a set shares with each partner at least: those have similarity * n elements or more
    enough = F.count("*") >= 1 + F.floor(MORE * similarity * F.first("n") - 1e-6)
    posts = sets.where("n > 0").select(F.xxhash64("key").alias("x"), F.col("n").cast("int").alias("n"), F.explode("c").alias("t"))
    twice = posts.groupBy("t").agg(F.count("*").alias("k")).where("k > 1").select("t")
    # rows may repeat: copies meet in all their elements
    once = cut(posts.join(twice, "t").select("x", "n", "t").distinct())
    some = once.groupBy("x").agg(enough.alias("enough")).where("enough").select("x")
    both = cut(once.join(some, "x").select("x", "n", "t", F.explode(classes).alias("z")))
    mates = both.groupBy("t", "z").agg(F.count("*").alias("k")).where("k > 1")
    all_ = cut(both.join(mates, ["t", "z"]))
    few = all_.groupBy("x", "z").agg(enough.alias("enough")).where("enough").select("x", "z")
    shared = cut(all_.join(few, ["x", "z"]))
    label = shared.groupBy("x").agg(F.max(F.struct("k", "t", "z")).alias("l"))
    home = shared.join(label, "x").groupBy("t", "z").agg(F.max("l").alias("l"))
    out = cut(shared.join(home, ["t", "z"]).groupBy("x", F.col("l.t").alias("t"), F.col("l.z").alias("z")).agg(F.first("n").alias("m")).select("x", "t", "z", "m"))
    drop(once, both, all_, shared)
    return out


def links(sets: DataFrame, packed: Callable[[DataFrame], DataFrame], similarity: float, part: int | None = None) -> DataFrame:
    """Links a, b (keys) between sets whose Jaccard similarity is at least ``similarity``: any two such sets are linked, at once or over others. No candidate is left out.

    sets: key, n (its size) and c (``prefixes``) of each set, at least once. packed: from a table with the column key to
    (key, s), the sorted elements of these sets, 64 bits each. Only sets that share an element of their prefixes with
    another one are asked for. In each home all pairs are compared, and a forest of the links found is returned: a group
    of any size costs a link for each member. A home of more than ``part`` sets is several tasks, one for each pair of
    its parts.
    """
    part = part or PART
    member = homes(sets, similarity)
    size = member.groupBy("t", "z").agg(F.count("*").alias("n"), F.sum("m").alias("m")).where("n > 1").select("t", "z", F.ceil(F.greatest(F.col("n") / part, F.col("m") / ELEMENTS)).cast("int").alias("parts"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    pair: Callable[[Column], Column] = lambda q: F.struct(F.least("p", q).alias("i"), F.greatest("p", q).alias("j"))
    dealt = cut(member.join(size, ["t", "z"]).withColumn("p", bucket(F.col("x"), F.col("parts"), 3)).select("x", "t", "z", "p", F.explode(F.transform(every, pair)).alias("b")).select("x", "t", "z", "p", "b.i", "b.j"))
    wanted = cut(sets.select("key", F.xxhash64("key").alias("x")).join(dealt.select("x").distinct(), "x").distinct())
    groups = pieces(dealt.count(), ROWS)
    placed = dealt.withColumn("g", bucket(F.struct("t", "z", "i", "j"), groups)).join(wanted, "x").drop("x")

    def compare(t: pa.Table) -> pa.Table:
        keys, packs = t.column("key").to_pylist(), t.column("s").to_pylist()
        names = [t.column(c).to_numpy() for c in ("j", "i", "z", "t")]
        order, p = np.lexsort(names), t.column("p").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in names], axis=0), [True]]))
        a, b = [], []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            at = order[lo:hi]
            i, j = names[1][at[0]], names[0][at[0]]
            for u, v in linked([np.frombuffer(packs[k], np.uint64) for k in at], p[at] == i, p[at] == j, similarity):
                a.append(keys[at[u]])
                b.append(keys[at[v]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    both = packed(wanted.select("key")).join(placed, "key").select("g", "t", "z", "i", "j", "p", "key", "s")
    out = cut(both.groupBy("g").applyInArrow(compare, "a binary, b binary"))
    drop(member, dealt, wanted)
    return out
