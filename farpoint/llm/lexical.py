"""Ranked lexical search: compressed postings by shard, merged document at a time, the shards' best merged globally."""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.llm.common import bucket, cut, drop, pieces, slices, text_batches

K = 10
#: Bytes of text in a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 16 << 20
#: Items that are searched together in a shard.
ITEMS = 256
#: Postings, about, of an item's heaviest terms that are merged to find a bound that its k best documents reach.
OPENING = 2_000
#: Candidates whose light terms are looked up together.
WINDOW = 1_024
#: Bytes to bytes: A-Z in lower case, all other ASCII but digits and letters to a blank, what is not ASCII stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

KIND = "shard long, term string, n long, total long, at binary, freq binary"


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, only A-Z in lower case."""
    return text.translate(FOLD).split()


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes of seven bits, low ones first and the last one below 128; and the number of bytes of each."""
    size = np.ones(len(x), np.int64)
    for bits in range(7, 63, 7):
        size += x >> bits > 0
    out, start = np.empty(size.sum(), np.uint8), np.cumsum(size) - size
    for k in range(size.max(initial=0)):
        on = size > k
        out[start[on] + k] = (x[on] >> (7 * k)) & 127 | (size[on] > k + 1).astype(np.int64) << 7
    return out, size


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)


class Ids(dict):
    """Numbers from 0 in the order in which keys come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def binary(data: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def built(shard: int, docs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """One shard: a row of its documents in the order of their ids, and a row for each term with the places of its documents as gaps."""
    docs.sort(key=lambda d: d[0])
    known, term, freq, ids, lengths, each = Ids(), array("q"), array("q"), [], [], []
    for i, text in docs:
        if found := Counter(terms(text)):
            term.extend(map(known.__getitem__, found))
            freq.extend(found.values())
            ids.append(i)
            lengths.append(found.total())
            each.append(len(found))
    if not ids:
        return
    data, _ = packed(np.array(lengths))
    row = [[shard], [None], [len(ids)], [sum(lengths)], [np.array(ids, np.int64).tobytes()], [data.tobytes()]]
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    names = [c.split()[0] for c in KIND.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=names)

    term, freq = np.frombuffer(term, np.int64), np.frombuffer(freq, np.int64)
    order = np.argsort(term, kind="stable")  # by term, then by document
    term, freq, place = term[order], freq[order], np.repeat(np.arange(len(ids)), each)[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    gap = np.concatenate([[0], np.diff(place)])
    gap[first] = place[first]
    columns = [pa.array(np.full(len(first), shard)), pa.array([t.decode() for t in known], pa.string()), pa.array(np.diff(np.concatenate([first, [len(term)]]))), pa.array(np.add.reduceat(freq, first))]
    for x in (gap, freq):
        data, size = packed(x)
        columns.append(binary(data, np.add.reduceat(size, first), pa.binary()))
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for i in range(0, whole.num_rows, 20_000):
        yield whole.slice(i, 20_000)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", each: int = SHARD_BYTES) -> DataFrame:
    """The inverted index of whole texts, a table in the shared folder: shard, term, n, total, at, freq.

    A task makes a shard of each ``each`` bytes of the text it reads; texts are never shuffled. Per shard and term: n
    documents with total occurrences, at: their places in the shard's order of ids, as gaps, freq: the occurrences in
    each, both in bytes of seven bits. The row of a null term has the shard's documents: at: their ids, 8 bytes each,
    freq: their numbers of terms. Documents without a term (null and empty texts too) and rows without an id take no
    part. Repeated rows are documents of their own.
    """
    src = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in (x for batch in batches for x in slices(batch, 1)):
            held += zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)
            size += b.column(1).nbytes
            if size >= each:
                yield from built(shard, held)
                shard, held, size = shard + 1, [], 0
        yield from built(shard, held)

    return cut(text_batches(src).mapInArrow(run, KIND))


def asked(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): each item's terms once. Rows of one item_id are one item; rows without one are none."""
    src = items.where(F.col(f"`{item_id}`").isNotNull()).select(F.col(f"`{item_id}`").alias("item_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    kind = src.select("item_id", F.col("t").alias("term")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [{t.decode() for t in terms(x)} for x in b.column(1).cast(pa.binary()).to_pylist()]
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([t for x in found for t in sorted(x)], pa.string())], names=["item_id", "term"])

    return text_batches(src).mapInArrow(run, kind).distinct()


class Postings:
    """A term's documents in ascending order and what it adds to the score of each."""

    def __init__(self, docs: np.ndarray, adds: np.ndarray):
        self.docs, self.adds, self.most = docs, adds, int(adds.max())

    def of(self, docs: np.ndarray) -> np.ndarray:
        """What it adds to each of ``docs``."""
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[at] == docs, self.adds[at], 0)


def best(lists: list[Postings], k: int, bar: int = 1) -> list[tuple[int, int]]:
    """(score, document) of the k highest scores of ``bar`` or more, best first, ties to the smaller document.

    Cursors stand in a heap by their next document: the least is taken, with all cursors that stand there. Once k
    documents are held in the bounded heap, or by ``bar``, a score has to reach ``need``; lists that cannot reach it
    all together are not merged, but looked up for the documents that may still reach it with them.
    """
    lists = sorted(lists, key=lambda x: x.most)
    upto = np.cumsum([0, *(x.most for x in lists)]).tolist()  # what the lists before can add
    need, light, held, cursors = max(bar, 1), 0, [], []
    docs, adds, at = [None] * len(lists), [None] * len(lists), [0] * len(lists)

    def divide() -> list[tuple[int, int]]:
        nonlocal light
        while light < len(lists) and upto[light + 1] < need:
            light += 1
        return [c for c in cursors if c[1] >= light]

    divide()
    for i in range(light, len(lists)):
        docs[i], adds[i] = lists[i].docs.tolist(), lists[i].adds.tolist()
        cursors.append((docs[i][0], i))
    heapq.heapify(cursors)
    while cursors:
        found, scores, rest = [], [], upto[light]
        while cursors and len(found) < WINDOW:
            d, s = cursors[0][0], 0
            while cursors and cursors[0][0] == d:
                i = cursors[0][1]
                s += adds[i][at[i]]
                at[i] += 1
                if at[i] < len(docs[i]):
                    heapq.heapreplace(cursors, (docs[i][at[i]], i))
                else:
                    heapq.heappop(cursors)
            if s + rest >= need:
                found.append(d)
                scores.append(s)
        found, scores = np.array(found, np.int64), np.array(scores, np.int64)
        for i in range(light - 1, -1, -1):
            may = scores + upto[i + 1] >= need
            found, scores = found[may], scores[may]
            scores = scores + lists[i].of(found)
        for d, s in zip(found.tolist(), scores.tolist(), strict=True):
            if s >= need:
                (heapq.heappush if len(held) < k else heapq.heappushpop)(held, (s, -d))
                if len(held) == k:
                    need = max(need, held[0][0] + 1)  # later documents lose ties
        before = light
        cursors = divide()
        if light > before:
            heapq.heapify(cursors)
    return [(s, -d) for s, d in sorted(held, reverse=True)]


def opening(lists: list[Postings], k: int) -> list[tuple[int, int]]:
    """(score, document) of up to k documents that do well in the heaviest terms: their whole scores, not surely the best ones."""
    lists = sorted(lists, key=lambda x: -x.most)
    size = np.cumsum([len(x.docs) for x in lists])
    lead = best(lists[: max(1, int(np.searchsorted(size, OPENING)))], k)
    docs = np.array([d for _, d in lead], np.int64)
    return [(int(s), d) for s, (_, d) in zip(sum(x.of(docs) for x in lists), lead, strict=True)] if lead else []


def search(table: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of ``table`` (see ``index``) for each of ``items`` (see ``asked``), ties to the smaller doc_id; fewer, if fewer score above 0.

    With N documents of L terms in all, a term in df of them weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); of a
    document of n terms, m = 10 + 90nN div L; a term that occurs tf times adds w * (1000000000tf div (1000tf + 8m)).

    A shard's postings of the terms of a block of ITEMS items meet in one task, which merges them item by item
    (``best``). Before that, each shard scores a few promising documents of each item (``opening``): what k of these
    reach over all shards, the item's k best reach as well, so all shards start from that bound. A shard gives k rows for an
    item at most, and tasks leave out all but the first k of theirs before the global merge. Empty tables give empty ones.
    """
    docs, lists = table.where("term is null"), table.where("term is not null")
    count, length = docs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    blocks = pieces(items.select("item_id").distinct().count(), ITEMS)
    df = lists.join(items.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(count) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = cut(items.join(df, "term").select("item_id", "term", weight.alias("w"), bucket(F.col("item_id"), blocks).alias("block")).where("w > 0"))
    item_type = items.schema["item_id"].dataType

    def merged(bars: DataFrame | None) -> DataFrame:
        """The shards' best for each item, or without bars the documents that open."""
        w = weighed.join(bars, "item_id", "left") if bars else weighed.withColumn("bar", F.lit(1).cast("long"))
        w = w.groupBy("term", "block", "w").agg(F.collect_list(F.struct("item_id", F.coalesce("bar", F.lit(1)).cast("long").alias("bar"))).alias("for"))  # ITEMS at most
        none, opens = F.lit(None), bars is None
        rows = lists.join(w, "term").select("shard", "block", "w", "for", "at", "freq")
        every = docs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), none.cast("long").alias("w"), none.cast(w.schema["for"].dataType).alias("for"), "at", "freq")

        def run(group: pa.Table) -> pa.Table:
            ids, m, found = None, None, {}
            at, freq, w, whom = (group.column(c).to_pylist() for c in ("at", "freq", "w", "for"))
            for i in range(len(at)):
                if w[i] is None:
                    ids = np.frombuffer(at[i], np.int64)
                    m = 10 + 90 * unpacked(freq[i]) * count // length
            for i in range(len(at)):
                if w[i] is not None:
                    d, tf = np.cumsum(unpacked(at[i])), unpacked(freq[i])
                    p = Postings(d, w[i] * (1_000_000_000 * tf // (1_000 * tf + 8 * m[d])))
                    for x in whom[i]:
                        found.setdefault(x["item_id"], (x["bar"], []))[1].append(p)
            out = [(item, int(ids[d]), s) for item, (bar, postings) in found.items() for s, d in (opening(postings, k) if opens else best(postings, k, bar))]
            return pa.table([pa.array(x, group.schema.field("for").type.value_type.field("item_id").type if j == 0 else pa.int64()) for j, x in enumerate(zip(*out, strict=True) if out else ([], [], []))], names=["item_id", "doc_id", "score"])

        kind = weighed.select("item_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).schema
        found = rows.unionByName(every).groupBy("shard", "block").applyInArrow(run, kind)
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    bars = cut(merged(None).where(F.col("rank") == k).select("item_id", F.col("score").alias("bar")))
    out = cut(merged(bars).select(F.col("item_id").cast(item_type), "rank", "doc_id", "score"))
    drop(bars, weighed)
    return out


def search_sql(k: int = K) -> str:
    """The same as SQL: ``benchmark`` against ``documents``."""
    found = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"
    return f"""
    WITH o AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {found} FROM documents) GROUP BY ALL),
    q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {found} FROM benchmark)),
    d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM o GROUP BY doc_id),
    s AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM d),
    f AS (SELECT term, count(*) AS df FROM o GROUP BY term),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, s),
    r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_docs) // all_terms)))) AS BIGINT) AS score
          FROM q JOIN o USING (term) JOIN w USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {k}
    """
