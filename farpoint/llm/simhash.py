"""SimHash near-dedup: meet-in-the-middle ball hashing of fingerprints; near copies by the similarity of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm import alike
from farpoint.llm.alike import frequent, prefixes
from farpoint.llm.common import cut, drop, fresh, maybe_in, pieces, sieve, slices, text_batches
from farpoint.llm.components import components
from farpoint.llm.shingling import rolled, shingle_hashes, word_hashes, words_of

RADIUS = 3
#: A bucket group holds about so many variants.
GROUP = 1_500_000
#: Fingerprints that a task spreads at a time.
CHUNK = 2048


def shingles(text: str | None, k: int) -> list[bytes]:
    """Shingles of k words of the whole text, repeats included: A-Z in lower case, words parted by ASCII white space, joined by a space. Fewer words: the whole sequence. No word: none."""
    words = (text or "").encode().lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    return [joined[a:b] for a, b in zip(starts, ends[k - 1 :], strict=False)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the rows of ``hashes`` (n x bytes), as bytes."""
    n, width = hashes.shape
    total = np.zeros(width * 8, np.int64)
    for i in range(0, n, 255 * 256):
        bits = np.unpackbits(hashes[i : i + 255 * 256], axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, width * 8).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)  # 255 ones fit in a byte
        total += bits[whole:].sum(0, dtype=np.uint8)
    return np.packbits(total * 2 > n, bitorder="little")


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """64 bits of XXH64 over the shingles; no word: 0."""
    s = shingles(text, k)
    if not s:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in s), np.uint64, len(s))
    return int(majority(h.astype("<u8").view(np.uint8).reshape(-1, 8)).view("<u8")[0])


def masks(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What is flipped in ``bits`` bits: nothing, one bit, and two bits of the same half; and how many that is.

    Fingerprints at distance 2 meet if each flips one bit. At distance 1 or 3 one has an even number of bits set and
    the other an odd one; of three differing bits two lie in the same half, the even one flips these two and the odd
    one the third. So only even fingerprints need the pairs, and only pairs within a half: half the radius on one side,
    the rest of it on the other.
    """
    one = [1 << i for i in range(bits)]
    half = bits // 2
    two = [one[i] | one[j] for lo, hi in ((0, half), (half, bits)) for i in range(lo, hi) for j in range(i + 1, hi)]
    return np.array([0, *one, *two], np.uint64), np.array([0] + [1] * bits + [2] * len(two), np.uint8)


def spread(fps: np.ndarray, bits: int, groups: int, salt: int = 0) -> Iterator[tuple[int, bytes]]:
    """(group, packed entries) of all variants of ``fps`` (distinct); an entry is the fingerprint and the mask's number, and equal variants go to the same group."""
    m, size = masks(bits)
    odd = np.bitwise_count(fps) % 2 == 1
    few = int((size < 2).sum())
    for part, codes in ((fps[~odd], len(m)), (fps[odd], few)):
        for i in range(0, len(part), CHUNK):
            f = part[i : i + CHUNK]
            v = (f[:, None] ^ m[None, :codes]).ravel()
            g = group_of(v, groups, salt)
            order = np.argsort(g, kind="stable")
            fp, code = np.repeat(f, codes)[order], np.tile(np.arange(codes, dtype=np.uint16), len(f))[order]
            at = np.searchsorted(g[order], np.arange(groups + 1))
            for x in np.flatnonzero(np.diff(at)):
                a, b = at[x], at[x + 1]
                yield int(x), np.uint32(b - a).tobytes() + fp[a:b].tobytes() + code[a:b].tobytes()


def group_of(variants: np.ndarray, groups: int, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (variants + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)


def unpack(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    fp, code = [], []
    for p in payloads:
        n = int(np.frombuffer(p, np.uint32, 1)[0])
        fp.append(np.frombuffer(p, np.uint64, n, 4))
        code.append(np.frombuffer(p, np.uint16, n, 4 + 8 * n))
    return (np.concatenate(fp), np.concatenate(code)) if fp else (np.zeros(0, np.uint64), np.zeros(0, np.uint16))


def meet(fp: np.ndarray, code: np.ndarray, bits: int, radius: int = RADIUS) -> np.ndarray:
    """Links (member, hub) among the entries that share a variant, each link once and verified.

    A variant's hub is the least fingerprint at most one flip away from it. All others within one flip are at most 2
    bits from the hub, those two flips away at most 3. Two fingerprints that both flip two bits need no link here: at
    distance 2 they also share a variant one flip from both. So a group of any size costs a link for each member and
    variant, and every pair within the radius is linked through some hub.
    """
    m, size = masks(bits)
    v, r = fp ^ m[code], size[code] == 2
    order = np.lexsort((fp, r, v))
    v, r, fp = v[order], r[order], fp[order]
    first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0)) if len(v) else np.zeros(0, np.int64)
    hub = fp[head]
    ok = ~r[head] & (hub != fp) if len(v) else np.zeros(0, bool)
    links = np.unique(np.stack([fp[ok], hub[ok]], 1), axis=0)
    return links[np.bitwise_count(links[:, 0] ^ links[:, 1]) <= radius]


def links(fps: DataFrame, count: int, bits: int = 64) -> DataFrame:
    """Links a, b (signed 64-bit) between the distinct fingerprints ``fp`` (64-bit) that are within 3 bits, through hubs."""
    n = pieces(count * (len(masks(bits)[0]) + bits + 1) // 2, GROUP)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(x), CHUNK):
                got = list(spread(x[i : i + CHUNK], bits, n))
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.int32()), pa.array([p for _, p in got], pa.binary())], names=["g", "p"])

    def back(t: pa.Table) -> pa.Table:
        got = meet(*unpack(t.column("p").to_pylist()), bits)
        return pa.table({"a": pa.array(got[:, 0].copy().view(np.int64)), "b": pa.array(got[:, 1].copy().view(np.int64))})

    return fps.select("fp").mapInArrow(out, "g int, p binary").repartition(n, "g").groupBy("g").applyInArrow(back, "a long, b long")


def with_fingerprint(docs: DataFrame, text: str = "text", k: int = 3, others: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``others`` of every document and ``fp``, the fingerprint of its whole text as a signed 64-bit number."""
    src = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("__t"))
    schema = src.select(*[f"`{c}`" for c in others], F.lit(None).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.fromiter((fingerprint(t, k) for t in b.column(b.num_columns - 1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(f.view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    return text_batches(src).mapInArrow(run, schema)


def simhash(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable over links.

    Null and empty texts have fingerprint 0 and are linked like any other. A null doc_id is never a component's id,
    unless its component has no other. Repeated rows stay repeated. An empty table gives an empty result; other
    columns are not read. Texts are never shuffled. Copies meet in an aggregate that is summed before its shuffle, so
    a group of any size is one fingerprint from then on; no pair of copies is ever made.
    """
    marked = cut(with_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", k))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps, fps.count()))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = named.join(least, "root").select("fp", "component_id")
    return marked.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by text: the similarity join of the sets of shingles.


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(key, s): the distinct shingles, as 64-bit hashes, of the documents that ``wanted`` (key, i, h) names.

    A filter of fixed size lets these documents through, and few others; so only their texts are shuffled.
    """
    bits = sieve(wanted, "h")
    some = docs.where(maybe_in(bits, "h")).select("i", "h", "t")
    both = some.join(wanted.withColumnsRenamed({"i": "i2", "h": "h2"}), F.col("i").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))).select("key", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                s = [np.unique(shingle_hashes(words_of(t), k)).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.binary())], names=["key", "s"])

    return text_batches(both).mapInArrow(run, "key binary, s binary").groupBy("key").agg(F.first("s").alias("s"))


def marked(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """i, h, key (128-bit hash of the words in lower case), n (the number of different shingles of k words) and c (the prefix of their set) of each of ``docs`` (i, h, t)."""
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, docs.count(), lambda t: [shingle_hashes(words_of(t), k)]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2):
                words = [words_of(t) for t in b.column(2).to_pylist()]
                keys = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
                hashes = [rolled(word_hashes(w), max(1, min(k, len(w)))) for w in words]
                c, length, n = prefixes(np.concatenate(hashes), np.array(list(map(len, hashes))), known.value, similarity)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(c.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), lists], names=["i", "h", "key", "n", "c"])

    schema = docs.select("i", "h", F.lit(b"").alias("key"), F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("c")).schema
    return text_batches(docs).mapInArrow(mark, schema)


def near_groups(docs: DataFrame, seen: DataFrame, texts: DataFrame, k: int = 5, similarity: float = 0.8, part: int | None = None) -> DataFrame:
    """(key, least): the groups of near copies among ``texts`` (key, and i, h of one document each) of ``docs`` (i, h, t); ``seen``: ``marked``.

    Texts are linked if the Jaccard similarity of their sets of k-word shingles is at least ``similarity``; groups are
    the components of the links. No link is lost: all pairs that can be at the similarity meet (``alike.links``), and
    are compared on their whole sets, as 64-bit hashes.
    """
    found = alike.links(seen.select("key", "n", "c"), lambda keys: sets_of(docs, texts.join(keys, "key").select("key", "i", "h"), k), similarity, part)
    roots = components(found)
    drop(found)
    return roots.select(F.col("node").alias("key"), F.col("root").alias("least"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, with its columns, with one document of each group of copies and near copies: the one of least doc_id.

    Groups are those of ``near_groups``; copies that differ in case or white space alone are always in one. Null ids
    come last; of rows that repeat an id and its text one stays: the one of least hash of all its columns but maps.
    Texts without words, null ones too, are copies of each other. An empty table gives an empty table.

    Documents meet only in aggregates summed before their shuffle: the least of each key, then of each group. Only
    documents that go, and repeated rows, are joined with the decision (``sieve``); all others stay where they lie.
    """
    cols = docs.columns
    i, h, n, keep = fresh(cols, "i", "h", "n", "keep")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    src = docs.select(F.col(f"`{doc_id}`").alias("i"), F.xxhash64(t).alias("h"), t.alias("t"))
    seen = cut(marked(src, k, similarity))
    order = F.struct(F.col("i").isNull().alias("z"), "i", "h")
    texts = cut(seen.groupBy("key").agg(F.min(order).alias("o")).select("key", "o", "o.i", "o.h"))
    groups = near_groups(src, seen, texts, k, similarity)
    kept = texts.join(groups, "key", "left").groupBy(F.coalesce("least", "key").alias("g")).agg(F.min("o").alias("o")).select(F.col("o.i").alias("i2"), F.col("o.h").alias("h2"), F.lit(True).alias("keep"))
    rows = seen.groupBy("i", "h").agg(F.count("*").alias("n"))
    said = rows.join(kept, F.col("i").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left").where("keep is null or n > 1")
    said = cut(said.select(F.col("i").alias("i2"), F.col("h").alias("h2"), F.coalesce("keep", F.lit(False)).alias("keep")))
    drop(seen, texts, groups)
    bits = sieve(said, "h2")
    keyed = docs.withColumns({i: F.col(f"`{doc_id}`"), h: F.xxhash64(t)})
    maybe = maybe_in(bits, h)
    said = said.withColumnsRenamed({"i2": n + "i", "h2": n + "h", "keep": keep})
    asked = keyed.where(maybe).join(said, F.col(i).eqNullSafe(F.col(n + "i")) & (F.col(h) == F.col(n + "h")), "left").where(F.col(keep).isNull() | F.col(keep))
    stay = [f"`{c}`" for c in cols]
    other = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    once = asked.where(keep).groupBy(i, h).agg(F.min_by(F.struct(*stay), other).alias(n)).select(f"{n}.*")
    return keyed.where(~maybe).select(*stay).union(asked.where(F.col(keep).isNull()).select(*stay)).union(once)
