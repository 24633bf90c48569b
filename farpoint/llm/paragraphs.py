"""Substring dedup: paragraphs that repeat, found by the similarity join of their shingles, and passages, found by hashes of runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm import alike
from farpoint.llm.common import cut, drop, fresh, maybe_in, sieve, slices, spread_join, text_batches
from farpoint.llm.components import components
from farpoint.llm.shingling import rolled, shingle_hashes, word_hashes, words_of

#: Words of a shingle, of the shortest paragraph, of the shortest passage of which a run is surely found, and of a run.
K, LINE, WORDS, RUN = 5, 20, 50, 30
#: Different words that a paragraph or a run has at least; what repeats one word is no passage.
DIFFERENT = 10
#: Paragraphs that a part of a home (``alike.homes``) holds.
PART = 2_000


def chosen(h: np.ndarray, counts: np.ndarray, window: int, length: int) -> np.ndarray:
    """Places in ``h`` of the runs that stand for their texts: of each ``window`` successive runs of a text the one of least hash (the first of equals), of fewer runs the one.

    ``counts``: the words of each text; ``h`` has the hash of the run of ``length`` words from each word of all texts
    on. What is chosen depends on the words alone: two texts that share length + window - 1 successive words choose a
    run in them alike, and what they choose there leaves no word between two runs, if window <= length.
    """
    begins = np.cumsum(counts) - counts
    runs = counts - length + 1
    full = runs >= window
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, begins[full], 1)
    np.add.at(edge, (begins + runs - window + 1)[full], -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    got = [[b + int(h[b : b + n].argmin()) for b, n in zip(begins[~full & (runs > 0)].tolist(), runs[~full & (runs > 0)].tolist(), strict=True)]]
    if len(at):
        view = np.lib.stride_tricks.sliding_window_view(h, window)
        got += [at[i : i + (1 << 16)] + view[at[i : i + (1 << 16)]].argmin(1) for i in range(0, len(at), 1 << 16)]
    return np.unique(np.concatenate(got)).astype(np.int64)


def different(x: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """How many different words each run has."""
    out = np.zeros(len(at), np.int64)
    for i in range(0, len(at), 1 << 16):
        w = np.sort(x[at[i : i + (1 << 16), None] + np.arange(length)], axis=1)
        out[i : i + (1 << 16)] = 1 + (w[:, 1:] != w[:, :-1]).sum(1)
    return out


def keyed(docs: DataFrame, text: str, id_: str) -> DataFrame:
    """i, h (which together are the document) and the text."""
    return docs.select(F.col(f"`{id_}`").alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).select("i", F.xxhash64("t").alias("h"), "t")


def paragraphs(docs: DataFrame, text: str, id_: str, similarity: float, line: int, least: int, run: int = RUN) -> DataFrame:
    """Rows of two kinds, all with i and h (the document) and a (the first word in it). For each line of at least
    ``line`` words: p (the line), key (128-bit hash of its words), n (the size of its set of shingles) and c (the set's
    prefix). For the runs of ``run`` words that stand
    for the document, whatever its lines: k and k2 (64-bit hashes of their words)."""
    src = keyed(docs, text, id_)
    none = F.lit(None).cast
    schema = src.select("i", "h", none("int").alias("p"), none("int").alias("a"), none("binary").alias("key"), none("long").alias("n"), none("array<long>").alias("c"), none("long").alias("k"), none("long").alias("k2")).schema
    window, fewest = least - run + 1, min(DIFFERENT, line, run)
    lines_of = lambda t: [shingle_hashes(w, K) for w in map(words_of, t.split("\n")) if len(w) >= line and len(set(w)) >= fewest]
    known = docs.sparkSession.sparkContext.broadcast(alike.frequent(src, src.count(), lines_of))

    def out(b: pa.RecordBatch, at, p, a, key, n, lists, k, k2) -> pa.RecordBatch:
        who = b.select([0, 1]).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*who.columns, pa.array(p, pa.int32()), pa.array(a, pa.int32()), pa.array(key, pa.binary()), pa.array(n, pa.int64()), lists, pa.array(k, pa.int64()), pa.array(k2, pa.int64())], names=["i", "h", "p", "a", "key", "n", "c", "k", "k2"])

    def of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every, counts, lines = [], [], []
        for r, t in enumerate(b.column(2).to_pylist()):
            begin = len(every)
            for q, one in enumerate(t.split("\n")):
                w = words_of(one)
                if len(w) >= line and len(set(w)) >= fewest:
                    lines.append((r, q, len(every) - begin, xxhash.xxh3_128_digest(b" ".join(w)), len(every), len(w)))
                every += w
            counts.append(len(every) - begin)
        x, counts = word_hashes(every), np.array(counts, np.int64)
        if lines:
            r, p, a, key, first, n = zip(*lines, strict=True)
            many = np.maximum(np.array(n) - K + 1, 0)
            ends = np.cumsum(many)
            place = np.repeat(np.array(first) - (ends - many), many) + np.arange(ends[-1])
            c, length, size = alike.prefixes(rolled(x, K)[place], many, known.value, similarity)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(c.view(np.int64)))
            none = [None] * len(r)
            yield out(b, r, p, a, key, size, lists, none, none)
        h = rolled(x, run)
        at = chosen(h, counts, window, run)
        at = at[different(x, at, run) >= fewest]
        if len(at):
            ends = np.cumsum(counts)
            r = np.searchsorted(ends, at, "right")
            none = [None] * len(at)
            yield out(b, r, none, at - (ends - counts)[r], none, none, pa.nulls(len(at), pa.list_(pa.int64())), h[at].view(np.int64), rolled(x, run, 1)[at].view(np.int64))

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2):
                yield from of(b)

    return text_batches(src).mapInArrow(run_, schema)


def shingle_sets(docs: DataFrame, text: str, id_: str, wanted: DataFrame) -> DataFrame:
    """(key, s): the distinct shingle hashes of the paragraphs that ``wanted`` (i, h, p, key) names, packed. Only texts that a filter of fixed size lets through are shuffled."""
    lines = wanted.groupBy("i", "h").agg(F.collect_list(F.struct("p", "key")).alias("w")).withColumnsRenamed({"i": "i2", "h": "h2"})
    src = keyed(docs, text, id_).where(maybe_in(sieve(wanted, "h"), "h"))
    both = src.join(lines, F.col("i").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))).select("t", F.col("w.p").alias("p"), F.col("w.key").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0):
                keys, sets = [], []
                for t, p, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    line = t.split("\n")
                    for q, x in zip(p, k, strict=True):
                        keys.append(x)
                        sets.append(np.unique(shingle_hashes(words_of(line[q]), K)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "s"])

    # rows that repeat an id and its text name a paragraph twice
    return text_batches(both).mapInArrow(run, "key binary, s binary").groupBy("key").agg(F.first("s").alias("s"))


def classes(found: DataFrame, docs: DataFrame, text: str, id_: str, similarity: float) -> DataFrame:
    """(key, root) of the paragraphs that are linked to another text: components of all links at the similarity.

    ``found``: a row for each distinct paragraph: key, n and c (``paragraphs``), and its first place i, h, p. Variants
    of a text cost a link each, however many they are, and no link is lost (``alike.links``).
    """
    links = alike.links(found.select("key", "n", "c"), lambda keys: shingle_sets(docs, text, id_, found.select("key", "i", "h", "p").join(keys, "key")), similarity, PART)
    roots = components(links).withColumnRenamed("node", "key")
    drop(links)
    return roots


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, line: int = LINE, least: int = WORDS, run: int = RUN, with_hash: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_paragraphs (lines of ``line`` words or more), n_repeated (those that have an
    equal or near one anywhere), n_removed and removed (lines to remove, from 0: all of a class but its first by
    doc_id, text and line), n_runs (runs of words that occur elsewhere word by word), spans (where they are to be
    removed, in words of the document: first and words; of all but the first occurrence; spans may overlap), keepers
    (the other documents that keep what is removed here) and classes (64-bit class ids of the repeated paragraphs).

    Paragraphs are lines; words are in lower case and parted by ASCII white space. Two are linked if the Jaccard
    similarity of their sets of five-word shingles is at least ``similarity``; classes are the components of all links.
    Equal paragraphs are one from the start. Passages that repeat word by word are found wherever they stand, inside lines, as lines or over
    several, each document's lines in its own way: by runs of ``run`` words of the document, chosen by their words
    alone (``chosen``). Of a passage of ``least`` words or more one run at least is found, and all its words but at
    most least - run at each end lie in found runs; of shorter ones, runs may be found, below ``run`` words none. An
    occurrence that overlaps the first one stays. Lines and runs of fewer than DIFFERENT different words (a word over
    and over) are no paragraphs. Null texts have no paragraphs; null ids come last; whole repeats of a row (id and
    text) share one decision. An empty table gives an empty result; other columns are not read.

    The rows of a paragraph or run that very many documents share are dealt over many tasks (``spread_join``).
    """
    where = [F.col("i").isNull().alias("z"), F.col("i"), F.col("h"), F.col("a")]
    place = F.struct(*where)
    seen = cut(paragraphs(docs, text, doc_id, similarity, line, least, run))

    lines = seen.where(F.col("key").isNotNull())
    found = cut(lines.groupBy("key").agg(F.min(F.struct(*where, "p")).alias("o"), F.max(place).alias("e"), F.first(F.struct("n", "c")).alias("s"), F.count("*").alias("m")).select("key", F.struct("o.z", "o.i", "o.h", "o.a").alias("o"), "e", "s.n", "s.c", "m", "o.i", "o.h", "o.p"))
    roots = classes(found.select("key", "n", "c", "i", "h", "p"), docs, text, doc_id, similarity)
    kept = found.select("key", "o", "e").join(roots, "key", "left").withColumn("class", F.coalesce("root", "key"))
    first = kept.groupBy("class").agg(F.min("o").alias("keep"), F.max("e").alias("last")).where(~F.col("keep").eqNullSafe(F.col("last")))
    label = cut(kept.select("key", "class").join(first.select("class", "keep"), "class").select("key", F.xxhash64("class").alias("class"), "keep"))
    whole = spread_join(lines.select("i", "h", "p", "a", "key"), label, ["key"], found.where("m > 1").select("key", F.col("m").alias("n")), ["i", "h", "a"], "left")

    runs = seen.where(F.col("k").isNotNull()).select("i", "h", "a", "k", "k2")
    several = cut(runs.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    hits = cut(spread_join(runs, several.select("k"), ["k"], several, ["i", "h", "a"]))
    at = F.xxhash64("i", "h", "a")
    again = cut(hits.groupBy("k", "k2").agg(F.min(place).alias("keep"), F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("k", "k2", "keep", "n"))
    inner = spread_join(hits, again.drop("n"), ["k", "k2"], again.select("k", "k2", "n"), ["i", "h", "a"])

    marked = whole.select("i", "h", "p", "a", "class", "keep").unionByName(inner.select("i", "h", "a", "keep"), allowMissingColumns=True)
    is_line, same = F.col("p").isNotNull(), F.col("i").eqNullSafe(F.col("keep.i")) & (F.col("h") == F.col("keep.h"))
    gone = F.col("keep").isNotNull() & ~(same & (F.col("a") >= F.col("keep.a")) & (F.col("a") < F.col("keep.a") + F.when(is_line, 1).otherwise(run)))
    set_of = lambda when, c: F.sort_array(F.collect_set(F.when(when, c)))
    per = cut(
        marked.groupBy("i", "h").agg(
            F.size(F.collect_set(F.col("p"))).cast("long").alias("n_paragraphs"),
            F.size(F.collect_set(F.when(F.col("keep").isNotNull(), F.col("p")))).cast("long").alias("n_repeated"),
            set_of(gone & is_line, F.col("p")).alias("removed"),
            F.size(F.collect_set(F.when(~is_line, F.col("a")))).cast("long").alias("n_runs"),
            set_of(gone & ~is_line, F.struct(F.col("a").alias("first"), F.lit(run).alias("words"))).alias("spans"),
            set_of(gone & F.col("keep.i").isNotNull() & ~F.col("i").eqNullSafe(F.col("keep.i")), F.col("keep.i")).alias("keepers"),
            set_of(F.lit(True), F.col("class")).alias("classes"),
        )
    )
    drop(seen, found, roots, label, several, hits, again)
    own = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("__h") == F.col("h"))
    out = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__h")).join(per, own, "left")
    kind = dict(per.dtypes)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    array = lambda c: F.coalesce(c, F.array().cast(kind[c])).alias(c)
    more = [F.col("__h").alias("hash")] if with_hash else []
    return out.select("doc_id", *more, count("n_paragraphs"), count("n_repeated"), F.size(array("removed")).cast("long").alias("n_removed"), array("removed"), count("n_runs"), array("spans"), array("keepers"), array("classes"))


def without(text: str, removed: list[int], spans: list[dict]) -> str:
    """``text`` without the lines ``removed`` and the words that ``spans`` cover; overlapping spans count once, and lines that lose all their words go."""
    gone, lines = set(removed), text.split("\n")
    words = [line.encode().split() for line in lines]
    begins = np.cumsum([0, *map(len, words)])
    inside = np.zeros(begins[-1], bool)
    for s in spans:
        inside[s["first"] : s["first"] + s["words"]] = True
    out = []
    for p, line in enumerate(lines):
        if p in gone:
            continue
        lost = inside[begins[p] : begins[p + 1]]
        if lost.any():
            if lost.all():
                continue
            line = b" ".join(w for w, x in zip(words[p], lost, strict=True) if not x).decode()
        out.append(line)
    return "\n".join(out)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with all rows and columns, without the lines and the spans that ``repeats`` removes; lines that lose a span have single blanks between their other words. Null, empty and repeated rows, and empty tables: as there."""
    cols = docs.columns
    h, i, k, r, s = fresh(cols, "h", "i", "k", "r", "s")
    keyed_ = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    found = repeats(docs, doc_id, text, with_hash=True, **how).where("n_removed > 0 or size(spans) > 0")
    found = found.select(F.col("doc_id").alias(i), F.col("hash").alias(k), F.col("removed").alias(r), F.col("spans").alias(s)).distinct()
    out = keyed_.join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col(i)) & (F.col(h) == F.col(k)), "left").select(*[f"`{c}`" for c in cols], r, s)
    at = cols.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [t if t is None or r is None else without(t, r, s) for t, r, s in zip(b.column(at).to_pylist(), b.column(len(cols)).to_pylist(), b.column(len(cols) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else b.column(k) for k in range(len(cols))], names=cols)

    return text_batches(out).mapInArrow(run, docs.schema)
