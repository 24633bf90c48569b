"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the halves of words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import bucket, cut, drop, pieces
from farpoint.llm.sqltext import crc32

# What a word is made of, its least length and number of occurrences, the share of runs that lose a letter, how much more frequent a form is.
LETTERS = "[A-Za-zÀ-ÿ]"
LENGTH, OCCURRENCES, SLIPS, RATIO = 6, 5, 199, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments of a shard's automaton, about.
SEGMENTS = 20_000
#: A segment that more words than this could hold is told apart by the halves of what is left of the word.
HOT = 5_000


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slips: int | None = None) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, A-Z in lower case, of LENGTH code points or more that occur OCCURRENCES times or more.

    slips: where it divides the CRC-32 h of "<doc_id>:<run>", the run loses its code point h % length before it counts.
    Null and empty texts have no runs; a null id is written as nothing. Occurrences are summed before the shuffle.
    """
    # shorter runs cannot become words, and a greedy match of LENGTH or more is maximal
    runs = docs.select(F.col(f"`{doc_id}`").cast("string").alias("i"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{LETTERS}{{{LENGTH},}}"), 0)).alias("x"))
    ascii_only = F.length("x") == F.octet_length("x")
    runs = runs.select("i", F.when(ascii_only, F.lower("x")).otherwise(F.translate("x", UPPER, LOWER)).alias("x"))
    if slips:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce("i", F.lit("")), F.lit(":"), "x").cast("binary")))
        at = F.pmod("h", F.length("x")).cast("int")
        runs = runs.withColumn("x", F.when(F.pmod("h", F.lit(slips)) == 0, F.concat(F.substring("x", F.lit(1), at), F.substring("x", at + 2, F.length("x")))).otherwise(F.col("x")))
    return runs.select(F.col("x").alias("word")).where(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OCCURRENCES)


def halves(x: str, lengths: list[str]) -> Column:
    """Sides and segments of ``x`` that the two halves of a string of one of ``lengths`` can be: its first length // 2 code points and its last length - length // 2."""
    both = [f"struct('head' AS side, left({x}, int({m}) div 2) AS seg), struct('tail' AS side, right({x}, int({m}) - int({m}) div 2) AS seg)" for m in lengths]
    return F.expr(f"array_distinct(array({', '.join(both)}))")


def rest() -> Column:
    """What ``word`` has beside its segment."""
    return F.when(F.col("side") == "head", F.expr("right(word, length(word) - length(seg))")).otherwise(F.expr("left(word, length(word) - length(seg))"))


class Rests:
    """What is left of the words that share a segment, also with each code point left out: all that are one edit away are found at once, however many words there are."""

    def __init__(self):
        self.whole: dict[str, tuple] = {}
        self.swapped: dict[tuple[int, str], list[tuple]] = defaultdict(list)
        self.shorter: dict[str, list[tuple]] = defaultdict(list)

    def add(self, rest: str, word: str, n: int) -> None:
        one = self.whole[rest] = (rest, word, n)
        less = [rest[:i] + rest[i + 1 :] for i in range(len(rest))]
        for i, x in enumerate(less):
            self.swapped[i, x].append(one)
        for x in set(less):
            self.shorter[x].append(one)

    def near(self, rest: str) -> Iterator[tuple]:
        less = [rest[:i] + rest[i + 1 :] for i in range(len(rest))]
        for i, x in enumerate(less):
            yield from (one for one in self.swapped.get((i, x), ()) if one[0] != rest)
        yield from self.shorter.get(rest, ())
        yield from (self.whole[x] for x in set(less) if x in self.whole)


def end(x: str, side: str, size: int) -> str:
    return x[:size] if side == "head" else x[len(x) - size :]


class Shard:
    """An automaton over segments of words; for each segment, side and length of what tells hot ones apart, the words that have it."""

    def __init__(self, owners: list[tuple[str, int, str, str, str, str]]):
        self.automaton, self.size = ahocorasick.Automaton(), 0
        for word, n, side, seg, side2, seg2 in owners:
            held = self.automaton.get(seg, None)
            if held is None:
                self.automaton.add_word(seg, held := (len(seg), {}))
            self.size += 1
            words = held[1].setdefault((side, side2, len(seg2)), {}).setdefault(seg2, Rests())
            words.add(word[len(seg) :] if side == "head" else word[: len(word) - len(seg)], word, n)
        if self.size:
            self.automaton.make_automaton()

    def near(self, word: str) -> Iterator[tuple[int, str]]:
        """(n, other) of the shard's words one edit from ``word``; over all shards each of them comes once.

        A word that shares both its halves' places with ``word`` is found by its head alone.
        """
        for last, (size, groups) in self.automaton.iter(word) if self.size else ():
            for (side, side2, size2), words in groups.items():
                if last + 1 != (size if side == "head" else len(word)):
                    continue
                rest = word[size:] if side == "head" else word[: last + 1 - size]
                for mine, other, n in words[x].near(rest) if (x := end(rest, side2, size2)) in words else ():
                    if side == "tail" and word.startswith(other[: len(other) // 2]) or side2 == "tail" and rest.startswith(mine[: len(mine) // 2]):
                        continue
                    yield n, other


def near(words: DataFrame, each: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """(word, n_near, best_n, best) of those of ``words`` (word, n) that have a word one insertion, deletion or replacement away: how many, and the one of largest n (ties: the least word).

    One edit leaves one half of a word as it is, at the same end of the other word. Each word's two halves go to
    automata, dealt over shards of about ``each`` by their hash; each word goes to the shards of those of its ends that
    may be a half of a word one longer, one shorter or as long (two or three lengths at each end), and is scanned there. A match counts at its end only, if what is left is
    one edit apart. Segments that more than ``hot`` words are sent for are told apart by the halves of what they leave.
    Shards return counts and their best, not pairs.
    """
    words = words.where(F.length("word") >= 2)
    own = words.select("word", "n", F.explode(halves("word", ["length(word)"])).alias("s")).select("word", "n", "s.*")
    scan = words.select("word", F.explode(halves("word", ["length(word) - 1", "length(word)", "length(word) + 1"])).alias("s")).select("word", "s.*")
    many = scan.groupBy("side", "seg").count().where(F.col("count") > hot).select("side", "seg", F.lit(True).alias("hot"))

    def dealt(rows: DataFrame, lengths: list[str]) -> DataFrame:
        rows = rows.join(many, ["side", "seg"], "left").withColumn("rest", rest())
        plain = F.expr("array(struct('head' AS side, '' AS seg))")
        return rows.withColumn("t", F.explode(F.when(F.col("hot"), halves("rest", lengths)).otherwise(plain))).withColumn("shard", bucket(F.concat_ws(" ", "side", "seg", "t.side", "t.seg"), parts))

    parts = pieces(2 * words.count(), each)
    owners = dealt(own, ["length(rest)"]).select("shard", "word", "n", "side", "seg", F.col("t.side").alias("side2"), F.col("t.seg").alias("seg2"))
    scans = dealt(scan, ["greatest(length(rest) - 1, 0)", "length(rest)", "length(rest) + 1"]).select("shard", F.col("word").alias("scanned"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(list(zip(*(left.column(c).to_pylist() for c in ("word", "n", "side", "seg", "side2", "seg2")), strict=True)))
        out = []
        for word in sorted(set(right.column("scanned").to_pylist())):
            if found := list(shard.near(word)):
                n, best = min((-n, other) for n, other in found)
                out.append((word, len(found), -n, best))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])

    found = owners.groupBy("shard").cogroup(scans.groupBy("shard")).applyInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last of the forms from word on. Forms must not go round; each round doubles the steps, so rounds are the logarithm of the longest chain."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(at)
        at = new
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slips: int | None = None, ratio: int = RATIO) -> DataFrame:
    """One row for each word of ``vocabulary``: word, form, root, n, n_near and form_n.

    form: its near word (one edit away, see ``near``) of largest n, ties to the least in code-point order, if that n is
    ``ratio`` times the word's n or more; else null, as form_n. root: the last of the forms from the word on, or the
    word. n grows with each form, so forms never go round, and a chain has at most log(n) of them. n_near counts near
    words, 0 if none. An empty table gives an empty table; repeated rows count as often as they come; other columns of
    ``docs`` are not read.
    """
    words = cut(vocabulary(docs, doc_id, text, slips))
    found = words.join(near(words), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = cut(found.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")))
    drop(words)
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql(slips: int = SLIPS) -> str:
    """The same as SQL over ``documents``, with words that share all but one code point at the same place, or one being the other without one."""
    return f"""
    WITH RECURSIVE r AS (SELECT doc_id, translate(x, '{UPPER}', '{LOWER}') AS x FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{LETTERS}+')) AS x FROM documents) WHERE length(x) >= {LENGTH}),
    k AS (SELECT doc_id, x, count(*) AS c FROM r GROUP BY ALL),
    h AS (SELECT x, c, {crc32("concat(doc_id, ':', x)")} AS h FROM k),
    v AS (SELECT CASE WHEN h % {slips} = 0 THEN substring(x, 1, h % length(x)) || substring(x, h % length(x) + 2) ELSE x END AS word, c FROM h),
    w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM v WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(c) >= {OCCURRENCES}),
    d AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS x FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
    p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.i = b.i AND a.x = b.x AND a.word <> b.word AND length(a.word) = length(b.word)
          UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.x = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.x = w.word),
    b AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
    f AS (SELECT w.word, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM w LEFT JOIN b USING (word)),
    s AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM s GROUP BY word) t USING (word)
    """
