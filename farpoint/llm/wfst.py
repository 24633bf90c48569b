"""SentencePiece encoding and decoding as the shortest path through a weighted finite-state transducer."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from heapq import merge
from itertools import groupby
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import fresh, slices, text_batches

SPACE = "▁"
#: Segments, and pairs of pieces, that a worker remembers; beyond, it starts anew.
MEMORY, PAIRS = 300_000, 600_000
#: What stands before a segment, and the arc of a character that is no piece.
UNKNOWN, FALLBACK = -1, -2


class Transducer:
    """normaliser o pieces with byte fallback (o merge order), over the tropical semiring (min, +).

    pieces: (piece, weight) by id, None for ids that no text reaches; weight: what an arc of the piece costs.
    fallback: ids of the 256 bytes. order: None for a model whose best path is the cheapest one; for a merge-built
    vocabulary the score by which merges are taken. Then the pieces are composed with an acceptor of pairs: the arc
    from one piece to the next costs 0 if merging the two's characters in order gives back just these two, else
    infinity. A path of finite weight exists for each input, and only one: what merging yields.
    """

    def __init__(self, pieces: list[tuple[str, float] | None], fallback: list[int], unk: int, merges: bool, prefix: bool = True):
        self.surface = [p[0] if p else "" for p in pieces]
        self.fallback, self.unk, self.merges, self.prefix = fallback, unk, merges, prefix
        self.byte_of = {i: b for b, i in enumerate(fallback)} if len(set(fallback)) == 256 else {}
        #: bytes that stand for no character by themselves; the others are their characters
        self.wide = {i for i, b in self.byte_of.items() if b > 127}
        for i, b in self.byte_of.items():
            self.surface[i] = chr(b) if b < 128 else ""
        #: the piece transducer, determinised: reading a text it puts out (length, id) of every piece where it ends
        self.automaton = ahocorasick.Automaton()
        self.weight: dict[int, float] = {}
        self.score: dict[str, float] = {}
        for i, p in enumerate(pieces):
            if p:
                self.automaton.add_word(p[0], (len(p[0]), i))
                self.weight[i] = p[1]
                self.score[p[0]] = -p[1]
        self.automaton.make_automaton()
        self.alphabet = {p for p in self.score if len(p) == 1}
        # where no piece has the two characters beside each other the best path always breaks, so texts come apart there
        inner = {a + b for p in self.score for a, b in zip(p, p[1:], strict=False)}
        apart = not any(x[1] == SPACE and x[0] != SPACE for x in inner) and not any("\n" in x for x in inner)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall if apart else lambda t: [t]
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.spines: dict[tuple[str, bool], list[tuple[str, float]] | None] = {}
        self.pairs: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Transducer:
        """From a .model file. Its normaliser must be the identity, with or without the leading blank."""
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n, kind = m.normalizer_spec, m.trainer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or kind.model_type not in (1, 2) or kind.treat_whitespace_as_suffix:
            raise ValueError("only models without a character map are supported")
        pieces = [(p.piece, -p.score) if p.type in (1, 4) else None for p in m.pieces]
        fallback = [0] * 256
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                fallback[int(p.piece[1:-1], 16)] = i
        return cls(pieces, fallback, kind.unk_id, kind.model_type == 2, n.add_dummy_prefix)

    # normaliser

    def normalise(self, text: str) -> str:
        """Blanks become the space mark, and a text that is not empty gets one in front."""
        return (SPACE + text if self.prefix and text else text).replace(" ", SPACE)

    # merge order

    def merged(self, s: str) -> list[str]:
        """The pieces that merging yields: the best-scored adjacent pair first, of equals the leftmost."""
        parts, score = list(s), self.score.get
        while True:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                x = score(parts[k] + parts[k + 1])
                if x is not None and x > best:
                    best, at = x, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def spine(self, piece: str, left: bool) -> list[tuple[str, float]] | None:
        """What stands at one end of ``piece`` while its characters merge, each with the score of the merge that ends it.

        None if the merges don't come by falling scores; then only merging itself tells.
        """
        key = (piece, left)
        if key in self.spines:
            return self.spines[key]
        parts, score = list(piece), self.score.get
        out, low, found = [], math.inf, True
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                x = score(parts[k] + parts[k + 1])
                if x is not None and x > best:
                    best, at = x, k
            if at < 0 or best >= low:  # equal scores: repeats of one piece, whose order matters
                found = False
                break
            low = best
            if at == (0 if left else len(parts) - 2):
                out.append((parts[0 if left else -1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out.append((parts[0 if left else -1], -math.inf))
        self.spines[key] = out if found else None
        return self.spines[key]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the pair acceptor has an arc of weight 0 from piece ``a`` (UNKNOWN: a segment's start) to ``b``.

        While ``a`` and ``b`` are built, merges come by falling scores. The arc is missing if at some time what stands
        on either side of the border makes a piece whose merge comes before the next merge on either side.
        """
        key = (a + 1) << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            x, y = self.surface[a] if a >= 0 else "", self.surface[b]
            u, v = self.spine(x, False) if x else None, self.spine(y, True) if x else None
            if u is None or v is None:
                known = self.merged(x + y) == ([x, y] if x else [y])
            else:
                i = k = 0
                known = True
                while True:
                    (p, s), (q, t) = u[i], v[k]
                    across = self.score.get(p + q)
                    if across is not None and across > s and across >= t:
                        known = False
                        break
                    if s == t == -math.inf:
                        break
                    if s >= t:
                        i += 1
                    else:
                        k += 1
            self.pairs[key] = known
        return known

    # shortest paths

    def arcs(self, s: str) -> Iterator[tuple[int, tuple[int, int]]]:
        """The arcs of ``s`` composed with the transducer, by where they end: (last character, (length, piece)). A character that is no piece has one arc, FALLBACK, which puts out its bytes."""
        pieces = self.automaton.iter(s)
        if self.alphabet.issuperset(s):
            return pieces
        return merge(pieces, ((i, (1, FALLBACK)) for i, c in enumerate(s) if c not in self.alphabet), key=itemgetter(0))

    def consistent(self, s: str) -> list[int]:
        """The path through pieces composed with the pair acceptor: all its arcs weigh 0, so the path that exists is the shortest.

        What merging makes of a prefix ends in one piece, so at each position one state (position, last piece) is alive.
        After bytes the state is that of a start.
        """
        n, pairs, follows = len(s), self.pairs.get, self.may_follow
        last: list[int | None] = [UNKNOWN] + [None] * n
        back = [0] * (n + 1)
        for j, (k, t) in self.arcs(s):
            j += 1
            if last[j] is None:
                a = last[j - k]
                if t == FALLBACK:
                    last[j], back[j] = t, j - k
                elif a is not None:
                    a = UNKNOWN if a == FALLBACK else a
                    ok = pairs((a + 1) << 32 | t)
                    if follows(a, t) if ok is None else ok:
                        last[j], back[j] = t, j - k
        return self.trace(s, last, back)

    def cheapest(self, s: str) -> list[int]:
        """The path of least weight; of equals the one whose last piece is longer. Bytes weigh nothing: where they stand there is no other arc."""
        n, weight = len(s), self.weight
        cost = [0.0] + [math.inf] * n
        last: list[int | None] = [UNKNOWN] + [None] * n
        back = [0] * (n + 1)
        for j, (k, t) in self.arcs(s):
            c = cost[j + 1 - k] + (0.0 if t == FALLBACK else weight[t])
            if c < cost[j + 1]:
                cost[j + 1], last[j + 1], back[j + 1] = c, t, j + 1 - k
        return self.trace(s, last, back)

    def path(self, s: str) -> list[int]:
        """The pieces of the shortest path of ``s``."""
        return self.consistent(s) if self.merges else self.cheapest(s)

    def bytes_of(self, s: str) -> list[int]:
        return [self.fallback[b] for b in s.encode()] if self.byte_of else [self.unk] * len(s)

    def trace(self, s: str, last: list[int | None], back: list[int]) -> list[int]:
        out, j = [], len(last) - 1
        while j:
            if last[j] == FALLBACK:
                out += self.bytes_of(s[j - 1])[::-1]
            else:
                out.append(last[j])
            j = back[j]
        return out[::-1]

    def encode(self, text: str) -> array:
        out = array("i")
        path = self.path
        for s in self.segments(self.normalise(text)):
            ids = self.known.get(s)
            if ids is None:
                ids = self.older.get(s)
                if ids is None:
                    ids = tuple(path(s))
                if len(s) <= 64:
                    if len(self.known) >= MEMORY // 2:  # what was not used lately goes
                        self.older, self.known = self.known, {}
                    self.known[s] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        """The text of the pieces; runs of byte pieces are read as UTF-8 (what is no UTF-8 becomes U+FFFD)."""
        if self.wide.isdisjoint(ids):
            s = "".join(map(self.surface.__getitem__, ids))
        else:
            parts = []
            for byte, run in groupby(ids, self.byte_of.__contains__):
                parts.append(bytes(map(self.byte_of.__getitem__, run)).decode("utf-8", "replace") if byte else "".join(map(self.surface.__getitem__, run)))
            s = "".join(parts)
        s = s.replace(SPACE, " ")
        return s[1:] if self.prefix and s[:1] == " " else s


def encode(docs: DataFrame, path: str, text: str = "text", check: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, with ids (array of int) and n_pieces; with ``check``, exact: whether decoding gives back the text.

    Equal to what the library gives for the model file, without begin or end. Rows are encoded where they lie, whole
    and one by one, without a shuffle; null and empty texts have no pieces. Columns of those names are replaced;
    repeated rows stay; an empty table gives an empty table. A text that holds the space mark itself is not exact.
    """
    new = ("ids", "n_pieces", "exact")
    keep = [c for c in docs.columns if c not in (text, *new)]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(*fresh([*keep, *new], "text")))
    schema = src.select(*[f"`{c}`" for c in keep], F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("boolean").alias("exact")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Transducer.load(path)
        for whole in batches:
            for b in slices(whole, whole.num_columns - 1):
                flat, ends, exact = array("i"), [0], []
                for t in b.column(b.num_columns - 1).to_pylist():
                    ids = model.encode(t)
                    exact.append(model.decode(ids) == t if check else None)
                    flat.extend(ids)
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, pa.array(exact, pa.bool_())], names=[*b.schema.names[:-1], "ids", "exact"])

    out = text_batches(src).mapInArrow(run, schema).withColumn("n_pieces", F.size("ids").cast("long"))
    return out if check else out.drop("exact")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of ``encoded`` but the ids, with text; null ids give an empty text, ids out of range or null ones inside nothing. Repeated rows stay; an empty table gives an empty table; a column named text is replaced."""
    keep = [c for c in encoded.columns if c not in (ids, "text")]
    src = encoded.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias(*fresh([*keep, "text"], "ids")))
    schema = src.select(*[f"`{c}`" for c in keep], F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Transducer.load(path)
        n = len(model.surface)
        for b in batches:
            texts = [model.decode([i for i in x if i is not None and 0 <= i < n]) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    return text_batches(src).mapInArrow(run, schema)
