"""Quality classifier: Bradley-Terry pairwise ranking, thresholded by a quantile of the scores."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import cut, drop, text_batches

#: At most so many labelled rows of each label (those whose hash comes first) and so many preference pairs are fitted.
SAMPLE, PAIRS = 20_000, 100_000
#: Frequencies of four-byte strings, by their hash.
GRAMS = 128
SYMBOLS = re.compile(r"[^\w\s.,;:'\"()?!\-¡¿‘’“”–—]")
MARKED = re.compile(r"[^\w\s.,;:'\"()?!\-]{2,}|!{2,}|\?{3,}|\.{4,}")
FEATURES = ("words", "length", "unique", "top", "pairs", "upper", "symbol", "marked", "bar", "digit", "space", "sentence", "lines", "short", "repeat", "alpha", "lone")
WIDTH = len(FEATURES) + GRAMS


def grams(data: bytes) -> np.ndarray:
    """Shares of the four-byte strings of a text, A-Z in lower case, in GRAMS buckets by their hash; roots, so that rare ones count."""
    x = np.frombuffer(data.lower(), np.uint8).astype(np.uint32)
    if len(x) < 4:
        return np.zeros(GRAMS)
    h = (x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)) * np.uint32(0x9E3779B1)
    return np.sqrt(np.bincount(h >> np.uint32(32 - GRAMS.bit_length() + 1), minlength=GRAMS) / len(h))


def features(text: str) -> np.ndarray:
    """What is learnt from: the shape and the hashed four-byte strings of a whole text. No word: zeros."""
    return np.concatenate([shape(text), grams(text.encode("utf-8", "replace")) if text.strip() else np.zeros(GRAMS)]).astype(np.float32)


def shape(text: str) -> list[float]:
    """Lengths, repetition, case, symbols and lines. No word: zeros."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    k = len(words)
    seen = Counter(words)
    unique = len(seen)
    rows = [x for x in text.split("\n") if x.strip()]
    letters = n - text.count(" ") - text.count("\n")
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    return [
        math.log1p(k),
        letters / k,
        # repetition grows with length by itself; the log makes long and short texts comparable
        math.log(unique) / math.log(k) if k > 1 else 1.0,
        seen.most_common(1)[0][1] / k if k >= 5 else 0.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        upper / k,
        len(SYMBOLS.findall(text)) / n,
        len(MARKED.findall(text)) / k,
        text.count("|") / k,
        sum(map(text.count, "0123456789")) / n,
        sum(map(text.count, (" ", "\n", "\t"))) / n,
        sum(map(text.count, ".!?")) / k,
        math.log1p(k / max(1, len(rows))),
        sum(len(x) < 30 for x in rows) / max(1, len(rows)),
        1 - len(set(rows)) / max(1, len(rows)),
        sum(map(str.isalpha, words)) / k,
        sum(len(w) == 1 for w in words) / k,
    ]


@dataclass(frozen=True)
class Ranking:
    """score(x) = 1 / (1 + exp(-(w.z + c))), z the features on the sample's scale; ``cut`` is the accepted share's edge."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edge: float
    width: float
    threshold: float = 0.3

    def strength(self, x: np.ndarray) -> np.ndarray:
        # row by row, so that equal texts score equal whatever stands beside them
        return (np.clip((np.nan_to_num(x) - self.mean) / self.scale, -10, 10) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The edge's score is ``threshold``: what lies above the quantile is at or above the threshold, and so on."""
        t = (self.strength(x) - self.edge) / self.width + math.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(t, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, threshold: float = 0.3, quantile: float | None = None, pairs: int = PAIRS, penalty: float = 1e-3, doubt: float = 1.0, seed: int = 7) -> Ranking:
    """Bradley-Terry strengths from preferences of label 1 over label 0: logistic loss on differences of features.

    quantile: the share of the sample's scores that is rejected. None: the quantile with the fewest errors of either
    label (each label weighs a half); the edge then lies midway between the two scores next to it. Without rows of
    both labels there is no preference, and every score is 0.5. ``penalty`` holds back the weights of the shape,
    ``doubt`` those of the many hashed strings.
    """
    d = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), -math.log((1 - threshold) / threshold), 1.0, threshold)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = np.clip((x - mean) / scale, -10, 10)
    rng = np.random.default_rng(seed)
    ridge = np.where(np.arange(d) < len(FEATURES), penalty, doubt)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(d)
    for _ in range(30):  # Newton's method, some pairs at a time
        second, slope = np.diag(ridge), -ridge * w
        for i in range(0, pairs, 10_000):
            diff = z[better[i : i + 10_000]] - z[worse[i : i + 10_000]]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))
            second += (diff * (p * (1 - p))[:, None]).T @ diff / pairs
            slope += diff.T @ p / pairs
        step = np.linalg.solve(second, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    v, yy = s[order], y[order]
    if quantile is None:
        # at cut i, the i lowest are rejected
        wrong = np.concatenate([[0], np.cumsum(yy == 1) / len(good)]) + np.concatenate([np.cumsum((yy == 0)[::-1])[::-1], [0]]) / len(bad)
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        i = int(best[len(best) // 2])
    else:
        i = round(quantile * len(v))
    i = min(max(i, 1), len(v) - 1)
    return Ranking(mean, scale, w, float(v[i - 1] + v[i]) / 2, max(float(np.std(s)), 1e-6) / 2, threshold)


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Rows that are never learnt from: crc32 of the id as text, modulo ``folds``, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % folds == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, quantile: float | None = None, sample: int = SAMPLE) -> Ranking:
    """Fit on labelled rows outside the held-out fold; of each label those ``sample`` rows whose hash comes first.

    Labels that are null or neither 0 nor 1 are left out; a document with repeated label rows counts once for each. The
    sample's ids, at most 2 * ``sample``, are broadcast, and features made of its texts alone.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(~held_out("id") & F.col("y").isin(0, 1))
    part = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).join(F.broadcast(part[0].union(part[1])), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f, pa.binary())], names=["id", "y", "f"])

    made = cut(text_batches(rows.select("id", "t", "y")).mapInArrow(run, rows.select("id", "y", F.lit(b"").alias("f")).schema))
    # rows that repeat an id can be more than the sample
    got = [r for y in (0, 1) for r in made.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id", "f").limit(sample).select("f", "y").toArrow().to_pylist()]
    drop(made)
    x = np.frombuffer(b"".join(r["f"] for r in got), np.float32).astype(float).reshape(len(got), WIDTH)
    return fit(x, np.array([r["y"] for r in got]), threshold, quantile)


def scores(model: Ranking, texts: list[str | None]) -> np.ndarray:
    return model.score(np.array([features(t or "") for t in texts], dtype=float).reshape(len(texts), WIDTH))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 if the score is at least the threshold).

    Scores depend on the whole text alone and are made where it lies; texts are never shuffled. Null and empty texts
    get the score of a text without words. Repeated rows are scored each; an empty table gives an empty result; other
    columns of either table are not read.
    """
    model = learn(docs, labels, label, doc_id, text, **how)
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(model, b.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    out = text_batches(src).mapInArrow(run, src.select("id", F.lit(0.0).alias("score")).schema)
    return out.select(F.col("id").alias(doc_id), held_out("id").alias("held_out"), "score", (F.col("score") >= model.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, with its columns, that the classifier accepts.

    The model is learnt from the labelled documents; then every whole text is scored where it lies, so that no text is
    shuffled and rows with null or repeated ids are judged by their own texts. Null and empty texts are judged as texts
    without words; an empty table gives an empty table.
    """
    model, cols = learn(docs, labels, label, doc_id, text, **how), docs.columns
    at = cols.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(model, b.column(at).to_pylist()) >= model.threshold))

    return text_batches(docs).mapInArrow(run, docs.schema)
