"""Words, shingles and their exact similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Odd factors of the two rolling hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, parted by ASCII white space."""
    return (text or "").encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def powers(factor: int, n: int) -> np.ndarray:
    """1, f, f**2, ... modulo 2**64."""
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, n - 1), factor, np.uint64), dtype=np.uint64)])[:n]


def rolled(x: np.ndarray, length: int, kind: int = 0) -> np.ndarray:
    """Hashes of all runs of ``length`` of ``x``: equal for equal runs, whatever stands before them. The two kinds are independent."""
    n = len(x) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    f = FACTORS[kind]
    with np.errstate(over="ignore"):
        y = x if not kind else (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.concatenate([[np.uint64(0)], np.cumsum(y * powers(f, len(x)), dtype=np.uint64)])
        h = (total[length:] - total[:-length]) * powers(pow(f, -1, 1 << 64), n)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def shingle_hashes(words: list[bytes], k: int = 5) -> np.ndarray:
    """64-bit hashes of the shingles of k words; of fewer words: of the whole; of none: nothing."""
    return rolled(word_hashes(words), max(1, min(k, len(words))))


def jaccard(a: bytes, b: bytes, kind: type = np.uint64) -> float:
    """Of two packed sorted sets of hashes; of two empty ones 1."""
    x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def compared(pairs: DataFrame, sets: DataFrame, kind: type = np.uint64) -> DataFrame:
    """(a, b, d) of the pairs (a, b): d is 1 less the Jaccard similarity of their ``sets`` (key, s: packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [1 - jaccard(x, y, kind) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64())], names=["a", "b", "d"])

    left, right = sets.withColumnsRenamed({"key": "a", "s": "x"}), sets.withColumnsRenamed({"key": "b", "s": "y"})
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, d double")
