"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import by_bytes, fresh, text_batches

#: Safe boundaries: a cut before a blank, tab or line end that follows a character that is no white space.
#: Pre-tokenizers of the byte-level kind match from left to right and look ahead only at white space, so a text's
#: tokens are those of its chunks. (White space of other kinds never starts a chunk.)
CHUNK = re.compile(r"\s*\S+(?:[^\S \t\n\r]\s*(?:\S+|\Z))*|\s+")
#: Counts of chunks that a worker remembers; beyond, it starts anew.
MEMORY = 300_000


class Counter:
    """Counts tokens with a tokenizer file; counts of chunks seen before are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> Iterator[int]:
        """Each text's tokens. Runs of texts are balanced by size, and long texts come apart at safe boundaries."""
        for run in by_bytes(texts):
            chunks = [CHUNK.findall(t) for t in run]
            if len(self.known) > MEMORY:
                self.known.clear()
            known = self.known
            new = list({c for cs in chunks for c in cs if c not in known})
            for part in by_bytes(new):
                for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    known[c] = len(e)
            for cs in chunks:
                yield sum(map(known.__getitem__, cs))


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """All columns of ``docs`` but the text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens above ``limit``).

    path: a tokenizer file that every executor can read. Each row is counted by itself, so tables of any order, with
    repeated rows or none, behave alike. A null or empty text has 0 bytes and 0 tokens. Columns that already bear one
    of the three names are replaced. Rows are never shuffled; a task's memory is bounded by a batch of rows, not by
    the table.
    """
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    (held,) = fresh([*keep, "n_bytes", "n_tokens", "over_limit"], "text")
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(held))
    src = src.withColumn("n_bytes", F.octet_length(F.col(f"`{held}`")).cast("long"))
    schema = src.select(*[f"`{c}`" for c in keep], "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counter = Counter(path)
        for b in batches:
            at = b.schema.get_field_index(held)
            n = pa.array(counter.counts(b.column(at).to_pylist()), pa.int64())
            cols = [c for i, c in enumerate(b.columns) if i != at]
            names = [x for i, x in enumerate(b.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, n], names=[*names, "n_tokens"])

    order = [f"`{c}`" for c in keep]
    return text_batches(src.select(*order, "n_bytes", f"`{held}`")).mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
