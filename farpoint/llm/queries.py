"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.llm import ann, html, lexical, linededup, mixing, paragraphs, quality, sharding, simhash, spelling, tokencount, topk, wfst
from farpoint.llm.common import drop


def tokenizer(name: str) -> str:
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document stands in the mix."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op4_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its pieces, and whether decoding gives back the text."""
    return wfst.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"), check=True)


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines removed, characters left and the new text's digest."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_removed", F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"))


def op7_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), slips=spelling.SLIPS)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.index(table(spark, sf_dir, "documents"))
    out = lexical.search(found, lexical.asked(table(spark, sf_dir, "benchmark")))
    drop(found)
    return out


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk, op2_ann, op3_mixing, op4_wfst, op5_linededup, op6_simhash, op7_tokencount, op8_quality, op9_html, op10_paragraphs, op11_spelling, op12_lexical, op13_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": topk.top_k_sql(), "op5_linededup": linededup.dedup_lines_sql(), "op11_spelling": spelling.variants_sql(), "op12_lexical": lexical.search_sql(), "op13_sharding": sharding.shards_sql()}
