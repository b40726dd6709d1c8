"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    crf_toxicity,
    log_lines,
    merkle,
    mixing,
    norm_buckets,
    order_minhash,
    pii,
    rp_forest,
    sentence_spans,
    simhash,
    spelling,
    warc,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_pairs(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = sentence_spans.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.withColumnsRenamed({"__n_sentences": "n_sentences", "__n_removed": "n_removed", "__removed": "removed"})


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *bpe.public_vocabulary())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents"))


def op8_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = log_lines.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.withColumnsRenamed({"__n_lines": "n_lines", "__n_dropped": "n_dropped"})


def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_mixing": op4_mixing,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash": op7_simhash,
    "op8_log_lines": op8_log_lines,
    "op9_rp_forest": op9_rp_forest,
    "op10_toxicity": op10_toxicity,
    "op11_norm_buckets": op11_norm_buckets,
    "op12_spelling": op12_spelling,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {"op4_mixing": mixing.SQL, "op11_norm_buckets": norm_buckets.SQL, "op12_spelling": spelling.SQL, "op13_merkle": merkle.SQL}
