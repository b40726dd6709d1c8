"""The corpus pipeline: toxic documents go, boilerplate lines go, near copies go, sources are mixed to target
weights, and what is left is encoded. Every stage reads the table that the one before it wrote.

Defined cases, in every stage: a null text counts as empty and stays null until it is encoded, as no tokens; null
ids and sources, repeated rows and very long texts pass like others, but of rows whose texts are near copies (empty
ones are copies of each other) one stays; an empty table gives an empty result; extra columns, whatever their names,
are kept by all stages but the last, which returns doc_id, n_tokens, token_ids and digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, crf_toxicity, log_lines, mixing, near_copies
from tidewater.llm.common import shared_folder, swept, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf_toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return log_lines.clean(docs, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, *bpe.public_vocabulary(), ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: The fitted model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
