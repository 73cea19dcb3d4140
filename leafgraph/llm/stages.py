"""The stages of the corpus pipeline; each takes (spark, docs, data folder)."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of rows that go to a Python worker at a time; a larger row goes alone.
BATCH_BYTES = 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Batches of whole texts of BATCH_BYTES at most in the session, from then on.

    A batch stands in the executor and in the worker several times over, and neither gives back
    what it took for the largest one. What a stage returns does not depend on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def in_short_batches(stage):
    """The stage with short batches."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_short_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their ids, each a sequence by itself."""
    from leafgraph.llm import packing

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


@in_short_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model, fitted on ``labels``, calls toxic."""
    from leafgraph.llm import toxicity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels).select(*COLUMNS)


@in_short_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id."""
    from leafgraph.llm import near_dedup

    return near_dedup.without_near_copies(docs).select(*COLUMNS)


@in_short_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in the corpus more than once."""
    from leafgraph.llm import repeats

    return repeats.without_repeats(docs).select(*COLUMNS)


@in_short_batches
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each span of personal data."""
    from leafgraph.llm import personal_data

    return personal_data.masked(docs).select(*COLUMNS)
