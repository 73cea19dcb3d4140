"""From raw documents to packed sequences: a list of stages, each written out before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafgraph.functions.durable import scratch_folder
from leafgraph.llm import stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.drop_near_copies),
    ("repeats", stages.cut_repeats),
    ("personal_data", stages.mask_personal_data),
    ("packing", stages.pack),
]

#: Trained models and token files have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
