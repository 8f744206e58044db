"""Stages that turn raw documents into packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkfolio.llm import common, stages

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("language_id", stages.language_id),
    ("minhash_near_dedup", stages.minhash_near_dedup),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: Trained models and packing have no SQL form; tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
