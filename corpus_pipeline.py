"""The training-data pipeline over ``documents``: STAGES run in order, each on
all rows that the one before it kept, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausekit.llm import stages
from clausekit.llm.stage import staged

STAGES = stages.STAGES

#: Classifier training and edit distance have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
