"""Corpus -> enriched clause table, as one lazy plan over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausekit.operators import extract, metadata
from clausekit.sources import adapters


def clean_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 clause rows, cleaned (normalised, lower-case)."""
    return extract.clean_clauses(adapters.clauses(spark, sf_dir))


def canonical_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.canonicalize_clauses(clean_clauses(spark, sf_dir))


def master_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.dedupe_master(metadata.canonicalize_master(adapters.master(spark, sf_dir)))


def enriched(spark: SparkSession, sf_dir: str, with_metadata: bool = False, **kw) -> DataFrame:
    """Every clause with its contract context (the flagship plan)."""
    return metadata.enrich(clean_clauses(spark, sf_dir), adapters.master(spark, sf_dir),
                           with_metadata=with_metadata, **kw)


def write_clean(clean: DataFrame, path: str) -> None:
    """Materialize the cleaned clause table (the pipeline's first stage
    output) with a ``has_text`` flag column, so later passes that only need
    presence flags never read the text."""
    clean.withColumn("has_text", F.coalesce(F.col("clause_text_cleaned") != "", F.lit(False))) \
        .write.mode("overwrite").parquet(path)


def enriched_from_stage(spark: SparkSession, clean_path: str, master: DataFrame, **kw) -> DataFrame:
    """Enrichment over a materialized clean table: the flag aggregate scans
    (contract_name, clause_type, has_text); only the clause pass reads text."""
    return metadata.enrich(spark.read.parquet(clean_path), master, with_metadata=False, **kw)
