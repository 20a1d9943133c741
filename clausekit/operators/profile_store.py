"""Corpus profiles that merge: one small row for every slice of rows, kept in a
store, and the profile of everything from those rows alone.

A slice's row has counts, null counts, word sums and extremes (merged exactly), HLL
sketches of the contract names and clause types (distinct counts) and a KLL sketch of
the word counts (quantiles).  When clauses arrive, only they are read; the store
grows by a row, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausekit.sources.corpus import committed, subfolders

LG_K = 14               # HLL: relative standard error 1.04 / sqrt(2**14) = 0.8 %
KLL_K = 400             # KLL: rank error below 0.7 %, with 99 % confidence


def slice_profile(rows: DataFrame, length: Column, null_cols: Sequence[str], distinct_cols: Sequence[str]) -> DataFrame:
    """The profile row of ``rows``: one pass, partial aggregates only."""
    n = length.cast("bigint")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(n).alias("n_lengths"), F.sum(n).alias("sum_length"),
        F.min(n).alias("min_length"), F.max(n).alias("max_length"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in null_cols],
        *[F.hll_sketch_agg(F.col(c), F.lit(LG_K)).alias(f"hll_{c}") for c in distinct_cols],
        F.kll_sketch_agg_bigint(n, F.lit(KLL_K)).alias("kll_length"))


def add_slice(profile: DataFrame, store: str, name: str) -> None:
    """Keep the profile row of slice ``name``; a slice that is there already stays as it
    is, so adding one again after a lost driver changes nothing."""
    path = f"{store.rstrip('/')}/slice={name}"
    if not committed(profile.sparkSession, path):
        profile.coalesce(1).write.mode("overwrite").parquet(path)


def slices(spark: SparkSession, store: str) -> DataFrame:
    """The profile rows of all complete slices."""
    paths = [f"{store.rstrip('/')}/{x}" for x in subfolders(spark, store) if x.startswith("slice=")]
    return spark.read.parquet(*[p for p in paths if committed(spark, p)])


def merged(profiles: DataFrame, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """One row for all profile rows: n_rows, mean, extremes and nulls exactly,
    approx_<column> distinct counts and approx_p<percent> quantiles of the lengths."""
    cols = profiles.columns
    sums = [c for c in cols if c.startswith(("n_", "sum_", "null_"))]
    distinct = [c.removeprefix("hll_") for c in cols if c.startswith("hll_")]
    one = profiles.agg(*[F.sum(c).alias(c) for c in sums], F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"),
                       *[F.hll_union_agg(f"hll_{c}").alias(f"hll_{c}") for c in distinct], F.kll_merge_agg_bigint("kll_length").alias("kll"))
    return one.select(
        "n_rows", *[c for c in sums if c.startswith("null_")], "min_length", "max_length",
        (F.col("sum_length") / F.col("n_lengths")).alias("mean_length"),
        *[F.hll_sketch_estimate(f"hll_{c}").alias(f"approx_{c}") for c in distinct],
        *[F.kll_sketch_get_quantile_bigint("kll", F.lit(float(q))).alias(f"approx_p{round(q * 100)}") for q in quantiles])
