"""Profiling aggregations.  Every one is a partial aggregate (map-side
combine) over the whole table; results are a handful of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausekit.functions import tokens as tk

# ---------------------------------------------------------------------------
# Fixed values (must match the reference)
PER_DEVICE_BATCH = 1
GRAD_ACCUMULATION = 16
EPOCHS = 3
WARMUP_RATIO = 0.03
# ---------------------------------------------------------------------------


def type_distribution(df: DataFrame, col: str = "clause_type") -> DataFrame:
    """Counts per value, most frequent first (ties by value)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.col(col)))


def null_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count per column as (column_name, n_null) rows."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = "stack({}, {}) as (column_name, n_null)".format(
        len(cols), ", ".join(f"'{c}', `{c}`" for c in cols))
    return wide.selectExpr(stack)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def cardinality(df: DataFrame, cols: Sequence[str] = ("contract_name", "clause_type"),
                approx: bool = False) -> DataFrame:
    """Distinct non-null values per column (``approx`` = HyperLogLog++)."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[f(F.col(c)).alias(f"n_{c}") for c in cols])


def word_count_stats(df: DataFrame, n_col: str = "n_words") -> DataFrame:
    c = F.col(n_col)
    return df.agg(F.count(c).alias("n"), F.max(c).alias("max_words"),
                  F.min(c).alias("min_words"), F.avg(c).alias("mean_words"))


def first_rows(df: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in ``order_cols`` order.  Planned as
    ``TakeOrderedAndProject``: each task keeps its own top ``n``, so the
    final merge sees at most ``n`` rows per partition, never the table."""
    return df.orderBy(*order_cols).limit(n)


def length_stats(df: DataFrame, len_col: str = "seq_len", first_n: int | None = None,
                 order_cols: Sequence[str] = ()) -> DataFrame:
    """min, max, mean, median, 95th percentile (linear interpolation, exact).
    ``first_n`` restricts to the first rows in ``order_cols`` order (the
    reference's 100-row diagnostic); default: all rows."""
    if first_n is not None:
        df = first_rows(df, first_n, order_cols)
    c = F.col(len_col)
    return df.agg(F.min(c).alias("min_len"), F.max(c).alias("max_len"),
                  F.avg(c).alias("mean_len"), F.percentile(c, 0.5).alias("median_len"),
                  F.percentile(c, 0.95).alias("p95_len"))


def over_limit(df: DataFrame, len_col: str = "seq_len", limit: int = tk.MAX_LENGTH) -> DataFrame:
    c = F.col(len_col)
    return df.agg(F.count_if(c > limit).alias("n_over"), F.count(F.lit(1)).alias("n"),
                  (F.count_if(c > limit) * 100.0 / F.count(F.lit(1))).alias("pct_over"))


def accuracy(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(gold)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def majority_baseline(df: DataFrame, gold: str = "gold") -> DataFrame:
    per = df.groupBy(gold).agg(F.count(F.lit(1)).alias("n"))
    return per.agg((F.max("n") / F.sum("n")).alias("majority_share"),
                   F.max_by(F.col(gold), F.struct(F.col("n"), F.col(gold))).alias("majority_class"))


def loss_series(log: DataFrame) -> DataFrame:
    """(series, step, value): train and eval series from a sparse log."""
    train = log.where(F.col("loss").isNotNull()).select(
        F.lit("train").alias("series"), "step", F.col("loss").alias("value"))
    ev = log.where(F.col("eval_loss").isNotNull()).select(
        F.lit("eval").alias("series"), "step", F.col("eval_loss").alias("value"))
    return train.unionByName(ev)


def loss_summary(log: DataFrame) -> DataFrame:
    """Final train loss, final eval loss (highest step), best eval loss."""
    return log.agg(
        F.max_by(F.col("loss"), F.when(F.col("loss").isNotNull(), F.col("step"))).alias("final_train_loss"),
        F.max_by(F.col("eval_loss"), F.when(F.col("eval_loss").isNotNull(), F.col("step"))).alias("final_eval_loss"),
        F.min("eval_loss").alias("best_eval_loss"))


def training_schedule(train: DataFrame, per_device: int = PER_DEVICE_BATCH,
                      accumulation: int = GRAD_ACCUMULATION, epochs: int = EPOCHS,
                      warmup_ratio: float = WARMUP_RATIO) -> DataFrame:
    """Effective batch and warm-up steps
    ``int(n / (batch * accumulation) * epochs * ratio)``."""
    eff = per_device * accumulation
    n = F.count(F.lit(1))
    return train.agg(n.alias("n_train")).select(
        "n_train", F.lit(eff).alias("effective_batch"),
        F.floor(F.col("n_train") / F.lit(float(eff)) * F.lit(float(epochs)) * F.lit(warmup_ratio))
        .cast("bigint").alias("warmup_steps"))
