"""Dense global row numbers without a single-partition window.

``dense_ordinal`` sorts globally (range partitioning), tags each row with
``monotonically_increasing_id`` (partition id in the upper bits, position in
the lower 33) and writes the tagged rows once to the shared folder
(``spark.checkpoint.dir``).  Counts per partition and the numbered rows are
both read from that one copy, so they cannot disagree, whatever the plan does
on either side.  Only the counts (one small row for each written partition) go
through a global window and a broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausekit.session import ensure_checkpoint_dir

_LOW_BITS = 33


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps see one
    version of it and do not depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense_ordinal(df: DataFrame, order_cols: Sequence[str], out: str = "row_idx") -> DataFrame:
    """Add ``out`` = 0-based rank of each row in ``order_cols`` order (ties broken
    arbitrarily; pass a unique key for a total order).  Rows are never lost or
    numbered twice.  Runs the plan of ``df`` once, when called."""
    tagged = (df.orderBy(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright(F.col("_mid"), _LOW_BITS))
              .withColumn("_pos", F.col("_mid").bitwiseAND((1 << _LOW_BITS) - 1)).drop("_mid"))
    tagged = staged(tagged, "ordinal")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid", "inner")   # one row for each partition
            .withColumn(out, (F.col("_off") + F.col("_pos")).cast("bigint"))
            .drop("_pid", "_pos", "_off"))
