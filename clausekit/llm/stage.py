"""Stage tables in the cluster's shared folder, and small bounded bitmaps."""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausekit.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder (``spark.checkpoint.dir``) and
    read back: later steps neither recompute it nor depend on the executors
    that made it."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(t._stage_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bitmap(keys: DataFrame, col: str, bits: int) -> np.ndarray:
    """Bitmap of 2**bits bits with the bit ``pmod(col, 2**bits)`` set for every
    key; at most 2**bits / 64 rows come to the driver, whatever the input."""
    rows = (keys.where(F.col(col).isNotNull())
            .select(F.expr(f"shiftright(pmod({col}, {1 << bits}L), 6)").alias("w"),
                    F.expr(f"shiftleft(1L, cast(pmod({col}, 64L) as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bm: np.ndarray, values: np.ndarray) -> np.ndarray:
    v = values.astype(np.int64).view(np.uint64) & np.uint64(len(bm) * 64 - 1)
    return (bm[(v >> np.uint64(6)).astype(np.int64)] >> (v & np.uint64(63))) & np.uint64(1) != 0
