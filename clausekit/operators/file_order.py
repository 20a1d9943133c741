"""Row numbers in file order without moving rows.

A scan gives every row its place: file, block of the file, and the running number
inside its task.  The rows of a block are neighbours in one task, so a count for
each block, summed over the blocks before it, and the distance from the block's
first row give the row's number.  Only those counts are shuffled, one row for each
input split, and they reach the rows by a broadcast join: the driver holds a
description of every split anyway, which is larger than the count.

Counts and rows come from two scans of the same files.  Were the files split in
another way the second time (executors came or went between the two plans), a
row would stand outside the range counted for its block; that is an error, never
a wrong number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACE, HERE = "_place", "_here"
TASK_BITS = 33          # monotonically_increasing_id: rows of a task below, the task above


def place(scan: DataFrame) -> DataFrame:
    """Add the place of every row of a file scan (before any shuffle)."""
    return scan.withColumn(PLACE, F.struct(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")))


def here(rows: DataFrame) -> DataFrame:
    """Add a place for rows made out of placed ones by filters and explodes, which
    keep the order and move nothing."""
    return rows.withColumn(HERE, F.struct(
        F.col(f"{PLACE}.path").alias("path"), F.col(f"{PLACE}.block").alias("block"),
        F.monotonically_increasing_id().alias("row")))


def block_offsets(rows: DataFrame, at: str = PLACE) -> DataFrame:
    """One row for every block: its first and last running number, and the rows of all
    blocks before it (by path, then start).  Summed inside each file, then over
    the files."""
    blocks = rows.groupBy(F.col(f"{at}.path").alias("path"), F.col(f"{at}.block").alias("block")).agg(
        F.min(f"{at}.row").alias("first"), F.max(f"{at}.row").alias("last"))
    n, file_n = F.col("last") - F.col("first") + 1, F.col("file_n")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)      # a row for each file
    files = blocks.groupBy("path").agg(F.sum(n).alias("file_n")).select("path", F.coalesce(F.sum(file_n).over(before), F.lit(0)).alias("files"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum(n).over(before), F.lit(0))).join(files, "path").select(
        "path", "block", "first", "last", (F.col("offset") + F.col("files")).alias("offset"))


def number(rows: DataFrame, offsets: DataFrame, out: str, at: str = PLACE) -> DataFrame:
    """Add ``out`` (bigint): the number of every row in file order."""
    o = F.broadcast(offsets.select(*[F.col(c).alias(f"_o_{c}") for c in offsets.columns]))
    j = rows.join(o, (F.col(f"{at}.path") == F.col("_o_path")) & (F.col(f"{at}.block") == F.col("_o_block")), "left")
    row, first, last = F.col(f"{at}.row"), F.col("_o_first"), F.col("_o_last")
    same = row.between(first, last) & (F.shiftright(first, TASK_BITS) == F.shiftright(last, TASK_BITS))
    n = F.when(F.coalesce(same, F.lit(False)), F.col("_o_offset") + row - first).otherwise(
        F.raise_error(F.lit("the input was split in another way while it was numbered: run again")).cast("bigint"))
    return j.withColumn(out, n).drop(*[f"_o_{c}" for c in offsets.columns])
