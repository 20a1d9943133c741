"""Ordered lists per key that stay within a number of items and of bytes.

A key within both bounds is one list, whatever its ordinals.  A larger key is cut
into consecutive chunks: a new one begins where the number of items before, or the
bytes before, reach a multiple of their bound.  So a chunk has at most ``max_items``
items, and its bytes pass ``max_bytes`` by less than its last item.

Only keys over a bound are measured item by item, on (key, order, bytes) alone: the
items are dealt out in ranges of (key, order), summed before each item inside its
range, and the sums of a key's ranges are added up from one row for each range.
A key with a third of all items is spread over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ITEMS = 4096
MAX_BYTES = 16 << 20


def _chunks(large: DataFrame, max_items: int, max_bytes: int) -> DataFrame:
    """(_key, _ord, _chunk) from rows (_key, _ord, _bytes)."""
    from clausekit.operators.ordinal import staged
    dealt = staged(large.repartitionByRange("_key", "_ord").withColumn("_range", F.spark_partition_id()), "ranges")
    per_range = dealt.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("_bytes").alias("_b"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = per_range.select("_key", "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_n", "_b")])
    within = Window.partitionBy("_key", "_range").orderBy("_ord")
    sums = dealt.withColumns({"_n": F.row_number().over(within) - 1, "_b": F.sum("_bytes").over(within) - F.col("_bytes")})
    items, size = F.col("_n") + F.col("_n0"), F.col("_b") + F.col("_b0")
    # both terms only rise, so their sum is a new number whenever one of them rises
    return sums.join(ranges, ["_key", "_range"]).select(
        "_key", "_ord", (F.floor(items / max_items) + F.floor(size / max_bytes)).cast("bigint").alias("_chunk"))


def with_chunk(rows: DataFrame, key: str, order: str, size: Column, max_items: int = MAX_ITEMS,
               max_bytes: int = MAX_BYTES, out: str = "chunk") -> DataFrame:
    """Add the number of the list that every row belongs to: 0 for all rows of a key
    within the bounds, rising (not always by one) along ``order`` in others.
    ``order`` is unique within a key; null keys are dropped.  Counts the keys when
    called."""
    rows = rows.where(F.col(key).isNotNull())
    measured = rows.select(F.col(key).alias("_key"), F.col(order).alias("_ord"), size.cast("bigint").alias("_bytes"))
    over = measured.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("b")).where(
        (F.col("n") > max_items) | (F.col("b") > max_bytes)).select("_key")
    from clausekit.operators.ordinal import staged
    over = staged(over, "over")
    if over.isEmpty():
        return rows.withColumn(out, F.lit(0).cast("bigint"))
    chunks = _chunks(measured.join(over, "_key", "left_semi"), max_items, max_bytes)
    j = rows.join(chunks, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_ord")), "left")
    return j.withColumn(out, F.coalesce("_chunk", F.lit(0).cast("bigint"))).drop("_key", "_ord", "_chunk")


def ordered_lists(rows: DataFrame, key: str, order: str, item: Column, size: Column, max_items: int = MAX_ITEMS,
                  max_bytes: int = MAX_BYTES, out: str = "items") -> DataFrame:
    """(key, chunk, ``out``): the items of every key, a struct that starts with
    ``order``, as ordered lists within the bounds."""
    return (with_chunk(rows, key, order, size, max_items, max_bytes)
            .groupBy(key, "chunk").agg(F.array_sort(F.collect_list(item)).alias(out)))
