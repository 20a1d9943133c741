"""Connected components of a link table, by alternating large-star and
small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausekit.llm.stage import drop, staged


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step.  Every step replaces the edges
    (u, v) by edges to the smallest neighbour; minima are pre-aggregated on the
    map side, so a hub with most of the links is no hot group."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.join(low, "u").where("v > u")
             .select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u != v").distinct())
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low2 = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(low2, "u")
    return (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .where("u != v").distinct())


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``links`` (a, b) of integer ids -> (id, component) for every id that has a
    link, the component being its smallest id.  Nulls and self links are
    ignored; an empty table gives an empty one.  Each round is a stage table;
    rounds grow with the logarithm of the longest chain, and a run that has not
    settled after ``max_rounds`` is an error, not a partial result."""
    e = staged(links.where("a is not null and b is not null and a != b")
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        n = staged(_star(e), "cc")
        drop(e)
        e = n
        # the edge set is a fixed point when each id has one edge and no target is a source
        now = e.agg(F.count(F.lit(1)), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
