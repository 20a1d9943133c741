"""Stratified sampling, set operations, de-duplication and train/val split.

All randomness is a seeded hash of the row key, ``md5('<seed>:<key>')``, so a
sample or split is the same on every run, on every cluster size and after
any task retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must match the reference)
SAMPLE_CAP = 110      # rows per clause type
SEED = 42
TEST_SIZE = 0.2       # validation share of the stratified split
# ---------------------------------------------------------------------------

# strata are cut in one pass up to this cap (the group limit's own bound), in so many parts
ONE_PASS_CAP = 1000
SAMPLE_PARTS = 64

# the split ranks rows inside (stratum, hash bucket); 16 bits of the md5
SPLIT_BUCKET_HEX = 4


def sort_key(key, seed: int = SEED) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string")))


def content_key(*cols) -> Column:
    """256-bit digest of one or more columns, null and empty told apart: set
    operations shuffle, sort and compare this instead of whole texts."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    marked = [F.coalesce(F.concat(F.lit("v"), F.sha2(p.cast("string"), 256)), F.lit("n")) for p in parts]
    return F.sha2(F.concat_ws(",", *marked), 256)


def stratified_sample(df: DataFrame, strata: str = "clause_type", key: str = "ord",
                      cap: int = SAMPLE_CAP, seed: int = SEED) -> DataFrame:
    """Up to ``cap`` rows per stratum without replacement, deterministic.

    Rows with a null stratum are dropped (as a pandas group-by).  The rows taken
    are the first of their stratum by seeded hash and key.  Up to ``ONE_PASS_CAP`` rows
    a stratum the input is read once (``_first_rows``); for a larger cap the cut is
    found from keys alone (``_mark_first``).  Either way a stratum holding a third of
    the data costs no task more than a small one."""
    df = df.where(F.col(strata).isNotNull())
    if cap <= ONE_PASS_CAP:
        return _first_rows(df, strata, key, cap, seed)
    keys = _keys(df, strata, key, seed)
    counts = keys.groupBy(F.col("_s").alias(strata)).agg(F.count(F.lit(1)).alias("n"))
    quotas = counts.select(strata, F.least(F.col("n"), F.lit(cap)).cast("bigint").alias("_q"))
    return _mark_first(df, strata, key, quotas, seed, keys).where("_first").drop("_first")


def _first_rows(df: DataFrame, strata: str, key: str, cap: int, seed: int) -> DataFrame:
    """The first ``cap`` rows of every stratum in (seeded hash, key) order, in one pass.

    Smallest-k of parts merge into the smallest k of all: every task keeps ``cap`` rows
    of a stratum at most before anything is sent (Spark's group limit below the
    window), 64 parts of a stratum are cut in parallel, and what is left of them,
    64 * ``cap`` rows a stratum at most, is cut again."""
    h = sort_key(key, seed)
    part = F.conv(F.substring(h, -2, 2), 16, 10).cast("int") % SAMPLE_PARTS
    rows = df.withColumns({"_h": h, "_part": part})
    for by in (("_part",), ()):
        place = Window.partitionBy(strata, *by).orderBy("_h", key)
        rows = rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= cap)
    return rows.select(*df.columns)


def remaining(base: DataFrame, sampled: DataFrame, key: str = "enriched_context",
              mode: str = "exactly_once") -> DataFrame:
    """Rows of ``base`` not taken by ``sampled``.

    ``exactly_once`` (the reference): keys occurring exactly once in
    ``base UNION ALL sampled`` (a symmetric difference: a key repeated inside
    ``base`` is dropped too, sampled keys vanish).  ``anti``: plain anti-join on
    the key; rows with a null key stay.  Keys are compared by digest and counted
    map-side; texts are shuffled once, as payload."""
    cols = base.columns
    if mode == "anti":
        taken = sampled.where(F.col(key).isNotNull()).select(content_key(key).alias("_k")).distinct()
        return base.withColumn("_k", content_key(key)).join(taken, "_k", "left_anti").select(*cols)
    if mode != "exactly_once":
        raise ValueError(f"unknown mode {mode!r}")
    return _exactly_once(base.unionByName(sampled.select(*cols)), content_key(key)).select(*cols)


def _exactly_once(u: DataFrame, key: Column) -> DataFrame:
    """Rows whose key occurs once.  One pass: a key's rows are counted and one of them is
    kept, map-side first, so that a key with a third of all rows is no hot group."""
    one = u.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*u.columns)).alias("_r"))
    return one.where("_n = 1").select("_r.*")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (over all columns) that occur exactly once in ``a UNION ALL b``."""
    cols = a.columns
    return _exactly_once(a.unionByName(b.select(*cols)), content_key(*cols)).select(*cols)


def merge_keep_first(sources: Sequence[DataFrame], key: str = "enriched_context",
                     ord_col: str = "ord") -> DataFrame:
    """Union of labelled sources, one row per key: the earliest source wins,
    then the lowest ordinal inside it, then the smallest row hash (never an
    arbitrary row).  The winner is found on digests and joined back."""
    cols = sources[0].columns
    u = None
    for i, s in enumerate(sources):
        part = s.select(*cols, content_key(key).alias("_k"), F.struct(
            F.lit(i).alias("src"), F.col(ord_col).alias("ord"), content_key(*cols).alias("h")).alias("_rank"))
        u = part if u is None else u.unionByName(part)
    first = u.groupBy("_k").agg(F.min("_rank").alias("_first"))
    return (u.join(first, "_k").where(F.col("_rank").eqNullSafe(F.col("_first")))
            .dropDuplicates(["_k"]).select(*cols))


def append(done: DataFrame, new: DataFrame) -> DataFrame:
    """Append new results to the checkpoint rows (bag union by name)."""
    return done.unionByName(new, allowMissingColumns=True)


def split_quotas(counts: DataFrame, strata: str = "clause_type",
                 test_size: float = TEST_SIZE) -> DataFrame:
    """Per-stratum train quotas from (stratum, n) rows.

    ``n_val = ceil(test_size * N)`` overall and ``n_train = N - n_val``; each
    stratum gets ``floor(n * n_train / N)`` plus one for the largest
    remainders (singleton strata first, then remainder, then stratum name)
    until the quotas sum to ``n_train``.  Runs on one row per stratum: the
    only global window of the split."""
    all_w = Window.partitionBy()
    c = counts.withColumn("_N", F.sum("n").over(all_w))
    c = c.withColumn("_ntr", F.col("_N") - F.ceil(F.col("_N") * F.lit(test_size)).cast("bigint"))
    c = (c.withColumn("_base", F.expr("(n * _ntr) div _N"))
         .withColumn("_rem", (F.col("n") * F.col("_ntr")) % F.col("_N")))
    c = c.withColumn("_left", F.col("_ntr") - F.sum("_base").over(all_w))
    rank_w = Window.orderBy(F.desc(F.col("n") == 1), F.desc("_rem"), F.col(strata))   # one row per stratum
    c = c.withColumn("_rk", F.row_number().over(rank_w))
    extra = F.when((F.col("_rk") <= F.col("_left")) & (F.col("_rem") > 0), 1).otherwise(0)
    return c.select(strata, "n", (F.col("_base") + extra).cast("bigint").alias("n_train"))


def stratified_split(df: DataFrame, strata: str = "clause_type", key: str = "ord",
                     test_size: float = TEST_SIZE, seed: int = SEED,
                     materialize: bool = False) -> DataFrame:
    """Add ``split`` in {train, val}: exact per-stratum quotas (see
    ``split_quotas``), rows ranked by the seeded hash.

    No stratum is ever ranked in one task (``_mark_first``).  The input is read
    twice: for its keys, which are written once and give counts, histogram and edge
    keys, and for the rows.  ``materialize=True`` first writes the input itself to
    the reliable checkpoint folder (``spark.checkpoint.dir``), so an expensive or
    non-deterministic upstream plan is computed once and both see the same rows."""
    if materialize:
        from clausekit.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    keys = _keys(df, strata, key, seed)
    counts = keys.groupBy(F.col("_s").alias(strata)).agg(F.count(F.lit(1)).alias("n"))
    quotas = split_quotas(counts, strata, test_size).select(strata, F.col("n_train").alias("_q"))
    marked = _mark_first(df, strata, key, quotas, seed, keys)
    return marked.withColumn("split", F.when(F.col("_first"), F.lit("train")).otherwise(F.lit("val"))) \
        .drop("_first")


def _keys(df: DataFrame, strata: str, key: str, seed: int) -> DataFrame:
    """(_s, _h, _key, _b): stratum, hash, key and hash bucket of every row, written once."""
    from clausekit.operators.ordinal import staged
    h = sort_key(key, seed)
    return staged(df.select(F.col(strata).alias("_s"), h.alias("_h"), F.col(key).alias("_key"),
                            F.conv(F.substring(h, 1, SPLIT_BUCKET_HEX), 16, 10).cast("int").alias("_b")), "keys")


def _mark_first(df: DataFrame, strata: str, key: str, quotas: DataFrame, seed: int, keys: DataFrame) -> DataFrame:
    """Add ``_first``: whether the row is among the first ``_q`` rows of its
    stratum in (seeded hash, key) order, for per-stratum quotas ``quotas``
    (stratum, _q); ``keys`` are those of ``df`` (``_keys``).  ``key`` should be unique: rows that share hash and key fall
    on one side together.  A null stratum is a stratum like any other.

    Three narrow passes find each stratum's cut: keys are bucketed by the first
    16 bits of their hash, a histogram (partial aggregate) finds the bucket
    where the quota falls, and only that bucket's keys are ranked for the last
    (hash, key) that is in.  The rows themselves are then compared with the cut
    in one pass; the cuts, one row per stratum, are joined in."""
    h = sort_key(key, seed)
    hist = keys.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    cw = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_cnt").over(cw), F.lit(0)))
    q = quotas.select(F.col(strata).alias("_qs"), "_q")
    bound = (hist.join(q, F.col("_s").eqNullSafe(F.col("_qs")))
             .where((F.col("_before") < F.col("_q")) & (F.col("_before") + F.col("_cnt") >= F.col("_q")))
             .select(F.col("_s").alias("_es"), F.col("_b").alias("_eb"), (F.col("_q") - F.col("_before")).alias("_need")))
    edge = keys.join(bound, F.col("_s").eqNullSafe(F.col("_es")) & (F.col("_b") == F.col("_eb")))
    ew = Window.partitionBy("_s").orderBy("_h", "_key")
    cut = (edge.withColumn("_rk", F.row_number().over(ew)).where(F.col("_rk") == F.col("_need"))
           .select(F.col("_s").alias("_cs"), F.struct("_h", "_key").alias("_cut")))
    # strata with quota 0 have no cut: no row is in
    j = df.join(cut, F.col(strata).eqNullSafe(F.col("_cs")), "left")
    own = F.struct(h.alias("_h"), F.col(key).alias("_key"))
    return j.withColumn("_first", F.coalesce(own <= F.col("_cut"), F.lit(False))).select(*df.columns, "_first")


def split_balance(split: DataFrame, strata: str = "clause_type") -> DataFrame:
    """Per stratum: rows, train rows, val rows."""
    return split.groupBy(strata).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "val").alias("n_val"))
