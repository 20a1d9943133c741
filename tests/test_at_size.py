"""Behaviour that small inputs do not show: sizes, retries, nulls, several files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from clausekit.operators import label, metadata, sample, training
from clausekit.operators.ordinal import dense_ordinal
from clausekit.sources import corpus
from clausekit.streaming.incremental import label_stream


@pytest.fixture
def sixteen(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_dense_ordinal_keeps_every_row(sixteen):
    n = 200_000
    df = sixteen.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("text"))
    seen = []
    for parts in (3, 17):
        out = dense_ordinal(df.repartition(parts), ["k"])
        r = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_idx").alias("d"), F.min("row_idx").alias("a"),
                    F.max("row_idx").alias("b"), F.sum(F.length("text")).alias("t"),
                    F.sum((F.col("k") != F.col("row_idx")).cast("int")).alias("off")).first()
        assert (r.n, r.d, r.a, r.b, r.t, r.off) == (n, n, 0, n - 1, n * 256, 0)
        seen.append(out.agg(F.bit_xor(F.xxhash64("row_idx", "text"))).first()[0])
    assert seen[0] == seen[1]


def test_pad_batches_keeps_every_row(sixteen):
    ids = F.expr("transform(sequence(1, 1 + cast(id % 37 as int)), x -> x)")
    df = sixteen.range(100_000).select(F.col("id").alias("ord"), ids.alias("input_ids"), ids.alias("attention_mask"), ids.alias("labels"))
    out = training.pad_batches(df, batch_size=4)
    r = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ord").alias("d"), F.countDistinct("batch_id").alias("b")).first()
    assert (r.n, r.d, r.b) == (100_000, 100_000, 25_000)
    assert set(training.pad_batches(df.limit(3), batch_size=1).columns) == set(out.columns)


def test_split_counts_null_strata(spark):
    df = spark.range(1000).select(F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, "a").alias("clause_type"))
    got = {(r.clause_type, r.split): r["count"] for r in sample.stratified_split(df).groupBy("clause_type", "split").count().collect()}
    assert got == {("a", "train"): 400, ("a", "val"): 100, (None, "train"): 400, (None, "val"): 100}


def test_sample_is_the_same_for_small_and_large_caps(spark):
    df = spark.range(9000).select(F.col("id").alias("ord"), (F.col("id") % 3).cast("string").alias("clause_type"))
    small = {r.ord for r in sample.stratified_sample(df, cap=10).collect()}
    large = {r.ord for r in sample.stratified_sample(df.repartition(7), cap=2000).collect()}
    assert len(small) == 30 and len(large) == 6000 and small < large


def clause_rows(spark, ords, text="x"):
    return spark.createDataFrame([(o, "C", "t", text) for o in ords], "ord bigint, contract_name string, clause_type string, clause_text_cleaned string")


def test_contract_within_the_bounds_is_one_list(spark):
    """Whatever its ordinals: 4 clauses 5000 apart, or 12 across a multiple of 4096."""
    for ords in (range(0, 20_000, 5000), range(4090, 4102)):
        got = metadata.clauses_by_contract(clause_rows(spark, ords)).collect()
        assert [(r.chunk, [c.ord for c in r.clauses]) for r in got] == [(0, list(ords))]


def test_large_contract_is_cut_by_count_and_bytes(spark):
    got = metadata.clauses_by_contract(clause_rows(spark, range(0, 1200, 100)), chunk=5)
    assert sorted((r.chunk, len(r.clauses)) for r in got.collect()) == [(0, 5), (1, 5), (2, 2)]
    got = metadata.clauses_by_contract(clause_rows(spark, range(10), "x" * 40), max_bytes=100).orderBy("chunk").collect()
    assert [[c.ord for c in r.clauses] for r in got] == [[0, 1, 2], [3, 4], [5, 6, 7], [8, 9]]


def test_hot_contract_is_measured_in_ranges(spark):
    """One contract with nearly all clauses: no clause is lost, order and bounds hold."""
    n = 50_000
    df = spark.range(n).select((F.col("id") * 7919 % 1_000_003).alias("ord"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("c"), F.col("id"))).otherwise(F.lit("hot")).alias("contract_name"),
                               F.lit("t").alias("clause_type"), F.repeat(F.lit("y"), (F.col("id") % 60).cast("int")).alias("clause_text_cleaned"))
    got = metadata.clauses_by_contract(df, chunk=1000, max_bytes=20_000).where("contract_name = 'hot'").orderBy("chunk").collect()
    flat = [c.ord for r in got for c in r.clauses]
    assert len(flat) == n * 49 // 50 and flat == sorted(flat)
    assert all(len(r.clauses) <= 1000 and sum(len(c.clause_text) for c in r.clauses[:-1]) < 20_000 for r in got)
    assert metadata.clauses_by_contract(df).where("contract_name != 'hot'").count() == n // 50


def test_file_order_follows_paths_and_lines(spark, tmp_path):
    for name, n in (("a", 2), ("b", 3000), ("c", 40)):
        with open(tmp_path / f"{name}.jsonl", "w") as f:
            for i in range(n):
                f.write(json.dumps({"title": f"{name}{i}", "paragraphs": []}) + "\n")
    want = [f"a{i}" for i in range(2)] + [f"b{i}" for i in range(3000)] + [f"c{i}" for i in range(40)]
    for size in ("4k", "128m"):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = corpus.read_corpus(spark, str(tmp_path), json_lines=True).orderBy("file_ord").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert [r.data[0].title for r in rows] == want
        assert [r.file_ord for r in rows] == list(range(len(want)))


def test_unreadable_table_is_not_an_empty_one(spark, tmp_path):
    assert corpus.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    os.makedirs(tmp_path / "bad")
    with open(tmp_path / "bad" / "part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        corpus.read_or_empty(spark, str(tmp_path / "bad"), "a int").count()


GOOD = '{"risk_level": "LOW", "risk_reason": "r", "plain_summary": "s"}'


def good():
    return lambda system, user: GOOD


def todo_rows(spark, n=100):
    return spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("ctx "), (F.col("id") % 60).cast("string")).alias("enriched_context"))


def test_incremental_labelling_resumes_and_labels_a_key_once(spark, tmp_path):
    done, flag = str(tmp_path / "done"), str(tmp_path / "broken")
    open(flag, "w").close()

    def breaks():
        import random
        if os.path.exists(flag) and random.random() < 0.4:
            raise RuntimeError("lost")
        return lambda system, user: GOOD

    with pytest.raises(Exception):
        for _ in range(40):
            label.label_incremental(todo_rows(spark), done, breaks, pause_s=0.0)
    os.remove(flag)
    out = label.label_incremental(todo_rows(spark), done, breaks, pause_s=0.0)
    assert sorted(r.enriched_context for r in out.collect()) == sorted(f"ctx {i}" for i in range(60))


@pytest.mark.parametrize("committed", [True, False])
def test_replayed_micro_batch_keeps_every_label(spark, tmp_path, committed):
    src, done, chk = (str(tmp_path / d) for d in ("todo", "done", "chk"))
    todo_rows(spark).coalesce(1).write.parquet(src)

    def run():
        stream = spark.readStream.schema("ord long, enriched_context string").parquet(src)
        label_stream(stream, done, chk, good, pause_s=0.0).awaitTermination()
        return sorted(r.enriched_context for r in spark.read.parquet(done).collect())

    want = sorted(f"ctx {i}" for i in range(60))
    assert run() == want
    for f in os.listdir(f"{chk}/commits"):
        os.remove(f"{chk}/commits/{f}")           # the driver was lost before its commit
    if not committed:
        os.remove(f"{done}/batch_id=0/_SUCCESS")
    assert run() == want


def test_set_operations_tell_null_from_empty(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("", 3), ("", 4)], "enriched_context string, ord int")
    b = spark.createDataFrame([("x", 9)], "enriched_context string, ord int")
    assert sorted(r.ord for r in sample.remaining(a, b).collect()) == [2]
    assert sorted(r.ord for r in sample.remaining(a, b, mode="anti").collect()) == [2, 3, 4]
    assert sorted(r.ord for r in sample.merge_keep_first([b, a]).collect()) == [2, 3, 9]
