"""Invariants of the driver-table adapters (sf0.01)."""

from pyspark.sql import functions as F

from clausekit.operators import label as L
from clausekit.sources import adapters as X
from conftest import SF01


def test_clauses_twelve_per_contract_whole_text(spark):
    c = X.clauses(spark, SF01)
    per = {r["contract_name"]: r["n"] for r in c.groupBy("contract_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(per.values()) == 12 and len(per) == 84
    docs = X.table(spark, SF01, "documents")
    assert c.join(docs, c.ord == docs.doc_id).where(F.col("clause_text") != F.col("text")).count() == 0
    assert {r["clause_type"] for r in c.select("clause_type").distinct().collect()} <= set(X.CLAUSE_TYPES)


def test_master_duplicates_and_gaps(spark):
    m = X.master(spark, SF01)
    names = m.select(F.regexp_replace("filename", r"(?i)\.pdf\s*$", "").alias("n"))
    dup = names.groupBy("n").count().where("count > 1").count()
    assert dup == 150 and m.count() == 1500
    assert m.where(F.col("filename").endswith(".PDF ")).count() > 0


def test_replies_cover_every_status(spark):
    r = X.replies(spark, SF01).withColumn("p", L.parse_reply("reply"))
    got = {row["s"]: row["n"] for row in r.groupBy(F.col("p.parse_status").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == {"ok", "json_error", "invalid_format"} and sum(got.values()) == 399


def test_pairs_are_user_then_assistant(spark):
    p = X.pairs(spark, SF01)
    cv = X.table(spark, SF01, "conversations")
    assert p.count() == 233
    j = p.join(cv.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    assert j.where(F.col("role") != "user").count() == 0


def test_definitions_shared_and_clearable(spark):
    from clausekit.plans import datasets as D
    a = X.table(spark, SF01, "documents")
    assert X.table(spark, SF01, "documents") is a
    e = D.enriched(spark, SF01)
    assert D.enriched(spark, SF01) is e
    X.clear_definitions(spark)
    assert X.table(spark, SF01, "documents") is not a
    assert D.enriched(spark, SF01) is not e
