from pyspark.sql import functions as F

from clausekit.operators import related as R

CLEAN_SCHEMA = "clause_text_cleaned string, clause_type string, contract_name string, ord bigint"


def test_first_k_in_contract_order_and_truncation(spark):
    long_text = "x" * 201
    rows_ = [("target", "License Grant", "A", 0)]
    rows_ += [(long_text if i == 0 else f"t{i}", "Non-Transferable License", "A", 10 - i) for i in range(3)]
    rows_ += [("p1", "Irrevocable or Perpetual License", "A", 1), ("p2", "Affiliate IP License-Licensor", "A", 20)]
    rows_ += [("other contract", "Non-Transferable License", "B", 0)]
    df = spark.createDataFrame(rows_, CLEAN_SCHEMA)
    r = R.related_clauses(df, k=3).where("contract_name = 'A' AND clause_type = 'License Grant'").first()
    rel = [(x["type"], x["text"]) for x in r["related"]]
    assert rel == [("Irrevocable or Perpetual License", "p1"),
                   ("Non-Transferable License", "t2"),
                   ("Non-Transferable License", "t1")]
    r4 = R.related_clauses(df, k=5).where("contract_name = 'A' AND clause_type = 'License Grant'").first()
    assert len(r4["related"]) == 5
    assert [x["text"] for x in r4["related"] if x["text"].startswith("x")] == ["x" * 200]


def test_unknown_target_gets_empty_list_and_blank_context(spark):
    df = spark.createDataFrame([("a", "Audit Rights", "A", 0), ("b", "Insurance", "A", 1)], CLEAN_SCHEMA)
    w = R.clauses_with_related(df).where("clause_type = 'Audit Rights'").first()
    assert list(w["related"]) == [] and w["has_related_clauses"] is False
    ctx = df.select(R.related_context(F.array().cast("array<struct<type:string,text:string>>")).alias("c")).first()
    assert ctx["c"] == ""


def test_case_sensitive_map_and_render(spark):
    df = spark.createDataFrame([("x", "Exclusivity", "A", 0), ("nc", "Non-Compete", "A", 1),
                                ("lc", "exclusivity", "B", 0), ("nc2", "non-compete", "B", 1)], CLEAN_SCHEMA)
    ctx = {(r["contract_name"], r["clause_type"]): r["related_context"] for r in R.related_contexts(df).collect()}
    assert ctx[("A", "Exclusivity")] == "Related Clauses:\n- Non-Compete: nc"
    assert ("B", "exclusivity") not in ctx
    ci = {(r["contract_name"], r["clause_type"]) for r in R.related_contexts(df, case_sensitive=False).collect()}
    assert ("B", "exclusivity") in ci


def test_no_pairs_blowup_on_hot_contract(spark):
    # one contract with many clauses of related types: output stays k per target
    n = 3000
    df = spark.range(n).select(F.lit("t").alias("clause_text_cleaned"),
                               F.when(F.col("id") % 2 == 0, "Exclusivity").otherwise("Non-Compete").alias("clause_type"),
                               F.lit("HOT").alias("contract_name"), F.col("id").alias("ord"))
    out = R.related_clauses(df, k=3).collect()
    assert len(out) == 2 and all(len(r["related"]) == 3 for r in out)
