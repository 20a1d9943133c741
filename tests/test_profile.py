from clausekit.operators import profile as P
from conftest import rows


def test_loss_series_and_summary(spark):
    log = spark.createDataFrame([(10, 2.0, None), (20, 1.5, None), (20, None, 1.7), (30, 1.2, None), (40, None, 1.9)],
                                "step bigint, loss double, eval_loss double")
    s = rows(P.loss_series(log))
    assert s == [("eval", 20, 1.7), ("eval", 40, 1.9), ("train", 10, 2.0), ("train", 20, 1.5), ("train", 30, 1.2)]
    r = P.loss_summary(log).first()
    assert (r["final_train_loss"], r["final_eval_loss"], r["best_eval_loss"]) == (1.2, 1.9, 1.7)


def test_length_stats_linear_percentile(spark):
    import numpy as np
    vals = [3, 9, 1, 20, 7, 7, 100]
    df = spark.createDataFrame([(v,) for v in vals], "seq_len int")
    r = P.length_stats(df).first()
    assert r["median_len"] == float(np.median(vals))
    assert abs(r["p95_len"] - float(np.percentile(vals, 95))) < 1e-9
    o = P.over_limit(spark.createDataFrame([(3000,), (10,)], "seq_len int"), limit=2048).first()
    assert (o["n_over"], o["n"], o["pct_over"]) == (1, 2, 50.0)


def test_null_audit_and_distribution(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "y")], "clause_type string, b string")
    assert rows(P.null_audit(df)) == [("b", 1), ("clause_type", 1)]
    assert [tuple(r) for r in P.type_distribution(df).collect()] == [("a", 2), (None, 1)]


def test_schedule_and_baseline(spark):
    train = spark.range(3500)
    r = P.training_schedule(train).first()
    assert (r["n_train"], r["effective_batch"], r["warmup_steps"]) == (3500, 16, int(3500 / 16 * 3 * 0.03))
    g = spark.createDataFrame([("LOW", "LOW"), ("HIGH", "LOW"), ("LOW", "MEDIUM")], "pred string, gold string")
    a = P.accuracy(g).first()
    assert abs(a["accuracy"] - 1 / 3) < 1e-12
    m = P.majority_baseline(g).first()
    assert (m["majority_class"], round(m["majority_share"], 6)) == ("LOW", round(2 / 3, 6))


def test_cardinality_exact_and_approx(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), (None, "y")], "contract_name string, clause_type string")
    ex = P.cardinality(df).first()
    ap = P.cardinality(df, approx=True).first()
    assert (ex["n_contract_name"], ex["n_clause_type"]) == (2, 2)
    assert (ap["n_contract_name"], ap["n_clause_type"]) == (2, 2)
    sh = P.shape(df).first()
    assert (sh["n_rows"], sh["n_cols"]) == (4, 2)
