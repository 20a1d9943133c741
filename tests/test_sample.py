import math

from pyspark.sql import functions as F

from clausekit.operators import sample as S
from conftest import rows


def _strata(spark, sizes):
    data = []
    k = 0
    for name, n in sizes.items():
        for _ in range(n):
            data.append((k, name))
            k += 1
    return spark.createDataFrame(data, "ord bigint, clause_type string")


def test_stratified_sample_caps_and_is_stable(spark):
    df = _strata(spark, {"small": 3, "big": 500})
    s1 = S.stratified_sample(df, cap=110)
    counts = dict(rows(s1.groupBy("clause_type").count()))
    assert counts == {"big": 110, "small": 3}
    s2 = S.stratified_sample(df.repartition(7), cap=110)
    assert rows(s1) == rows(s2)


def test_stratified_sample_matches_hash_rule(spark):
    df = _strata(spark, {"big": 300})
    got = [r["ord"] for r in S.stratified_sample(df, cap=10).collect()]
    import hashlib
    want = sorted(range(300), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))[:10]
    assert sorted(got) == sorted(want)


def test_remaining_exactly_once_vs_anti(spark):
    base = spark.createDataFrame([(1, "dup"), (2, "dup"), (3, "taken"), (4, "free")], "ord bigint, enriched_context string")
    sampled = spark.createDataFrame([(3, "taken")], "ord bigint, enriched_context string")
    once = [r["enriched_context"] for r in S.remaining(base, sampled).collect()]
    assert once == ["free"]
    anti = sorted(r["ord"] for r in S.remaining(base, sampled, mode="anti").collect())
    assert anti == [1, 2, 4]


def test_symmetric_difference(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), (None, 3)], "a string, b int")
    b = spark.createDataFrame([("y", 2), (None, 3), (None, 4)], "a string, b int")
    assert rows(S.symmetric_difference(a, b)) == [(None, 4)] or \
        sorted(rows(S.symmetric_difference(a, b)), key=str) == [(None, 4)]


def test_merge_keep_first(spark):
    first = spark.createDataFrame([("k1", 5, "HIGH"), ("k1", 2, "LOW")], "enriched_context string, ord bigint, risk_level string")
    second = spark.createDataFrame([("k1", 0, "MEDIUM"), ("k2", 1, "MEDIUM")], "enriched_context string, ord bigint, risk_level string")
    got = rows(S.merge_keep_first([first, second]), "enriched_context", "risk_level")
    assert got == [("k1", "LOW"), ("k2", "MEDIUM")]
    again = S.merge_keep_first([S.merge_keep_first([first, second]), second])
    assert rows(again, "enriched_context", "risk_level") == got


def test_split_quotas_and_partition(spark):
    sizes = {"one": 1, "two": 2, "seven": 7, "big": 500}
    df = _strata(spark, sizes)
    sp = S.stratified_split(df)
    n = sum(sizes.values())
    total_train = sp.where("split = 'train'").count()
    assert total_train == n - math.ceil(0.2 * n)
    assert sp.count() == n and sp.select("ord").distinct().count() == n
    bal = {r["clause_type"]: (r["n"], r["n_train"], r["n_val"]) for r in S.split_balance(sp).collect()}
    assert bal["one"] == (1, 1, 0)
    assert all(v[1] + v[2] == v[0] for v in bal.values())
    assert rows(sp) == rows(S.stratified_split(df.repartition(5)))


def test_split_hot_class_uses_bucket_ranking(spark):
    # 20k rows in one class: rank only inside the boundary bucket
    df = spark.range(20000).select(F.col("id").alias("ord"), F.lit("hot").alias("clause_type"))
    sp = S.stratified_split(df)
    assert sp.where("split = 'train'").count() == 20000 - 4000
    import hashlib
    want = set(sorted(range(20000), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))[:16000])
    got = {r["ord"] for r in sp.where("split = 'train'").select("ord").collect()}
    assert got == want


def test_split_materialized_same_result(spark):
    df = _strata(spark, {"a": 40, "b": 9})
    assert rows(S.stratified_split(df, materialize=True)) == rows(S.stratified_split(df))


def test_split_quota_properties():
    """Quota arithmetic on random class sizes (pure: run through Spark once)."""
    import random
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rnd = random.Random(3)
    cases = [[rnd.choice([1, 1, 2, 3, 5, 8, 50, 400]) for _ in range(rnd.randint(1, 12))] for _ in range(25)]
    rows_ = [(i, f"c{j}", n) for i, sizes in enumerate(cases) for j, n in enumerate(sizes)]
    df = spark.createDataFrame(rows_, "case int, clause_type string, n bigint")
    for i, sizes in enumerate(cases):
        q = {r["clause_type"]: r["n_train"] for r in S.split_quotas(df.where(f"case = {i}").drop("case")).collect()}
        total = sum(sizes)
        assert sum(q.values()) == total - math.ceil(0.2 * total)
        for j, n in enumerate(sizes):
            exact = n * (total - math.ceil(0.2 * total)) / total
            assert math.floor(exact) <= q[f"c{j}"] <= math.ceil(exact) and 0 <= q[f"c{j}"] <= n


def test_large_cap_sample_uses_bucket_ranking(spark):
    """cap above the WindowGroupLimit threshold: same rows as the hash rule."""
    import hashlib
    df = spark.range(5000).select(F.col("id").alias("ord"),
                                  F.when(F.col("id") < 4500, "hot").otherwise("cold").alias("clause_type"))
    got = S.stratified_sample(df, cap=2000)
    counts = dict(rows(got.groupBy("clause_type").count()))
    assert counts == {"hot": 2000, "cold": 500}
    hot = sorted(range(4500), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))[:2000]
    assert {r["ord"] for r in got.where("clause_type = 'hot'").collect()} == set(hot)
