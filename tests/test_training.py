from pyspark.sql import functions as F

from clausekit.functions import tokens as tk
from clausekit.operators import training as T
from clausekit.operators.ordinal import dense_ordinal


def test_instruction_response_golden(spark):
    df = spark.createDataFrame([("CTX", "Non-Compete", "HIGH", "why", None)],
                               "enriched_context string, clause_type string, risk_level string, "
                               "risk_reason string, plain_summary string")
    r = T.instruction_response(df).first()
    assert r["instruction"] == ("Analyse the following clause and provide:\n1. Clause type classification\n"
                                "2. Risk assessment (HIGH/MEDIUM/LOW) with explanation\n3. Plain English summary\n\n"
                                "CTX\n\nProvide your analysis:\n\n")
    assert r["response"] == ("**Clause Type:** Non-Compete\n\n**Risk Assessment:** HIGH\n**Explanation:** why"
                             "\n\n**Plain English Summary:** nan")
    assert r["full_text"] == r["instruction"] + "\n\n" + r["response"]


def test_type_line_can_be_removed(spark):
    df = spark.createDataFrame([("**Contract Context:**\n    x\n\n    **Target Clause Type:** Parties\n    **Clause Text:**\n    t",
                                 "Parties", "LOW", "r", "s")],
                               "enriched_context string, clause_type string, risk_level string, "
                               "risk_reason string, plain_summary string")
    r = T.instruction_response(df, include_type_in_prompt=False).first()
    assert "Target Clause Type" not in r["instruction"] and "Parties" in r["response"]


def test_mask_start_rules(spark):
    # full n tokens, response m tokens: start n-m; equal: 0; longer: max(2n-m, 0)
    df = spark.createDataFrame([([1, 2, 3, 4, 5], 2), ([1, 2, 3], 3), ([1, 2, 3], 4), ([1, 2], 7)],
                               "ids array<int>, m int")
    got = [list(r["l"]) for r in df.select(tk.mask_instruction_n(F.col("ids"), F.col("m")).alias("l")).collect()]
    assert got == [[-100, -100, -100, 4, 5], [1, 2, 3], [-100, -100, 3], [1, 2]]
    for full, m in [([1, 2, 3, 4, 5], 2), ([1, 2, 3], 4)]:
        want = [-100] * len(full)
        start = len(full) - m
        want[start:] = full[start:]
        assert want in got


def test_pad_batches_multiple_of_eight(spark):
    df = spark.createDataFrame([(0, list(range(5))), (1, list(range(13)))], "ord bigint, input_ids array<int>")
    df = df.withColumn("attention_mask", tk.attention_mask(F.col("input_ids"))).withColumn(
        "labels", F.col("input_ids"))
    out = T.pad_batches(df, batch_size=2, order_cols=("ord",), pad_id=0).orderBy("ord").collect()
    assert [len(r["input_ids"]) for r in out] == [16, 16]
    assert list(out[0]["labels"][5:]) == [-100] * 11
    assert list(out[0]["attention_mask"]) == [1] * 5 + [0] * 11
    single = T.pad_batches(df, batch_size=1).orderBy("ord").collect()
    assert [len(r["input_ids"]) for r in single] == [8, 16]


def test_dense_ordinal_is_global_rank(spark):
    df = spark.range(0, 5000, 3).repartition(7).withColumnRenamed("id", "k")
    got = sorted((r["row_idx"], r["k"]) for r in dense_ordinal(df, ["k"]).collect())
    assert got == [(i, k) for i, k in enumerate(range(0, 5000, 3))]


def test_render_chat_and_tokens(spark):
    df = spark.createDataFrame([("hi there", "fine thanks")], "instruction string, response string")
    df = df.withColumn("chat_text", T.render_chat(T.chat_messages()))
    r = df.first()
    assert r["chat_text"] == ("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nhi there<|eot_id|>"
                              "<|start_header_id|>assistant<|end_header_id|>\n\nfine thanks<|eot_id|>")
    t = T.format_for_training(df).first()
    assert len(t["input_ids"]) == len(t["attention_mask"]) == len(t["labels"])
    assert sum(1 for x in t["labels"] if x != -100) == 2


def test_truncation(spark):
    df = spark.createDataFrame([(" ".join(["w"] * 3000),)], "t string")
    r = T.tokenize(df, "t").first()
    assert len(r["input_ids"]) == 2048 and sum(r["attention_mask"]) == 2048


def char_len_encode(text):
    return [len(w) for w in text.split()]


def test_pluggable_python_tokenizer(spark):
    df = spark.createDataFrame([("ab cde f", "f"), (None, "x")], "chat_text string, response string")
    tok = tk.udf_tokenizer(char_len_encode)
    out = T.format_for_training(df, tokenizer=tok).collect()
    got = {tuple(r["input_ids"]) if r["input_ids"] is not None else None: list(r["labels"] or []) for r in out}
    assert got[(2, 3, 1)] == [-100, -100, 1]


def test_dense_ordinal_reliable_checkpoint(spark):
    df = spark.range(0, 3000, 7).repartition(5).withColumnRenamed("id", "k")
    got = sorted((r["row_idx"], r["k"]) for r in dense_ordinal(df, ["k"]).collect())
    assert got == [(i, k) for i, k in enumerate(range(0, 3000, 7))]


def test_pad_batches_keeps_all_rows_and_moves_tokens_once(spark):
    from pyspark.sql import functions as F
    n = 200_000
    ids = F.array_repeat(F.col("id").cast("int"), (F.col("id") % 11).cast("int"))
    df = spark.range(n).select((F.lit(n) - F.col("id")).alias("ord"), ids.alias("input_ids"),
                               F.transform(ids, lambda x: F.lit(1)).alias("attention_mask"), ids.alias("labels"))
    out = T.pad_batches(df.repartition(5), batch_size=16)
    assert "rangepartitioning" not in out._jdf.queryExecution().toString()
    got = out.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi"),
                                      F.max(F.size("input_ids")).alias("a"), F.min(F.size("labels")).alias("b")).collect()
    assert sum(r.n for r in got) == n and {r.n for r in got} == {16}
    assert all(r.hi - r.lo == 15 and r.a == r.b and r.a % 8 == 0 for r in got)


def test_pad_batches_with_equal_and_null_places(spark):
    df = spark.createDataFrame([(1, [1]), (1, [2]), (None, [3, 3]), (None, [3, 3]), (1, [4] * 9), (2, [])], "ord int, input_ids array<int>")
    df = df.selectExpr("ord", "input_ids", "input_ids AS attention_mask", "input_ids AS labels")
    out = T.pad_batches(df, batch_size=2).collect()
    assert sorted(str([x for x in r.input_ids if x]) for r in out) == sorted(["[1]", "[2]", "[3, 3]", "[3, 3]", "[4, 4, 4, 4, 4, 4, 4, 4, 4]", "[]"])
    assert sorted(r.batch_id for r in out) == [0, 0, 1, 1, 2, 2]
