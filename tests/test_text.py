from pyspark.sql import functions as F

from clausekit.functions import text as tx

# every character Python's str.split() treats as whitespace
PY_WS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first()["o"]


def test_clause_type_from_question(spark):
    q = tx.clause_type_from_question
    assert _one(spark, q, 'related to "Parties" or "Other"') == "Parties"
    assert _one(spark, q, "no quotes here") == "Unknown"
    assert _one(spark, q, 'empty "" quotes') == "Unknown"
    assert _one(spark, q, 'spans "two\nlines" ok') == "two\nlines"
    assert _one(spark, q, None) == "Unknown"


def test_normalize_matches_python_split_join(spark):
    samples = ["a\tb\nc d e\x1cf\x85g", "  edges  ", "", " \t\n ", "x", "a" + PY_WS + "b",
               "multi   space\r\nlines　end​"]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    out = df.select("v", tx.normalize_ws(F.col("v")).alias("n"), tx.word_count(F.col("v")).alias("w")).collect()
    for r in out:
        assert r["n"] == " ".join(r["v"].split())
        assert r["w"] == len(r["v"].split())


def test_ws_class_covers_python_whitespace(spark):
    # each Python whitespace char alone splits two words; U+200B is not whitespace
    df = spark.createDataFrame([("a" + c + "b",) for c in PY_WS + "​"], "v string")
    got = [r["w"] for r in df.select(tx.word_count(F.col("v")).alias("w")).collect()]
    assert got == [2] * len(PY_WS) + [1]


def test_normalize_on_documents_equals_python(spark):
    from conftest import SF01
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = docs.select("text", tx.normalize_ws(F.col("text")).alias("n"),
                      tx.word_count(F.col("text")).alias("w")).collect()
    assert len(out) == 1000
    for r in out:
        assert r["n"] == " ".join(r["text"].split())
        assert r["w"] == len(r["text"].split())


def test_word_count_null_and_empty(spark):
    assert _one(spark, tx.word_count, None) == 0
    assert _one(spark, tx.word_count, "") == 0
    assert _one(spark, tx.word_count, "   ") == 0


def test_canonical_contract_name(spark):
    c = tx.canonical_contract_name
    assert _one(spark, c, "A.PDF ") == "A"
    assert _one(spark, c, "A.pdf") == "A"
    assert _one(spark, c, "A.pdf.x") == "A.pdf.x"
    assert _one(spark, c, "  B.Pdf \n") == "B"


def test_unicode_trim(spark):
    assert _one(spark, tx.unicode_trim, "  x y \n") == "x y"


def test_contains_ci_null_safe(spark):
    df = spark.createDataFrame([("Could Not Generate label",), (None,), ("fine",)], "v string")
    got = [r["m"] for r in df.select(tx.contains_ci("v", "could not generate").alias("m")).collect()]
    assert got == [True, False, False]
