"""Differential checks against plain-Python statements of the semantics."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausekit.functions import text as tx
from clausekit.functions import tokens as tk
from clausekit.operators import label as L

WS = [chr(i) for i in range(0x3001) if chr(i).isspace()]
ALPHABET = WS + list("abcXYZ.,;\"'é ß") + ["​", "­", "İ", "Σ"]


def _random_texts(n, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_text_functions_match_python(spark):
    texts = _random_texts(3000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", tx.normalize_ws("t").alias("n"), tx.word_count("t").alias("w"),
                    tx.unicode_trim("t").alias("s"), tx.clean_clause_text("t").alias("c")).collect()
    for r in out:
        t = texts[r["i"]]
        assert r["n"] == " ".join(t.split())
        assert r["w"] == len(t.split())
        assert r["s"] == t.strip()
        assert r["c"] == " ".join(t.split()).lower()


def _py_mask(n_full, n_resp):
    full = list(range(1, n_full + 1))
    temp = [-100] * n_full
    start = n_full - n_resp
    temp[start:] = full[start:]
    return temp


def test_mask_matches_python_slice(spark):
    cases = [(n, m) for n in range(0, 9) for m in range(0, 20)]
    df = spark.createDataFrame([(list(range(1, n + 1)), m) for n, m in cases], "ids array<int>, m int")
    got = [list(r["l"]) for r in df.select(tk.mask_instruction_n(F.col("ids"), F.col("m")).alias("l")).collect()]
    assert got == [_py_mask(n, m) for n, m in cases]


@settings(max_examples=300, deadline=None)
@given(st.one_of(
    st.text(max_size=30),
    st.dictionaries(st.sampled_from(["risk_level", "risk_reason", "plain_summary", "x"]),
                    st.one_of(st.sampled_from(["HIGH", "MEDIUM", "LOW", "low"]), st.none(), st.integers()),
                    max_size=4).map(lambda d: __import__("json").dumps(d)),
))
def test_parse_status_is_total_and_consistent(reply):
    r, why, summ, status = L.parse_reply_py(reply)
    assert status in {"ok", "json_error", "invalid_format", "error"}
    if status == "ok":
        assert r in L.RISK_LEVELS
    else:
        assert r is None and why is None and summ is None
