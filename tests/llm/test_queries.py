"""Registered queries whose operators are checked against plain Python elsewhere
(tests/llm/test_brute_force.py, tests/llm/test_alignment.py): the query is the operator
over the whole tables."""

import pytest

from clausekit.llm.alignment import align_tokens
from clausekit.llm.chat import format_chat, read_back
from clausekit.llm.decontaminate import contaminated
from clausekit.llm.licenses import find_licenses
from clausekit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def chat(t):
    said = "\\### Assistant: </turn> ok"
    extra = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    turns = t("conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chat(turns.unionByName(turns.sparkSession.createDataFrame(extra, turns.schema))))


@pytest.mark.parametrize("name,operator", [
    ("op1_benchmark_decontamination", lambda t: contaminated(t("documents"), t("benchmark"))),
    ("op5_license_scan", lambda t: find_licenses(t("documents"))),
    ("op7_chat_formatting", chat),
    ("op12_token_alignment", lambda t: align_tokens(t("documents"))),
])
def test_query_is_the_operator_over_whole_tables(spark, name, operator):
    want = operator(lambda table: spark.read.parquet(f"{SF}/{table}.parquet"))
    got = QUERIES[name](spark, SF)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
