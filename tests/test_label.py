import json

from clausekit.operators import label as L
from conftest import rows

REPLIES = [
    ('{"risk_level": "HIGH", "risk_reason": "r", "plain_summary": "s"}', "ok"),
    ('{"risk_level": "HIGH", "risk_reason": "r", "plain_summary": "s"} trailing', "json_error"),
    ("{'risk_level': 'HIGH', 'risk_reason': 'r', 'plain_summary': 's'}", "json_error"),
    ('```json\n{"risk_level": "HIGH", "risk_reason": "r", "plain_summary": "s"}\n```', "json_error"),
    ('{"risk_level": "HIGH", "risk_reason": "line\nbreak", "plain_summary": "s"}', "json_error"),
    ('{"risk_level": "LOW", "risk_reason": "r", "plain_summary": "s", "risk_level": "HIGH"}', "ok"),
    ("[1]", "invalid_format"),
    ('{"risk_level": "HIGH", "risk_reason": "r"}', "invalid_format"),
    ('{"risk_level": "low", "risk_reason": "r", "plain_summary": "s"}', "invalid_format"),
    ('{"risk_level": "MEDIUM", "risk_reason": null, "plain_summary": "s"}', "ok"),
    ("5", "error"),
    (None, "error"),
]


def test_parse_reply_python_rule():
    for reply, want in REPLIES:
        assert L.parse_reply_py(reply)[3] == want, reply
    assert L.parse_reply_py(REPLIES[5][0])[0] == "HIGH"  # duplicate key: last value


def test_parse_reply_udf_matches(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    got = df.select("i", L.parse_reply("reply").alias("p")).collect()
    for r in got:
        assert r["p"]["parse_status"] == REPLIES[r["i"]][1]
    nullreason = [r for r in got if r["i"] == 9][0]["p"]
    assert nullreason["risk_reason"] is None and nullreason["risk_level"] == "MEDIUM"


def test_default_label_and_clean(spark):
    df = spark.createDataFrame([("{bad", "a"), ('{"risk_level": "LOW", "risk_reason": "x", "plain_summary": "y"}', "b")],
                               "reply string, k string")
    lab = df.select("k", L.with_default(L.parse_reply("reply")).alias("l")).select("k", "l.*")
    got = {r["k"]: (r["risk_level"], r["risk_reason"], r["plain_summary"]) for r in lab.collect()}
    assert got["a"] == (L.DEFAULT_RISK, L.DEFAULT_REASON, L.DEFAULT_SUMMARY)
    assert got["b"] == ("LOW", "x", "y")


def test_clean_and_rerun(spark):
    df = spark.createDataFrame([("k1", "Could Not Generate label", "ok"), ("k2", "fine", "COULD NOT GENERATE summary"),
                                ("k3", None, None), ("k4", "ok", "ok")],
                               "enriched_context string, risk_reason string, plain_summary string")
    assert [r[0] for r in rows(L.clean_labels(df), "enriched_context")] == ["k3", "k4"]
    assert [r[0] for r in rows(L.rerun_required(df), "enriched_context")] == ["k2"]


class FlakyLabeller:
    """Fails the first attempt for every prompt, then answers."""

    def __init__(self):
        self.seen = set()

    def __call__(self, system, user):
        if user not in self.seen:
            self.seen.add(user)
            return "not json"
        return json.dumps({"risk_level": "LOW", "risk_reason": "r", "plain_summary": "s"})


def make_flaky():
    return FlakyLabeller()


def make_broken():
    def f(system, user):
        raise RuntimeError("service down")
    return f


def test_label_batch_retries_and_default(spark):
    df = spark.createDataFrame([("ctx a",), ("ctx b",)], "enriched_context string")
    out = L.label_batch(df, make_flaky, pause_s=0).collect()
    assert {(r["risk_level"], r["parse_status"], r["attempts"]) for r in out} == {("LOW", "ok", 2)}
    bad = L.label_batch(df, make_broken, pause_s=0, max_retries=2).collect()
    assert {(r["risk_level"], r["risk_reason"], r["parse_status"], r["attempts"]) for r in bad} == \
        {(L.DEFAULT_RISK, L.DEFAULT_REASON, "error", 2)}


def test_incremental_labelling_labels_each_key_once(spark, tmp_path):
    done = str(tmp_path / "done")
    todo1 = spark.createDataFrame([("a",), ("b",)], "enriched_context string")
    L.label_incremental(todo1, done, make_flaky, pause_s=0)
    todo2 = spark.createDataFrame([("a",), ("b",), ("c",)], "enriched_context string")
    out = L.label_incremental(todo2, done, make_flaky, pause_s=0)
    keys = sorted(r["enriched_context"] for r in out.collect())
    assert keys == ["a", "b", "c"]


def test_label_prompts(spark):
    df = spark.createDataFrame([("CTX",)], "enriched_context string")
    r = L.label_prompts(df).first()
    assert r["user_prompt"] == ("Analyze this contract clause:\n\nCTX\n\n"
                                "Remember: Respond ONLY with valid JSON, nothing else.")
    for key in ("risk_level", "risk_reason", "plain_summary", "HIGH", "MEDIUM", "LOW", "JSON"):
        assert key in r["system_prompt"]


def test_label_batch_concurrency_keeps_rows(spark):
    df = spark.range(50).selectExpr("cast(id as string) AS enriched_context")
    out = L.label_batch(df, make_flaky, pause_s=0, concurrency=3)
    assert out.rdd.getNumPartitions() == 3
    assert sorted(r["enriched_context"] for r in out.collect()) == sorted(str(i) for i in range(50))
