from clausekit.operators import scoring as V

SCHEMA = ("clause_text string, target_clause string, contract_type string, jurisdiction string, "
          "renewal_term string, notice_period string, has_liability_cap boolean, has_termination boolean, "
          "has_change_control boolean, has_minimum_commitment boolean")


def test_validation_order_and_defaults(spark):
    df = spark.createDataFrame([
        ("   ", "Non-Compete", None, None, None, None, None, None, None, None),
        ("text", "Select clause type...", None, None, None, None, None, None, None, None),
        ("", "Select clause type...", None, None, None, None, None, None, None, None),
        ("text", None, None, None, None, None, None, None, None, None),
    ], SCHEMA)
    out = V.inference_prompts(df).collect()
    assert [r["message"] for r in out] == [V.MSG_EMPTY_TEXT, V.MSG_NO_TYPE, V.MSG_EMPTY_TEXT, None]
    last = out[3]
    assert (last["contract_type"], last["jurisdiction"], last["renewal_term"], last["notice_period"],
            last["target_clause"]) == ("Service Agreement", "Delaware", "Not Applicable", "none", "")
    assert list(last["key_provisions"]) == [] and out[0]["prompt"] is None


def test_inference_prompt_golden(spark):
    df = spark.createDataFrame([("its products are warranted.", "Warranty Duration", "Distributor Agreement",
                                 "Texas", "6 months", None, True, True, True, True)], SCHEMA)
    r = V.inference_prompts(df).first()
    assert r["prompt"] == (
        "\n  Analyse the following clause and provide:\n1. Clause type classification\n"
        "2. Risk assessment (HIGH/MEDIUM/LOW) with explanation\n3. Plain English summary\n\n"
        "**Contract Context:**\n    Contract Type: Distributor Agreement\nJurisdiction : Texas\n"
        "Renewal Term: 6 months\nNotice Period to terminate renewal: none\n"
        "Key Provisions: Cap on Liability, Termination for Convenience, Change of Control, Minimum Commitment\n\n"
        "    **Target Clause Type:** Warranty Duration\n    **Clause Text:**\n      its products are warranted.\n\n"
        "Provide your analysis:\n")


def make_echo(**generation):
    assert generation["max_new_tokens"] == 350 and generation["temperature"] == 0.3
    return lambda p: p + "  ANSWER \n"


def test_score_batch_strips_prompt(spark):
    df = spark.createDataFrame([("clause", "Insurance", None, None, None, None, None, None, None, None),
                                ("", "Insurance", None, None, None, None, None, None, None, None)], SCHEMA)
    out = V.score_batch(V.inference_prompts(df), make_echo).collect()
    assert sorted(r["response"] for r in out) == sorted(["ANSWER", V.MSG_EMPTY_TEXT])


def test_out_of_domain_report(spark):
    df = spark.createDataFrame([("t", "Warranty Duration", "NDA", "Texas", None, None, None, None, None, None),
                                ("t", "My Type", "Lease", "Mars", None, None, None, None, None, None)], SCHEMA)
    out = V.out_of_domain(df).collect()
    assert len(out) == 1 and list(out[0]["out_of_domain"]) == ["target_clause", "contract_type", "jurisdiction"]
