from clausekit.operators import metadata as M
from conftest import rows

MASTER_SCHEMA = ("filename string, document_name_answer string, agreement_date_answer string, "
                 "effective_date_answer string, expiration_date_answer string, renewal_term_answer string, "
                 "notice_period_answer string, governing_law_answer string, file_ord bigint")
CLEAN_SCHEMA = "clause_text_cleaned string, clause_type string, contract_name string, ord bigint"


def _master(spark, rows_):
    return spark.createDataFrame(rows_, MASTER_SCHEMA)


def _clean(spark, rows_):
    return spark.createDataFrame(rows_, CLEAN_SCHEMA)


def test_alias_both_sides(spark):
    acc = "LECLANCHÉ S.A. - JOINT DEVELOPMENT AND MARKETING AGREEMENT"
    c = _clean(spark, [("x", "Governing Law", acc, 1)])
    m = _master(spark, [(acc + ".pdf", "Dev", None, None, None, None, None, "Swiss", 0)])
    e = M.enrich(c, m, with_metadata=False).collect()
    assert len(e) == 1
    assert e[0]["contract_name"] == "LECLANCH S.A. - JOINT DEVELOPMENT AND MARKETING AGREEMENT"


def test_unmatched_goes_to_quarantine(spark):
    c = _clean(spark, [("x", "Parties", "A", 1), ("y", "Parties", "B", 2)])
    m = _master(spark, [("A.pdf", None, None, None, None, None, None, None, 0)])
    assert [r["contract_name"] for r in M.enrich(c, m).collect()] == ["A"]
    assert [r["contract_name"] for r in M.unmatched_clauses(c, m).collect()] == ["B"]


def test_first_master_row_wins_no_fanout(spark):
    c = _clean(spark, [("t", "Document Name", "A", 1), ("u", "Parties", "A", 2)])
    m = _master(spark, [("A.pdf ", "Second", None, None, None, None, None, None, 5),
                        ("A.PDF", "First", None, None, None, None, None, None, 3)])
    e = M.enrich(c, m).collect()
    assert len(e) == 2
    assert {r["metadata"]["document_name"] for r in e} == {"First"}


def _ctx(spark, clauses, master_row, **kw):
    c = _clean(spark, clauses)
    m = _master(spark, [master_row])
    meta = M.contract_metadata(M.canonicalize_clauses(c), M.dedupe_master(M.canonicalize_master(m)))
    return M.with_metadata_context(meta, **kw).first()


def test_present_type_null_master_cell_renders_nan(spark):
    r = _ctx(spark, [("t", "Renewal Term", "A", 1), ("t", "governing law", "A", 2)],
             ("A.pdf", None, None, None, None, None, None, None, 0))
    assert r["renewal_term"] is None
    assert r["metadata_context"] == ("Jurisdiction : nan\nRenewal Term: nan\n"
                                     "Notice Period to terminate renewal: None\n"
                                     "Key Provisions: Change of Control,Cap on Liability,Minimum Commitment")
    r2 = _ctx(spark, [("t", "Renewal Term", "A", 1)],
              ("A.pdf", None, None, None, None, None, None, None, 0), null_text=None)
    assert "Renewal Term" not in r2["metadata_context"]


def test_absent_types_defaults_and_skipped_lines(spark):
    r = _ctx(spark, [("t", "Non-Compete", "A", 1)],
             ("A.pdf", "Supply", None, None, None, "2 years", "30 days", "Texas", 0))
    assert (r["document_name"], r["governing_law"], r["renewal_term"], r["notice_period"]) == \
        ("", "", "Not Applicable", "None")
    assert r["metadata_context"] == ("Renewal Term: Not Applicable\n"
                                     "Notice Period to terminate renewal: None\n"
                                     "Key Provisions: Change of Control,Cap on Liability,Minimum Commitment")


def test_provision_flags_need_text(spark):
    r = _ctx(spark, [("", "Cap on Liability", "A", 1), ("yes", "TERMINATION FOR CONVENIENCE", "A", 2)],
             ("A.pdf", None, None, None, None, None, None, None, 0))
    assert r["cap_on_liability"] == "None"
    assert r["termination_for_convenience"] == "Yes"
    assert r["metadata_context"].endswith(
        "Key Provisions: Termination for Convenience,Change of Control,Cap on Liability,Minimum Commitment")


def test_strict_provisions(spark):
    r = _ctx(spark, [("t", "Non-Compete", "A", 1)],
             ("A.pdf", None, None, None, None, None, None, None, 0), strict_provisions=True)
    assert "Key Provisions" not in r["metadata_context"]


def test_enriched_template_golden(spark):
    c = _clean(spark, [("the clause.", "Governing Law", "A", 1)])
    m = _master(spark, [("A.pdf", "Supply Agreement", None, None, None, None, None, "Delaware", 0)])
    e = M.enrich(c, m).first()
    assert e["enriched_context"] == (
        "**Contract Context:**\n"
        "    Jurisdiction : Delaware\n"
        "Renewal Term: Not Applicable\n"
        "Notice Period to terminate renewal: None\n"
        "Key Provisions: Change of Control,Cap on Liability,Minimum Commitment\n"
        "\n"
        "    **Target Clause Type:** Governing Law\n"
        "    **Clause Text:**\n"
        "    the clause.")
    flat = M.enrich(c, m, indent="").first()["enriched_context"]
    assert flat.startswith("**Contract Context:**\nJurisdiction : Delaware\n")
    assert flat.endswith("\n\n**Target Clause Type:** Governing Law\n**Clause Text:**\nthe clause.")


def test_extended_metadata_parties_in_order(spark):
    c = _clean(spark, [("bob", "Parties", "A", 5), ("alice", "Parties", "A", 2),
                       ("x", "Agreement Date", "A", 3)])
    m = _master(spark, [("A.pdf", None, "1/1/2020", "2/2/2020", None, None, None, None, 0)])
    meta = M.contract_metadata(M.canonicalize_clauses(c), M.dedupe_master(M.canonicalize_master(m)), True)
    r = M.with_metadata_context(meta, extended=True).first()
    assert r["parties"] == ["alice", "bob"]
    assert (r["agreement_date"], r["effective_date"], r["expiration_date"]) == ("1/1/2020", "Unknown", "Unknown")
    assert r["metadata_context"].startswith("Parties Involved: alice; bob\nDate signed: 1/1/2020\n"
                                            "Expiration Date: Unknown\nEffective Date: Unknown\n")


def test_clauses_by_contract_chunks_bounded(spark):
    c = _clean(spark, [("t%d" % i, "T", "A", i) for i in range(10)] + [("z", "T", None, 99)])
    g = M.clauses_by_contract(c, chunk=4)
    got = rows(g.selectExpr("contract_name", "chunk", "transform(clauses, x -> x.ord) AS o"))
    assert [(r[1], list(r[2])) for r in got] == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7]), (2, [8, 9])]


def test_join_reconciliation(spark):
    c = M.canonicalize_clauses(_clean(spark, [("t", "T", "A", 1), ("t", "T", "B", 2)]))
    m = M.canonicalize_master(_master(spark, [("B.pdf", None, None, None, None, None, None, None, 0),
                                              ("C.pdf", None, None, None, None, None, None, None, 1)]))
    assert rows(M.join_reconciliation(c, m)) == [("A", "left_only"), ("C", "right_only")]


def test_enriched_plus_quarantine_is_input(spark):
    from conftest import SF01
    from clausekit.plans import enrichment as E
    from clausekit.sources import adapters as X
    clean = E.clean_clauses(spark, SF01)
    master = X.master(spark, SF01)
    e = M.enrich(clean, master, with_metadata=False).select("ord")
    q = M.unmatched_clauses(clean, master).select("ord")
    assert e.count() + q.count() == clean.count() == 1000
    assert e.join(q, "ord", "inner").count() == 0
    assert e.select("ord").distinct().count() == e.count()   # no fan-out from duplicate master rows
