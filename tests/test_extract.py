import json

from clausekit.operators import extract
from clausekit.sources import corpus as src
from conftest import rows


def _corpus_obj():
    return {"data": [
        {"title": "Alpha.pdf", "paragraphs": [
            {"context": "ctx one", "qas": [
                {"id": "q1", "question": 'Highlight "Parties" here', "is_impossible": True,
                 "answers": [{"text": "should not appear"}]},
                {"id": "q2", "question": 'About "Governing Law"', "is_impossible": False, "answers": []},
                {"id": "q3", "question": 'About "License Grant" and "x"', "is_impossible": False,
                 "answers": [{"text": "first"}, {"text": "second"}]},
            ]}]},
        {"title": "Beta", "paragraphs": [
            {"context": "ctx two", "qas": [
                {"id": "q4", "question": "no quoted type", "is_impossible": False,
                 "answers": [{"text": "third"}]}]}]},
    ]}


def test_flatten_corpus_multiline_json(spark, tmp_path):
    p = tmp_path / "corpus.json"
    p.write_text(json.dumps(_corpus_obj(), indent=2))
    df = extract.flatten_corpus(src.read_corpus(spark, str(p)))
    got = rows(df, "contract_name", "clause_type", "q_id", "clause_text", "full_context",
               "c_pos", "p_pos", "q_pos", "a_pos")
    # impossible -> 0 rows, empty answers -> 0 rows, two answers -> 2 rows
    assert got == [
        ("Alpha.pdf", "License Grant", "q3", "first", "ctx one", 0, 0, 2, 0),
        ("Alpha.pdf", "License Grant", "q3", "second", "ctx one", 0, 0, 2, 1),
        ("Beta", "Unknown", "q4", "third", "ctx two", 1, 0, 0, 0),
    ]


def test_flatten_corpus_json_lines(spark, tmp_path):
    p = tmp_path / "corpus.jsonl"
    p.write_text("\n".join(json.dumps(c) for c in _corpus_obj()["data"]))
    df = extract.flatten_corpus(src.read_corpus(spark, str(p), json_lines=True), with_context=False)
    assert "full_context" not in df.columns
    assert sorted(r["clause_text"] for r in df.collect()) == ["first", "second", "third"]


def test_answerable_null_flag_rejected(spark):
    schema = "data array<struct<title string, paragraphs array<struct<context string, qas array<struct<id string, question string, is_impossible boolean, answers array<struct<text string>>>>>>>>, file_ord bigint"
    df = spark.createDataFrame([([("T", [("c", [("q", '"A"', None, [("t",)])])])], 0)], schema)
    assert extract.flatten_corpus(df).count() == 0


def test_skip_clause_types_keeps_null(spark):
    df = spark.createDataFrame([("Parties",), ("Document Name",), (None,), ("Non-Compete",)], "clause_type string")
    got = sorted((r["clause_type"] or "") for r in extract.skip_clause_types(df).collect())
    assert got == ["", "Non-Compete"]


def test_filter_by_word_count(spark):
    df = spark.createDataFrame([("a b c",), ("one",), ("a b c d e f",)], "clause_text string")
    df = extract.with_word_count(df)
    assert [r["n_words"] for r in extract.filter_by_word_count(df, max_words=4).collect()] == [3, 1]
    assert [r["n_words"] for r in extract.filter_by_word_count(df, min_words=1, max_words=1).collect()] == [1]


def test_read_master_cp1252_and_na(spark, tmp_path):
    from clausekit.schemas import MASTER_COLUMNS
    lines = [",".join(f'"{c}"' for c in MASTER_COLUMNS + ["Extra"])]
    lines.append(",".join(['"LECLANCHÉ S.A. - X.pdf"', '"Supply “Agreement”"', '"NA"', '""',
                           '"2020"', '"1 year"', '"30\ndays"', '"Delaware"', '"e"']))
    p = tmp_path / "master.csv"
    p.write_bytes(("\r\n".join(lines) + "\r\n").encode("cp1252"))
    m = src.read_master(spark, str(p)).collect()
    assert len(m) == 1
    r = m[0]
    assert r["filename"] == "LECLANCHÉ S.A. - X.pdf"
    assert r["document_name_answer"] == "Supply “Agreement”"
    assert r["agreement_date_answer"] is None and r["effective_date_answer"] is None
    assert r["notice_period_answer"] == "30\ndays"
    assert "Extra" not in m[0].asDict()


def test_stage_roundtrip_csv(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", [1, 2])], "t string, ids array<int>")
    src.write_stage(df, str(tmp_path / "s"), fmt="csv")
    back = src.read_stage(spark, str(tmp_path / "s"), "t string, ids string", fmt="csv").first()
    assert back["t"] == "a\nb" and back["ids"] == "[1,2]"


def test_read_or_empty(spark, tmp_path):
    df = src.read_or_empty(spark, str(tmp_path / "missing"), "a string")
    assert df.count() == 0 and df.columns == ["a"]


def test_clause_ordinal_follows_document_order(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps(_corpus_obj()))
    df = extract.with_clause_ordinal(extract.flatten_corpus(src.read_corpus(spark, str(p))))
    got = [r["clause_text"] for r in df.orderBy("ord").collect()]
    assert got == ["first", "second", "third"]
    assert sorted(r["ord"] for r in df.collect()) == [0, 1, 2]


def test_csv_stage_keeps_edge_whitespace(spark, tmp_path):
    df = spark.createDataFrame([(" lead", "trail ", None)], "a string, b string, c string")
    src.write_stage(df, str(tmp_path / "w"), fmt="csv", encoding="windows-1252")
    back = src.read_stage(spark, str(tmp_path / "w"), "a string, b string, c string", fmt="csv").first()
    assert (back["a"], back["b"], back["c"]) == (" lead", "trail ", None)
