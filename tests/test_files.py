"""Checked readers, file order without moving rows."""

import json

import pytest
from pyspark.sql import functions as F

from clausekit.operators import file_order
from clausekit.sources import corpus, rejects
from conftest import rows

QA = {"id": "1", "question": 'the "X" part', "is_impossible": False, "answers": [{"text": "t1"}, {"text": "t2"}]}


def contract(title="A.pdf", *qas):
    return {"title": title, "paragraphs": [{"context": "c", "qas": list(qas or (QA,))}]}


def without(d, *keys):
    return {k: v for k, v in d.items() if k not in keys}


DAMAGED = [
    (json.dumps(contract()), 2, []),
    (json.dumps(contract())[:-9], 0, [(None, None, None, "malformed record")]),
    ('{"title": 5, "paragraphs": "none"}', 0, [(None, None, None, "malformed record")]),
    ("[1, 2", 0, [(None, None, None, "malformed record")]),
    (json.dumps(without(contract(), "title")), 0, [(0, None, None, "contract without title")]),
    (json.dumps(without(contract(), "paragraphs")), 0, [(0, None, None, "contract without paragraphs")]),
    (json.dumps({"title": "B", "paragraphs": [{"qas": []}, {"context": "x"}, {"context": "x", "qas": [QA]}]}), 2,
     [(0, 0, None, "paragraph without context"), (0, 1, None, "paragraph without qas")]),
    (json.dumps(contract("C", without(QA, "is_impossible"), QA, without(QA, "answers"), without(QA, "id"), without(QA, "question"),
                         {**QA, "answers": [{"text": "x"}, {}]})), 2,
     [(0, 0, 0, "question without is_impossible"), (0, 0, 2, "question without answers"), (0, 0, 3, "question without id"),
      (0, 0, 4, "question without text"), (0, 0, 5, "answer without text")]),
    # nothing is missing here that is needed
    (json.dumps(contract("D", {"is_impossible": True}, {"is_impossible": False, "answers": []})), 0, []),
    (json.dumps({"title": "E", "paragraphs": []}), 0, []),
]


def test_every_record_is_kept_or_rejected(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(x for x, _, _ in DAMAGED[:6]) + "\n\n")
    (tmp_path / "b.jsonl").write_text("\n".join(x for x, _, _ in DAMAGED[6:]))
    got = rejects.check_corpus(spark, str(tmp_path))
    kept = {r.file_ord: r["count"] for r in got.kept.groupBy("file_ord").count().collect()}
    assert kept == {i: n for i, (_, n, _) in enumerate(DAMAGED) if n}
    found = got.rejected.collect()
    want = [(i, *w) for i, (_, _, ws) in enumerate(DAMAGED) for w in ws]
    assert sorted(map(str, want)) == sorted(str((r.file_ord, r.c_pos, r.p_pos, r.q_pos, r.reason)) for r in found)
    by_line = {r.file_ord: r for r in found}
    assert by_line[1].content == DAMAGED[1][0] and by_line[1].file.endswith("a.jsonl") and by_line[7].file.endswith("b.jsonl")
    flat = corpus.read_clauses(spark, str(tmp_path), json_lines=True)
    assert rows(got.kept, "file_ord", "q_pos", "a_pos", "clause_text")[:2] == rows(flat, "file_ord", "q_pos", "a_pos", "clause_text")[:2]


def test_damaged_multi_line_files(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"data": [contract("A"), without(contract("B"), "title"), contract("C")]}, indent=1))
    (tmp_path / "2.json").write_text(json.dumps({"data": [contract("A")]}, indent=1)[:-20])
    (tmp_path / "3.json").write_text('{"other": 1}')
    got = rejects.check_corpus(spark, str(tmp_path), json_lines=False)
    assert rows(got.kept, "file_ord", "c_pos", "contract_name", "a_pos") == [(0, 0, "A", 0), (0, 0, "A", 1), (0, 2, "C", 0), (0, 2, "C", 1)]
    assert sorted((r.file_ord, r.c_pos, r.reason) for r in got.rejected.collect() if r.file_ord == 0) == [(0, 1, "contract without title")]
    assert sorted((r.file_ord, r.reason) for r in got.rejected.collect() if r.file_ord) == [(1, "malformed record"), (2, "malformed record")]


def test_damaged_master(spark, tmp_path):
    from clausekit.schemas import MASTER_COLUMNS
    head = ",".join(f'"{c}"' for c in MASTER_COLUMNS)
    row = lambda *cells: ",".join(f'"{c}"' for c in cells)
    lines = [row("A.pdf", *"1234567"), row("B.pdf", "2"), row("", *"1234567"), row("C.pdf", *"12345678"), row("D’s.pdf", *["two\nlines"] * 7)]
    (tmp_path / "m.csv").write_bytes("\r\n".join([head, *lines, ""]).encode("cp1252"))
    got = rejects.check_master(spark, str(tmp_path / "m.csv"))
    assert rows(got.kept, "file_ord", "filename") == [(0, "A.pdf"), (4, "D’s.pdf")]
    assert rows(got.rejected, "file_ord", "reason") == [(1, "malformed row"), (2, "row without file name"), (3, "malformed row")]
    assert "B.pdf" in got.rejected.where("file_ord = 1").first().content
    (tmp_path / "n.csv").write_text("Filename,Other\na,b\n")
    with pytest.raises(ValueError, match="Document Name-Answer"):
        rejects.check_master(spark, str(tmp_path / "n.csv"))


@pytest.fixture
def lines(tmp_path):
    for name, n in (("b", 900), ("a", 3), ("c", 0), ("d", 250)):
        with open(tmp_path / f"{name}.jsonl", "w") as f:
            for i in range(n):
                f.write(json.dumps(contract(f"{name}{i}", *[QA] * (i % 4), {**QA, "is_impossible": True})) + "\n")
    return str(tmp_path)


def split_by(spark, size, fn):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        return fn()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_same_numbers_under_every_split(spark, lines):
    titles = [f"{f}{i}" for f, n in (("a", 3), ("b", 900), ("d", 250)) for i in range(n)]
    want = [(i, t) for i, t in enumerate(titles) for _ in range(2 * (int(t[1:]) % 4))]
    for size in ("3k", "40k", "128m"):
        got = split_by(spark, size, lambda: corpus.read_clauses(spark, lines, json_lines=True).orderBy("ord").collect())
        assert [(r.file_ord, r.contract_name) for r in got] == want
        assert [r.ord for r in got] == list(range(len(want)))


def test_no_row_is_moved_to_be_numbered(spark, lines):
    plan = corpus.read_clauses(spark, lines, json_lines=True)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    moved = [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x]
    assert moved and "rangepartitioning" not in plan
    # what is exchanged is (path, block) or path, never a contract
    assert all(any(k in x for k in ("_groupingexpression", "path#", "SinglePartition")) for x in moved)


def test_another_split_is_an_error_not_a_wrong_number(spark, lines):
    scan = spark.read.schema("title string").json(lines)
    at = file_order.place(scan).select("title", file_order.PLACE)
    offsets = split_by(spark, "3k", lambda: spark.createDataFrame(file_order.block_offsets(at).collect()))
    with pytest.raises(Exception, match="split in another way"):
        file_order.number(at, offsets, "n").collect()
    assert sorted(r.n for r in file_order.number(at, file_order.block_offsets(at), "n").collect()) == list(range(1153))
    assert file_order.number(at.where(F.lit(False)), offsets, "n").collect() == []


def test_texts_of_contracts_move_once_and_are_written_small(spark, tmp_path):
    """Whole texts pass one exchange on their way into contracts, once a row, and the
    stages between the files are compressed."""
    from clausekit.plans import file_queries as Q
    docs = [(k, f"{k} " + "some words of a long text\n" * 200) for k in range(120, -1, -1)]
    docs += [(5, "again"), (7, None), (None, "no id"), (None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    c = Q.contracts(spark, str(tmp_path))
    moved = [x for x in c._jdf.queryExecution().executedPlan().toString().splitlines()
             if "Exchange" in x and "RoundRobin" not in x]
    assert len(moved) == 1 and "rangepartitioning" in moved[0], moved
    path = Q.write_contract_lines(spark, str(tmp_path))
    back = [r.data[0] for r in corpus.read_corpus(spark, path, json_lines=True).orderBy("file_ord").collect()]
    assert [c.title for c in back] == [None, *[f"Contract {k}" for k in range(11)]]     # in order of their number
    texts = {k: t for k, t in docs[:121]}
    first = [(p.qas[0].id, p.context) for p in back[1].paragraphs]
    want = [(k, texts[k]) for k in range(6)] + [(5, "again"), (6, texts[6]), (7, None)] + [(k, texts[k]) for k in range(7, 12)]
    assert first == [(f"q{k}", t) for k, t in want]
    assert sorted(p.context or "" for p in back[0].paragraphs) == ["", "no id"]
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = fs.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(fs).getLength()
    assert size < sum(len(t or "") for _, t in docs)                        # of twice the texts
