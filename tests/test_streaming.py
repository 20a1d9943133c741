import json
import os

import pytest

from clausekit.operators import label as L
from clausekit.streaming import incremental as S


def make_ok():
    def f(system, user):
        return json.dumps({"risk_level": "LOW", "risk_reason": "r", "plain_summary": "s"})
    return f


def test_label_stream_resumes_by_key(spark, tmp_path):
    src = tmp_path / "todo"
    spark.createDataFrame([("a",), ("b",)], "enriched_context string").write.parquet(str(src / "p1"))
    todo = spark.readStream.schema("enriched_context string").parquet(str(src / "*"))
    done = str(tmp_path / "done")
    q = S.label_stream(todo, done, str(tmp_path / "chk"), make_ok, pause_s=0)
    q.awaitTermination()
    spark.createDataFrame([("b",), ("c",)], "enriched_context string").write.parquet(str(src / "p2"))
    todo2 = spark.readStream.schema("enriched_context string").parquet(str(src / "*"))
    q2 = S.label_stream(todo2, done, str(tmp_path / "chk"), make_ok, pause_s=0)
    q2.awaitTermination()
    out = spark.read.parquet(done)
    assert sorted(r["enriched_context"] for r in out.collect()) == ["a", "b", "c"]
    assert {r["parse_status"] for r in out.collect()} == {L.STATUS_OK}


def test_repeated_and_null_keys_keep_every_row(spark, tmp_path, monkeypatch):
    from clausekit.plans import catalog
    sampled = [(1, "T", "a"), (2, "T", "a"), (3, "U", "a"), (4, "T", None), (5, "T", None), (6, "T", ""), (6, "T", "")]
    df = spark.createDataFrame(sampled, "ord bigint, clause_type string, enriched_context string")
    monkeypatch.setattr(catalog.D, "sampled", lambda spark, d: df)
    want = sorted(map(tuple, catalog.q_label_batch_stub(spark, "").collect()))
    assert len(want) == 7
    assert sorted(map(tuple, catalog.q_stream_label_sampled(spark, "").collect())) == want
    done = str(tmp_path / "done")
    for _ in range(2):
        out = L.label_incremental(df, done, catalog.make_stub_labeller, commits=2, every_row=True, pause_s=0.0)
        assert sorted((r.ord, *r[3:]) for r in out.collect()) == want
    assert spark.read.parquet(done).count() == 3         # one call a key, null too


def test_stream_enrich_equals_batch(spark):
    import __spark_entry__ as E
    from conftest import SF001, rows
    s = E.queries()["stream_enrich_clauses"](spark, SF001)
    b = E.queries()["enrich_clauses"](spark, SF001)
    assert rows(s) == rows(b)


@pytest.mark.parametrize("batch_bytes", [S.BATCH_BYTES, 1])     # all files in a micro-batch, one in each
def test_stream_of_tables_that_are_folders(spark, tmp_path, monkeypatch, batch_bytes):
    from clausekit.plans import catalog
    from conftest import rows
    monkeypatch.setattr(S, "BATCH_BYTES", batch_bytes)
    docs = [(k, f"Text {k}", "en", "web", 6) for k in range(60)] + [(3, "again", "en", "web", 5), (None, "x", "en", "web", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, "BUILDING") for k in range(4)], "c_custkey bigint, c_nationkey bigint, c_mktsegment string") \
        .repartition(2).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "PERU")], "n_nationkey bigint, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = rows(catalog.q_stream_enrich_clauses(spark, str(tmp_path)))
    assert len(got) == 49 and got == rows(catalog.q_enrich_clauses(spark, str(tmp_path)))


def test_late_contracts_wait_and_are_retried(spark, tmp_path):
    src, meta, out, chk = (str(tmp_path / d) for d in ("src", "meta", "out", "chk"))
    rows = [("A", "Parties", "x y", 1), ("B", "Parties", "late", 2), (None, "Parties", "none", 3)]
    spark.createDataFrame(rows, "contract_name string, clause_type string, clause_text string, ord bigint").write.parquet(src)
    schema = spark.read.parquet(src).schema

    def known(*names):
        spark.createDataFrame([(n, f"ctx {n}") for n in names], "contract_name string, metadata_context string") \
            .write.mode("overwrite").parquet(meta)

    known("A")
    S.enrich_stream(spark.readStream.schema(schema).parquet(src), meta, out, chk).awaitTermination()
    assert [r.ord for r in spark.read.parquet(out).collect()] == [1]
    known("A", "B")
    got = S.retry_waiting(spark, meta, out).collect()
    assert [(r.ord, "ctx B" in r.enriched_context) for r in got] == [(2, True)]


@pytest.fixture
def late(spark, tmp_path):
    """A running sink whose contracts arrive one after the other."""
    class Late:
        src, meta, out, chk = (str(tmp_path / d) for d in ("src", "meta", "out", "chk"))
        schema = "contract_name string, clause_type string, clause_text string, ord bigint"

        def clauses(self, rows):
            spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.src)

        def known(self, *names):
            spark.createDataFrame([(n, f"ctx {n}") for n in names], "contract_name string, metadata_context string") \
                .coalesce(1).write.mode("overwrite").parquet(self.meta)

        def run(self):
            S.enrich_stream(spark.readStream.schema(self.schema).parquet(self.src), self.meta, self.out, self.chk).awaitTermination()

        def seen(self):
            """What a reader sees: (sink, moved, still waiting)."""
            moved = S.retry_waiting(spark, self.meta, self.out)
            return [sorted(r.ord for r in x.collect()) for x in (spark.read.parquet(self.out), moved, S.waiting(spark, self.out))]
    return Late()


def test_waiting_table_shrinks(spark, late):
    late.clauses([("A", "T", "x", 1), ("B", "T", "x", 2), ("C", "T", "x", 3), ("C", "T", "x", 3)])
    late.known("A")
    late.run()
    assert late.seen() == [[1], [], [2, 3, 3]]
    late.known("A", "B")
    assert late.seen() == [[1], [2], [3, 3]]
    late.clauses([("B", "T", "x", 4), ("C", "T", "x", 5)])
    late.run()
    assert late.seen() == [[1, 4], [2], [3, 3, 5]]
    assert late.seen() == [[1, 4], [2], [3, 3, 5]]          # nothing moves twice
    late.known("A", "B", "C")
    assert late.seen() == [[1, 4], [2, 3, 3, 5], []]
    state = f"{late.out}-waiting-state"
    files = [f for d, _, fs in os.walk(state) for f in fs if f.startswith("part-") and "arrived=false" in d]
    raw = [f for d, _, fs in os.walk(f"{late.out}-waiting") for f in fs if f.startswith("part-")]
    assert not files and not raw                            # nothing is left to read again


def test_replayed_batch_does_not_come_twice(spark, late):
    """The driver is lost after a batch was written and moved, before the stream's commit."""
    late.clauses([("A", "T", "x", 1), ("B", "T", "x", 2)])
    late.known("A")
    late.run()
    late.known("A", "B")
    assert late.seen() == [[1], [2], []]
    for f in os.listdir(f"{late.chk}/commits"):
        os.remove(f"{late.chk}/commits/{f}")
    late.run()
    assert late.seen() == [[1], [2], []]


def test_a_move_that_is_cut_short_changes_nothing(spark, late, monkeypatch):
    late.clauses([("A", "T", "x", 1), ("B", "T", "x", 2), ("C", "T", "x", 3)])
    late.known("A")
    late.run()
    late.known("A", "B")
    real = S.committed
    # the version's rows are written, its list of batches is not
    monkeypatch.setattr(S, "remove", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        S.retry_waiting(spark, late.meta, late.out)
    os.remove(f"{late.out}-waiting-state/version=1/batches/_SUCCESS")
    monkeypatch.undo()
    assert S.committed is real and sorted(r.ord for r in S.waiting(spark, late.out).collect()) == [2, 3]
    assert late.seen() == [[1], [2], [3]]
