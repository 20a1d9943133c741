"""Labelling runs: one evaluation, commits by slice, a call budget over all tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from clausekit.operators import label as L
from clausekit.operators import label_runs as R

GOOD = json.dumps({"risk_level": "LOW", "risk_reason": "r", "plain_summary": "s"})


def todo_rows(spark, n=100, keys=60):
    return spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("ctx "), (F.col("id") % keys).cast("string")).alias("enriched_context"))


def logged(path, fail=lambda user, n: False):
    """A labeller that writes a line for every call."""
    def make():
        def call(system, user):
            with open(path, "a") as f:
                f.write(user.replace("\n", " ") + "\n")
            n = open(path).read().count(user.replace("\n", " ") + "\n")
            return "broken" if fail(user, n) else GOOD
        return call
    return make


def calls(path):
    return open(path).read().splitlines() if os.path.exists(path) else []


def test_todo_is_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = todo_rows(spark).withColumn("enriched_context", counted("enriched_context"))
    out = L.label_incremental(rows, str(tmp_path / "done"), lambda: lambda s, u: GOOD, every_row=True, pause_s=0.0)
    assert out.count() == 100 and seen.value == 100


def test_a_stop_between_commits_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    done, log = str(tmp_path / "done"), str(tmp_path / "calls")
    enter, left = R._enter, [3]

    def stops(*a):
        left[0] -= 1
        if left[0] < 0:
            raise KeyboardInterrupt("killed")
        return enter(*a)

    monkeypatch.setattr(R, "_enter", stops)
    with pytest.raises(KeyboardInterrupt):   # after the fourth slice's labels, before its entry
        L.label_incremental(todo_rows(spark), done, logged(log), commits=8, pause_s=0.0)
    assert 0 < len(calls(log)) < 60
    monkeypatch.setattr(R, "_enter", enter)
    out = L.label_incremental(todo_rows(spark, 120, 70), done, logged(log), commits=8, pause_s=0.0)
    assert sorted(r.enriched_context for r in out.collect()) == sorted(f"ctx {i}" for i in range(70))
    assert len(calls(log)) == 70 == len(set(calls(log)))
    entries = R.manifest(spark, done).collect()
    assert len({(e.run, e.slice) for e in entries}) == len(entries) and sum(e.calls for e in entries) == 70


def test_an_unfinished_list_is_no_run(spark, tmp_path):
    done = str(tmp_path / "done")
    todo_rows(spark).write.parquet(f"{done}-runs/run=000000/rows")      # stopped before the list was there
    out = L.label_incremental(todo_rows(spark), done, lambda: lambda s, u: GOOD, pause_s=0.0)
    assert out.count() == 60
    assert L.label_incremental(todo_rows(spark).limit(0), done, lambda: lambda s, u: GOOD, pause_s=0.0).count() == 60


@pytest.mark.parametrize("lanes", [1, 4, 16])
def test_never_more_calls_a_minute_than_allowed(spark, tmp_path, lanes):
    """A minute of 1.5 seconds: no window of that length has more than 30 starts, over
    two slices and their retries."""
    done = str(tmp_path / "done")
    rows = todo_rows(spark, 70, 70)
    out, state = R.label_within_budget(rows, done, logged(str(tmp_path / "log"), lambda u, n: "ctx 7\n" in u and n < 3), 30, 10_000,
                                       slice_rows=40, lanes=lanes, minute=1.5)
    assert state == "done" and out.count() == 70
    at = sorted(r.called_at for r in spark.read.parquet(f"{done}-runs/attempts").collect())
    assert len(at) == 72
    assert all(at[i + 30] - at[i] >= 1.5 for i in range(len(at) - 30))


def test_lanes_stay_within_the_limit():
    for limit in (1, 7, 30, 1000):
        for wanted in (1, 4, 16, 500):
            lanes, share = R.lanes_of(limit, wanted)
            assert share >= 1 and lanes * share <= limit


def test_quota_stops_and_resumes(spark, tmp_path):
    done, log = str(tmp_path / "done"), str(tmp_path / "calls")

    def day(n, fail=lambda u, n: False):
        out, state = R.label_within_budget(todo_rows(spark), done, logged(log, fail), 6_000_000, 25, slice_rows=10, today=lambda: f"day {n}")
        return out.count(), state, len(calls(log))

    assert day(1) == (0, "quota", 25)
    assert day(1) == (0, "quota", 25)
    assert day(2) == (0, "quota", 50)
    assert day(3, lambda u, n: "ctx 1" in u and n < 3)[1] == "quota" or len(calls(log)) <= 75
    n = 3
    while day(n)[1] != "done":
        n += 1
    out = L.with_labels(todo_rows(spark), R.label_within_budget(todo_rows(spark), done, logged(log), 6_000_000, 25, today=lambda: "day 99")[0])
    assert out.count() == 100
    used = {}
    for e in R.manifest(spark, done).collect():
        used[e.day] = used.get(e.day, 0) + e.calls
    assert max(used.values()) <= 25 and sum(used.values()) == len(calls(log))


def test_a_stopped_slice_stays_reserved(spark, tmp_path):
    """The calls of a slice that broke off count for its day; its rows come again."""
    done = str(tmp_path / "done")

    def broken():
        raise RuntimeError("no client")

    with pytest.raises(Exception):
        R.label_within_budget(todo_rows(spark), done, broken, 6_000_000, 50, slice_rows=30, today=lambda: "a")
    out, state = R.label_within_budget(todo_rows(spark), done, logged(str(tmp_path / "log")), 6_000_000, 50, slice_rows=30, today=lambda: "a")
    assert state == "quota" and len(calls(str(tmp_path / "log"))) == 20
    out, state = R.label_within_budget(todo_rows(spark), done, logged(str(tmp_path / "log")), 6_000_000, 50, slice_rows=30, today=lambda: "b")
    assert state == "done" and out.count() == 60 and {r.attempts for r in out.collect()} == {1}
