"""Labelling runs that survive a stop: the work list is written once, and every
slice of it is committed by itself.

Layout beside the labelled table ``<done>`` (one row a key, by run and slice):

* ``<done>-runs/run=<n>/rows``   the rows as they came, written once: the upstream
  plan is evaluated one time, and what it gave then is what gets labelled;
* ``<done>-runs/run=<n>/todo``   one row for every key without a label, by slice;
* ``<done>/run=<n>/slice=<k>``   the labels of a slice;
* ``<done>-runs/manifest``       an entry for every slice that is finished.

A folder counts from the moment its ``_SUCCESS`` mark is there.  The next call first
finishes the slices of earlier runs that have none, then starts a run of its own.

``label_within_budget`` works through the same list under a limit of calls a minute
over all tasks and of calls a day.  Each call is one attempt; a row whose reply is
no label comes back in a later slice, until it has one or no attempt is left.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausekit._ship import ensure_shipped
from clausekit.functions import templates as tpl
from clausekit.operators import label as L
from clausekit.sources.corpus import committed, read_or_empty, subfolders

MANIFEST = "run string, slice int, day string, reserved bigint, calls bigint, state string, entry string"
#: Calls start a little further apart than the limit asks for: clocks are read, not met.
MARGIN = 1.02


def _runs(done_path: str) -> str:
    return f"{done_path.rstrip('/')}-runs"


def _enter(spark: SparkSession, done_path: str, *entry) -> None:
    """Add an entry to the manifest: one small file, there in whole or not at all."""
    row = spark.createDataFrame([(*entry, uuid.uuid4().hex)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{_runs(done_path)}/manifest")


def manifest(spark: SparkSession, done_path: str) -> DataFrame:
    return read_or_empty(spark, f"{_runs(done_path)}/manifest", MANIFEST)


def labelled(spark: SparkSession, done_path: str, schema: T.StructType) -> DataFrame:
    """The labelled table: all finished slices of all runs."""
    table = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("slice", T.IntegerType())])
    return read_or_empty(spark, done_path, table).select(*schema.names)


def _names(spark: SparkSession, done_path: str) -> list[str]:
    return sorted(x for x in subfolders(spark, _runs(done_path)) if x.startswith("run="))


def _new_run(todo: DataFrame, done: DataFrame, done_path: str, key: str, slices: int) -> str:
    """Write a run's rows and its work list; the name of the run."""
    spark = todo.sparkSession
    name = f"run={len(_names(spark, done_path)):06d}"
    base = f"{_runs(done_path)}/{name}"
    todo.write.mode("overwrite").parquet(f"{base}/rows")
    rows = L.unlabelled(spark.read.schema(todo.schema).parquet(f"{base}/rows"), done, key)
    at = F.pmod(F.conv(F.substring(L.content_key(key), 1, 8), 16, 10).cast("bigint"), F.lit(slices)).cast("int")
    rows.withColumn("slice", at).repartition("slice", F.rand(7)).write.mode("overwrite").partitionBy("slice").parquet(f"{base}/todo")
    return name


def _finish(spark: SparkSession, done_path: str, name: str, schema: T.StructType, label) -> None:
    """Label the slices of a run that are not finished, one after the other."""
    todo_path = f"{_runs(done_path)}/{name}/todo"
    if not committed(spark, todo_path):
        return      # the list itself was not finished: its rows come again with the next call
    todo = spark.read.schema(T.StructType([*schema.fields, T.StructField("slice", T.IntegerType())])).parquet(todo_path)
    entered = {r.slice for r in manifest(spark, done_path).where(F.col("run") == name).collect()}
    for k in sorted(int(x.split("=")[1]) for x in subfolders(spark, todo_path) if x.startswith("slice=")):
        out = f"{done_path.rstrip('/')}/{name}/slice={k}"
        if not committed(spark, out):
            label(todo.where(F.col("slice") == k).drop("slice")).write.mode("overwrite").parquet(out)
        if k not in entered:
            calls = spark.read.parquet(out).agg(F.coalesce(F.sum("attempts"), F.lit(0))).first()[0]
            _enter(spark, done_path, name, k, _today(), calls, calls, "labelled")


def label_incremental(todo: DataFrame, done_path: str, make_labeller: Callable[[], L.Labeller],
                      key: str = "enriched_context", commits: int = 8, every_row: bool = False, **kw) -> DataFrame:
    """Label the keys that ``done_path`` does not hold yet, one row each, and
    return the whole labelled table read back from storage, or with ``every_row``
    every row of ``todo`` with the label of its key.

    ``todo`` is evaluated once.  The work is cut into ``commits`` slices by key
    digest, each committed when it is done: a stop between two commits loses and
    repeats nothing, and the next call finishes what is open before it adds its
    own rows (of the same columns)."""
    spark = todo.sparkSession
    schema = L.label_batch(todo.limit(0), make_labeller, **kw).schema

    def run(rows: DataFrame) -> DataFrame:
        return L.label_batch(rows, make_labeller, **kw)

    for name in _names(spark, done_path):
        _finish(spark, done_path, name, todo.schema, run)
    name = _new_run(todo, labelled(spark, done_path, schema), done_path, key, commits)
    _finish(spark, done_path, name, todo.schema, run)
    done = labelled(spark, done_path, schema)
    if not every_row:
        return done
    return L.with_labels(spark.read.schema(todo.schema).parquet(f"{_runs(done_path)}/{name}/rows"), done, key)


# ------------------------------------------------------------------ call budget

def _today() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d")


def lanes_of(calls_per_minute: int, wanted: int) -> tuple[int, int]:
    """(lanes, calls a minute of each): as many lanes as wanted, none with less than
    one call a minute, together within the limit."""
    lanes = max(1, min(wanted, calls_per_minute))
    return lanes, calls_per_minute // lanes


def attempt(rows: DataFrame, make_labeller: Callable[[], L.Labeller], ctx_col: str, calls_per_minute: int,
            lanes: int, minute: float = 60.0, system_prompt: str = tpl.LABEL_SYSTEM_PROMPT) -> DataFrame:
    """One call for every row of ``rows`` (with a running number ``_n``); adds the label
    columns of ``label_batch`` and ``called_at``.

    The slot of a call follows from its running number: number n is call n // lanes of
    lane n % lanes.  A lane is one task; it starts its calls a fixed time apart, the
    first that time after its own start, and a late call moves all later ones.  So a
    lane never starts more than its share of calls in any minute, not even when it is
    run again after a lost executor or follows an earlier job, and all lanes together
    stay within the limit whatever their clocks say.  (Speculative copies of tasks
    would call twice: leave spark.speculation off.)"""
    ensure_shipped(rows.sparkSession)
    lanes, share = lanes_of(calls_per_minute, lanes)
    apart = minute / share * MARGIN
    head, tail = tpl.LABEL_USER_HEAD, tpl.LABEL_USER_TAIL
    names = [c for c in rows.columns if c != "_n"]
    schema = T.StructType([*[rows.schema[c] for c in names], *L.label_fields(), T.StructField("called_at", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = time.monotonic() + apart * (1 + TaskContext.get().partitionId() / lanes)
        labeller = make_labeller()
        for pdf in batches:
            res = []
            for ctx in pdf[ctx_col]:
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + apart
                at = time.time()
                try:
                    reply = labeller(system_prompt, head + ("" if ctx is None else str(ctx)) + tail)
                except Exception:  # noqa: BLE001 - a failed call is an attempt
                    reply = None
                r, why, summary, status = L.parse_reply_py(reply)
                res.append((r, why, summary, status, 1, at))
            lab = pd.DataFrame(res, columns=schema.names[len(names):], index=pdf.index)
            yield pd.concat([pdf[names], lab], axis=1)

    lane = (F.col("_n") % lanes).cast("int")
    return rows.repartitionById(lanes, lane).sortWithinPartitions("_n").mapInPandas(run, schema)


def label_within_budget(todo: DataFrame, done_path: str, make_labeller: Callable[[], L.Labeller],
                        calls_per_minute: int, calls_per_day: int, key: str = "enriched_context",
                        max_retries: int = L.MAX_RETRIES, slice_rows: int = 1000, lanes: int | None = None,
                        minute: float = 60.0, today: Callable[[], str] = _today) -> tuple[DataFrame, str]:
    """Label the keys of ``todo`` under a limit of calls; (labelled table, state).

    The state is "done", or "quota" when the day's calls are used up: the same call on
    another day goes on.  Attempts are kept in ``<done>-runs/attempts``, a slice of at
    most ``slice_rows`` calls at a time.  The manifest reserves the calls of a slice
    before it starts and a slice that was stopped stays reserved, so that the day's
    limit holds over stops; its rows come again.  Rows without a label after
    ``max_retries`` attempts get the default one.  ``slice_rows`` bounds what a stop can
    lose.  The labelled table has a row a key; ``label.with_labels`` gives it to all rows."""
    spark = todo.sparkSession
    fields = [*todo.schema.fields, *L.label_fields()]
    schema = T.StructType(fields)
    attempts_path = f"{_runs(done_path)}/attempts"
    kept = T.StructType([*fields, T.StructField("called_at", T.DoubleType()), T.StructField("slice", T.IntegerType())])
    wanted = lanes or spark.sparkContext.defaultParallelism
    names = _names(spark, done_path)
    if not names or not committed(spark, f"{_runs(done_path)}/{names[-1]}/todo"):
        names = [*names, _new_run(todo, labelled(spark, done_path, schema), done_path, key, 1)]
    run, state = names[-1], "done"
    todo_path = f"{_runs(done_path)}/{run}/todo"
    rows = spark.read.schema(T.StructType([*todo.schema.fields, T.StructField("slice", T.IntegerType())])).parquet(todo_path).drop("slice")
    while True:
        entries = manifest(spark, done_path)
        tried = (read_or_empty(spark, attempts_path, kept).groupBy(L.content_key(key).alias("_k"))
                 .agg(F.count(F.lit(1)).alias("_tried"), F.max(F.col("parse_status") == L.STATUS_OK).alias("_ok")))
        left = rows.withColumn("_k", L.content_key(key)).join(tried, "_k", "left").where(
            ~F.coalesce("_ok", F.lit(False)) & (F.coalesce("_tried", F.lit(0)) < max_retries))
        used = entries.where(F.col("day") == today()).agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("n")).first().n
        room = min(slice_rows, calls_per_day - used)
        # the slice: rows with the fewest attempts first
        part = left.orderBy(F.coalesce("_tried", F.lit(0)), "_k").limit(max(0, room)).select(*todo.columns, "_k")
        part = part.withColumn("_n", (F.row_number().over(Window.orderBy("_k")) - 1).cast("bigint")).drop("_k")
        n = part.count() if room > 0 else 0
        if not n:
            state = "done" if left.isEmpty() else "quota"
            break
        k = entries.count()
        _enter(spark, done_path, run, k, today(), n, n, "called")
        attempt(part, make_labeller, key, calls_per_minute, wanted, minute).write.mode("overwrite").parquet(f"{attempts_path}/slice={k}")
    if state == "done":
        tried = read_or_empty(spark, attempts_path, kept)
        good = F.col("parse_status") == L.STATUS_OK
        # the label of the successful attempt, else the status of the last
        best = F.max_by(F.struct(*L.LABEL_COLUMNS[:4]), F.struct(good, F.col("called_at"))).alias("_l")
        one = tried.groupBy(L.content_key(key).alias("_k")).agg(best, F.count(F.lit(1)).cast("int").alias("attempts"))
        out = rows.withColumn("_k", L.content_key(key)).join(one, "_k")
        out = out.select(*todo.columns, L.with_default(F.col("_l")).alias("_d"), "attempts").select(*todo.columns, "_d.*", "attempts")
        target = f"{done_path.rstrip('/')}/{run}/slice=0"
        if not committed(spark, target):
            out.write.mode("overwrite").parquet(target)
    return labelled(spark, done_path, schema), state
