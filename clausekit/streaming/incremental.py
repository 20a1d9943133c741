"""Structured Streaming jobs for clauses that keep arriving.

* ``enrich_stream``: new clause rows (a file stream) meet the written contract
  metadata table, as it is at that time, and are written enriched, one folder per
  micro-batch; clauses of contracts that are not there yet wait in a quarantine,
  which ``retry_waiting`` empties as their contracts arrive.
* ``label_stream``: new rows to label are anti-joined against what the
  labelled table already holds, labelled with ``label_batch`` (one call per
  distinct key) and written per micro-batch to ``<done>/batch_id=<n>``.  A
  micro-batch that is run again after its folder was committed is skipped; one
  that was cut short is labelled again without counting its own folder as done.

Checkpoints and sinks live under the session's reliable checkpoint folder
(``spark.checkpoint.dir``) unless a path is given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clausekit.functions import templates as tpl
from clausekit.operators import extract, label, metadata
from clausekit.session import ensure_checkpoint_dir
from clausekit.sources.corpus import committed, read_or_empty, remove, subfolders


BATCH_BYTES = 1 << 30   # of files in a micro-batch; a larger file is one of its own


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def enrich_stream(clauses: DataFrame, meta_path: str, out_path: str, checkpoint: str,
                  indent: str = "    ", aliases: Mapping[str, str] | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Start the streaming enrichment.

    ``clauses``: a streaming DataFrame of raw clause rows (contract_name,
    clause_type, clause_text, ord).  ``meta_path``: a written table of contract
    metadata with ``metadata_context`` (``metadata.with_metadata_context``), read
    anew for every micro-batch.  A clause whose contract is not there yet goes to
    ``<out_path>-waiting`` and is tried again by ``retry_waiting``.  Each micro-batch
    writes folders of its own, the waiting one last: one that was cut short is written
    again, one whose waiting folder is complete is done and is skipped."""
    c = metadata.canonicalize_clauses(extract.clean_clauses(clauses), aliases)
    spark = clauses.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        name = f"batch_id={batch_id}"
        if committed(spark, f"{out_path}-waiting/{name}"):
            return
        meta = spark.read.parquet(meta_path)
        _enriched(batch, meta, indent).write.mode("overwrite").parquet(f"{out_path}/{name}")
        late = batch.where(F.col("contract_name").isNotNull()).join(meta, "contract_name", "left_anti")
        late.write.mode("overwrite").parquet(f"{out_path}-waiting/{name}")

    w = c.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _enriched(clean: DataFrame, meta: DataFrame, indent: str) -> DataFrame:
    j = clean.join(meta.select("contract_name", "metadata_context"), "contract_name", "inner")
    return j.select(
        "ord", "contract_name", "clause_type",
        F.col("clause_text_cleaned").alias("clause_text"),
        tpl.enriched_context(F.col("metadata_context"), F.col("clause_type"),
                             F.col("clause_text_cleaned"), indent).alias("enriched_context"))


_WAITING = "ord bigint, contract_name string, clause_type string, clause_text_cleaned string"
_ARRIVED = f"{_WAITING}, metadata_context string, arrived boolean"


def _versions(spark: SparkSession, state: str) -> list[int]:
    """Complete versions of the waiting table, oldest first: those whose list of
    batches, written last, is complete."""
    found = [int(x.split("=")[1]) for x in subfolders(spark, state) if x.startswith("version=")]
    return sorted(v for v in found if committed(spark, f"{state}/version={v}/batches"))


def _still_waiting(spark: SparkSession, out_path: str) -> tuple[DataFrame, set[str], list[str], int]:
    """(rows that wait, batches counted in the last version, newer batches, last version)."""
    state = f"{out_path}-waiting-state"
    known = _versions(spark, state)
    last = known[-1] if known else 0
    seen = {r.name for r in spark.read.parquet(f"{state}/version={last}/batches").collect()} if known else set()
    new = [x for x in subfolders(spark, f"{out_path}-waiting")
           if x.startswith("batch_id=") and x not in seen and committed(spark, f"{out_path}-waiting/{x}")]
    rows = read_or_empty(spark, f"{state}/version={last}/rows", _ARRIVED).where("not arrived").select(*T.StructType.fromDDL(_WAITING).names)
    if new:
        rows = rows.unionByName(spark.read.schema(_WAITING).parquet(*[f"{out_path}-waiting/{x}" for x in new]))
    return rows, seen, new, last


def waiting(spark: SparkSession, out_path: str) -> DataFrame:
    """Clauses whose contract has not arrived yet."""
    return _still_waiting(spark, out_path)[0]


def retry_waiting(spark: SparkSession, meta_path: str, out_path: str, indent: str = "    ") -> DataFrame:
    """Move the waiting clauses whose contract has arrived since out of the waiting
    table, and return all that were ever moved, enriched with the metadata they met:
    the reader's view of a sink is its folder united with this.

    A call makes one new version of the waiting table from the last one and the
    batches that came after it.  One write decides for every row whether it has arrived,
    and the version counts from its last folder on: a call that is cut short leaves the
    old version, and a clause is moved once.  What the new version holds is then
    deleted elsewhere, so the next call reads only what still waits.  One caller at a
    time."""
    state = f"{out_path}-waiting-state"
    rows, seen, new, last = _still_waiting(spark, out_path)
    meta = spark.read.parquet(meta_path).select("contract_name", "metadata_context", F.lit(True).alias("_there"))
    if new or not rows.isEmpty():
        version = f"{state}/version={last + 1}"
        split = rows.join(meta, "contract_name", "left").select(
            *rows.columns, "metadata_context", F.coalesce("_there", F.lit(False)).alias("arrived"))
        split.write.mode("overwrite").partitionBy("arrived").parquet(f"{version}/rows")
        batches = spark.createDataFrame([(x,) for x in sorted(seen | set(new))], "name string")
        batches.coalesce(1).write.mode("overwrite").parquet(f"{version}/batches")
        remove(spark, f"{state}/version={last}/rows/arrived=false")
        for x in new:   # the mark stays: it tells a repeated micro-batch that it is done
            remove(spark, f"{out_path}-waiting/{x}", keep="_SUCCESS")
    moved = [f"{state}/version={v}/rows/arrived=true" for v in _versions(spark, state)
             if "arrived=true" in subfolders(spark, f"{state}/version={v}/rows")]
    late = spark.read.schema(f"{_WAITING}, metadata_context string").parquet(*moved) if moved else \
        spark.createDataFrame([], f"{_WAITING}, metadata_context string")
    return late.select(
        "ord", "contract_name", "clause_type", F.col("clause_text_cleaned").alias("clause_text"),
        tpl.enriched_context(F.col("metadata_context"), F.col("clause_type"), F.col("clause_text_cleaned"), indent).alias("enriched_context"))


def label_stream(todo: DataFrame, done_path: str, checkpoint: str,
                 make_labeller: Callable[[], label.Labeller], key: str = "enriched_context",
                 available_now: bool = True, **label_kw) -> StreamingQuery:
    """Start incremental labelling of a streaming ``todo`` DataFrame.  The labelled
    table has one row a key; ``label.with_labels`` joins it to all rows."""
    spark = todo.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        out = f"{done_path.rstrip('/')}/batch_id={batch_id}"
        if committed(spark, out):
            return
        schema = label.label_batch(batch.limit(0), make_labeller, **label_kw).schema
        done = read_or_empty(spark, done_path, T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
        done = done.where(F.col("batch_id") != batch_id)
        part = label.unlabelled(batch, done, key)
        label.label_batch(part, make_labeller, **label_kw).write.mode("overwrite").parquet(out)

    w = todo.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema) -> DataFrame:
    """One driver table as a file stream, be it one file or a folder of part files: a
    pattern that matches its name alone finds either (a plain path may not be a file).
    A micro-batch takes up to ``BATCH_BYTES``: each reads the metadata anew, so their
    number must not grow with that of the files."""
    return (spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES)
            .parquet(f"{sf_dir}/{name}.parque[t]"))


def enrich_documents_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run ``enrich_stream`` over the documents table as it arrives and return
    the sink's contents (same rows as the batch flagship query)."""
    from clausekit.plans import enrichment as E
    from clausekit.sources import adapters as X
    docs = stream_table(spark, sf_dir, "documents", X.table(spark, sf_dir, "documents").schema)
    clauses = X.clauses_from(docs)
    meta = metadata.with_metadata_context(
        metadata.contract_metadata(E.canonical_clauses(spark, sf_dir), E.master_dedup(spark, sf_dir)))
    base = _scratch(spark, "enrich")
    meta.write.parquet(f"{base}/meta")
    q = enrich_stream(clauses, f"{base}/meta", f"{base}/out", f"{base}/chk")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(f"{base}/out").drop("batch_id")
