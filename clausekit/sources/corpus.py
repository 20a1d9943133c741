"""Readers and writers for the clause pipeline's files.

* annotated corpus JSON (one object with a ``data`` array, or JSON lines with
  one contract per line, which is splittable and the right layout at scale)
* the master CSV (cp1252, quoted, multi-line cells)
* stage tables (Parquet by default, CSV on request)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from clausekit import schemas
from clausekit.operators import file_order

# pandas' default NA strings; Spark CSV only nulls the empty cell, so these are
# mapped to null explicitly to read the master file the way the reference did.
PANDAS_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def spread_scan(df: DataFrame, min_files: int | None = None) -> DataFrame:
    """Round-robin a file scan over ``min_files`` partitions (default: the
    cluster's default parallelism) when it has fewer files than that.

    A single file with one row group scans as one task, which would run all
    per-row text work on one core.  A corpus at scale has far more files than
    cores, and nothing is added.  Decided from the scan's file list alone: no
    job runs, and ``df`` must be a scan without a shuffle.  (Round-robin
    repartitioning sorts locally first, so a retried task gets the same rows.)"""
    try:
        target = min_files or df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no SparkContext (Spark Connect): leave as is
        return df
    return df.repartition(target) if len(df.inputFiles()) < target else df


def with_file_order(scan: DataFrame, out: str = "file_ord") -> DataFrame:
    """Add ``out``, the 0-based place of every row of a file scan in file order: by
    path, then block, then position inside the block.  The numbers are the same
    however the input is split or the cluster sized; no row moves
    (``operators.file_order``)."""
    at = file_order.place(scan)
    return file_order.number(at, file_order.block_offsets(at), out).drop(file_order.PLACE)


def _scan_corpus(spark: SparkSession, path: str, json_lines: bool, extra=()) -> DataFrame:
    """The corpus as (data, *extra) rows at their places; ``extra`` are more schema fields."""
    if json_lines:
        rows = spark.read.schema(schemas.T.StructType([*schemas.CONTRACT.fields, *extra])).json(path)
        data = F.array(F.struct(*[F.col(f.name) for f in schemas.CONTRACT.fields]))
        rows = rows.withColumn("data", data).select("data", *[f.name for f in extra], "_metadata")
    else:
        rows = (spark.read.schema(schemas.T.StructType([*schemas.CORPUS.fields, *extra]))
                .option("multiLine", True).json(path).select("data", *[f.name for f in extra], "_metadata"))
    return file_order.place(rows).drop("_metadata")


def read_corpus(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Annotated corpus with a declared schema: (data, file_ord).

    ``json_lines=False``: each file is one JSON object ``{"data": [...]}``
    (not splittable: one task per file).  ``json_lines=True``: each line is
    one contract object ``{"title":..., "paragraphs": [...]}``; the result is
    wrapped to the same ``data`` shape so the flattener is shared.
    ``file_ord`` is the record's place in file order.  Records that cannot be
    parsed are empty here; ``sources.rejects`` tells them apart.
    """
    rows = _scan_corpus(spark, path, json_lines)
    return file_order.number(rows, file_order.block_offsets(rows), "file_ord").drop(file_order.PLACE)


def read_clauses(spark: SparkSession, path: str, json_lines: bool = False, with_context: bool = True) -> DataFrame:
    """Clause rows of a corpus, one for each answer, with ``file_ord`` (place of the
    record) and ``ord`` (place of the answer, 0, 1, ... in document order).  Two
    counts for each block of the files give both; contracts are not moved."""
    from clausekit.operators.extract import flatten_corpus
    records = _scan_corpus(spark, path, json_lines)
    rows = file_order.here(flatten_corpus(records, (file_order.PLACE,), with_context))
    rows = file_order.number(rows, file_order.block_offsets(rows, file_order.HERE), "ord", file_order.HERE)
    rows = file_order.number(rows, file_order.block_offsets(records), "file_ord")
    return rows.drop(file_order.PLACE, file_order.HERE)


# charsets Spark 4 accepts without the legacy flag
_STANDARD_CHARSETS = {"utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"}


def allow_charset(spark: SparkSession, encoding: str) -> None:
    """Spark 4 rejects legacy charsets such as windows-1252 (the master file's
    encoding) unless ``spark.sql.legacy.javaCharsets`` is on; ISO-8859-1 is
    accepted but decodes 0x80-0x9F (smart quotes) wrongly."""
    if encoding.lower() not in _STANDARD_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_master(spark: SparkSession, path: str, encoding: str = "windows-1252",
                na_values: list[str] | None = None) -> DataFrame:
    """Master CSV, keeping only the eight used columns, renamed snake_case,
    with ``file_ord`` (row order in the file) for first-row-wins."""
    allow_charset(spark, encoding)
    na = PANDAS_NA_VALUES if na_values is None else na_values
    raw = (spark.read
           .option("header", True)
           .option("multiLine", True)
           .option("escape", '"')
           .option("encoding", encoding)
           .csv(path))
    cols = []
    for c in schemas.MASTER_COLUMNS:
        v = F.col(f"`{c}`")
        cols.append(F.when(v.isin(na), F.lit(None)).otherwise(v).alias(schemas.MASTER_RENAME[c]))
    return with_file_order(raw).select(*cols, "file_ord")


def read_stage(spark: SparkSession, path: str, schema=None, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        r = (spark.read.option("header", True).option("multiLine", True)
             .option("escape", '"'))
        if schema is not None:
            r = r.schema(schema)
        return r.csv(path)
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                encoding: str = "utf-8", compression: str | None = None) -> None:
    """Write a stage table.  CSV quotes every cell and stores struct/array
    columns as JSON text; ``json`` writes JSON lines.  ``compression``: a codec for
    the text formats (``gzip``, ``lz4``); the readers know it by the file name, and read each
    file in one task, as they do multi-line CSV anyway."""
    if fmt == "json":
        df.write.mode(mode).option("compression", compression or "none").json(path)
        return
    if fmt == "csv":
        allow_charset(df.sparkSession, encoding)
        out = df.select(*[
            F.to_json(F.col(f.name)).alias(f.name)
            if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name)
            for f in df.schema.fields
        ])
        # the CSV writer trims cell whitespace by default: keep values as they are
        (out.write.mode(mode).option("header", True).option("quoteAll", True)
         .option("escape", '"').option("encoding", encoding)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("compression", compression or "none").csv(path))
    else:
        df.write.mode(mode).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """Load a checkpoint table, or an empty frame of ``schema`` if the path is absent
    (any other failure is raised: an unreadable table is not an empty one)."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet folder was written to its end."""
    fs, p = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under ``path``; none if it is absent."""
    fs, p = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def remove(spark: SparkSession, path: str, keep: str | None = None) -> None:
    """Delete a folder, or all in it but the file ``keep``."""
    fs, p = _folder(spark, path)
    if keep is None:
        fs.delete(p, True)
    elif fs.exists(p):
        for s in fs.listStatus(p):
            if s.getPath().getName() != keep:
                fs.delete(s.getPath(), True)
