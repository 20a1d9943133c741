"""Checked readers: what cannot be used goes to a reject table instead of vanishing
or stopping the run.

Each reader makes one permissive pass whose rows carry a reason; the kept part is
what has none, the rejected part tells where (file, record, element), why, and
what was found.  Both parts are views of the same pass, so every record and
every question is in exactly one of them.  A null counts as a missing key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausekit import schemas
from clausekit.functions import text as tx
from clausekit.operators import file_order
from clausekit.sources.corpus import PANDAS_NA_VALUES, _scan_corpus, allow_charset

CORRUPT = "_corrupt_record"
REJECTED = ("file", "file_ord", "c_pos", "p_pos", "q_pos", "reason", "content")


@dataclass
class Checked:
    """``kept`` rows for the next step and ``rejected`` rows (``REJECTED`` columns)."""

    kept: DataFrame
    rejected: DataFrame


def _first(*cases: tuple[Column, str]) -> Column:
    """The reason of the first case that holds, else null."""
    out = None
    for case, reason in cases:
        out = F.when(case, reason) if out is None else out.when(case, reason)
    return out


def question_reason(qa: Column) -> Column:
    """Why a question cannot be used: a key that the extraction needs is missing.  The
    answers of an impossible question, and the text of one without answers, are
    not needed."""
    used = ~qa["is_impossible"] & (F.size(qa["answers"]) > 0)
    return _first((qa["is_impossible"].isNull(), "question without is_impossible"),
                  (~qa["is_impossible"] & qa["answers"].isNull(), "question without answers"),
                  (used & qa["question"].isNull(), "question without text"),
                  (used & qa["id"].isNull(), "question without id"),
                  (used & F.exists(qa["answers"], lambda a: a["text"].isNull()), "answer without text"))


def _elements(spark: SparkSession, path: str, json_lines: bool) -> DataFrame:
    """One row for every question, and one for every record, contract or paragraph
    that has none to give: (place, positions, contract_name, full_context, qa, reason,
    content)."""
    records = _scan_corpus(spark, path, json_lines, (T.StructField(CORRUPT, T.StringType()),))
    bad = F.col(CORRUPT).isNotNull() | F.col("data").isNull()
    # explode_outer keeps one row where a level is missing, as it does where a list is empty
    c = records.select(file_order.PLACE, CORRUPT, F.when(bad, "malformed record").alias("reason"),
                       F.posexplode_outer(F.when(~bad, F.col("data"))).alias("c_pos", "contract"))
    of = F.col("contract")
    reason = F.coalesce("reason", _first((of.isNotNull() & of["title"].isNull(), "contract without title"),
                                         (of.isNotNull() & of["paragraphs"].isNull(), "contract without paragraphs")))
    c = c.withColumn("reason", reason)
    p = c.select(file_order.PLACE, CORRUPT, "reason", "c_pos", "contract",
                 F.posexplode_outer(F.when(F.col("reason").isNull(), of["paragraphs"])).alias("p_pos", "para"))
    of = F.col("para")
    reason = F.coalesce("reason", _first((of.isNotNull() & of["context"].isNull(), "paragraph without context"),
                                         (of.isNotNull() & of["qas"].isNull(), "paragraph without qas")))
    p = p.withColumn("reason", reason)
    q = p.select(file_order.PLACE, CORRUPT, "reason", "c_pos", "p_pos", "contract", "para",
                 F.posexplode_outer(F.when(F.col("reason").isNull(), of["qas"])).alias("q_pos", "qa"))
    qa = F.col("qa")
    q = q.withColumn("reason", F.coalesce("reason", F.when(qa.isNotNull(), question_reason(qa)),
                                          F.when(qa.isNull() & F.col("q_pos").isNotNull(), "question missing")))
    found = F.coalesce(F.col(CORRUPT), F.to_json(qa), F.to_json("para"), F.to_json("contract"))
    return q.select(file_order.PLACE, "reason", "c_pos", "p_pos", "q_pos", F.col("contract.title").alias("contract_name"),
                    F.col("para.context").alias("full_context"), "qa", F.when(F.col("reason").isNotNull(), found).alias("content"))


def check_corpus(spark: SparkSession, path: str, json_lines: bool = True, with_context: bool = True) -> Checked:
    """Clause rows (one for each answer, with ``file_ord`` and positions) and the
    rejected elements of an annotated corpus.

    Rejected are records that are not JSON of the declared types, contracts
    without title or paragraphs, paragraphs without context or questions, and
    questions without a key that their extraction needs; the rest of the record
    is kept.  Empty lists and unanswerable questions are no faults: they give no
    clause rows and no rejects, as in ``flatten_corpus``."""
    elements = _elements(spark, path, json_lines)
    numbers = file_order.block_offsets(_scan_corpus(spark, path, json_lines))
    good = elements.where("reason is null and qa is not null and not qa.is_impossible")
    rows = good.select(file_order.PLACE, "contract_name", "full_context", "c_pos", "p_pos", "q_pos", "qa",
                       F.posexplode("qa.answers").alias("a_pos", "answer"))
    kept = file_order.number(rows, numbers, "file_ord").select(
        "contract_name", tx.clause_type_from_question(F.col("qa.question")).alias("clause_type"),
        F.col("qa.question").alias("question"), F.col("qa.id").alias("q_id"), F.col("answer.text").alias("clause_text"),
        *(["full_context"] if with_context else []), "file_ord", "c_pos", "p_pos", "q_pos", "a_pos")
    rejected = file_order.number(elements.where("reason is not null"), numbers, "file_ord")
    return Checked(kept, rejected.withColumn("file", F.col(f"{file_order.PLACE}.path")).select(*REJECTED))


def check_master(spark: SparkSession, path: str, encoding: str = "windows-1252",
                 na_values: list[str] | None = None) -> Checked:
    """Master rows as ``read_master`` gives them, and the rejected ones: rows with
    more or fewer cells than the header, and rows without a file name.  A file
    without one of the eight columns is an error."""
    allow_charset(spark, encoding)
    na = PANDAS_NA_VALUES if na_values is None else na_values
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
    header = [f.name for f in reader.csv(path).schema.fields]
    missing = [c for c in schemas.MASTER_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"master file without {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
    rows = file_order.place(reader.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    cells = [F.when(F.col(f"`{c}`").isin(na), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(schemas.MASTER_RENAME[c])
             for c in schemas.MASTER_COLUMNS]
    rows = rows.select(file_order.PLACE, CORRUPT, *cells)
    rows = rows.withColumn("reason", _first((F.col(CORRUPT).isNotNull(), "malformed row"),
                                            (F.col("filename").isNull(), "row without file name")))
    rows = file_order.number(rows, file_order.block_offsets(rows), "file_ord")
    names = [schemas.MASTER_RENAME[c] for c in schemas.MASTER_COLUMNS]
    no_place = F.lit(None).cast("int")
    rejected = rows.where("reason is not null").select(
        F.col(f"{file_order.PLACE}.path").alias("file"), "file_ord", no_place.alias("c_pos"), no_place.alias("p_pos"),
        no_place.alias("q_pos"), "reason", F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*names))).alias("content"))
    return Checked(rows.where("reason is null").select(*names, "file_ord"), rejected)
