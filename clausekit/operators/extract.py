"""Extraction, projection and filters (corpus -> clause rows -> clean rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausekit.functions import text as tx

# ---------------------------------------------------------------------------
# Fixed values (must match the reference)
# clause types already carried by the metadata context; dropped before labelling
SKIP_CLAUSE_TYPES = [
    "Document Name",
    "Parties",
    "Agreement Date",
    "Effective Date",
    "Expiration Date",
]
# ---------------------------------------------------------------------------


def answerable(qa_col: str = "qa") -> F.Column:
    """Keep a question only if it is not impossible and has answers.  A null
    flag or answer list is not answerable (the reference would raise)."""
    qa = F.col(qa_col)
    return (F.coalesce(~qa["is_impossible"], F.lit(False))
            & F.coalesce(F.size(qa["answers"]) > 0, F.lit(False)))


def answerable_questions(corpus: DataFrame, keep: Sequence[str] = ("file_ord",)) -> DataFrame:
    """Question-level view after the answerability predicate: one row per
    kept question with its answer count (filter applied before the answer
    explode)."""
    k = [F.col(c) for c in keep]
    c = corpus.select(*k, F.posexplode("data").alias("c_pos", "contract"))
    p = c.select(*k, "c_pos", F.col("contract.title").alias("contract_name"),
                 F.posexplode("contract.paragraphs").alias("p_pos", "para"))
    q = p.select(*k, "c_pos", "contract_name", "p_pos",
                 F.posexplode("para.qas").alias("q_pos", "qa"))
    return q.where(answerable("qa")).select(
        *k, "c_pos", "p_pos", "q_pos", "contract_name",
        F.col("qa.id").alias("q_id"), F.size("qa.answers").alias("n_answers"))


def flatten_corpus(corpus: DataFrame, keep: Sequence[str] = ("file_ord",),
                   with_context: bool = True, partitions: int | None = None) -> DataFrame:
    """Contract x paragraph x question x answer -> one clause row per answer.

    Positions of every level are kept (``c_pos, p_pos, q_pos, a_pos``) so the
    document order survives shuffles; ``keep`` carries top-level columns such
    as the file ordinal.  ``with_context=False`` drops ``full_context`` (a
    whole paragraph per answer row) at the source instead of downstream.
    ``partitions`` deals the contracts out before the per-answer work: set it for a
    multi-line corpus file, which is read by one task.
    """
    k = [F.col(c) for c in keep]
    c = corpus.select(*k, F.posexplode("data").alias("c_pos", "contract"))
    c = c.repartition(partitions) if partitions else c
    p = c.select(*k, "c_pos", F.col("contract.title").alias("contract_name"),
                 F.posexplode("contract.paragraphs").alias("p_pos", "para"))
    q = p.select(*k, "c_pos", "contract_name", "p_pos",
                 F.col("para.context").alias("full_context"),
                 F.posexplode("para.qas").alias("q_pos", "qa"))
    q = q.where(answerable("qa"))
    a = q.select(*k, "c_pos", "contract_name", "p_pos", "full_context", "q_pos",
                 F.col("qa.question").alias("question"), F.col("qa.id").alias("q_id"),
                 F.posexplode("qa.answers").alias("a_pos", "answer"))
    cols = [
        "contract_name",
        tx.clause_type_from_question(F.col("question")).alias("clause_type"),
        "question", "q_id",
        F.col("answer.text").alias("clause_text"),
    ]
    if with_context:
        cols.append("full_context")
    return a.select(*cols, *[F.col(c) for c in keep],
                    F.col("c_pos").cast("int"), F.col("p_pos").cast("int"),
                    F.col("q_pos").cast("int"), F.col("a_pos").cast("int"))


def with_clause_ordinal(clauses: DataFrame, keep: Sequence[str] = ("file_ord",),
                        out: str = "ord") -> DataFrame:
    """Unique ``ord`` in document order (file, contract, paragraph, question,
    answer), numbered without a single-partition window (see
    ``operators.ordinal``)."""
    from clausekit.operators.ordinal import dense_ordinal
    return dense_ordinal(clauses, [*keep, "c_pos", "p_pos", "q_pos", "a_pos"], out)


def clean_clauses(clauses: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Clean clause rows: normalised lower-case text, type, contract, ordinal."""
    return clauses.select(
        tx.clean_clause_text(F.col("clause_text")).alias("clause_text_cleaned"),
        "clause_type", "contract_name", F.col(ord_col).alias("ord"))


def with_word_count(df: DataFrame, text_col: str = "clause_text", out: str = "n_words") -> DataFrame:
    return df.withColumn(out, tx.word_count(F.col(text_col)))


def filter_by_word_count(df: DataFrame, n_col: str = "n_words", min_words: int | None = None,
                         max_words: int | None = None) -> DataFrame:
    """Keep rows with ``min_words <= n <= max_words`` (either bound optional)."""
    cond = F.lit(True)
    if min_words is not None:
        cond = cond & (F.col(n_col) >= min_words)
    if max_words is not None:
        cond = cond & (F.col(n_col) <= max_words)
    return df.where(cond)


def skip_clause_types(df: DataFrame, skip: Sequence[str] = tuple(SKIP_CLAUSE_TYPES),
                      type_col: str = "clause_type") -> DataFrame:
    """Drop metadata clause types; null types are kept (as pandas ``isin``)."""
    t = F.col(type_col)
    return df.where(t.isNull() | ~t.isin(list(skip)))
