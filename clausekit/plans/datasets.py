"""Shared lazy datasets the registered queries are built from.

Each function returns a plan over the driver tables; nothing is collected or
cached here.  Chains mirror the reference's stages: clauses -> enriched ->
sampled -> labelled -> training rows -> chat/tokens; requests for scoring.
"""

from __future__ import annotations

import functools
import threading
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausekit.operators import extract, label, metadata, sample, scoring, training
from clausekit.plans import enrichment as E
from clausekit.sources import adapters as X

_DEFS: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()
_LOCK = threading.RLock()


def shared(fn):
    """Define a dataset once per (session, scale-factor folder, arguments):
    every query that needs it reuses the same lazy DataFrame, so identical
    subplans share their exchanges and the plan is analysed once.  Only the
    definition is shared; nothing is cached."""
    @functools.wraps(fn)
    def wrapper(spark: SparkSession, d: str, *args, **kw):
        key = (fn.__name__, d, args, tuple(sorted(kw.items())))
        with _LOCK:
            per = _DEFS.setdefault(spark, {})
            if key not in per:
                per[key] = fn(spark, d, *args, **kw)
            return per[key]
    return wrapper


def clear_definitions(spark: SparkSession) -> None:
    with _LOCK:
        _DEFS.pop(spark, None)


HAND_REASON = "Reviewed and corrected by hand."
HAND_SUMMARY = "A hand-checked label."


@shared
def corpus_rows(spark: SparkSession, d: str, with_context: bool = True) -> DataFrame:
    """X2 corpus flattened to clause rows (one per answer line)."""
    return extract.flatten_corpus(X.corpus(spark, d), ("file_ord",), with_context)


@shared
def enriched(spark: SparkSession, d: str) -> DataFrame:
    return E.enriched(spark, d)


@shared
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    r = X.replies(spark, d)
    return r.withColumn("p", label.parse_reply("reply")).select(
        "doc_id", "reply", F.col("p.risk_level"), F.col("p.risk_reason"),
        F.col("p.plain_summary"), F.col("p.parse_status"))


@shared
def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Enriched clauses joined to their labeller reply, default label on
    failure: the 7-column labelled rows plus ``ord``."""
    r = X.replies(spark, d).withColumn("label", label.with_default(label.parse_reply("reply")))
    j = enriched(spark, d).join(r, F.col("ord") == F.col("doc_id"), "inner")
    return label.labelled_rows(j, keep=("ord",))


@shared
def hand_labels(spark: SparkSession, d: str) -> DataFrame:
    """Second labelled source (the hand-fixed sheet): every enriched clause
    that has a ``labels`` row, risk from (quality, toxic)."""
    lab = X.table(spark, d, "labels").select("doc_id", "quality", "toxic")
    j = enriched(spark, d).join(lab, F.col("ord") == F.col("doc_id"), "inner")
    return j.select("ord", "contract_name", "clause_type", "clause_text", "enriched_context",
                    X.risk_of(F.col("quality"), F.col("toxic")).alias("risk_level"),
                    F.lit(HAND_REASON).alias("risk_reason"), F.lit(HAND_SUMMARY).alias("plain_summary"))


@shared
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    return training.instruction_response(label.clean_labels(labelled(spark, d)))


@shared
def to_label(spark: SparkSession, d: str) -> DataFrame:
    return extract.skip_clause_types(enriched(spark, d))


@shared
def sampled(spark: SparkSession, d: str) -> DataFrame:
    return sample.stratified_sample(to_label(spark, d), "clause_type", "ord")


@shared
def chat_pairs(spark: SparkSession, d: str) -> DataFrame:
    """X5 pairs with messages and the rendered chat text."""
    p = X.pairs(spark, d)
    return p.withColumn("messages", training.chat_messages()).withColumn(
        "chat_text", training.render_chat("messages"))


@shared
def token_rows(spark: SparkSession, d: str) -> DataFrame:
    return training.format_for_training(chat_pairs(spark, d).drop("messages"), "chat_text", "response")


@shared
def requests(spark: SparkSession, d: str) -> DataFrame:
    """Scoring requests: each corpus answer line with its contract's
    metadata (left join: contracts without metadata take the defaults).
    An ``Unknown`` clause type stands for an unselected type."""
    rows = corpus_rows(spark, d, with_context=False)
    c = metadata.canonicalize_clauses(E.clean_clauses(spark, d))
    meta = metadata.contract_metadata(c, E.master_dedup(spark, d))
    rows = rows.withColumn("contract_name", metadata.canonical_name(F.col("contract_name")))
    j = rows.join(meta, "contract_name", "left")
    return j.select(
        "file_ord", "a_pos",
        F.col("clause_text"),
        F.when(F.col("clause_type") == "Unknown", F.lit(scoring.TYPE_SENTINEL))
         .otherwise(F.col("clause_type")).alias("target_clause"),
        F.col("document_name").alias("contract_type"),
        F.col("governing_law").alias("jurisdiction"),
        F.col("renewal_term"), F.col("notice_period").alias("notice_period"),
        (F.col("cap_on_liability") == "Yes").alias("has_liability_cap"),
        (F.col("termination_for_convenience") == "Yes").alias("has_termination"),
        (F.col("change_of_control") == "Yes").alias("has_change_control"),
        (F.col("minimum_commitment") == "Yes").alias("has_minimum_commitment"),
    )


def echo_output(prompt: F.Column) -> F.Column:
    """A model output that echoes the prompt, as generation does."""
    return F.concat(prompt, F.lit("**Risk Assessment:** LOW\n  A short answer.  \n"))

