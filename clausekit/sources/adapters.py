"""Adapters from the driver's tables to the clause pipeline's inputs.

The driver ships generic tables (``documents``, ``customer``, ``nation``,
``labels``, ``conversations``, ``events``).  These functions derive the
pipeline's inputs from them with native expressions only, so every query's
work grows with the tables.  Each rule has an exact DuckDB twin in
``clausekit.plans.oracle``.

X1 clauses        documents -> clause rows (contract, type, text, ord)
X2 corpus         documents -> nested annotated corpus (one contract per row)
X3 master         customer x nation -> master metadata rows
X4 replies        documents x labels -> labeller reply text
X5 pairs          conversations -> (instruction, response) pairs
training log      events -> (step, loss, eval_loss)
"""

from __future__ import annotations

import threading
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausekit.sources.corpus import spread_scan

# Clause types assigned to documents by hash (adapter design, not reference
# data).  Mixed case on purpose: metadata matching is case-insensitive,
# related-clause matching is not.
CLAUSE_TYPES = [
    "Document Name", "Parties", "Governing Law", "Renewal Term",
    "Notice Period To Terminate Renewal", "Non-Compete", "Exclusivity",
    "Termination For Convenience", "Change Of Control", "Cap On Liability",
    "Minimum Commitment", "License Grant", "Anti-Assignment",
    "Uncapped Liability", "Insurance", "Expiration Date",
]
CLAUSES_PER_CONTRACT = 12


# tables whose rows carry whole texts: per-row CPU work is heavy, so a scan
# narrower than the cluster is spread before it (``sources.corpus.spread_scan``)
TEXT_TABLES = ("documents", "conversations", "pages")


_DEFINED: "weakref.WeakKeyDictionary[SparkSession, dict[str, DataFrame]]" = weakref.WeakKeyDictionary()
_LOCK = threading.Lock()


def clear_definitions(spark: SparkSession) -> None:
    """Forget the table definitions of ``spark`` (call after the input files
    change: a definition keeps the file listing it was built with)."""
    with _LOCK:
        _DEFINED.pop(spark, None)
    from clausekit.plans import datasets
    datasets.clear_definitions(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; text tables are spread over the cluster when their
    scan has fewer partitions than the default parallelism.

    Each table is defined once per session (file listing and footer reads
    happen once) and the same lazy DataFrame is reused by every plan that
    reads it.  Nothing is cached: only the definition is shared."""
    path = f"{sf_dir}/{name}.parquet"
    with _LOCK:
        per_session = _DEFINED.setdefault(spark, {})
        df = per_session.get(path)
        if df is None:
            df = spark.read.parquet(path)
            df = spread_scan(df) if name in TEXT_TABLES else df
            per_session[path] = df
    return df


def _hash6(expr) -> F.Column:
    return F.conv(F.substring(F.md5(expr), 1, 6), 16, 10).cast("bigint")


def contract_of(doc_id) -> F.Column:
    n = F.try_divide(doc_id - doc_id % CLAUSES_PER_CONTRACT, F.lit(CLAUSES_PER_CONTRACT))
    return F.concat(F.lit("Contract "), n.cast("bigint").cast("string"))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1: one clause row per document; raw (uncleaned) whole text."""
    return clauses_from(table(spark, sf_dir, "documents"))


def clauses_from(documents: DataFrame) -> DataFrame:
    """X1 over any documents DataFrame (batch or streaming)."""
    d = documents.select("doc_id", "text")
    h = _hash6(F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    types = F.array(*[F.lit(t) for t in CLAUSE_TYPES])
    return d.select(
        F.col("doc_id").alias("ord"),
        contract_of(F.col("doc_id")).alias("contract_name"),
        F.element_at(types, (h % len(CLAUSE_TYPES) + 1).cast("int")).alias("clause_type"),
        F.col("text").alias("clause_text"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2: nested corpus rows shaped like one-contract JSON lines.

    Paragraph = the document, one question per paragraph, answers = the
    document's lines.  Questions carry two quoted parts (the first wins), or
    none when ``doc_id % 9 = 4``; ``doc_id % 10 = 0`` is impossible and
    ``doc_id % 10 = 5`` has no answers.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    did = F.col("doc_id")
    question = (F.when(did % 9 == 4, F.lit("no quoted type here"))
                .otherwise(F.concat(F.lit('Highlight the parts related to "T'),
                                    (did % 5).cast("string"), F.lit('" or "x"'))))
    answers = (F.when(did % 10 == 5, F.array().cast("array<struct<text:string>>"))
               .otherwise(F.transform(F.split(F.col("text"), "\n"),
                                      lambda x: F.struct(x.alias("text")))))
    qa = F.struct(F.concat(F.lit("q"), did.cast("string")).alias("id"),
                  question.alias("question"),
                  (did % 10 == 0).alias("is_impossible"),
                  answers.alias("answers"))
    para = F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))
    contract = F.struct(contract_of(did).alias("title"), F.array(para).alias("paragraphs"))
    return d.select(F.array(contract).alias("data"), did.alias("file_ord"))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3: master rows from customer x nation, in ``file_ord`` = custkey order.

    Filenames end in ``.pdf`` or, for ``custkey % 4 = 1``, ``.PDF `` (case and
    trailing blank).  ``custkey % 10 = 7`` names the previous contract again:
    that contract gets a duplicate master row (first row wins) and contract
    ``custkey`` gets none (it lands in quarantine).
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    target = F.when(k % 10 == 7, k - 1).otherwise(k)
    suffix = F.when(k % 4 == 1, F.lit(".PDF ")).otherwise(F.lit(".pdf"))
    day = (k % 28 + 1).cast("string")
    return c.join(n, c.c_nationkey == n.n_nationkey, "inner").select(
        F.concat(F.lit("Contract "), target.cast("string"), suffix).alias("filename"),
        F.concat(F.col("c_mktsegment"), F.lit(" Agreement")).alias("document_name_answer"),
        F.concat(F.lit("1/"), day, F.lit("/2020")).alias("agreement_date_answer"),
        F.concat(F.lit("2/"), day, F.lit("/2020")).alias("effective_date_answer"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("3/"), day, F.lit("/2025"))).alias("expiration_date_answer"),
        F.when(k % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat((k % 5 + 1).cast("string"), F.lit(" years"))).alias("renewal_term_answer"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(((k % 3 + 1) * 30).cast("string"), F.lit(" days"))).alias("notice_period_answer"),
        F.col("n_name").alias("governing_law_answer"),
        k.alias("file_ord"),
    )


def risk_of(quality, toxic) -> F.Column:
    return (F.when(toxic == 1, F.lit("HIGH")).when(quality == 0, F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4: one labeller reply per labelled document (``doc_id``, ``reply``).

    Valid JSON by default; by rule (first hit wins) it is cut short (%7),
    misses a key (%13), has a lower-case risk (%11), trailing text (%17),
    is a JSON array (%19), has a null reason (%23) or surrounding blanks (%29).
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "inner")
    did = F.col("doc_id")
    risk = risk_of(F.col("quality"), F.col("toxic"))
    reason = F.concat(F.lit("Document "), did.cast("string"), F.lit(" from "), F.col("source"),
                      F.lit(" scored quality "), F.col("quality").cast("string"),
                      F.lit(" and toxic "), F.col("toxic").cast("string"), F.lit("."))
    summary = F.concat(F.lit("A "), F.col("lang"), F.lit(" text of "),
                       F.col("n_chars").cast("string"), F.lit(" characters."))

    def obj(r, with_summary=True, reason_json=None):
        parts = [F.lit('{"risk_level": "'), r, F.lit('", "risk_reason": ')]
        parts += [reason_json if reason_json is not None else F.concat(F.lit('"'), reason, F.lit('"'))]
        if with_summary:
            parts += [F.lit(', "plain_summary": "'), summary, F.lit('"}')]
        else:
            parts += [F.lit("}")]
        return F.concat(*parts)

    valid = obj(risk)
    reply = (F.when(did % 7 == 0, F.expr("substring({0}, 1, length({0}) - 5)".format("__v")))
             .when(did % 13 == 0, obj(risk, with_summary=False))
             .when(did % 11 == 0, obj(F.lower(risk)))
             .when(did % 17 == 0, F.concat(F.col("__v"), F.lit(" trailing")))
             .when(did % 19 == 0, F.lit("[1]"))
             .when(did % 23 == 0, obj(risk, reason_json=F.lit("null")))
             .when(did % 29 == 0, F.concat(F.lit("  "), F.col("__v"), F.lit("\n")))
             .otherwise(F.col("__v")))
    return j.withColumn("__v", valid).select(did, reply.alias("reply"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5: a user turn followed by an assistant turn is one
    (instruction, response) pair.

    ``turn`` is the 0-based position in the conversation, so "the next turn"
    is an equi-join on ``(conv_id, turn + 1)``.  Hash-partitioned on both
    columns, a conversation holding a third of all turns still spreads over
    every task (a window over ``conv_id`` would put it in one)."""
    cv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user = cv.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("instruction"), (F.col("turn") + 1).alias("_next"))
    nxt = cv.where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("_next"), F.col("text").alias("response"))
    return user.join(nxt, ["conv_id", "_next"], "inner").select("conv_id", "turn", "instruction", "response")


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trainer log shape: training-loss rows and sparse evaluation rows
    (``purchase`` events)."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    is_eval = F.col("event_type") == "purchase"
    return e.select(
        F.col("event_id").alias("step"),
        F.when(~is_eval, F.col("value")).alias("loss"),
        F.when(is_eval, F.col("value")).alias("eval_loss"),
    )
