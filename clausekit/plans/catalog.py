"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver tables (whole tables, whole texts) and runs one
operator or operator chain of the engine.  Array outputs are rendered to text
with ``array_join`` so the oracle comparison is type-stable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausekit.functions import text as tx
from clausekit.functions import tokens as tk
from clausekit.operators import (extract, label, metadata, profile, related, sample, scoring,
                                 training)
from clausekit.plans import datasets as D
from clausekit.plans import enrichment as E
from clausekit.sources import adapters as X

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _ints(c) -> F.Column:
    """``array<int>`` as space-separated text."""
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(col.cast("array<string>"), " ")


# ---- extraction, projection, filters --------------------------------------

@register("extract_clauses")
def q_extract_clauses(spark, d):
    return D.corpus_rows(spark, d, with_context=True)


@register("clause_ordinals")
def q_clause_ordinals(spark, d):
    places = D.corpus_rows(spark, d, with_context=False).select("file_ord", "c_pos", "p_pos", "q_pos", "a_pos")
    return extract.with_clause_ordinal(places).select("file_ord", "a_pos", "ord")


def _scratch(spark, name):
    from clausekit.streaming.incremental import _scratch as scratch
    return scratch(spark, name)


_MASTER_FIELDS = ["filename", "document_name_answer", "agreement_date_answer", "effective_date_answer",
                  "expiration_date_answer", "renewal_term_answer", "notice_period_answer",
                  "governing_law_answer"]


@register("master_csv_roundtrip")
def q_master_csv_roundtrip(spark, d):
    """Master rows written as a quoted cp1252 CSV with the original headers
    (plus a column the reader must ignore), read back with ``read_master``."""
    from clausekit import schemas
    from clausekit.sources import corpus as src
    m = X.master(spark, d)
    back = {v: k for k, v in schemas.MASTER_RENAME.items()}
    out = m.select(*[F.col(c).alias(back[c]) for c in _MASTER_FIELDS],
                   F.col("file_ord").alias("Category"))
    path = _scratch(spark, "master-csv")
    src.write_stage(out.orderBy("Category"), path, fmt="csv", encoding="windows-1252")
    return src.read_master(spark, path).select(*_MASTER_FIELDS, "file_ord")


@register("corpus_json_roundtrip")
def q_corpus_json_roundtrip(spark, d):
    """The nested corpus written as JSON lines (one contract per line), read
    back as numbered clause rows."""
    from clausekit.sources import corpus as src
    path = _scratch(spark, "corpus-jsonl")
    lines = X.corpus(spark, d).orderBy("file_ord").select(F.explode("data").alias("c")).select("c.*")
    src.write_stage(lines, path, fmt="json")
    return src.read_clauses(spark, path, json_lines=True, with_context=False)


@register("answerable_filter")
def q_answerable_filter(spark, d):
    return extract.answerable_questions(X.corpus(spark, d), ("file_ord",))


@register("clause_type_from_question")
def q_clause_type_from_question(spark, d):
    c = X.corpus(spark, d).select("file_ord", F.explode("data").alias("c"))
    p = c.select("file_ord", F.explode("c.paragraphs").alias("p"))
    qa = p.select("file_ord", F.explode("p.qas").alias("qa"))
    return qa.select("file_ord", F.col("qa.id").alias("q_id"),
                     tx.clause_type_from_question(F.col("qa.question")).alias("clause_type"))


@register("normalize_text")
def q_normalize_text(spark, d):
    return X.table(spark, d, "documents").select(
        "doc_id", tx.normalize_ws(F.col("text")).alias("text_normalized"))


@register("word_count")
def q_word_count(spark, d):
    return X.table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


@register("clean_clauses")
def q_clean_clauses(spark, d):
    return E.clean_clauses(spark, d)


@register("canonical_contract_name")
def q_canonical_contract_name(spark, d):
    return X.master(spark, d).select("file_ord", "filename",
                                     tx.canonical_contract_name(F.col("filename")).alias("contract_name"))


@register("alias_names")
def q_alias_names(spark, d):
    m = metadata.canonicalize_master(X.master(spark, d)).select("file_ord", "contract_name")
    c = E.canonical_clauses(spark, d).select(F.col("ord").alias("file_ord"), "contract_name")
    return m.withColumn("side", F.lit("master")).unionByName(c.withColumn("side", F.lit("clauses")))


@register("filter_by_word_count")
def q_filter_by_word_count(spark, d):
    rows = extract.with_word_count(X.clauses(spark, d), "clause_text", "n_words")
    return extract.filter_by_word_count(rows, "n_words", max_words=4).select(
        "ord", "clause_type", tx.clean_clause_text(F.col("clause_text")).alias("clause_text_cleaned"),
        "n_words")


@register("skip_clause_types")
def q_skip_clause_types(spark, d):
    return D.to_label(spark, d).select("ord", "contract_name", "clause_type")


# ---- profiling ------------------------------------------------------------

@register("clause_type_distribution")
def q_clause_type_distribution(spark, d):
    return profile.type_distribution(E.clean_clauses(spark, d), "clause_type")


@register("null_audit")
def q_null_audit(spark, d):
    return profile.null_audit(X.master(spark, d))


@register("corpus_shape")
def q_corpus_shape(spark, d):
    return profile.shape(D.corpus_rows(spark, d, with_context=True).select(
        "contract_name", "clause_type", "question", "q_id", "clause_text", "full_context"))


@register("corpus_cardinality")
def q_corpus_cardinality(spark, d):
    return profile.cardinality(D.enriched(spark, d), ("contract_name", "clause_type"))


@register("word_count_stats")
def q_word_count_stats(spark, d):
    return profile.word_count_stats(extract.with_word_count(X.clauses(spark, d)))


def _seq_lens(spark, d):
    return D.chat_pairs(spark, d).select(
        "conv_id", "turn", F.size(tk.hash_tokenize(F.col("chat_text"))).alias("seq_len"))


@register("sequence_length_stats")
def q_sequence_length_stats(spark, d):
    return profile.length_stats(_seq_lens(spark, d))


@register("sequence_length_stats_first100")
def q_sequence_length_stats_first100(spark, d):
    return profile.length_stats(_seq_lens(spark, d), first_n=100, order_cols=("conv_id", "turn"))


@register("over_limit_rate")
def q_over_limit_rate(spark, d):
    return profile.over_limit(_seq_lens(spark, d))


@register("learnable_tokens")
def q_learnable_tokens(spark, d):
    return D.token_rows(spark, d).select("conv_id", "turn",
                                         tk.learnable_count(F.col("labels")).alias("n_learnable"))


def _pred_gold(spark, d):
    p = D.parsed_replies(spark, d).select(
        "doc_id", label.with_default(F.struct("risk_level", "risk_reason", "plain_summary",
                                              "parse_status"))["risk_level"].alias("pred"))
    lab = X.table(spark, d, "labels").select(
        "doc_id", X.risk_of(F.col("quality"), F.col("toxic")).alias("gold"))
    return p.join(lab, "doc_id", "inner")


@register("risk_accuracy")
def q_risk_accuracy(spark, d):
    return profile.accuracy(_pred_gold(spark, d), "pred", "gold")


@register("majority_baseline")
def q_majority_baseline(spark, d):
    return profile.majority_baseline(_pred_gold(spark, d), "gold")


@register("loss_series")
def q_loss_series(spark, d):
    return profile.loss_series(X.training_log(spark, d))


@register("loss_summary")
def q_loss_summary(spark, d):
    return profile.loss_summary(X.training_log(spark, d))


@register("training_schedule")
def q_training_schedule(spark, d):
    s = sample.stratified_split(D.training_rows(spark, d).select("ord", "clause_type"), materialize=True)
    return profile.training_schedule(s.where(F.col("split") == "train"))


# ---- grouping, joins, metadata ------------------------------------------

def _lists(g):
    return g.select("contract_name", F.col("chunk").cast("bigint").alias("chunk"),
                    F.size("clauses").alias("n_clauses"),
                    F.array_join(F.transform("clauses", lambda s: s["clause_type"]), "|").alias("clause_types"),
                    _ints(F.transform("clauses", lambda s: s["ord"])).alias("ords"))


@register("clauses_by_contract")
def q_clauses_by_contract(spark, d):
    return _lists(metadata.clauses_by_contract(E.canonical_clauses(spark, d)))


@register("clauses_by_contract_bounded")
def q_clauses_by_contract_bounded(spark, d):
    """The same lists cut at 5 clauses or 8,000 bytes of text."""
    return _lists(metadata.clauses_by_contract(E.canonical_clauses(spark, d), chunk=5, max_bytes=8000))


@register("contract_parties_bounded")
def q_contract_parties_bounded(spark, d):
    """Parties of every contract, cut at 2 or 2,000 bytes."""
    p = metadata.contract_parties(E.canonical_clauses(spark, d), max_parties=2, max_bytes=2000)
    return p.select("contract_name", "chunk", F.size("parties").alias("n_parties"), F.md5(F.array_join("parties", "; ")).alias("parties_md5"))


@register("join_master")
def q_join_master(spark, d):
    contracts = E.canonical_clauses(spark, d).select("contract_name").distinct()
    m = metadata.canonicalize_master(X.master(spark, d))
    return metadata.join_master(contracts, m).select("contract_name", "file_ord",
                                                     "document_name_answer", "governing_law_answer")


@register("join_reconciliation")
def q_join_reconciliation(spark, d):
    return metadata.join_reconciliation(E.canonical_clauses(spark, d),
                                        metadata.canonicalize_master(X.master(spark, d)))


@register("dedupe_master")
def q_dedupe_master(spark, d):
    return E.master_dedup(spark, d)


@register("unmatched_clauses")
def q_unmatched_clauses(spark, d):
    return metadata.unmatched_clauses(E.clean_clauses(spark, d), X.master(spark, d)).select(
        "ord", "contract_name", "clause_type")


def _meta(spark, d, extended=False):
    return metadata.contract_metadata(E.canonical_clauses(spark, d), E.master_dedup(spark, d), extended)


@register("contract_metadata")
def q_contract_metadata(spark, d):
    return _meta(spark, d)


@register("provision_flags")
def q_provision_flags(spark, d):
    return _meta(spark, d).select("contract_name", "termination_for_convenience", "change_of_control",
                                  "cap_on_liability", "minimum_commitment")


@register("contract_metadata_extended")
def q_contract_metadata_extended(spark, d):
    m = _meta(spark, d, extended=True)
    return m.withColumn("parties", F.array_join("parties", "; "))


@register("metadata_context")
def q_metadata_context(spark, d):
    return metadata.with_metadata_context(_meta(spark, d)).select("contract_name", "metadata_context")


@register("metadata_context_extended")
def q_metadata_context_extended(spark, d):
    return metadata.with_metadata_context(_meta(spark, d, True), extended=True).select(
        "contract_name", "metadata_context")


@register("key_provisions")
def q_key_provisions(spark, d):
    from clausekit.functions import templates as tpl
    cols = [F.col(c) for c in ("termination_for_convenience", "change_of_control",
                               "cap_on_liability", "minimum_commitment")]
    return _meta(spark, d).select(
        "contract_name",
        F.array_join(tpl.key_provisions(*cols, strict=False), ",").alias("key_provisions"),
        F.array_join(tpl.key_provisions(*cols, strict=True), ",").alias("strict_key_provisions"))


@register("enrich_clauses")
def q_enrich_clauses(spark, d):
    return E.enriched(spark, d)


@register("enrich_from_stage")
def q_enrich_from_stage(spark, d):
    """The flagship over a materialized clean stage (written to the
    checkpoint folder, read back): same rows as ``enrich_clauses``."""
    path = _scratch(spark, "clean-stage")
    E.write_clean(E.clean_clauses(spark, d), path)
    return E.enriched_from_stage(spark, path, X.master(spark, d))


@register("stream_enrich_clauses")
def q_stream_enrich_clauses(spark, d):
    from clausekit.streaming.incremental import enrich_documents_stream
    return enrich_documents_stream(spark, d)


@register("enrich_clauses_flat")
def q_enrich_clauses_flat(spark, d):
    return E.enriched(spark, d, indent="")


# ---- related clauses -------------------------------------------------------

@register("related_clauses")
def q_related_clauses(spark, d):
    r = related.related_clauses(E.canonical_clauses(spark, d))
    return r.select("contract_name", "clause_type", F.size("related").alias("n_related"),
                    F.array_join(F.transform("related", lambda s: s["type"]), "|").alias("related_types"),
                    F.array_join(F.transform("related", lambda s: s["text"]), "\u0001").alias("related_texts"))


@register("related_context")
def q_related_context(spark, d):
    return related.related_contexts(E.canonical_clauses(spark, d))


@register("related_coverage")
def q_related_coverage(spark, d):
    r = related.clauses_with_related(E.canonical_clauses(spark, d))
    return r.agg(F.count(F.lit(1)).alias("n_clauses"),
                 F.count_if("has_related_clauses").alias("n_with_related"))


@register("enrich_with_related")
def q_enrich_with_related(spark, d):
    rel = related.related_contexts(E.canonical_clauses(spark, d), k=2)
    return E.enriched(spark, d, related=rel)


# ---- sampling, set operations ---------------------------------------------

@register("stratified_sample")
def q_stratified_sample(spark, d):
    return D.sampled(spark, d).select("ord", "clause_type")


@register("stratified_sample_lang")
def q_stratified_sample_lang(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", "lang")
    return sample.stratified_sample(docs, "lang", "doc_id")


@register("remaining_exactly_once")
def q_remaining_exactly_once(spark, d):
    return sample.remaining(D.enriched(spark, d), D.sampled(spark, d), "enriched_context").select(
        "ord", "clause_type")


@register("remaining_anti")
def q_remaining_anti(spark, d):
    return sample.remaining(D.enriched(spark, d), D.sampled(spark, d), "enriched_context",
                            mode="anti").select("ord", "clause_type")


@register("resample_remaining")
def q_resample_remaining(spark, d):
    rem = sample.remaining(D.enriched(spark, d), D.sampled(spark, d), "enriched_context")
    return sample.stratified_sample(rem, "clause_type", "ord").select("ord", "clause_type")


@register("symmetric_difference")
def q_symmetric_difference(spark, d):
    cols = ["contract_name", "clause_type", "clause_text", "enriched_context"]
    return sample.symmetric_difference(D.enriched(spark, d).select(*cols),
                                       D.sampled(spark, d).select(*cols)).select(
        "contract_name", "clause_type", F.md5("enriched_context").alias("context_md5"))


@register("merge_labels_keep_first")
def q_merge_labels_keep_first(spark, d):
    first = label.clean_labels(D.labelled(spark, d))
    m = sample.merge_keep_first([first, D.hand_labels(spark, d)], "enriched_context", "ord")
    return m.select("ord", "clause_type", "risk_level", "risk_reason", "plain_summary")


@register("append_results")
def q_append_results(spark, d):
    lab = D.labelled(spark, d)
    hand = D.hand_labels(spark, d)
    redo = label.rerun_required(lab).select("enriched_context").join(hand, "enriched_context", "inner")
    return sample.append(label.clean_labels(lab), redo).select(
        "ord", "clause_type", "risk_level", "risk_reason")


# ---- labelling ---------------------------------------------------------------

@register("label_prompts")
def q_label_prompts(spark, d):
    return label.label_prompts(D.labelled(spark, d)).select("ord", "system_prompt", "user_prompt")


class StubLabeller:
    """Deterministic stand-in for a hosted model.  The reply depends only on
    ``h`` = the first 8 hex digits of md5(user prompt): risk by ``h % 3``,
    reason/summary numbers by ``h % 97`` / ``h % 89``.  When ``h % 5 == 0``
    the first attempt for a row gets a broken reply (exercises the retry)."""

    def __init__(self):
        self.pending = None  # prompt whose first attempt just failed

    def __call__(self, system: str, user: str) -> str:
        import hashlib
        import json
        h = int(hashlib.md5(user.encode("utf-8")).hexdigest()[:8], 16)
        if h % 5 == 0 and self.pending != user:
            self.pending = user
            return '{"risk_level": "HIGH", '
        self.pending = None
        risk = ["HIGH", "MEDIUM", "LOW"][h % 3]
        return json.dumps({"risk_level": risk, "risk_reason": f"Stub reason {h % 97}.",
                           "plain_summary": f"Stub summary {h % 89}."})


def make_stub_labeller():
    return StubLabeller()


@register("label_batch_stub")
def q_label_batch_stub(spark, d):
    return label.label_batch(D.sampled(spark, d).select("ord", "clause_type", "enriched_context"),
                             make_stub_labeller, pause_s=0.0).select(
        "ord", "risk_level", "risk_reason", "plain_summary", "parse_status", "attempts")


def _label_sampled(spark, d):
    rows = D.sampled(spark, d).select("ord", "clause_type", "enriched_context")
    return rows, ("ord", "risk_level", "risk_reason", "plain_summary", "parse_status", "attempts")


@register("label_incremental_stub")
def q_label_incremental_stub(spark, d):
    """Labelling in committed slices, in two calls: the second adds the rows that the
    first did not have."""
    rows, cols = _label_sampled(spark, d)
    done = _scratch(spark, "label-runs")
    label.label_incremental(rows.where(F.col("ord") % 3 != 0), done, make_stub_labeller, commits=4, pause_s=0.0)
    return label.label_incremental(rows, done, make_stub_labeller, commits=4, every_row=True, pause_s=0.0).select(*cols)


@register("label_within_budget_stub")
def q_label_within_budget_stub(spark, d):
    """Labelling under a limit of calls a minute and a day, day after day until no row
    is left."""
    from clausekit.operators import label_runs
    rows, cols = _label_sampled(spark, d)
    done, day, state = _scratch(spark, "label-budget"), 0, ""
    total = rows.count()
    while state != "done":
        day += 1
        out, state = label_runs.label_within_budget(rows, done, make_stub_labeller, calls_per_minute=60_000_000,
                                                    calls_per_day=total // 2 + 1, slice_rows=total + 1, today=lambda: f"day {day}")
    return label.with_labels(rows, out).select(*cols)


@register("stream_label_sampled")
def q_stream_label_sampled(spark, d):
    """The sampled rows arrive as files; ``label_stream`` labels them
    micro-batch by micro-batch (resume by key) with the stub model."""
    from clausekit.streaming.incremental import _scratch as scratch, label_stream
    base = scratch(spark, "label-stream")
    rows = D.sampled(spark, d).select("ord", "clause_type", "enriched_context")
    rows.write.parquet(f"{base}/todo")
    todo = spark.readStream.schema(rows.schema).parquet(f"{base}/todo")
    q = label_stream(todo, f"{base}/done", f"{base}/chk", make_stub_labeller, pause_s=0.0)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return label.with_labels(spark.read.parquet(f"{base}/todo"), spark.read.parquet(f"{base}/done")).select(
        "ord", "risk_level", "risk_reason", "plain_summary", "parse_status", "attempts")


@register("parse_labels")
def q_parse_labels(spark, d):
    return D.parsed_replies(spark, d).drop("reply")


@register("label_failure_counts")
def q_label_failure_counts(spark, d):
    return label.failure_counts(D.parsed_replies(spark, d))


@register("label_with_default")
def q_label_with_default(spark, d):
    p = D.parsed_replies(spark, d)
    lab = label.with_default(F.struct("risk_level", "risk_reason", "plain_summary", "parse_status"))
    return p.select("doc_id", lab.alias("l")).select("doc_id", "l.*")


@register("labelled_rows")
def q_labelled_rows(spark, d):
    return D.labelled(spark, d)


@register("incremental_todo")
def q_incremental_todo(spark, d):
    return label.incremental_todo(D.to_label(spark, d), D.labelled(spark, d)).select("ord", "clause_type")


@register("clean_labels")
def q_clean_labels(spark, d):
    return label.clean_labels(D.labelled(spark, d)).select("ord", "clause_type", "risk_level")


@register("rerun_required")
def q_rerun_required(spark, d):
    return label.rerun_required(D.labelled(spark, d)).select("ord", "clause_type", "plain_summary")


# ---- training set ----------------------------------------------------------

@register("instruction_response")
def q_instruction_response(spark, d):
    return D.training_rows(spark, d).select("ord", "instruction", "response", "full_text")


@register("stratified_split")
def q_stratified_split(spark, d):
    return sample.stratified_split(D.training_rows(spark, d).select("ord", "clause_type"), materialize=True)


@register("split_balance")
def q_split_balance(spark, d):
    return sample.split_balance(sample.stratified_split(D.training_rows(spark, d).select("ord", "clause_type"), materialize=True))


@register("chat_messages")
def q_chat_messages(spark, d):
    p = D.chat_pairs(spark, d)
    return p.select("conv_id", "turn",
                    F.array_join(F.transform("messages", lambda m: m["role"]), "|").alias("roles"),
                    F.col("messages")[0]["content"].alias("user_content"),
                    F.col("messages")[1]["content"].alias("assistant_content"))


@register("render_chat")
def q_render_chat(spark, d):
    return D.chat_pairs(spark, d).select("conv_id", "turn", "chat_text")


@register("token_lengths")
def q_token_lengths(spark, d):
    return _seq_lens(spark, d)


@register("tokenize_truncate")
def q_tokenize_truncate(spark, d):
    t = training.tokenize(D.chat_pairs(spark, d), "chat_text")
    return t.select("conv_id", "turn", F.size("input_ids").alias("n_ids"),
                    _ints("input_ids").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@register("mask_instruction")
def q_mask_instruction(spark, d):
    t = D.token_rows(spark, d)
    return t.select("conv_id", "turn", _ints("labels").alias("labels"))


@register("pad_batches")
def q_pad_batches(spark, d):
    p = training.pad_batches(D.token_rows(spark, d), batch_size=4, order_cols=("conv_id", "turn"))
    return p.select("conv_id", "turn", F.col("batch_id").cast("bigint").alias("batch_id"),
                    F.size("input_ids").alias("padded_len"),
                    _ints("input_ids").alias("input_ids"), _ints("labels").alias("labels"),
                    _ints("attention_mask").alias("attention_mask"))


# ---- batch scoring ---------------------------------------------------------

_REQ_KEY = ("file_ord", "a_pos")


@register("validate_requests")
def q_validate_requests(spark, d):
    r = D.requests(spark, d)
    return r.select(*_REQ_KEY, scoring.validation_message().alias("message"))


@register("provisions_from_flags")
def q_provisions_from_flags(spark, d):
    r = scoring.with_defaults(D.requests(spark, d))
    return r.select(*_REQ_KEY, F.array_join(scoring.provisions_from_flags(), ",").alias("key_provisions"))


@register("request_defaults")
def q_request_defaults(spark, d):
    return scoring.with_defaults(D.requests(spark, d)).drop("clause_text")


@register("inference_prompts")
def q_inference_prompts(spark, d):
    return scoring.inference_prompts(D.requests(spark, d)).select(*_REQ_KEY, "message", "prompt")


def make_echo_scorer(**generation):
    """Stand-in model: echoes the prompt and appends a fixed answer."""
    def score(prompt: str) -> str:
        return prompt + "**Risk Assessment:** LOW\n  A short answer.  \n"
    return score


@register("score_batch_stub")
def q_score_batch_stub(spark, d):
    p = scoring.inference_prompts(D.requests(spark, d)).select(*_REQ_KEY, "message", "prompt")
    return scoring.score_batch(p, make_echo_scorer).select(*_REQ_KEY, "response")


@register("strip_prompt")
def q_strip_prompt(spark, d):
    p = scoring.inference_prompts(D.requests(spark, d))
    out = p.withColumn("full_output", D.echo_output(F.col("prompt")))
    return out.select(*_REQ_KEY, F.coalesce(F.col("message"), scoring.strip_prompt()).alias("response"))


@register("out_of_domain")
def q_out_of_domain(spark, d):
    r = scoring.out_of_domain(scoring.with_defaults(D.requests(spark, d)))
    return r.select(*_REQ_KEY, F.array_join("out_of_domain", ",").alias("out_of_domain"))


from clausekit.plans import file_queries  # noqa: E402,F401  registers its queries
