"""DuckDB oracle SQL for every registered query that SQL can express.

Written independently of the Spark plans from the operator semantics; the
two only share the adapter rules, the longer templates, the relationship map and
the choice lists; defaults, messages and skip lists are spelled out here.
"""

from __future__ import annotations

from clausekit.functions import templates as tpl
from clausekit.functions.text import WS_CLASS
from clausekit.operators import related, scoring
from clausekit.plans import sql_blocks as B
from clausekit.plans.sql_blocks import q

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


W = B.with_

# ---- shared blocks ---------------------------------------------------------

CORPUS = """corpus AS (
  SELECT doc_id AS file_ord, text,
         'Contract ' || CAST(doc_id // 12 AS VARCHAR) AS title,
         CASE WHEN doc_id % 9 = 4 THEN 'no quoted type here'
              ELSE 'Highlight the parts related to "T' || CAST(doc_id % 5 AS VARCHAR) || '" or "x"' END AS question,
         'q' || CAST(doc_id AS VARCHAR) AS q_id,
         doc_id % 10 = 0 AS is_impossible,
         CASE WHEN doc_id % 10 = 5 THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS answers
  FROM documents)"""

CROWS = f"""crows AS (
  SELECT contract_name, clause_type, question, q_id, clause_text, full_context, file_ord,
         0::INTEGER AS c_pos, 0::INTEGER AS p_pos, 0::INTEGER AS q_pos, CAST(a_pos0 AS INTEGER) AS a_pos
  FROM (SELECT title AS contract_name, {B.clause_type_from_question('question')} AS clause_type,
               question, q_id, text AS full_context, file_ord,
               unnest(answers) AS clause_text, unnest(range(len(answers))) AS a_pos0
        FROM corpus WHERE NOT is_impossible AND len(answers) > 0))"""

ENRICHED_ALL = B.ENRICH_BLOCKS

_RISK = "CASE WHEN toxic = 1 THEN 'HIGH' WHEN quality = 0 THEN 'MEDIUM' ELSE 'LOW' END"


def _obj(risk: str, with_summary: bool = True, reason_null: bool = False) -> str:
    reason = "'null'" if reason_null else "'\"' || reason || '\"'"
    s = f"""'{{"risk_level": "' || {risk} || '", "risk_reason": ' || {reason}"""
    if with_summary:
        s += """ || ', "plain_summary": "' || summary || '"}'"""
    else:
        s += " || '}'"
    return s


REPLIES = f"""rbase AS (
  SELECT d.doc_id, {_RISK} AS risk,
         'Document ' || CAST(d.doc_id AS VARCHAR) || ' from ' || source || ' scored quality '
           || CAST(quality AS VARCHAR) || ' and toxic ' || CAST(toxic AS VARCHAR) || '.' AS reason,
         'A ' || lang || ' text of ' || CAST(n_chars AS VARCHAR) || ' characters.' AS summary
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
rvalid AS (SELECT *, {_obj('risk')} AS v FROM rbase),
replies AS (
  SELECT doc_id,
         CASE WHEN doc_id % 7 = 0 THEN substring(v, 1, length(v) - 5)
              WHEN doc_id % 13 = 0 THEN {_obj('risk', with_summary=False)}
              WHEN doc_id % 11 = 0 THEN {_obj('lower(risk)')}
              WHEN doc_id % 17 = 0 THEN v || ' trailing'
              WHEN doc_id % 19 = 0 THEN '[1]'
              WHEN doc_id % 23 = 0 THEN {_obj('risk', reason_null=True)}
              WHEN doc_id % 29 = 0 THEN '  ' || v || chr(10)
              ELSE v END AS reply
  FROM rvalid)"""

PARSED = f"""pj AS (
  SELECT doc_id, reply, s, CASE WHEN json_valid(s) THEN s END AS j
  FROM (SELECT doc_id, reply, {B.utrim('reply')} AS s FROM replies)),
parsed0 AS (
  SELECT doc_id, reply,
         CASE WHEN j IS NULL THEN 'json_error'
              WHEN json_type(j::JSON) = 'OBJECT'
                   AND json_exists(j, '$.risk_level') AND json_exists(j, '$.risk_reason')
                   AND json_exists(j, '$.plain_summary')
                   AND coalesce(json_extract_string(j, '$.risk_level') IN ('HIGH', 'MEDIUM', 'LOW'), false)
              THEN 'ok' ELSE 'invalid_format' END AS parse_status, j
  FROM pj),
parsed AS (
  SELECT doc_id, reply, parse_status,
         CASE WHEN parse_status = 'ok' THEN json_extract_string(j, '$.risk_level') END AS risk_level,
         CASE WHEN parse_status = 'ok' THEN json_extract_string(j, '$.risk_reason') END AS risk_reason,
         CASE WHEN parse_status = 'ok' THEN json_extract_string(j, '$.plain_summary') END AS plain_summary
  FROM parsed0),
ldef AS (
  SELECT doc_id, parse_status,
         CASE WHEN parse_status = 'ok' THEN risk_level ELSE 'MEDIUM' END AS risk_level,
         CASE WHEN parse_status = 'ok' THEN risk_reason ELSE 'Could not generate label after retries' END AS risk_reason,
         CASE WHEN parse_status = 'ok' THEN plain_summary ELSE 'Could not generate summary after retries' END AS plain_summary
  FROM parsed)"""

LABELLED = """labelled AS (
  SELECT e.ord, e.contract_name, e.clause_type, e.clause_text, e.enriched_context,
         l.risk_level, l.risk_reason, l.plain_summary
  FROM enriched e JOIN ldef l ON e.ord = l.doc_id)"""

_FAILED = "'could not generate'"

CLEANLAB = f"""cleanlab AS (
  SELECT * FROM labelled
  WHERE NOT coalesce(contains(lower(risk_reason), {_FAILED}), false)
    AND NOT coalesce(contains(lower(plain_summary), {_FAILED}), false))"""

HAND = f"""hand AS (
  SELECT e.ord, e.contract_name, e.clause_type, e.clause_text, e.enriched_context,
         {_RISK} AS risk_level, 'Reviewed and corrected by hand.' AS risk_reason, 'A hand-checked label.' AS plain_summary
  FROM enriched e JOIN labels l ON e.ord = l.doc_id)"""


def _nan(c: str) -> str:
    return f"coalesce({c}, 'nan')"


TRAIN = f"""train AS (
  SELECT *, instruction || {q(tpl.FULL_TEXT_SEP)} || response AS full_text
  FROM (SELECT *,
               {q(tpl.INSTRUCTION_HEAD)} || enriched_context || {q(tpl.INSTRUCTION_TAIL)} AS instruction,
               '**Clause Type:** ' || {_nan('clause_type')} || {q(tpl.RESPONSE_RISK)} || {_nan('risk_level')}
                 || {q(tpl.RESPONSE_REASON)} || {_nan('risk_reason')} || {q(tpl.RESPONSE_SUMMARY)}
                 || {_nan('plain_summary')} AS response
        FROM cleanlab))"""

_SKIP = "'Document Name', 'Parties', 'Agreement Date', 'Effective Date', 'Expiration Date'"
TO_LABEL = f"""to_label AS (
  SELECT * FROM enriched WHERE clause_type IS NULL OR clause_type NOT IN ({_SKIP}))"""


def _sample(src: str, strata: str, key: str, name: str, cap: int = 110) -> str:
    return f"""{name} AS (
  SELECT * FROM {src} WHERE {strata} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {strata}
                             ORDER BY md5('42:' || CAST({key} AS VARCHAR)), {key}) <= {cap})"""


SAMPLED = _sample("to_label", "clause_type", "ord", "sampled")

REMAINING = """remaining AS (
  SELECT any_value(ord) AS ord, any_value(contract_name) AS contract_name,
         any_value(clause_type) AS clause_type, any_value(clause_text) AS clause_text,
         enriched_context
  FROM (SELECT ord, contract_name, clause_type, clause_text, enriched_context FROM enriched
        UNION ALL
        SELECT ord, contract_name, clause_type, clause_text, enriched_context FROM sampled)
  GROUP BY enriched_context HAVING count(*) = 1)"""

PAIRS = """pairs AS (
  SELECT conv_id, turn, text AS instruction, next_text AS response
  FROM (SELECT conv_id, turn, role, text,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
        FROM conversations)
  WHERE role = 'user' AND next_role = 'assistant')"""


def _msg(role: str, content: str) -> str:
    from clausekit.operators import training as T
    return (f"{q(T.CHAT_HEADER_START + role + T.CHAT_HEADER_END)} || {content} || {q(T.CHAT_EOT)}")


def _chat_sql() -> str:
    from clausekit.operators import training as T
    return f"{q(T.CHAT_BOS)} || {_msg('user', 'instruction')} || {_msg('assistant', 'response')}"


CHAT = f"""chat AS (SELECT conv_id, turn, instruction, response, {_chat_sql()} AS chat_text FROM pairs)"""

TOKENS = f"""tok0 AS (
  SELECT conv_id, turn,
         list_slice({B.tok_ids('chat_text')}, 1, 2048) AS ids,
         list_slice({B.tok_ids('response')}, 1, 2048) AS rids
  FROM chat),
tok1 AS (
  SELECT conv_id, turn, ids,
         CASE WHEN len(ids) - len(rids) >= 0 THEN len(ids) - len(rids)
              ELSE greatest(2 * len(ids) - len(rids), 0) END AS st
  FROM tok0),
tokens AS (
  SELECT conv_id, turn, ids,
         list_transform(ids, lambda x, i: CASE WHEN i - 1 >= st THEN x ELSE -100 END) AS labels
  FROM tok1)"""

REQUESTS = f"""rrows AS (
  SELECT file_ord, a_pos, clause_text, clause_type, {B.canon('contract_name')} AS contract_name FROM crows),
requests AS (
  SELECT r.file_ord, r.a_pos, r.clause_text,
         CASE WHEN r.clause_type = 'Unknown' THEN 'Select clause type...' ELSE r.clause_type END AS target_clause,
         m.document_name AS contract_type, m.governing_law AS jurisdiction,
         m.renewal_term, m.notice_period,
         m.cap_on_liability = 'Yes' AS has_liability_cap,
         m.termination_for_convenience = 'Yes' AS has_termination,
         m.change_of_control = 'Yes' AS has_change_control,
         m.minimum_commitment = 'Yes' AS has_minimum_commitment
  FROM rrows r LEFT JOIN meta m ON r.contract_name = m.contract_name),
rdef AS (
  SELECT file_ord, a_pos, clause_text,
         coalesce(contract_type, 'Service Agreement') AS contract_type,
         coalesce(jurisdiction, 'Delaware') AS jurisdiction,
         coalesce(renewal_term, 'Not Applicable') AS renewal_term,
         coalesce(notice_period, 'none') AS notice_period,
         coalesce(target_clause, '') AS target_clause,
         coalesce(has_liability_cap, false) AS has_liability_cap,
         coalesce(has_termination, false) AS has_termination,
         coalesce(has_change_control, false) AS has_change_control,
         coalesce(has_minimum_commitment, false) AS has_minimum_commitment
  FROM requests),
rprov AS (
  SELECT *, list_filter([CASE WHEN has_liability_cap THEN 'Cap on Liability' END,
                         CASE WHEN has_termination THEN 'Termination for Convenience' END,
                         CASE WHEN has_change_control THEN 'Change of Control' END,
                         CASE WHEN has_minimum_commitment THEN 'Minimum Commitment' END],
                        lambda x: x IS NOT NULL) AS provs,
         CASE WHEN coalesce({B.utrim('clause_text')}, '') = '' THEN '⚠️ Please enter clause text'
              WHEN target_clause = 'Select clause type...' THEN '⚠️ Please select clause type' END AS message
  FROM rdef),
prompts AS (
  SELECT *, CASE WHEN message IS NULL THEN
           {q(tpl.INFER_HEAD)} || contract_type || {q(tpl.INFER_JURISDICTION)} || jurisdiction
           || {q(tpl.INFER_RENEWAL)} || renewal_term || {q(tpl.INFER_NOTICE)} || notice_period
           || {q(tpl.INFER_PROVISIONS)} || array_to_string(provs, ', ')
           || {q(tpl.INFER_TARGET)} || target_clause || {q(tpl.INFER_TEXT)} || clause_text
           || {q(tpl.INFER_TAIL)} END AS prompt
  FROM rprov)"""

REQ_BLOCKS = (B.CLAUSES, B.CLEAN, B.CCLEAN, B.MASTER, B.MCANON, B.MDEDUP, B.FLAGS, B.META,
              CORPUS, CROWS, REQUESTS)
LAB_BLOCKS = ENRICHED_ALL + (REPLIES, PARSED, LABELLED)

# ---- extraction, projection, filters ----------------------------------------

oracle("extract_clauses", W(CORPUS, CROWS) + "SELECT * FROM crows")

oracle("clause_ordinals", W(CORPUS, CROWS) + """
SELECT file_ord, a_pos,
       row_number() OVER (ORDER BY file_ord, c_pos, p_pos, q_pos, a_pos) - 1 AS ord
FROM crows""")

oracle("master_csv_roundtrip", W(B.MASTER) + """
SELECT filename, document_name_answer, agreement_date_answer, effective_date_answer,
       expiration_date_answer, renewal_term_answer, notice_period_answer, governing_law_answer,
       row_number() OVER (ORDER BY file_ord) - 1 AS file_ord
FROM master""")

oracle("corpus_json_roundtrip", W(CORPUS, CROWS) + """
SELECT contract_name, clause_type, question, q_id, clause_text, c_pos, p_pos, q_pos, a_pos,
       row_number() OVER (ORDER BY file_ord, a_pos) - 1 AS ord, place AS file_ord
FROM crows JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) ON doc_id = file_ord""")

oracle("answerable_filter", W(CORPUS) + """
SELECT file_ord, 0::INTEGER AS c_pos, 0::INTEGER AS p_pos, 0::INTEGER AS q_pos,
       title AS contract_name, q_id, CAST(len(answers) AS INTEGER) AS n_answers
FROM corpus WHERE NOT is_impossible AND len(answers) > 0""")

oracle("clause_type_from_question", W(CORPUS) + f"""
SELECT file_ord, q_id, {B.clause_type_from_question('question')} AS clause_type FROM corpus""")

oracle("normalize_text", f"SELECT doc_id, {B.norm('text')} AS text_normalized FROM documents")

oracle("word_count", f"SELECT doc_id, CAST({B.word_count('text')} AS INTEGER) AS n_words FROM documents")

oracle("clean_clauses", W(B.CLAUSES, B.CLEAN) + "SELECT * FROM clean")

oracle("canonical_contract_name", W(B.MASTER) + f"""
SELECT file_ord, filename, {B.utrim(f"regexp_replace(filename, '(?i)\\.pdf{WS_CLASS}*$', '', 'g')")} AS contract_name
FROM master""")

oracle("alias_names", W(B.CLAUSES, B.CLEAN, B.CCLEAN, B.MASTER, B.MCANON) + """
SELECT file_ord, contract_name, 'master' AS side FROM mcanon
UNION ALL SELECT ord AS file_ord, contract_name, 'clauses' AS side FROM cclean""")

oracle("filter_by_word_count", W(B.CLAUSES) + f"""
SELECT ord, clause_type, lower({B.norm('clause_text')}) AS clause_text_cleaned,
       CAST({B.word_count('clause_text')} AS INTEGER) AS n_words
FROM clauses WHERE {B.word_count('clause_text')} <= 4""")

oracle("skip_clause_types", W(*ENRICHED_ALL, TO_LABEL) + "SELECT ord, contract_name, clause_type FROM to_label")

# ---- profiling ---------------------------------------------------------------

oracle("clause_type_distribution", W(B.CLAUSES, B.CLEAN) +
       "SELECT clause_type, count(*) AS n FROM clean GROUP BY clause_type")

_MASTER_COLS = ["filename", "document_name_answer", "agreement_date_answer", "effective_date_answer",
                "expiration_date_answer", "renewal_term_answer", "notice_period_answer",
                "governing_law_answer", "file_ord"]
oracle("null_audit", W(B.MASTER) + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM master"
    for c in _MASTER_COLS))

oracle("corpus_shape", W(CORPUS, CROWS) + "SELECT count(*) AS n_rows, 6 AS n_cols FROM crows")

oracle("corpus_cardinality", W(*ENRICHED_ALL) + """
SELECT count(DISTINCT contract_name) AS n_contract_name, count(DISTINCT clause_type) AS n_clause_type
FROM enriched""")

oracle("word_count_stats", W(B.CLAUSES) + f"""
SELECT count(n) AS n, max(n) AS max_words, min(n) AS min_words, avg(n) AS mean_words
FROM (SELECT CAST({B.word_count('clause_text')} AS INTEGER) AS n FROM clauses)""")

SEQ = f"""seq AS (SELECT conv_id, turn, CAST(len({B.words('chat_text')}) AS INTEGER) AS seq_len FROM chat)"""

oracle("sequence_length_stats", W(PAIRS, CHAT, SEQ) + """
SELECT min(seq_len) AS min_len, max(seq_len) AS max_len, avg(seq_len) AS mean_len,
       quantile_cont(seq_len, 0.5) AS median_len, quantile_cont(seq_len, 0.95) AS p95_len FROM seq""")

oracle("sequence_length_stats_first100", W(PAIRS, CHAT, SEQ) + """
SELECT min(seq_len) AS min_len, max(seq_len) AS max_len, avg(seq_len) AS mean_len,
       quantile_cont(seq_len, 0.5) AS median_len, quantile_cont(seq_len, 0.95) AS p95_len
FROM (SELECT * FROM seq ORDER BY conv_id, turn LIMIT 100)""")

oracle("over_limit_rate", W(PAIRS, CHAT, SEQ) + """
SELECT count(*) FILTER (WHERE seq_len > 2048) AS n_over, count(*) AS n,
       count(*) FILTER (WHERE seq_len > 2048) * 100.0 / count(*) AS pct_over FROM seq""")

oracle("learnable_tokens", W(PAIRS, CHAT, TOKENS) + """
SELECT conv_id, turn, CAST(len(list_filter(labels, lambda x: x <> -100)) AS INTEGER) AS n_learnable
FROM tokens""")

PREDGOLD = f"""pg AS (
  SELECT l.doc_id, d.risk_level AS pred, {_RISK} AS gold
  FROM ldef d JOIN labels l ON d.doc_id = l.doc_id)"""

oracle("risk_accuracy", W(REPLIES, PARSED, PREDGOLD) + """
SELECT avg(CAST(pred = gold AS DOUBLE)) AS accuracy, count(*) AS n FROM pg""")

oracle("majority_baseline", W(REPLIES, PARSED, PREDGOLD,
                             "g AS (SELECT gold, count(*) AS n FROM pg GROUP BY gold)") + """
SELECT (SELECT max(n) / sum(n) FROM g) AS majority_share,
       (SELECT gold FROM g ORDER BY n DESC, gold DESC LIMIT 1) AS majority_class""")

TLOG = """tlog AS (
  SELECT event_id AS step,
         CASE WHEN event_type <> 'purchase' THEN value END AS loss,
         CASE WHEN event_type = 'purchase' THEN value END AS eval_loss
  FROM events)"""

oracle("loss_series", W(TLOG) + """
SELECT 'train' AS series, step, loss AS value FROM tlog WHERE loss IS NOT NULL
UNION ALL SELECT 'eval' AS series, step, eval_loss AS value FROM tlog WHERE eval_loss IS NOT NULL""")

oracle("loss_summary", W(TLOG) + """
SELECT (SELECT loss FROM tlog WHERE loss IS NOT NULL ORDER BY step DESC LIMIT 1) AS final_train_loss,
       (SELECT eval_loss FROM tlog WHERE eval_loss IS NOT NULL ORDER BY step DESC LIMIT 1) AS final_eval_loss,
       (SELECT min(eval_loss) FROM tlog) AS best_eval_loss""")

QUOTA = """counts AS (SELECT clause_type, count(*) AS n FROM srows GROUP BY clause_type),
q0 AS (SELECT c.clause_type, c.n, t.tot,
              t.tot - CAST(ceil(t.tot * 0.2::DOUBLE) AS BIGINT) AS ntr
       FROM counts c, (SELECT sum(n) AS tot FROM counts) t),
q1 AS (SELECT *, (n * ntr) // tot AS base, (n * ntr) % tot AS rem FROM q0),
q2 AS (SELECT *, ntr - sum(base) OVER () AS left_,
              row_number() OVER (ORDER BY (n = 1) DESC, rem DESC, clause_type) AS rk FROM q1),
quota AS (SELECT clause_type, n,
                 CAST(base + CASE WHEN rk <= left_ AND rem > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_train
          FROM q2),
split AS (
  SELECT s.ord, s.clause_type,
         CASE WHEN row_number() OVER (PARTITION BY s.clause_type
                                      ORDER BY md5('42:' || CAST(s.ord AS VARCHAR)), s.ord) <= q.n_train
              THEN 'train' ELSE 'val' END AS split
  FROM srows s JOIN quota q ON s.clause_type = q.clause_type)"""

SPLIT_BLOCKS = LAB_BLOCKS + (CLEANLAB, TRAIN, "srows AS (SELECT ord, clause_type FROM train)", QUOTA)

oracle("training_schedule", W(*SPLIT_BLOCKS) + """
SELECT n_train, 16 AS effective_batch, CAST(floor(n_train / 16.0::DOUBLE * 3.0::DOUBLE * 0.03::DOUBLE) AS BIGINT) AS warmup_steps
FROM (SELECT count(*) AS n_train FROM split WHERE split = 'train')""")

# ---- grouping, joins, metadata ----------------------------------------------

oracle("clauses_by_contract", W(B.CLAUSES, B.CLEAN, B.CCLEAN) + """
SELECT contract_name, CAST(0 AS BIGINT) AS chunk, CAST(count(*) AS INTEGER) AS n_clauses,
       string_agg(clause_type, '|' ORDER BY ord) AS clause_types,
       string_agg(CAST(ord AS VARCHAR), ' ' ORDER BY ord) AS ords
FROM cclean WHERE contract_name IS NOT NULL GROUP BY contract_name""")



def _chunked(items: int, size: int, rows: str = "cclean") -> str:
    """Rows with their list: items and bytes before them, each cut at its bound."""
    return f"""sized AS (
  SELECT *, strlen(coalesce(clause_text_cleaned, '')) AS bytes FROM {rows} WHERE contract_name IS NOT NULL),
chunked AS (
  SELECT *, (row_number() OVER p - 1) // {items} + CAST(sum(bytes) OVER p - bytes AS BIGINT) // {size} AS cut,
         count(*) OVER (PARTITION BY contract_name) <= {items} AND sum(bytes) OVER (PARTITION BY contract_name) <= {size} AS whole
  FROM sized WINDOW p AS (PARTITION BY contract_name ORDER BY ord))"""


_CHUNK = "CAST(CASE WHEN whole THEN 0 ELSE cut END AS BIGINT)"

oracle("clauses_by_contract_bounded", W(B.CLAUSES, B.CLEAN, B.CCLEAN, _chunked(5, 8000)) + f"""
SELECT contract_name, {_CHUNK} AS chunk, CAST(count(*) AS INTEGER) AS n_clauses,
       string_agg(clause_type, '|' ORDER BY ord) AS clause_types,
       string_agg(CAST(ord AS VARCHAR), ' ' ORDER BY ord) AS ords
FROM chunked GROUP BY ALL""")

oracle("contract_parties_bounded", W(B.CLAUSES, B.CLEAN, B.CCLEAN,
                                     "parties AS (SELECT * FROM cclean WHERE lower(clause_type) = 'parties')",
                                     _chunked(2, 2000, "parties")) + f"""
SELECT contract_name, {_CHUNK} AS chunk, CAST(count(*) AS INTEGER) AS n_parties,
       md5(string_agg(clause_text_cleaned, '; ' ORDER BY ord)) AS parties_md5
FROM chunked GROUP BY ALL""")

oracle("join_master", W(B.CLAUSES, B.CLEAN, B.CCLEAN, B.MASTER, B.MCANON) + """
SELECT c.contract_name, m.file_ord, m.document_name_answer, m.governing_law_answer
FROM (SELECT DISTINCT contract_name FROM cclean) c JOIN mcanon m ON c.contract_name = m.contract_name""")

oracle("join_reconciliation", W(B.CLAUSES, B.CLEAN, B.CCLEAN, B.MASTER, B.MCANON) + """
SELECT contract_name, 'left_only' AS side FROM
  (SELECT contract_name FROM cclean EXCEPT SELECT contract_name FROM mcanon)
UNION ALL
SELECT contract_name, 'right_only' AS side FROM
  (SELECT contract_name FROM mcanon EXCEPT SELECT contract_name FROM cclean)""")

oracle("dedupe_master", W(B.MASTER, B.MCANON, B.MDEDUP) + "SELECT * FROM mdedup")

oracle("unmatched_clauses", W(B.CLAUSES, B.CLEAN, B.CCLEAN, B.MASTER, B.MCANON) + """
SELECT ord, contract_name, clause_type FROM cclean c
WHERE NOT EXISTS (SELECT 1 FROM mcanon m WHERE m.contract_name = c.contract_name)""")

META_BLOCKS = (B.CLAUSES, B.CLEAN, B.CCLEAN, B.MASTER, B.MCANON, B.MDEDUP, B.FLAGS, B.META)

oracle("contract_metadata", W(*META_BLOCKS) + """
SELECT contract_name, document_name, governing_law, renewal_term, notice_period,
       termination_for_convenience, change_of_control, cap_on_liability, minimum_commitment
FROM meta""")

oracle("provision_flags", W(*META_BLOCKS) + """
SELECT contract_name, termination_for_convenience, change_of_control, cap_on_liability, minimum_commitment
FROM meta""")

oracle("contract_metadata_extended", W(*META_BLOCKS) + """
SELECT contract_name, document_name, array_to_string(parties, '; ') AS parties, governing_law,
       agreement_date, effective_date, expiration_date, renewal_term, notice_period,
       termination_for_convenience, change_of_control, cap_on_liability, minimum_commitment
FROM meta""")

oracle("metadata_context", W(*META_BLOCKS, B.CTX) + "SELECT contract_name, metadata_context FROM ctx")

oracle("metadata_context_extended", W(*META_BLOCKS, B.CTX_EXT) +
       "SELECT contract_name, metadata_context FROM ctx")

_STRICT = ("list_filter([CASE WHEN termination_for_convenience <> 'None' THEN 'Termination for Convenience' END, "
           "CASE WHEN change_of_control <> 'None' THEN 'Change of Control' END, "
           "CASE WHEN cap_on_liability <> 'None' THEN 'Cap on Liability' END, "
           "CASE WHEN minimum_commitment <> 'None' THEN 'Minimum Commitment' END], lambda x: x IS NOT NULL)")
oracle("key_provisions", W(*META_BLOCKS) + f"""
SELECT contract_name, array_to_string({B.PROVISIONS}, ',') AS key_provisions,
       array_to_string({_STRICT}, ',') AS strict_key_provisions
FROM meta""")

oracle("enrich_clauses", W(*ENRICHED_ALL) +
       "SELECT ord, contract_name, clause_type, clause_text, enriched_context FROM enriched")

oracle("stream_enrich_clauses", ORACLE["enrich_clauses"])
oracle("enrich_from_stage", ORACLE["enrich_clauses"])

oracle("enrich_clauses_flat", W(*ENRICHED_ALL[:-1]) + f"""
SELECT c.ord, c.contract_name, c.clause_type, c.clause_text_cleaned AS clause_text,
       {B.enriched('x.metadata_context', 'c.clause_type', 'c.clause_text_cleaned', '')} AS enriched_context
FROM cclean c JOIN ctx x ON c.contract_name = x.contract_name""")

# ---- related clauses ----------------------------------------------------------

_REL_VALUES = ", ".join(f"({q(t)}, {q(r)})" for t, rs in related.CLAUSE_RELATIONSHIPS.items() for r in rs)


def _related_blocks(k: int) -> tuple:
    return (
        f"rel AS (SELECT * FROM (VALUES {_REL_VALUES}) v(target_type, related_type))",
        f"""cand AS (
  SELECT contract_name, ord, clause_type, clause_text_cleaned FROM cclean
  WHERE contract_name IS NOT NULL AND clause_type IN (SELECT related_type FROM rel)
  QUALIFY row_number() OVER (PARTITION BY contract_name, clause_type ORDER BY ord) <= {k})""",
        """targets AS (
  SELECT DISTINCT contract_name, clause_type AS target_type FROM cclean
  WHERE contract_name IS NOT NULL AND clause_type IS NOT NULL)""",
        f"""top AS (
  SELECT t.contract_name, t.target_type, c.ord, c.clause_type,
         substring(c.clause_text_cleaned, 1, 200) AS text
  FROM targets t JOIN rel r ON t.target_type = r.target_type
  JOIN cand c ON c.contract_name = t.contract_name AND c.clause_type = r.related_type
  QUALIFY row_number() OVER (PARTITION BY t.contract_name, t.target_type ORDER BY c.ord) <= {k})""",
        """relagg AS (
  SELECT contract_name, target_type AS clause_type, CAST(count(*) AS INTEGER) AS n_related,
         string_agg(clause_type, '|' ORDER BY ord) AS related_types,
         string_agg(text, chr(1) ORDER BY ord) AS related_texts,
         'Related Clauses:' || chr(10) || string_agg('- ' || clause_type || ': ' || text, chr(10) ORDER BY ord)
           AS related_context
  FROM top GROUP BY contract_name, target_type)""",
    )


REL_BASE = (B.CLAUSES, B.CLEAN, B.CCLEAN)

oracle("related_clauses", W(*REL_BASE, *_related_blocks(3)) +
       "SELECT contract_name, clause_type, n_related, related_types, related_texts FROM relagg")

oracle("related_context", W(*REL_BASE, *_related_blocks(3)) +
       "SELECT contract_name, clause_type, related_context FROM relagg")

oracle("related_coverage", W(*REL_BASE, *_related_blocks(3)) + """
SELECT count(*) AS n_clauses, count(r.n_related) AS n_with_related
FROM cclean c LEFT JOIN relagg r ON c.contract_name = r.contract_name AND c.clause_type = r.clause_type""")

oracle("enrich_with_related", W(*ENRICHED_ALL[:-1], *_related_blocks(2)) + f"""
SELECT c.ord, c.contract_name, c.clause_type, c.clause_text_cleaned AS clause_text,
       {B.enriched("CASE WHEN coalesce(r.related_context, '') <> '' THEN x.metadata_context || chr(10) || r.related_context ELSE x.metadata_context END", 'c.clause_type', 'c.clause_text_cleaned')} AS enriched_context
FROM cclean c JOIN ctx x ON c.contract_name = x.contract_name
LEFT JOIN relagg r ON c.contract_name = r.contract_name AND c.clause_type = r.clause_type""")

# ---- sampling, set operations ---------------------------------------------------

SAMPLE_BLOCKS = ENRICHED_ALL + (TO_LABEL, SAMPLED)

oracle("stratified_sample", W(*SAMPLE_BLOCKS) + "SELECT ord, clause_type FROM sampled")

oracle("stratified_sample_lang", W(_sample("(SELECT doc_id, lang FROM documents)", "lang", "doc_id", "s")) +
       "SELECT doc_id, lang FROM s")

oracle("remaining_exactly_once", W(*SAMPLE_BLOCKS, REMAINING) + "SELECT ord, clause_type FROM remaining")

oracle("remaining_anti", W(*SAMPLE_BLOCKS) + """
SELECT ord, clause_type FROM enriched e
WHERE NOT EXISTS (SELECT 1 FROM sampled s WHERE s.enriched_context = e.enriched_context)""")

oracle("resample_remaining", W(*SAMPLE_BLOCKS, REMAINING, _sample("remaining", "clause_type", "ord", "s2")) +
       "SELECT ord, clause_type FROM s2")

oracle("symmetric_difference", W(*SAMPLE_BLOCKS) + """
SELECT contract_name, clause_type, md5(enriched_context) AS context_md5
FROM (SELECT contract_name, clause_type, clause_text, enriched_context FROM enriched
      UNION ALL SELECT contract_name, clause_type, clause_text, enriched_context FROM sampled)
GROUP BY contract_name, clause_type, clause_text, enriched_context HAVING count(*) = 1""")

oracle("merge_labels_keep_first", W(*LAB_BLOCKS, CLEANLAB, HAND) + """
SELECT ord, clause_type, risk_level, risk_reason, plain_summary
FROM (SELECT *, 0 AS src FROM cleanlab UNION ALL SELECT *, 1 AS src FROM hand)
QUALIFY row_number() OVER (PARTITION BY enriched_context ORDER BY src, ord) = 1""")

oracle("append_results", W(*LAB_BLOCKS, CLEANLAB, HAND) + f"""
SELECT ord, clause_type, risk_level, risk_reason FROM cleanlab
UNION ALL
SELECT h.ord, h.clause_type, h.risk_level, h.risk_reason
FROM labelled l JOIN hand h ON l.enriched_context = h.enriched_context
WHERE coalesce(contains(lower(l.plain_summary), {_FAILED}), false)""")

# ---- labelling -------------------------------------------------------------------

oracle("label_prompts", W(*LAB_BLOCKS) + f"""
SELECT ord, {q(tpl.LABEL_SYSTEM_PROMPT)} AS system_prompt,
       {q(tpl.LABEL_USER_HEAD)} || enriched_context || {q(tpl.LABEL_USER_TAIL)} AS user_prompt
FROM labelled""")

_H = ("('0x' || substr(md5(" + q(tpl.LABEL_USER_HEAD) + " || enriched_context || "
      + q(tpl.LABEL_USER_TAIL) + "), 1, 8))::BIGINT")
oracle("label_batch_stub", W(*SAMPLE_BLOCKS) + f"""
SELECT ord, (['HIGH', 'MEDIUM', 'LOW'])[h % 3 + 1] AS risk_level,
       'Stub reason ' || CAST(h % 97 AS VARCHAR) || '.' AS risk_reason,
       'Stub summary ' || CAST(h % 89 AS VARCHAR) || '.' AS plain_summary,
       'ok' AS parse_status, CAST(CASE WHEN h % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts
FROM (SELECT ord, {_H} AS h FROM sampled)""")

oracle("parse_labels", W(REPLIES, PARSED) +
       "SELECT doc_id, risk_level, risk_reason, plain_summary, parse_status FROM parsed")

oracle("label_failure_counts", W(REPLIES, PARSED) +
       "SELECT parse_status, count(*) AS n FROM parsed GROUP BY parse_status")

oracle("label_with_default", W(REPLIES, PARSED) +
       "SELECT doc_id, risk_level, risk_reason, plain_summary, parse_status FROM ldef")

oracle("labelled_rows", W(*LAB_BLOCKS) + "SELECT * FROM labelled")

oracle("incremental_todo", W(*LAB_BLOCKS, TO_LABEL) + """
SELECT ord, clause_type FROM to_label t
WHERE NOT EXISTS (SELECT 1 FROM labelled l WHERE l.enriched_context = t.enriched_context)""")

oracle("clean_labels", W(*LAB_BLOCKS, CLEANLAB) + "SELECT ord, clause_type, risk_level FROM cleanlab")

oracle("rerun_required", W(*LAB_BLOCKS) + f"""
SELECT ord, clause_type, plain_summary FROM labelled
WHERE coalesce(contains(lower(plain_summary), {_FAILED}), false)""")

# ---- training set --------------------------------------------------------------

oracle("instruction_response", W(*LAB_BLOCKS, CLEANLAB, TRAIN) +
       "SELECT ord, instruction, response, full_text FROM train")

oracle("stratified_split", W(*SPLIT_BLOCKS) + "SELECT ord, clause_type, split FROM split")

oracle("split_balance", W(*SPLIT_BLOCKS) + """
SELECT clause_type, count(*) AS n, count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'val') AS n_val
FROM split GROUP BY clause_type""")

oracle("chat_messages", W(PAIRS) + """
SELECT conv_id, turn, 'user|assistant' AS roles, instruction AS user_content, response AS assistant_content
FROM pairs""")

oracle("render_chat", W(PAIRS, CHAT) + "SELECT conv_id, turn, chat_text FROM chat")

oracle("token_lengths", W(PAIRS, CHAT, SEQ) + "SELECT conv_id, turn, seq_len FROM seq")

oracle("tokenize_truncate", W(PAIRS, CHAT, TOKENS) + """
SELECT conv_id, turn, CAST(len(ids) AS INTEGER) AS n_ids, array_to_string(ids, ' ') AS input_ids,
       CAST(len(ids) AS INTEGER) AS mask_sum
FROM tokens""")

oracle("mask_instruction", W(PAIRS, CHAT, TOKENS) +
       "SELECT conv_id, turn, array_to_string(labels, ' ') AS labels FROM tokens")

PADB = """b AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 4 AS batch_id FROM tokens),
p AS (SELECT *, CAST((max(len(ids)) OVER (PARTITION BY batch_id) + 7) // 8 * 8 AS INTEGER) AS plen FROM b)"""

oracle("pad_batches", W(PAIRS, CHAT, TOKENS, PADB) + """
SELECT conv_id, turn, batch_id, plen AS padded_len,
       array_to_string(list_concat(ids, list_transform(range(plen - len(ids)), lambda x: 0)), ' ') AS input_ids,
       array_to_string(list_concat(labels, list_transform(range(plen - len(ids)), lambda x: -100)), ' ') AS labels,
       array_to_string(list_concat(list_transform(ids, lambda x: 1),
                                   list_transform(range(plen - len(ids)), lambda x: 0)), ' ') AS attention_mask
FROM p""")

# ---- batch scoring --------------------------------------------------------------

oracle("validate_requests", W(*REQ_BLOCKS) + f"""
SELECT file_ord, a_pos,
       CASE WHEN coalesce({B.utrim('clause_text')}, '') = '' THEN '⚠️ Please enter clause text'
            WHEN target_clause = 'Select clause type...' THEN '⚠️ Please select clause type' END AS message
FROM requests""")

oracle("provisions_from_flags", W(*REQ_BLOCKS) + """
SELECT file_ord, a_pos, array_to_string(provs, ',') AS key_provisions FROM rprov""")

oracle("request_defaults", W(*REQ_BLOCKS) + """
SELECT file_ord, a_pos, contract_type, jurisdiction, renewal_term, notice_period, target_clause,
       has_liability_cap, has_termination, has_change_control, has_minimum_commitment
FROM rdef""")

oracle("inference_prompts", W(*REQ_BLOCKS) + "SELECT file_ord, a_pos, message, prompt FROM prompts")

oracle("strip_prompt", W(*REQ_BLOCKS) + f"""
SELECT file_ord, a_pos,
       coalesce(message, {B.utrim("substring(prompt || " + q("**Risk Assessment:** LOW\n  A short answer.  \n") + ", length(prompt) + 1)")}) AS response
FROM prompts""")

_OOD = ", ".join([
    f"CASE WHEN target_clause NOT IN ('Select clause type...', {', '.join(q(v) for v in scoring.CLAUSE_TYPE_CHOICES)}) THEN 'target_clause' END",
    f"CASE WHEN contract_type NOT IN ({', '.join(q(v) for v in scoring.CONTRACT_TYPE_CHOICES)}) THEN 'contract_type' END",
    f"CASE WHEN jurisdiction NOT IN ({', '.join(q(v) for v in scoring.JURISDICTION_CHOICES)}) THEN 'jurisdiction' END",
])
oracle("out_of_domain", W(*REQ_BLOCKS) + f"""
SELECT file_ord, a_pos, array_to_string(f, ',') AS out_of_domain
FROM (SELECT file_ord, a_pos, list_filter([{_OOD}], lambda x: x IS NOT NULL) AS f FROM rdef)
WHERE len(f) > 0""")

# the echo scorer returns prompt + fixed answer, so the scored response is the
# stripped-prompt response
oracle("score_batch_stub", ORACLE["strip_prompt"])
oracle("stream_label_sampled", ORACLE["label_batch_stub"])
oracle("label_incremental_stub", ORACLE["label_batch_stub"])

# a client for each call: the prompts whose first reply is broken never get another
oracle("label_within_budget_stub", W(*SAMPLE_BLOCKS) + f"""
SELECT ord, CASE WHEN h % 5 = 0 THEN 'MEDIUM' ELSE (['HIGH', 'MEDIUM', 'LOW'])[h % 3 + 1] END AS risk_level,
       CASE WHEN h % 5 = 0 THEN 'Could not generate label after retries'
            ELSE 'Stub reason ' || CAST(h % 97 AS VARCHAR) || '.' END AS risk_reason,
       CASE WHEN h % 5 = 0 THEN 'Could not generate summary after retries'
            ELSE 'Stub summary ' || CAST(h % 89 AS VARCHAR) || '.' END AS plain_summary,
       CASE WHEN h % 5 = 0 THEN 'json_error' ELSE 'ok' END AS parse_status,
       CAST(CASE WHEN h % 5 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempts
FROM (SELECT ord, {_H} AS h FROM sampled)""")

from clausekit.plans import file_oracle  # noqa: E402,F401  adds its SQL
