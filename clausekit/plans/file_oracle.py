"""DuckDB SQL of the file-to-file queries, with every text spelled out."""

from __future__ import annotations

from clausekit.plans import sql_blocks as B
from clausekit.plans.oracle import CORPUS, CROWS, W, oracle

PLACES = "places AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents)"

oracle("corpus_checked", W(CORPUS, CROWS, PLACES) + """
SELECT contract_name, clause_type, question, q_id, clause_text, place AS file_ord, c_pos, p_pos, q_pos, a_pos
FROM crows JOIN places ON doc_id = file_ord
WHERE doc_id % 23 NOT IN (3, 5, 7, 11, 13, 17)""")

oracle("corpus_rejects", W(CORPUS, PLACES) + """
SELECT place AS file_ord, CAST(CASE WHEN r = 3 THEN -1 ELSE 0 END AS INTEGER) AS c_pos,
       CAST(CASE WHEN r IN (3, 11) THEN -1 ELSE 0 END AS INTEGER) AS p_pos,
       CAST(CASE WHEN r IN (3, 11, 13) THEN -1 ELSE 0 END AS INTEGER) AS q_pos,
       CASE r WHEN 3 THEN 'malformed record' WHEN 11 THEN 'contract without title'
              WHEN 13 THEN 'paragraph without context' WHEN 7 THEN 'question without is_impossible'
              WHEN 5 THEN 'question without answers' ELSE 'question without id' END AS reason
FROM (SELECT *, file_ord % 23 AS r FROM corpus) JOIN places ON doc_id = file_ord
WHERE r IN (3, 7, 11, 13) OR (r = 5 AND NOT is_impossible) OR (r = 17 AND NOT is_impossible AND len(answers) > 0)""")

LINES = "lines AS (SELECT *, file_ord AS k, row_number() OVER (ORDER BY file_ord) - 1 AS place FROM master)"

oracle("master_checked", W(B.MASTER, LINES) + """
SELECT filename, document_name_answer, agreement_date_answer, effective_date_answer, expiration_date_answer,
       renewal_term_answer, notice_period_answer, governing_law_answer, place AS file_ord
FROM lines WHERE k % 29 NOT IN (4, 9, 15)""")

oracle("master_rejects", W(B.MASTER, LINES) + """
SELECT place AS file_ord, CASE WHEN k % 29 = 15 THEN 'row without file name' ELSE 'malformed row' END AS reason
FROM lines WHERE k % 29 IN (4, 9, 15)""")

NUMBERED = """answered AS (
  SELECT doc_id // 12 AS number, doc_id, contract_name, clause_type, 'q' || CAST(doc_id AS VARCHAR) AS q_id,
         unnest(string_split(clause_text, chr(10))) AS clause_text,
         unnest(range(len(string_split(clause_text, chr(10))))) AS a_pos
  FROM (SELECT ord AS doc_id, contract_name, clause_type, clause_text FROM clauses)),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, a_pos) - 1 AS ord FROM answered)"""

oracle("corpus_multiline_clauses", W(B.CLAUSES, NUMBERED) + """
SELECT dense_rank() OVER (ORDER BY number // 8) - 1 AS file_ord,
       CAST(dense_rank() OVER (PARTITION BY number // 8 ORDER BY number) - 1 AS INTEGER) AS c_pos,
       CAST(dense_rank() OVER (PARTITION BY number ORDER BY doc_id) - 1 AS INTEGER) AS p_pos,
       0 AS q_pos, CAST(a_pos AS INTEGER) AS a_pos, ord, contract_name, clause_type, q_id, clause_text
FROM numbered""")

KEPT = """kept AS (SELECT * FROM (SELECT *, file_ord AS k FROM master) WHERE k % 29 NOT IN (4, 9, 15))"""


def _json(*cols: str) -> str:
    """A JSON object that leaves out null fields; the values hold nothing to escape."""
    cells = ", ".join(f"""CASE WHEN {c} IS NOT NULL THEN '"{c}":"' || {c} || '"' END""" for c in cols)
    return f"'{{' || concat_ws(',', {cells}) || '}}'"


oracle("files_to_enriched", W(
    B.CLAUSES, NUMBERED,
    f"""cclean AS (SELECT lower({B.norm('clause_text')}) AS clause_text_cleaned, clause_type,
         {B.canon('contract_name')} AS contract_name, ord FROM numbered)""",
    B.MASTER, KEPT, B.MCANON.replace("FROM master)", "FROM kept)"), B.MDEDUP, B.FLAGS, B.META, B.CTX) + f"""
SELECT c.ord, c.contract_name, c.clause_type, c.clause_text_cleaned AS clause_text,
       {B.enriched('x.metadata_context', 'c.clause_type', 'c.clause_text_cleaned')} AS enriched_context,
       {_json("contract_name", "document_name", "governing_law", "renewal_term", "notice_period", "termination_for_convenience",
              "change_of_control", "cap_on_liability", "minimum_commitment").replace('contract_name IS', 'x.contract_name IS').replace('|| contract_name', '|| x.contract_name')} AS metadata
FROM cclean c JOIN ctx x ON c.contract_name = x.contract_name""")

oracle("profile_from_slices", W(B.CLAUSES) + f"""
SELECT count(*) AS n_rows, CAST(count(*) - count(clause_type) AS BIGINT) AS null_clause_type,
       CAST(count(*) - count(clause_text) AS BIGINT) AS null_clause_text,
       CAST(min({B.word_count('clause_text')}) AS BIGINT) AS min_length, CAST(max({B.word_count('clause_text')}) AS BIGINT) AS max_length,
       round(avg({B.word_count('clause_text')}), 6) AS mean_length, true AS contracts_close, true AS types_close
FROM clauses""")
