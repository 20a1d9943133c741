"""DuckDB SQL twins of the adapters and building blocks, used by the oracle.

Every block here mirrors a Spark expression in ``clausekit.sources.adapters``
or ``clausekit.functions``; they are composed into one ``WITH`` query per
registered query in ``clausekit.plans.oracle``.
"""

from __future__ import annotations

from clausekit.functions.text import WS_CLASS
from clausekit.sources.adapters import CLAUSE_TYPES, CLAUSES_PER_CONTRACT

NL = "chr(10)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, '{WS_CLASS}+', ' ', 'g'), "
            f"'^ | $', '', 'g')")


def utrim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def canon(x: str) -> str:
    """Canonical contract name (trim, strip .pdf, default alias)."""
    from clausekit.operators.metadata import DEFAULT_ALIASES
    base = utrim(f"regexp_replace({x}, '(?i)\\.pdf{WS_CLASS}*$', '', 'g')")
    expr = base
    for k, v in DEFAULT_ALIASES.items():
        expr = f"(CASE WHEN {base} = {q(k)} THEN {q(v)} ELSE {base} END)"
    return expr


def word_count(x: str) -> str:
    n = norm(x)
    return f"(CASE WHEN {n} IS NULL OR {n} = '' THEN 0 ELSE len(string_split({n}, ' ')) END)"


def words(x: str) -> str:
    n = norm(x)
    return f"(CASE WHEN {n} = '' THEN []::VARCHAR[] ELSE string_split({n}, ' ') END)"


def hash6(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 6))::BIGINT"


def tok_ids(x: str) -> str:
    return f"list_transform({words(x)}, lambda w: {hash6('w')}::INTEGER)"


def clause_type_from_question(x: str) -> str:
    e = f"regexp_extract({x}, '\"([^\"]+)\"', 1)"
    return f"(CASE WHEN {e} IS NULL OR {e} = '' THEN 'Unknown' ELSE {e} END)"


TYPES_LIST = "[" + ", ".join(q(t) for t in CLAUSE_TYPES) + "]"

CLAUSES = f"""clauses AS (
  SELECT doc_id AS ord,
         'Contract ' || CAST(doc_id // {CLAUSES_PER_CONTRACT} AS VARCHAR) AS contract_name,
         {TYPES_LIST}[CAST({hash6("'t' || CAST(doc_id AS VARCHAR)")} % {len(CLAUSE_TYPES)} + 1 AS INTEGER)] AS clause_type,
         text AS clause_text
  FROM documents)"""

CLEAN = f"""clean AS (
  SELECT lower({norm('clause_text')}) AS clause_text_cleaned, clause_type,
         contract_name, ord
  FROM clauses)"""

CCLEAN = f"""cclean AS (
  SELECT clause_text_cleaned, clause_type, {canon('contract_name')} AS contract_name, ord
  FROM clean)"""

MASTER = """master AS (
  SELECT 'Contract ' || CAST(CASE WHEN c_custkey % 10 = 7 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR)
           || CASE WHEN c_custkey % 4 = 1 THEN '.PDF ' ELSE '.pdf' END AS filename,
         c_mktsegment || ' Agreement' AS document_name_answer,
         '1/' || CAST(c_custkey % 28 + 1 AS VARCHAR) || '/2020' AS agreement_date_answer,
         '2/' || CAST(c_custkey % 28 + 1 AS VARCHAR) || '/2020' AS effective_date_answer,
         CASE WHEN c_custkey % 4 = 0 THEN NULL
              ELSE '3/' || CAST(c_custkey % 28 + 1 AS VARCHAR) || '/2025' END AS expiration_date_answer,
         CASE WHEN c_custkey % 3 = 0 THEN NULL
              ELSE CAST(c_custkey % 5 + 1 AS VARCHAR) || ' years' END AS renewal_term_answer,
         CASE WHEN c_custkey % 5 = 0 THEN NULL
              ELSE CAST((c_custkey % 3 + 1) * 30 AS VARCHAR) || ' days' END AS notice_period_answer,
         n_name AS governing_law_answer,
         c_custkey AS file_ord
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

MCANON = f"""mcanon AS (
  SELECT {canon('filename')} AS contract_name, document_name_answer, agreement_date_answer,
         effective_date_answer, expiration_date_answer, renewal_term_answer,
         notice_period_answer, governing_law_answer, file_ord
  FROM master)"""

MDEDUP = """mdedup AS (
  SELECT * FROM mcanon WHERE contract_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY contract_name ORDER BY file_ord) = 1)"""


def _has(t: str) -> str:
    return f"coalesce(bool_or(lower(clause_type) = {q(t)}), false)"


def _has_text(t: str) -> str:
    return (f"coalesce(bool_or(lower(clause_type) = {q(t)} AND "
            f"coalesce(clause_text_cleaned, '') <> ''), false)")


FLAGS = f"""flags AS (
  SELECT contract_name,
         {_has('document name')} AS has_document_name,
         {_has('governing law')} AS has_governing_law,
         {_has('renewal term')} AS has_renewal_term,
         {_has('notice period to terminate renewal')} AS has_notice_period,
         {_has_text('termination for convenience')} AS prov_termination,
         {_has_text('change of control')} AS prov_change,
         {_has_text('cap on liability')} AS prov_cap,
         {_has_text('minimum commitment')} AS prov_minimum,
         {_has('agreement date')} AS has_agreement_date,
         {_has('effective date')} AS has_effective_date,
         {_has('expiration date')} AS has_expiration_date,
         list(clause_text_cleaned ORDER BY ord) FILTER (WHERE lower(clause_type) = 'parties') AS parties_raw
  FROM cclean WHERE contract_name IS NOT NULL GROUP BY contract_name)"""

META = """meta AS (
  SELECT f.contract_name,
         CASE WHEN has_document_name THEN document_name_answer ELSE '' END AS document_name,
         coalesce(parties_raw, []::VARCHAR[]) AS parties,
         CASE WHEN has_governing_law THEN governing_law_answer ELSE '' END AS governing_law,
         CASE WHEN has_agreement_date THEN agreement_date_answer ELSE 'Unknown' END AS agreement_date,
         CASE WHEN has_effective_date THEN effective_date_answer ELSE 'Unknown' END AS effective_date,
         CASE WHEN has_expiration_date THEN expiration_date_answer ELSE 'Unknown' END AS expiration_date,
         CASE WHEN has_renewal_term THEN renewal_term_answer ELSE 'Not Applicable' END AS renewal_term,
         CASE WHEN has_notice_period THEN notice_period_answer ELSE 'None' END AS notice_period,
         CASE WHEN prov_termination THEN 'Yes' ELSE 'None' END AS termination_for_convenience,
         CASE WHEN prov_change THEN 'Yes' ELSE 'None' END AS change_of_control,
         CASE WHEN prov_cap THEN 'Yes' ELSE 'None' END AS cap_on_liability,
         CASE WHEN prov_minimum THEN 'Yes' ELSE 'None' END AS minimum_commitment
  FROM flags f JOIN mdedup m ON f.contract_name = m.contract_name)"""


def _line(prefix: str, col: str) -> str:
    v = f"coalesce({col}, 'nan')"
    return f"CASE WHEN {v} <> '' THEN {q(prefix)} || {v} END"


PROVISIONS = ("list_filter([CASE WHEN termination_for_convenience <> 'None' "
              "THEN 'Termination for Convenience' END, 'Change of Control', "
              "'Cap on Liability', 'Minimum Commitment'], lambda x: x IS NOT NULL)")


def context_sql(extended: bool = False) -> str:
    parts = [_line("Contract Type: ", "document_name")]
    if extended:
        parts.append("CASE WHEN len(parties) > 0 THEN 'Parties Involved: ' || "
                     "array_to_string(parties, '; ') END")
    parts.append(_line("Jurisdiction : ", "governing_law"))
    if extended:
        parts += [_line("Date signed: ", "agreement_date"),
                  _line("Expiration Date: ", "expiration_date"),
                  _line("Effective Date: ", "effective_date")]
    parts += [_line("Renewal Term: ", "renewal_term"),
              _line("Notice Period to terminate renewal: ", "notice_period"),
              f"CASE WHEN len({PROVISIONS}) > 0 THEN 'Key Provisions: ' || "
              f"array_to_string({PROVISIONS}, ',') END"]
    return f"concat_ws({NL}, " + ", ".join(parts) + ")"


CTX = f"""ctx AS (SELECT meta.*, {context_sql(False)} AS metadata_context FROM meta)"""
CTX_EXT = f"""ctx AS (SELECT meta.*, {context_sql(True)} AS metadata_context FROM meta)"""


def enriched(ctx: str, ctype: str, text: str, indent: str = "    ") -> str:
    ind = q(indent)
    return (f"'**Contract Context:**' || {NL} || {ind} || {ctx} || {NL} || {NL} || {ind} || "
            f"'**Target Clause Type:** ' || {ctype} || {NL} || {ind} || '**Clause Text:**' || "
            f"{NL} || {ind} || {text}")


ENRICHED = f"""enriched AS (
  SELECT c.ord, c.contract_name, c.clause_type, c.clause_text_cleaned AS clause_text,
         {enriched('x.metadata_context', 'c.clause_type', 'c.clause_text_cleaned')} AS enriched_context
  FROM cclean c JOIN ctx x ON c.contract_name = x.contract_name)"""


def with_(*blocks: str) -> str:
    return "WITH " + ",\n".join(blocks) + "\n"


ENRICH_BLOCKS = (CLAUSES, CLEAN, CCLEAN, MASTER, MCANON, MDEDUP, FLAGS, META, CTX, ENRICHED)
