"""Declared schemas for every stage of the clause data model."""

from pyspark.sql import types as T

S = T.StringType()

ANSWER = T.StructType([T.StructField("text", S)])
QA = T.StructType([
    T.StructField("id", S),
    T.StructField("question", S),
    T.StructField("is_impossible", T.BooleanType()),
    T.StructField("answers", T.ArrayType(ANSWER)),
])
PARAGRAPH = T.StructType([
    T.StructField("context", S),
    T.StructField("qas", T.ArrayType(QA)),
])
CONTRACT = T.StructType([
    T.StructField("title", S),
    T.StructField("paragraphs", T.ArrayType(PARAGRAPH)),
])
# one JSON object with a top-level ``data`` array (multi-line file)
CORPUS = T.StructType([T.StructField("data", T.ArrayType(CONTRACT))])

CLAUSE_ROW = T.StructType([
    T.StructField("contract_name", S),
    T.StructField("clause_type", S),
    T.StructField("question", S),
    T.StructField("q_id", S),
    T.StructField("clause_text", S),
    T.StructField("full_context", S),
    T.StructField("c_pos", T.IntegerType()),
    T.StructField("p_pos", T.IntegerType()),
    T.StructField("q_pos", T.IntegerType()),
    T.StructField("a_pos", T.IntegerType()),
    T.StructField("ord", T.LongType()),
])

# master CSV columns, exactly as headed in the file (note the stray space)
MASTER_COLUMNS = [
    "Filename",
    "Document Name-Answer",
    "Agreement Date-Answer",
    "Effective Date-Answer",
    "Expiration Date-Answer",
    "Renewal Term-Answer",
    "Notice Period To Terminate Renewal- Answer",
    "Governing Law-Answer",
]
MASTER = T.StructType([T.StructField(c, S) for c in MASTER_COLUMNS])

# snake_case names we use after reading the master file
MASTER_RENAME = {
    "Filename": "filename",
    "Document Name-Answer": "document_name_answer",
    "Agreement Date-Answer": "agreement_date_answer",
    "Effective Date-Answer": "effective_date_answer",
    "Expiration Date-Answer": "expiration_date_answer",
    "Renewal Term-Answer": "renewal_term_answer",
    "Notice Period To Terminate Renewal- Answer": "notice_period_answer",
    "Governing Law-Answer": "governing_law_answer",
}

LABELLED_ROW = T.StructType([
    T.StructField("contract_name", S),
    T.StructField("clause_type", S),
    T.StructField("clause_text", S),
    T.StructField("enriched_context", S),
    T.StructField("risk_level", S),
    T.StructField("risk_reason", S),
    T.StructField("plain_summary", S),
])

LABEL = T.StructType([
    T.StructField("risk_level", S),
    T.StructField("risk_reason", S),
    T.StructField("plain_summary", S),
])

MESSAGE = T.StructType([T.StructField("role", S), T.StructField("content", S)])
MESSAGES = T.ArrayType(MESSAGE)

REQUEST = T.StructType([
    T.StructField("clause_text", S),
    T.StructField("target_clause", S),
    T.StructField("contract_type", S),
    T.StructField("jurisdiction", S),
    T.StructField("renewal_term", S),
    T.StructField("notice_period", S),
    T.StructField("has_liability_cap", T.BooleanType()),
    T.StructField("has_termination", T.BooleanType()),
    T.StructField("has_change_control", T.BooleanType()),
    T.StructField("has_minimum_commitment", T.BooleanType()),
])

TRAINING_LOG = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()),
])
