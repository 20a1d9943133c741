"""Batch scoring: the serving rules applied to a table of requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausekit._ship import ensure_shipped
from clausekit.functions import templates as tpl
from clausekit.functions.text import unicode_trim

# ---------------------------------------------------------------------------
# Fixed values (must match the reference)
MSG_EMPTY_TEXT = "⚠️ Please enter clause text"
MSG_NO_TYPE = "⚠️ Please select clause type"
TYPE_SENTINEL = "Select clause type..."
DEFAULT_CONTRACT_TYPE = "Service Agreement"
DEFAULT_JURISDICTION = "Delaware"
DEFAULT_RENEWAL_TERM = "Not Applicable"
DEFAULT_NOTICE_PERIOD = "none"
DEFAULT_TARGET_CLAUSE = ""
MAX_NEW_TOKENS = 350
TEMPERATURE = 0.3
TOP_P = 0.9
MAX_INPUT_TOKENS = 2048
CLAUSE_TYPE_CHOICES = [
    "Non-Compete", "Non-Disparagement", "Covenant Not to Sue", "Exclusivity",
    "License Grant", "Cap on Liability", "Termination for Convenience",
    "Change of Control", "Minimum Commitment", "Volume Restriction",
    "Anti-Assignment", "Post-Termination Services", "Audit Rights", "Insurance",
    "Renewal Term", "Notice to Terminate Renewal", "IP Ownership Assignment",
    "No-Solicit of Employees", "Warranty Duration", "Competitive Restriction Exception",
]
CONTRACT_TYPE_CHOICES = [
    "Service Agreement", "Employment Agreement", "License Agreement",
    "Distribution Agreement", "Distributor Agreement", "Franchise Agreement",
    "Master Franchise Agreement", "License and Reseller Agreement",
    "Exclusive License And Product Development Agreement", "NDA", "Other",
]
JURISDICTION_CHOICES = [
    "Delaware", "California", "New York", "Texas", "Florida", "Illinois",
    "Washington", "Ontario, Canada", "British Columbia, Canada", "Other",
]
# ---------------------------------------------------------------------------


def validation_message(clause_text="clause_text", target_clause="target_clause") -> Column:
    """First failing check wins; null when the request is valid."""
    t = F.col(clause_text) if isinstance(clause_text, str) else clause_text
    ty = F.col(target_clause) if isinstance(target_clause, str) else target_clause
    return (F.when(F.coalesce(unicode_trim(t), F.lit("")) == "", F.lit(MSG_EMPTY_TEXT))
            .when(ty == TYPE_SENTINEL, F.lit(MSG_NO_TYPE)))


def provisions_from_flags(cap="has_liability_cap", term="has_termination",
                          change="has_change_control", minimum="has_minimum_commitment") -> Column:
    """Provision names from the four booleans, in serving order (cap first)."""
    def on(c):
        return F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    items = [F.when(on(cap), F.lit(tpl.PROV_CAP)), F.when(on(term), F.lit(tpl.PROV_TERMINATION)),
             F.when(on(change), F.lit(tpl.PROV_CHANGE)), F.when(on(minimum), F.lit(tpl.PROV_MINIMUM))]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fill missing optional request fields with the serving defaults."""
    defaults = {
        "contract_type": DEFAULT_CONTRACT_TYPE, "jurisdiction": DEFAULT_JURISDICTION,
        "renewal_term": DEFAULT_RENEWAL_TERM, "notice_period": DEFAULT_NOTICE_PERIOD,
        "target_clause": DEFAULT_TARGET_CLAUSE,
    }
    cols = {}
    for c, v in defaults.items():
        src = F.col(c) if c in requests.columns else F.lit(None).cast("string")
        cols[c] = F.coalesce(src, F.lit(v))
    for c in ("has_liability_cap", "has_termination", "has_change_control", "has_minimum_commitment"):
        src = F.col(c) if c in requests.columns else F.lit(None).cast("boolean")
        cols[c] = F.coalesce(src, F.lit(False))
    return requests.withColumns(cols)  # one projection, analysed once


def inference_prompts(requests: DataFrame) -> DataFrame:
    """Validate, default and render the inference prompt for each request.
    Invalid requests keep their message and get no prompt."""
    r = with_defaults(requests)
    r = r.withColumns({"message": validation_message(), "key_provisions": provisions_from_flags()})
    prompt = tpl.inference_prompt("clause_text", "contract_type", "jurisdiction", "renewal_term",
                                  "notice_period", "key_provisions", "target_clause")
    return r.withColumn("prompt", F.when(F.col("message").isNull(), prompt))


def strip_prompt(output="full_output", prompt="prompt") -> Column:
    """Drop the echoed prompt by length (not by prefix check), then trim."""
    o = F.col(output) if isinstance(output, str) else output
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return unicode_trim(F.substring(o, F.length(p) + 1, 1 << 30))


Scorer = Callable[[str], str]


GENERATION = {"max_new_tokens": MAX_NEW_TOKENS, "temperature": TEMPERATURE, "top_p": TOP_P,
              "max_input_tokens": MAX_INPUT_TOKENS}


def score_batch(prompts: DataFrame, make_scorer: Callable[..., Scorer],
                prompt_col: str = "prompt", generation: dict | None = None) -> DataFrame:
    """Run the scorer on every valid request (``mapInPandas``, one model per
    partition) and add ``full_output`` and ``response`` (prompt stripped);
    invalid requests answer with their validation message.  The factory is
    called as ``make_scorer(**generation)`` (default: the serving settings,
    ``GENERATION``)."""
    gen = dict(GENERATION if generation is None else generation)
    ensure_shipped(prompts.sparkSession)
    schema = T.StructType(prompts.schema.fields + [T.StructField("full_output", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer(**gen)
        for pdf in batches:
            outs = [None if p is None else scorer(p) for p in pdf[prompt_col]]
            yield pdf.assign(full_output=outs)

    scored = prompts.mapInPandas(run, schema)
    return scored.withColumn("response", F.coalesce(F.col("message"), strip_prompt("full_output", prompt_col)))


def out_of_domain(requests: DataFrame) -> DataFrame:
    """Requests whose clause type, contract type or jurisdiction is outside
    the offered choices (custom values are allowed, so this is a report,
    never a reject).  The unselected type is a choice that is offered.  The
    lists are literals: an ``isin``, no join."""
    checks = [("target_clause", [TYPE_SENTINEL, *CLAUSE_TYPE_CHOICES]), ("contract_type", CONTRACT_TYPE_CHOICES),
              ("jurisdiction", JURISDICTION_CHOICES)]
    fields = F.filter(F.array(*[F.when(~F.col(c).isin(v), F.lit(c)) for c, v in checks]),
                      lambda x: x.isNotNull())
    return requests.withColumn("out_of_domain", fields).where(F.size("out_of_domain") > 0)
