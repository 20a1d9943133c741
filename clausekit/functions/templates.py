"""Prompt and context templates as native ``concat`` expressions.

Three template dialects exist and are kept apart on purpose: the enriched
clause context (indented or flat), the training instruction/response, and the
inference prompt.  The literal pieces below are fixed values: they must equal
the reference's text byte for byte for results to match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must match the reference text exactly)
LINE_CONTRACT_TYPE = "Contract Type: "
LINE_PARTIES = "Parties Involved: "
LINE_JURISDICTION = "Jurisdiction : "
LINE_DATE_SIGNED = "Date signed: "
LINE_EXPIRATION = "Expiration Date: "
LINE_EFFECTIVE = "Effective Date: "
LINE_RENEWAL = "Renewal Term: "
LINE_NOTICE = "Notice Period to terminate renewal: "
LINE_PROVISIONS = "Key Provisions: "
PARTIES_SEP = "; "
CONTEXT_PROVISIONS_SEP = ","
# provision names in context order (metadata rendering)
PROV_TERMINATION = "Termination for Convenience"
PROV_CHANGE = "Change of Control"
PROV_CAP = "Cap on Liability"
PROV_MINIMUM = "Minimum Commitment"

ENRICH_HEADER = "**Contract Context:**"
ENRICH_TARGET = "**Target Clause Type:** "
ENRICH_TEXT = "**Clause Text:**"

INSTRUCTION_HEAD = ("Analyse the following clause and provide:\n"
                    "1. Clause type classification\n"
                    "2. Risk assessment (HIGH/MEDIUM/LOW) with explanation\n"
                    "3. Plain English summary\n\n")
INSTRUCTION_TAIL = "\n\nProvide your analysis:\n\n"
RESPONSE_TYPE = "**Clause Type:** "
RESPONSE_RISK = "\n\n**Risk Assessment:** "
RESPONSE_REASON = "\n**Explanation:** "
RESPONSE_SUMMARY = "\n\n**Plain English Summary:** "
FULL_TEXT_SEP = "\n\n"

LABEL_USER_HEAD = "Analyze this contract clause:\n\n"
LABEL_USER_TAIL = "\n\nRemember: Respond ONLY with valid JSON, nothing else."

INFER_HEAD = ("\n  Analyse the following clause and provide:\n"
              "1. Clause type classification\n"
              "2. Risk assessment (HIGH/MEDIUM/LOW) with explanation\n"
              "3. Plain English summary\n\n"
              "**Contract Context:**\n"
              "    Contract Type: ")
INFER_JURISDICTION = "\nJurisdiction : "
INFER_RENEWAL = "\nRenewal Term: "
INFER_NOTICE = "\nNotice Period to terminate renewal: "
INFER_PROVISIONS = "\nKey Provisions: "
INFER_TARGET = "\n\n    **Target Clause Type:** "
INFER_TEXT = "\n    **Clause Text:**\n      "
INFER_TAIL = "\n\nProvide your analysis:\n"
INFER_PROVISIONS_SEP = ", "
# ---------------------------------------------------------------------------

# The fields of a label and what each holds; the reply is checked by these names
# (``operators.label``), so the instructions are made from them.
LABEL_FIELDS = {
    "risk_level": "HIGH if the clause can cost its party rights or much money, MEDIUM if it should be negotiated, "
                  "LOW if it is customary for such a contract",
    "risk_reason": "which words of the clause, and which facts of its contract, decide the level",
    "plain_summary": "what the clause says, for a reader without legal training",
}
LABEL_SYSTEM_PROMPT = (
    "You get one clause, after what is known of its contract. Reply with a JSON object of these text fields "
    "and with nothing else:\n" + "\n".join(f"{name}: {what}" for name, what in LABEL_FIELDS.items()))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _line(prefix: str, value: Column, null_text: str | None) -> Column:
    """One context line, skipped when the value is ``''``.

    A null value renders as ``null_text`` (``'nan'`` reproduces the
    reference, where a blank master cell is NaN and NaN is truthy); with
    ``null_text=None`` the line is omitted.
    """
    v = value if null_text is None else F.coalesce(value, F.lit(null_text))
    return F.when(v != "", F.concat(F.lit(prefix), v))


def key_provisions(termination: Column, change: Column, cap: Column, minimum: Column,
                   strict: bool = False) -> Column:
    """Provision names in context order as ``array<string>``.

    With ``strict=False`` (the reference) only Termination for Convenience
    depends on its flag; the other three are always listed because the
    reference compares the string ``'None'`` with the value ``None``.
    """
    def on(flag):
        return F.coalesce(flag, F.lit("None")) != "None"
    items = [
        F.when(on(termination), F.lit(PROV_TERMINATION)),
        F.when(on(change), F.lit(PROV_CHANGE)) if strict else F.lit(PROV_CHANGE),
        F.when(on(cap), F.lit(PROV_CAP)) if strict else F.lit(PROV_CAP),
        F.when(on(minimum), F.lit(PROV_MINIMUM)) if strict else F.lit(PROV_MINIMUM),
    ]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def metadata_context(document_name, governing_law, renewal_term, notice_period,
                     termination, change, cap, minimum, *, null_text: str | None = "nan",
                     strict_provisions: bool = False) -> Column:
    """Render contract metadata to the newline-joined context block."""
    provs = key_provisions(_c(termination), _c(change), _c(cap), _c(minimum), strict_provisions)
    return F.concat_ws(
        "\n",
        _line(LINE_CONTRACT_TYPE, _c(document_name), null_text),
        _line(LINE_JURISDICTION, _c(governing_law), null_text),
        _line(LINE_RENEWAL, _c(renewal_term), null_text),
        _line(LINE_NOTICE, _c(notice_period), null_text),
        F.when(F.size(provs) > 0,
               F.concat(F.lit(LINE_PROVISIONS), F.array_join(provs, CONTEXT_PROVISIONS_SEP))),
    )


def metadata_context_extended(document_name, parties, governing_law, agreement_date,
                              expiration_date, effective_date, renewal_term, notice_period,
                              termination, change, cap, minimum, *,
                              null_text: str | None = "nan",
                              strict_provisions: bool = False) -> Column:
    """Extended rendering with parties and the three dates."""
    provs = key_provisions(_c(termination), _c(change), _c(cap), _c(minimum), strict_provisions)
    p = _c(parties)
    return F.concat_ws(
        "\n",
        _line(LINE_CONTRACT_TYPE, _c(document_name), null_text),
        F.when(F.size(p) > 0, F.concat(F.lit(LINE_PARTIES), F.array_join(p, PARTIES_SEP))),
        _line(LINE_JURISDICTION, _c(governing_law), null_text),
        _line(LINE_DATE_SIGNED, _c(agreement_date), null_text),
        _line(LINE_EXPIRATION, _c(expiration_date), null_text),
        _line(LINE_EFFECTIVE, _c(effective_date), null_text),
        _line(LINE_RENEWAL, _c(renewal_term), null_text),
        _line(LINE_NOTICE, _c(notice_period), null_text),
        F.when(F.size(provs) > 0,
               F.concat(F.lit(LINE_PROVISIONS), F.array_join(provs, CONTEXT_PROVISIONS_SEP))),
    )


def enriched_context(context, clause_type, clause_text, indent: str = "    ",
                     related: Column | None = None) -> Column:
    """The clause prompt block.  ``indent='    '`` is the indented dialect,
    ``indent=''`` the flat one.  ``related`` (a rendered related-clause
    block) is inserted after the metadata when given and non-empty."""
    ctx = _c(context)
    if related is not None:
        ctx = F.when(related != "", F.concat(ctx, F.lit("\n"), related)).otherwise(ctx)
    return F.concat(
        F.lit(ENRICH_HEADER + "\n" + indent), ctx,
        F.lit("\n\n" + indent + ENRICH_TARGET), _c(clause_type),
        F.lit("\n" + indent + ENRICH_TEXT + "\n" + indent), _c(clause_text),
    )


def instruction(enriched) -> Column:
    return F.concat(F.lit(INSTRUCTION_HEAD), _c(enriched), F.lit(INSTRUCTION_TAIL))


def response(clause_type, risk_level, risk_reason, plain_summary,
             null_text: str = "nan") -> Column:
    """A missing label field renders as ``null_text`` (``'nan'``: the
    labelled table went through CSV, where a null cell reads back as NaN)."""
    def v(c):
        return F.coalesce(_c(c), F.lit(null_text))
    return F.concat(F.lit(RESPONSE_TYPE), v(clause_type),
                    F.lit(RESPONSE_RISK), v(risk_level),
                    F.lit(RESPONSE_REASON), v(risk_reason),
                    F.lit(RESPONSE_SUMMARY), v(plain_summary))


def full_text(instr: Column, resp: Column) -> Column:
    return F.concat(instr, F.lit(FULL_TEXT_SEP), resp)


def label_user_prompt(enriched) -> Column:
    return F.concat(F.lit(LABEL_USER_HEAD), _c(enriched), F.lit(LABEL_USER_TAIL))


def inference_prompt(clause_text, contract_type, jurisdiction, renewal_term,
                     notice_period, provisions, target_clause) -> Column:
    return F.concat(
        F.lit(INFER_HEAD), _c(contract_type),
        F.lit(INFER_JURISDICTION), _c(jurisdiction),
        F.lit(INFER_RENEWAL), _c(renewal_term),
        F.lit(INFER_NOTICE), _c(notice_period),
        F.lit(INFER_PROVISIONS), F.array_join(_c(provisions), INFER_PROVISIONS_SEP),
        F.lit(INFER_TARGET), _c(target_clause),
        F.lit(INFER_TEXT), _c(clause_text),
        F.lit(INFER_TAIL),
    )
