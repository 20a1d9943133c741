"""Contract grouping, master join and metadata enrichment.

Plan shape (one Catalyst plan): per-contract presence flags are a partial
aggregation (no lists), the master is de-duplicated with ``min_by`` (also
partial), and each clause meets its contract's metadata through one
many-to-one equi-join whose strategy AQE picks at run time (broadcast when the
metadata side is measured small, shuffle join with skew splitting otherwise).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausekit.functions import templates as tpl
from clausekit.functions import text as tx
from clausekit.operators import lists

# ---------------------------------------------------------------------------
# Fixed values (must match the reference)
# exact-value alias applied to contract names on both join sides
DEFAULT_ALIASES = {
    "LECLANCHÉ S.A. - JOINT DEVELOPMENT AND MARKETING AGREEMENT":
        "LECLANCH S.A. - JOINT DEVELOPMENT AND MARKETING AGREEMENT",
}
# lower-cased clause types that copy a master answer, and their defaults
T_DOCUMENT_NAME = "document name"
T_PARTIES = "parties"
T_GOVERNING_LAW = "governing law"
T_AGREEMENT_DATE = "agreement date"
T_EFFECTIVE_DATE = "effective date"
T_EXPIRATION_DATE = "expiration date"
T_RENEWAL_TERM = "renewal term"
T_NOTICE_PERIOD = "notice period to terminate renewal"
# lower-cased provision types flagged 'Yes' when a clause has text
T_TERMINATION = "termination for convenience"
T_CHANGE = "change of control"
T_CAP = "cap on liability"
T_MINIMUM = "minimum commitment"
DEFAULT_DOCUMENT_NAME = ""
DEFAULT_GOVERNING_LAW = ""
DEFAULT_DATE = "Unknown"
DEFAULT_RENEWAL_TERM = "Not Applicable"
DEFAULT_NONE = "None"
PROVISION_YES = "Yes"
# ---------------------------------------------------------------------------


def apply_aliases(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Exact whole-value replacement.  A literal map lookup: no join."""
    aliases = DEFAULT_ALIASES if aliases is None else aliases
    if not aliases:
        return name
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(m, name), name)


def canonical_name(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Trim, strip a trailing ``.pdf``, then alias.  Used on both join sides
    so a ``.pdf``-suffixed title cannot drop out of the join."""
    return apply_aliases(tx.canonical_contract_name(name), aliases)


def canonicalize_clauses(clean: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    return clean.withColumn("contract_name", canonical_name(F.col("contract_name"), aliases))


def canonicalize_master(master: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    return (master.withColumn("contract_name", canonical_name(F.col("filename"), aliases))
            .drop("filename"))


def dedupe_master(master: DataFrame) -> DataFrame:
    """First master row (lowest ``file_ord``) per contract name.

    ``min_by`` is a partial aggregate, so a name repeated many times is
    combined map-side before the shuffle."""
    cols = [c for c in master.columns if c != "contract_name"]
    first = F.min_by(F.struct(*cols), F.col("file_ord")).alias("m")
    return (master.where(F.col("contract_name").isNotNull())
            .groupBy("contract_name").agg(first).select("contract_name", "m.*"))


def clauses_by_contract(clean: DataFrame, chunk: int = lists.MAX_ITEMS,
                        max_bytes: int = lists.MAX_BYTES) -> DataFrame:
    """Per-contract ordered (ord, clause_type, clause_text) lists: (contract_name, chunk,
    clauses).

    One list (chunk 0) for every contract of at most ``chunk`` clauses and ``max_bytes``
    bytes of text, whatever its ordinals; a larger one goes on in further chunks (``operators.lists``).  Null contract names are
    dropped (as a pandas group-by does)."""
    item = F.struct(F.col("ord"), F.col("clause_type"), F.col("clause_text_cleaned").alias("clause_text"))
    return lists.ordered_lists(clean, "contract_name", "ord", item,
                               F.octet_length(F.coalesce("clause_text_cleaned", F.lit(""))), chunk, max_bytes, "clauses")


def contract_parties(clean: DataFrame, max_parties: int = lists.MAX_ITEMS, max_bytes: int = lists.MAX_BYTES) -> DataFrame:
    """(contract_name, chunk, parties): the texts of the parties clauses in order, as
    lists within the bounds."""
    rows = clean.where(F.lower("clause_type") == T_PARTIES).select("contract_name", "ord", "clause_text_cleaned")
    item = F.struct(F.col("ord"), F.col("clause_text_cleaned").alias("text"))
    out = lists.ordered_lists(rows, "contract_name", "ord", item, F.octet_length(F.coalesce("clause_text_cleaned", F.lit(""))),
                              max_parties, max_bytes, "parties")
    return out.withColumn("parties", F.transform("parties", lambda p: p["text"]))


def join_master(contracts: DataFrame, master: DataFrame) -> DataFrame:
    """Contract x master inner equi-join on the canonical name."""
    return contracts.join(master, "contract_name", "inner")


def join_reconciliation(contracts: DataFrame, master: DataFrame) -> DataFrame:
    """Names only on the clause side (``left_only``) or only in the master
    (``right_only``)."""
    both = contracts.select("contract_name", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        master.select("contract_name", F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = both.groupBy("contract_name").agg(
        F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.where("l != r").select(
        "contract_name", F.when(F.col("l") == 1, "left_only").otherwise("right_only").alias("side"))


def _has(t: str) -> Column:
    return F.max(F.col("_type") == t)


def _has_text(t: str) -> Column:
    return F.max((F.col("_type") == t) & F.col("_filled"))


def contract_flags(clean: DataFrame, extended: bool = False) -> DataFrame:
    """Per-contract presence flags: one partial aggregation, no lists.

    When ``clean`` carries a boolean ``has_text`` column (a materialized
    clean table, see ``plans.enrichment.write_clean``), the provision flags
    read it instead of the text, so on Parquet this pass scans three small
    columns only."""
    kind = F.lower(F.col("clause_type"))
    if "has_text" in clean.columns:
        filled = F.coalesce(F.col("has_text"), F.lit(False))
    else:   # evaluated for the four provision types only: no other text is normalised here
        filled = F.when(kind.isin(T_TERMINATION, T_CHANGE, T_CAP, T_MINIMUM),
                        F.coalesce(F.col("clause_text_cleaned"), F.lit("")) != "").otherwise(F.lit(False))
    rows = clean.where(F.col("contract_name").isNotNull()).select(
        "contract_name", kind.alias("_type"), filled.alias("_filled"))
    aggs = [
        _has(T_DOCUMENT_NAME).alias("has_document_name"),
        _has(T_GOVERNING_LAW).alias("has_governing_law"),
        _has(T_RENEWAL_TERM).alias("has_renewal_term"),
        _has(T_NOTICE_PERIOD).alias("has_notice_period"),
        _has_text(T_TERMINATION).alias("prov_termination"),
        _has_text(T_CHANGE).alias("prov_change"),
        _has_text(T_CAP).alias("prov_cap"),
        _has_text(T_MINIMUM).alias("prov_minimum"),
    ]
    if extended:
        aggs += [
            _has(T_AGREEMENT_DATE).alias("has_agreement_date"),
            _has(T_EFFECTIVE_DATE).alias("has_effective_date"),
            _has(T_EXPIRATION_DATE).alias("has_expiration_date"),
        ]
    return rows.groupBy("contract_name").agg(*aggs)


def _yes(flag: str) -> Column:
    return F.when(F.col(flag), F.lit(PROVISION_YES)).otherwise(F.lit(DEFAULT_NONE))


def contract_metadata(clean: DataFrame, master: DataFrame, extended: bool = False) -> DataFrame:
    """One metadata row per contract that has a master row.

    A present clause type copies the master answer (null stays null and is
    rendered later as ``null_text``); an absent one keeps the default.
    ``master`` must already be canonical and de-duplicated.  The extended row names
    all parties: their chunks (``contract_parties``) meet in it, since one text shows
    them all."""
    flags = contract_flags(clean, extended)
    if extended:
        parties = contract_parties(clean).groupBy("contract_name").agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "parties"))), lambda c: c["parties"])).alias("_parties"))
        flags = flags.join(parties, "contract_name", "left")
    j = flags.join(master, "contract_name", "inner")
    cols = [
        "contract_name",
        F.when(F.col("has_document_name"), F.col("document_name_answer"))
         .otherwise(F.lit(DEFAULT_DOCUMENT_NAME)).alias("document_name"),
    ]
    if extended:
        cols.append(F.coalesce("_parties", F.array().cast("array<string>")).alias("parties"))
    cols += [
        F.when(F.col("has_governing_law"), F.col("governing_law_answer"))
         .otherwise(F.lit(DEFAULT_GOVERNING_LAW)).alias("governing_law"),
    ]
    if extended:
        cols += [
            F.when(F.col("has_agreement_date"), F.col("agreement_date_answer"))
             .otherwise(F.lit(DEFAULT_DATE)).alias("agreement_date"),
            F.when(F.col("has_effective_date"), F.col("effective_date_answer"))
             .otherwise(F.lit(DEFAULT_DATE)).alias("effective_date"),
            F.when(F.col("has_expiration_date"), F.col("expiration_date_answer"))
             .otherwise(F.lit(DEFAULT_DATE)).alias("expiration_date"),
        ]
    cols += [
        F.when(F.col("has_renewal_term"), F.col("renewal_term_answer"))
         .otherwise(F.lit(DEFAULT_RENEWAL_TERM)).alias("renewal_term"),
        F.when(F.col("has_notice_period"), F.col("notice_period_answer"))
         .otherwise(F.lit(DEFAULT_NONE)).alias("notice_period"),
        _yes("prov_termination").alias("termination_for_convenience"),
        _yes("prov_change").alias("change_of_control"),
        _yes("prov_cap").alias("cap_on_liability"),
        _yes("prov_minimum").alias("minimum_commitment"),
    ]
    return j.select(*cols)


def with_metadata_context(meta: DataFrame, extended: bool = False, null_text: str | None = "nan",
                          strict_provisions: bool = False) -> DataFrame:
    """Add the rendered ``metadata_context`` text column."""
    prov = ["termination_for_convenience", "change_of_control", "cap_on_liability",
            "minimum_commitment"]
    if extended:
        ctx = tpl.metadata_context_extended(
            "document_name", "parties", "governing_law", "agreement_date", "expiration_date",
            "effective_date", "renewal_term", "notice_period", *prov,
            null_text=null_text, strict_provisions=strict_provisions)
    else:
        ctx = tpl.metadata_context("document_name", "governing_law", "renewal_term",
                                   "notice_period", *prov, null_text=null_text,
                                   strict_provisions=strict_provisions)
    return meta.withColumn("metadata_context", ctx)


def metadata_struct(meta: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in meta.columns if c != "metadata_context"])


def enrich(clean: DataFrame, master: DataFrame, *, aliases: Mapping[str, str] | None = None,
           extended: bool = False, indent: str = "    ", null_text: str | None = "nan",
           strict_provisions: bool = False, related: DataFrame | None = None,
           with_metadata: bool = True) -> DataFrame:
    """Clause rows with their contract's prompt context.

    ``clean``: cleaned clause rows (clause_text_cleaned, clause_type,
    contract_name, ord).  ``master``: raw master rows (filename, answers,
    file_ord).  ``related``: optional per-(contract, type) rendered
    ``related_context`` (see ``operators.related``).
    Clauses whose contract has no master row are not returned; get them with
    ``unmatched_clauses``.
    """
    c = canonicalize_clauses(clean, aliases)
    m = dedupe_master(canonicalize_master(master, aliases))
    meta = with_metadata_context(contract_metadata(c, m, extended), extended, null_text,
                                 strict_provisions)
    meta = meta.select("contract_name", "metadata_context",
                       metadata_struct(meta).alias("metadata"))
    j = c.join(meta, "contract_name", "inner")
    rel = None
    if related is not None:
        j = j.join(related.select("contract_name", "clause_type", "related_context"),
                   ["contract_name", "clause_type"], "left")
        rel = F.coalesce(F.col("related_context"), F.lit(""))
    cols = [
        "ord", "contract_name", "clause_type",
        F.col("clause_text_cleaned").alias("clause_text"),
        tpl.enriched_context(F.col("metadata_context"), F.col("clause_type"),
                             F.col("clause_text_cleaned"), indent, rel).alias("enriched_context"),
    ]
    if with_metadata:
        cols.append("metadata")
    return j.select(*cols)


def unmatched_clauses(clean: DataFrame, master: DataFrame,
                      aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Quarantine: clauses whose contract has no master row (the reference
    crashes on the first one)."""
    c = canonicalize_clauses(clean, aliases)
    m = canonicalize_master(master, aliases).select("contract_name")
    return c.join(m, "contract_name", "left_anti")
