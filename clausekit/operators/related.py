"""Related clauses: first k clauses of related types in the same contract.

Plan: candidate clauses (types that appear in some related list) are cut to
their first k per (contract, type) with a ranking window that Spark plans as
``WindowGroupLimit`` (partial limit before the shuffle, so a huge contract
sends at most k rows per type per map task).  The distinct (contract, target
type) pairs meet the small relationship map, join the candidates on
(contract, related type) and keep the first k per (contract, target).  The
result depends on (contract, target type) only, so it is computed once per
pair, never per clause, and never pairs clauses with each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must match the reference)
CLAUSE_RELATIONSHIPS = {
    "Non-Compete": ["Exclusivity", "Competitive Restriction Exception", "Termination for Convenience"],
    "Exclusivity": ["Non-Compete", "No-Solicit of Customers"],
    "Cap on Liability": ["Uncapped Liability", "Liquidated Damages", "Insurance"],
    "License Grant": ["Non-Transferable License", "Affiliate IP License-Licensor", "Irrevocable or Perpetual License"],
    "Expiration Date": ["Renewal Term", "Notice to Terminate Renewal", "Effective Date"],
    "Termination for Convenience": ["Notice to Terminate Renewal", "Post-Termination Services"],
    "Anti-Assignment": ["Change of Control"],
    "IP Ownership Assignment": ["Joint IP Ownership", "License Grant"],
}
MAX_RELATED = 3
RELATED_TEXT_CHARS = 200
RELATED_HEADER = "Related Clauses:"
RELATED_ITEM = "- "
RELATED_SEP = ": "
# ---------------------------------------------------------------------------


def relationship_table(spark: SparkSession,
                       relationships: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(target_type, related_type, pos) rows; a literal, so its size is the
    size of the map the caller passes."""
    rel = CLAUSE_RELATIONSHIPS if relationships is None else relationships
    rows = [(t, r, i) for t, rs in rel.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "target_type string, related_type string, pos int")


def related_clauses(clean: DataFrame, k: int = MAX_RELATED,
                    relationships: Mapping[str, Sequence[str]] | None = None,
                    case_sensitive: bool = True) -> DataFrame:
    """Per (contract_name, target clause_type): ``related`` =
    ``array<struct<type, text>>`` of the first ``k`` same-contract clauses (in
    ``ord`` order) whose type is related to the target; text cut to 200
    characters.  Only targets present in the map get a row; callers left-join
    and default to an empty list."""
    spark = clean.sparkSession
    rel = relationship_table(spark, relationships)

    def key(c):
        return F.col(c) if case_sensitive else F.lower(F.col(c))

    rel = rel.select(key("target_type").alias("t_key"), key("related_type").alias("r_key"))
    rel = F.broadcast(rel.distinct())  # bounded by the literal map
    base = clean.where(F.col("contract_name").isNotNull() & F.col("clause_type").isNotNull())

    # cut first: only the shown characters pass the windows and the join
    cand = (base.select("contract_name", "ord", "clause_type",
                        F.substring(F.col("clause_text_cleaned"), 1, RELATED_TEXT_CHARS).alias("_text"),
                        key("clause_type").alias("r_key"))
            .join(rel.select("r_key").distinct(), "r_key", "left_semi"))
    w1 = Window.partitionBy("contract_name", "r_key").orderBy("ord")
    cand = cand.withColumn("_rn", F.row_number().over(w1)).where(F.col("_rn") <= k).drop("_rn")

    targets = (base.select("contract_name", F.col("clause_type").alias("target_type"),
                           key("clause_type").alias("t_key"))
               .distinct()
               .join(rel, "t_key", "inner"))
    pairs = targets.join(cand, ["contract_name", "r_key"], "inner")
    w2 = Window.partitionBy("contract_name", "target_type").orderBy("ord")
    top = pairs.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= k)
    item = F.struct(F.col("ord"), F.col("clause_type").alias("type"),
                    F.col("_text").alias("text"))
    out = (top.groupBy("contract_name", "target_type")
           .agg(F.array_sort(F.collect_list(item)).alias("_items")))
    return out.select("contract_name", F.col("target_type").alias("clause_type"),
                      F.transform("_items", lambda s: F.struct(s["type"].alias("type"),
                                                               s["text"].alias("text"))).alias("related"))


def related_context(related) -> F.Column:
    """``Related Clauses:`` header plus one ``- type: text`` line each;
    ``''`` when the list is empty or missing."""
    r = F.col(related) if isinstance(related, str) else related
    lines = F.transform(r, lambda s: F.concat(F.lit(RELATED_ITEM), s["type"],
                                              F.lit(RELATED_SEP), s["text"]))
    return (F.when(r.isNull() | (F.size(r) == 0), F.lit(""))
            .otherwise(F.concat(F.lit(RELATED_HEADER + "\n"), F.array_join(lines, "\n"))))


def clauses_with_related(clean: DataFrame, k: int = MAX_RELATED,
                         relationships: Mapping[str, Sequence[str]] | None = None,
                         case_sensitive: bool = True) -> DataFrame:
    """Every clause with its ``related`` list (empty when none) and the
    ``has_related_clauses`` flag."""
    rel = related_clauses(clean, k, relationships, case_sensitive)
    j = clean.join(rel, ["contract_name", "clause_type"], "left")
    empty = F.array().cast("array<struct<type:string,text:string>>")
    j = j.withColumn("related", F.coalesce(F.col("related"), empty))
    return j.withColumn("has_related_clauses", F.size("related") > 0)


def related_contexts(clean: DataFrame, k: int = MAX_RELATED,
                     relationships: Mapping[str, Sequence[str]] | None = None,
                     case_sensitive: bool = True) -> DataFrame:
    """(contract_name, clause_type, related_context) for enrichment."""
    rel = related_clauses(clean, k, relationships, case_sensitive)
    return rel.select("contract_name", "clause_type",
                      related_context(F.col("related")).alias("related_context"))
