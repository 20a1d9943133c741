"""Registered queries of the training-data operators: opN_<name> over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausekit.llm import quality_crf, toxicity
from clausekit.llm.alignment import align_tokens
from clausekit.llm.chat import format_chat, read_back
from clausekit.llm.decontaminate import contaminated
from clausekit.llm.licenses import find_licenses
from clausekit.llm.mixing import mix
from clausekit.llm.ngram_jaccard import jaccard_components
from clausekit.llm.quality_rules import quality_rules
from clausekit.llm.repeats import repeated_passages
from clausekit.llm.search import ranked_search
from clausekit.llm.secrets import find_secrets
from clausekit.llm.winnowing import compare_neighbours

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


@register("op8_ngram_jaccard_join")
def op8(spark, d):
    return jaccard_components(table(spark, d, "documents"))


def _fold(modulus: int, rest: int):
    """crc32(doc_id as text) mod ``modulus`` = ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


@register("op2_toxicity")
def op2(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, d, "labels"))
    out = toxicity.toxicity_scores(docs, model, out_col="score").drop("text")
    return out.select("doc_id", _fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op3_quality_rules")
def op3(spark, d):
    return quality_rules(table(spark, d, "documents"))


@register("op4_secret_scan")
def op4(spark, d):
    return find_secrets(table(spark, d, "documents"))


@register("op6_quality_classifier")
def op6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality_crf.train(docs, table(spark, d, "labels"))
    out = quality_crf.quality_scores(docs, model, out_col="score").drop("text")
    return out.select("doc_id", _fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op1_benchmark_decontamination")
def op1(spark, d):
    return contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@register("op10_source_mixing")
def op10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).drop("text")


@register("op9_suffix_array_dedup")
def op9(spark, d):
    return repeated_passages(table(spark, d, "documents"))


@register("op5_license_scan")
def op5(spark, d):
    return find_licenses(table(spark, d, "documents"))


@register("op7_chat_formatting")
def op7(spark, d):
    turns = table(spark, d, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_chat(turns.unionByName(extra)))


@register("op11_document_fingerprints")
def op11(spark, d):
    return compare_neighbours(table(spark, d, "documents"))


@register("op13_ranked_search")
def op13(spark, d):
    return ranked_search(table(spark, d, "documents"), table(spark, d, "benchmark"))


@register("op12_token_alignment")
def op12(spark, d):
    return align_tokens(table(spark, d, "documents"))
