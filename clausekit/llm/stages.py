"""Stage functions of the corpus pipeline: (spark, docs, sf_dir) -> docs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausekit.llm import quality_crf
from clausekit.llm.decontaminate import contaminated
from clausekit.llm.mixing import mix
from clausekit.llm.ngram_jaccard import jaccard_components
from clausekit.llm.secrets import redact_secrets
from clausekit.llm.stage import staged, unused

QUALITY = 0.3


def quality(spark, docs, sf_dir):
    """Documents that the line classifier, trained on this stage's labelled
    documents, scores below 0.3 go.  Null, empty and word-free texts have a score like
    others; repeated rows have equal scores and go or stay together."""
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "_quality")
    return quality_crf.quality_scores(docs, model, out_col=score).where(F.col(score) >= QUALITY).drop(score)


def near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate group stays, the one with the smallest id.

    A document is an id with its text: rows of one id with other texts are documents of
    their own and go only as copies of something; of rows that are equal in both, one
    stays (the first by lang, source and n_chars).  Null and word-free texts are
    copies of nothing; rows without an id cannot be grouped and stay."""
    key, place = unused(docs, "_key"), unused(docs, "_row")
    text = F.coalesce("text", F.lit(""))
    known = docs.where("doc_id is not null")
    several = staged(known.groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("lo"), F.max(F.xxhash64(text)).alias("hi"))
                     .where("lo != hi").select(F.col("doc_id").alias("_id")), "several")
    if several.isEmpty():
        known = known.withColumn(key, F.col("doc_id").cast("bigint"))
    else:
        # only ids that name several texts need a key made up for each of them
        known = known.join(several, F.col("doc_id") == F.col("_id"), "left").withColumn(
            key, F.when(F.col("_id").isNotNull(), F.xxhash64("doc_id", text)).otherwise(F.col("doc_id").cast("bigint"))).drop("_id")
    groups = jaccard_components(known.select(F.col(key).alias("doc_id"), "text")).select(
        F.col("doc_id").alias("_k"), "component_id").distinct()
    ids = known.select(F.col(key).alias("_k"), "doc_id").distinct()
    if several.isEmpty():
        keep = groups.where("_k = component_id").select("_k")
    else:
        keep = groups.join(ids, "_k").groupBy("component_id").agg(F.min(F.struct("doc_id", "_k")).alias("first")).select("first._k")
    first = Window.partitionBy(key).orderBy("lang", "source", "n_chars")
    known = known.join(keep, F.col(key) == F.col("_k"), "left_semi").withColumn(place, F.row_number().over(first))
    return known.where(F.col(place) == 1).drop(place, key).unionByName(docs.where("doc_id is null"))


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark item go; rows without an id stay."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark, docs, sf_dir):
    """Every document stays; its secrets are masked and n_chars follows.  Null texts stay
    null with their n_chars; repeated rows stay."""
    return redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def mixing(spark, docs, sf_dir):
    """Documents drawn towards the target weights, with the copies to take.  Texts
    without words have no tokens to share and go; null ids, sources and languages are
    values of their own; repeated rows are drawn alike."""
    return mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("secrets", secrets), ("mixing", mixing)]
