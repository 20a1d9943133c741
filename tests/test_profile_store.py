"""Merged profiles against exact queries; subword token columns against another library."""

import json

import pytest
from pyspark.sql import functions as F

from clausekit.functions import subword
from clausekit.functions import tokens as tk
from clausekit.operators import profile_store as P
from clausekit.operators import training as T
from conftest import SF001


def corpus(spark, n=40_000):
    """Contract names in many slices, lengths far from uniform."""
    return spark.range(n).select(F.concat(F.lit("C"), F.col("id") % 9000).alias("contract_name"),
                                 F.when(F.col("id") % 17 != 0, F.concat(F.lit("T"), F.col("id") % 41)).alias("clause_type"),
                                 F.pow(F.col("id") % 997, F.lit(1.5)).cast("int").alias("n_words"), (F.col("id") % 8).alias("slice"))


def test_bounds_against_exact_queries(spark, tmp_path):
    rows, store = corpus(spark), str(tmp_path / "store")
    for k in range(8):
        part = P.slice_profile(rows.where(F.col("slice") == k), F.col("n_words"), ("clause_type",), ("contract_name", "clause_type"))
        P.add_slice(part, store, str(k))
        P.add_slice(part, store, str(k))        # a slice counts once
    got = P.merged(P.slices(spark, store), (0.05, 0.5, 0.95)).first()
    n = rows.count()
    want = rows.agg(F.count_if(F.col("clause_type").isNull()).alias("nulls"), F.min("n_words").alias("lo"), F.max("n_words").alias("hi"),
                    F.avg("n_words").alias("mean"), F.count_distinct("contract_name").alias("names")).first()
    assert (got.n_rows, got.null_clause_type, got.min_length, got.max_length) == (n, want.nulls, want.lo, want.hi)
    assert abs(got.mean_length - want.mean) < 1e-9
    assert abs(got.approx_contract_name - want.names) <= 0.03 * want.names and got.approx_clause_type == 41
    for q, value in ((0.05, got.approx_p5), (0.5, got.approx_p50), (0.95, got.approx_p95)):
        below, upto = rows.agg(F.count_if(F.col("n_words") < value) / n, F.count_if(F.col("n_words") <= value) / n).first()
        assert below - 0.01 <= q <= upto + 0.01


def test_new_clauses_are_read_alone(spark, tmp_path):
    rows, store = corpus(spark, 1000), str(tmp_path / "store")
    P.add_slice(P.slice_profile(rows, F.col("n_words"), (), ("contract_name",)), store, "a")
    P.add_slice(P.slice_profile(rows.where(F.lit(False)), F.col("n_words"), (), ("contract_name",)), store, "b")
    more = rows.withColumn("contract_name", F.concat(F.lit("N"), "contract_name"))
    P.add_slice(P.slice_profile(more, F.col("n_words"), (), ("contract_name",)), store, "c")
    got = P.merged(P.slices(spark, store)).first()
    assert got.n_rows == 2000 and abs(got.approx_contract_name - 2000) <= 40


def test_subword_mask_against_another_library(spark):
    """The whole registered query: ids by the ``tokenizers`` file of the same vocabulary,
    the mask by its rule."""
    import hashlib
    from tokenizers import Tokenizer
    from clausekit.plans import datasets as D
    from clausekit.plans.catalog import QUERIES
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    md5 = lambda x: hashlib.md5(" ".join(map(str, x)).encode()).hexdigest()
    want = []
    for r in D.chat_pairs(spark, SF001).collect():
        ids, resp = (other.encode(t, add_special_tokens=False).ids[:tk.MAX_LENGTH] for t in (r.chat_text, r.response))
        labels = [tk.IGNORE_INDEX] * len(ids)
        labels[len(ids) - len(resp):] = ids[len(ids) - len(resp):]
        want.append((r.conv_id, r.turn, len(ids), len([x for x in labels if x != tk.IGNORE_INDEX]), md5(ids), md5(labels)))
    assert sorted(map(tuple, QUERIES["subword_mask"](spark, SF001).collect())) == sorted(want)


@pytest.mark.parametrize("text", [None, "", " ", "<|endoftext|> it's", "日本 \U0001F600 é", "a" * 5000, "x\x00y"])
def test_subword_edge_texts(spark, text):
    from tokenizers import Tokenizer
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    df = spark.createDataFrame([(text,), ("after",)], "t string")
    got = [r.i for r in df.select(subword.subword_tokenizer()(F.col("t")).alias("i")).collect()]
    assert got[0] == (None if text is None else other.encode(text, add_special_tokens=False).ids)
    assert got[1] == other.encode("after", add_special_tokens=False).ids
    assert T.tokenize(df, "t", subword.subword_tokenizer(), 2).where(F.size("input_ids") > 2).count() == 0


def test_rank_file_agrees_with_vocabulary():
    """Same ids in both files of the vocabulary."""
    ids = json.load(open("/opt/tokenizers/byte_bpe_50k.json"))["model"]["vocab"]
    e = subword._encoder(open(subword.RANK_FILE, "rb").read(), subword.PATTERN)
    assert e.n_vocab == len(ids)
