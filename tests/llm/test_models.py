"""Held-out accuracy of the trained models, and their independence of the held-out fold."""

import zlib

import pytest
from pyspark.sql import functions as F

from clausekit.llm.queries import QUERIES
from conftest import SF01

SF1 = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name,label,modulus,rest,least", [("op2_toxicity", "toxic", 3, 1, 0.97),
                                                           ("op6_quality_classifier", "quality", 5, 0, 0.97)])
def test_held_out_accuracy(spark, name, label, modulus, rest, least):
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    got = QUERIES[name](spark, SF1).join(labels, "doc_id").select("doc_id", "held_out", "predicted", label).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r[label] for r in held) >= least * len(held)


def test_misspellings_share_vectors(spark):
    from clausekit.llm import toxicity
    import pyarrow as pa
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    bad, plain = model.scores(pa.array(["what a worthlesss thing", "what a common thing"]))
    assert bad > 0.7 > plain


def test_every_row_is_scored(spark):
    n = spark.read.parquet(f"{SF01}/documents.parquet").count()
    for name in ("op2_toxicity", "op6_quality_classifier"):
        out = QUERIES[name](spark, SF01)
        assert out.count() == n and out.where(F.col("score").isNull()).count() == 0


def test_toxic_texts_are_found_and_clean_ones_left_alone(spark):
    """Held-out recall and precision, not accuracy alone (never saying toxic has 0.89)."""
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    got = [r for r in QUERIES["op2_toxicity"](spark, SF1).join(labels, "doc_id").collect() if r.held_out]
    hit = sum(r.predicted == r.toxic == 1 for r in got)
    assert hit >= 0.87 * sum(r.toxic for r in got)
    assert hit >= 0.92 * sum(r.predicted for r in got)


def test_scale_settles_on_far_margins():
    """Margins so far apart that the curvature vanishes: the scale still goes to the loss's foot."""
    import numpy as np
    from clausekit.llm.toxicity import SubwordSoftmax
    rng = np.random.default_rng(1)
    y = (rng.random(600) < 0.1).astype(int)
    x = np.where(y == 1, 9.0, 2.0) + rng.normal(0, 2.5, 600)
    m = SubwordSoftmax()
    m._calibrate(x, y)
    p = 1 / (1 + np.exp(-(m.scale * x + m.shift)))
    assert abs(m.shift) > 1 and 0.95 > ((p > 0.5) == y).mean() - 0.03 > 0.85


def test_marginals_against_enumeration():
    """Forward-backward over several texts at once = sums over all labellings of each."""
    import itertools
    import numpy as np
    from clausekit.llm.quality_crf import _marginals
    rng = np.random.default_rng(4)
    sizes = [3, 0, 1, 7, 2, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    score, trans = rng.normal(0, 2, first[-1]), rng.normal(0, 1, (2, 2))
    got, pairs = _marginals(score, first, trans, pairs=True)
    want, joint = np.zeros(first[-1]), np.zeros((2, 2))
    for lo, n in zip(first, sizes):
        total, mine, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.prod([1 / (1 + np.exp(-score[lo + i] if y[i] else score[lo + i])) for i in range(n)])
            w *= np.exp(sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            mine += w * np.array(y)
            for a, b in zip(y, y[1:]):
                steps[a, b] += w
        want[lo:lo + n] = mine / total
        joint += steps / total
    assert np.allclose(got, want) and np.allclose(pairs, joint)
