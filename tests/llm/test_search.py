"""Ranked search against a plain Python version, over one shard and many."""

import math
import re
from collections import Counter

import pytest

from clausekit.llm.search import evaluate, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def brute(docs, items, k=10):
    """docs, items: (id, text)."""
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    docs = [(i, Counter(split(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n, length = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(split(t))
    for item, terms in of.items():
        scored = []
        for i, c in docs:
            m = 10 + 90 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1) if item is not None]
    return sorted(out)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("shard_bytes,k", [(2 << 20, 10), (20_000, 10), (3_000, 3)])
def test_against_brute_force(spark, shard_bytes, k):
    """Small shards: long texts are counted in pieces, and the best so far bound later shards."""
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)
    assert got(ranked_search(docs.repartition(3), items, k, shard_bytes=shard_bytes)) == want


def test_edge_rows(spark, monkeypatch):
    """Nulls, empty and term-free texts, ties, repeated rows and ids, one term longer
    than a shard, bytes outside ASCII, extra columns, blocks of one item."""
    monkeypatch.setattr("clausekit.llm.search.BLOCK_TERMS", 2)
    docs = [(1, None), (2, ""), (3, " \x00,;"), (4, "Alpha beta"), (5, "ALPHA, beta"), (5, "alpha beta"), (6, "Été été Δx9"),
            (7, "alpha " * 3000), (8, "y" * 9000 + " alpha"), (None, "beta beta"), (9, "beta")]
    items = [(1, "alpha Beta beta"), (2, "été ΔX9"), (3, None), (4, ""), (5, "nowhere"), (6, "y" * 9000), (None, "alpha"), (7, "alpha"), (7, "beta")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id int, text string, score string")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, rank string")
    assert got(ranked_search(d, q, 3, shard_bytes=1000)) == brute(docs, items, 3)
    assert got(ranked_search(d.limit(0), q)) == [] == got(ranked_search(d, q.limit(0)))


def test_accumulators_stop_without_loss():
    """Many documents hold only the common term: none of them gets an accumulator, and
    those that have one are scored in full."""
    import numpy as np
    doc = np.concatenate([np.arange(12), np.arange(1000)])
    impact = np.concatenate([np.full(12, 100), np.full(1000, 3)])
    score = evaluate(np.array([0, 1]), np.array([0, 12, 1012]), doc, impact, np.array([100, 3]), 1000, 10, 1)
    assert np.flatnonzero(score).tolist() == list(range(12)) and set(score[:12]) == {103}
    # a tie with the kth is not cut off
    score = evaluate(np.array([0, 1]), np.array([0, 10, 1010]), np.concatenate([np.arange(10), np.arange(1000)]),
                     np.concatenate([np.full(10, 3), np.full(1000, 3)]), np.array([3, 3]), 1000, 10, 1)
    assert np.count_nonzero(score) == 1000
