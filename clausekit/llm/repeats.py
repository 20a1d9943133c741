"""Passages that repeat across documents, by hashes of minimiser grams and of whole
windows; no suffixes are sorted.

Only suffixes at minimiser positions are kept: a position is kept if its k-word
gram has the smallest hash of all grams of some window of ``min_words`` words
(the leftmost, on ties).  The choice depends on the words alone, so equal windows
anywhere keep a suffix at the same place inside them, and about one position in
twenty is kept.

1. The kept suffixes are grouped by the hash of their first k words: a gram that no other document has cannot start a shared window.
2. A surviving suffix is extended to both sides: for every window of
   ``min_words`` words that it is the minimiser of, one hash of all its words is
   grouped with those of other documents.
3. Windows that another document holds too are joined into maximal spans.

Step 2 goes through two passes: the first counts documents per window,
pre-aggregated within tasks, so that a passage which a third of all documents
share is no hot group; the second emits only windows that a bounded bitmap of
the shared ones lets through, and an exact join removes the bitmap's mistakes.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausekit.llm import words as W
from clausekit.llm.stage import bitmap, drop, in_bitmap, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS = 50
GRAM = 8
BITS = 24               # a bitmap of 2 MB for grams, of 4 MB for windows


def _suffixes(w: W.Words, min_words: int, gram: int):
    """For every window of ``min_words`` words: (first word, text, gram hash of its
    minimiser, position of its minimiser)."""
    n = len(w.hash)
    if n < min_words:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    m = n - gram + 1
    g = W.combine([w.hash[j:j + m] for j in range(gram)])
    # smallest gram of each run of grams: (top bits of the hash, position), by doubling
    bits = np.uint64(max(1, int(m).bit_length()))
    key = (g >> bits << bits) | np.arange(m, dtype=np.uint64)
    need, have = min_words - gram + 1, 1
    low = key
    while have * 2 <= need:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    k = n - min_words + 1
    low = np.minimum(low[:k], low[need - have:need - have + k])
    doc = w.doc
    s = np.flatnonzero(doc[:k] == doc[min_words - 1:])
    at = (low[s] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return s, doc[s], g[at], at


def _window_hash(h: np.ndarray, s: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` words from each position: position-weighted prefix sums of
    the word hashes, brought to a common origin."""
    p, inv = W._powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[:len(h)], out=sums[1:])
    return W.mix64((sums[s + size] - sums[s]) * inv[s])


def _kept(min_words: int, gram: int):
    """(gram, document) of the kept suffixes."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, _, data, off in W.chunks(b.column(1)):
                w = W.split_words(data, off, W.byte_table())
                _, doc, g, at = _suffixes(w, min_words, gram)
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), pa.array(ids[lo + doc[new]])],
                                                 ["g", "id"])
    return run


def _extended(min_words: int, gram: int, grams: np.ndarray, windows: np.ndarray | None):
    """(window hash, document, first word) of the windows of surviving suffixes."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, _, data, off in W.chunks(b.column(1)):
                w = W.split_words(data, off, W.byte_table())
                s, doc, g, _ = _suffixes(w, min_words, gram)
                ok = in_bitmap(grams, g)
                s, doc = s[ok], doc[ok]
                h = _window_hash(w.hash, s, min_words)
                if windows is not None:
                    ok = in_bitmap(windows, h)
                    s, doc, h = s[ok], doc[ok], h[ok]
                if len(s):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(ids[lo + doc]),
                         pa.array((s - w.first[doc]).astype(np.int32))], ["h", "id", "s"])
    return run


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that two documents or more hold."""
    return (rows.groupBy(key).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
            .where("lo != hi").select(key))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the maximal runs of words (lower-cased
    A-Z, split at white space; end exclusive) in which every window of ``min_words``
    words also occurs in another document.

    Null and short texts and rows with a null id have none.  Rows that share an id
    are one document: their spans are given together, and words they share only
    with each other do not count as repeated.  Other columns are ignored."""
    d = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    kept = d.mapInArrow(_kept(min_words, gram), "g bigint, id bigint")
    grams = bitmap(_shared(kept, "g"), "g", BITS)
    shape = "h bigint, id bigint, s int"
    counted = d.mapInArrow(_extended(min_words, gram, grams, None), shape)
    shared = staged(_shared(counted, "h"), "windows")
    windows = bitmap(shared, "h", BITS + 1)
    rows = d.mapInArrow(_extended(min_words, gram, grams, windows), shape).join(shared, "h", "left_semi")
    by = Window.partitionBy("id").orderBy("s")
    runs = (rows.select("id", "s").withColumn("gap", F.col("s") > F.lag("s").over(by) + F.lit(min_words))
            .withColumn("run", F.sum(F.when(F.col("gap"), 1).otherwise(0)).over(by)))
    return (runs.groupBy("id", "run").agg(F.min("s").alias("a"), (F.max("s") + min_words).alias("b"))
            .select(F.col("id").alias(id_col), F.col("a").cast("bigint").alias("start_word"),
                    F.col("b").cast("bigint").alias("end_word"), (F.col("b") - F.col("a")).cast("bigint").alias("n_words")))
