"""Ranked lexical search: for every query item the k highest-scoring documents, by
accumulator-limited term-at-a-time evaluation.

Documents are scored shard by shard (a run of documents of bounded bytes, inverted
in memory), the queries are the same for all.  Within a shard each item goes
through its terms from the rarest to the commonest.  A term adds to the
accumulators of its documents; once the largest that all remaining terms together
can add is below the kth best score so far (of the shard's partial scores or of the
shards that the task has behind it), no document outside can get among the best
k: no accumulator is made any more, and only those that exist go on to be updated,
exactly.  Each task returns k rows an item at most; the best of them are final.

Corpus statistics (documents, terms, documents that hold a query term) are counted
over all documents first.  Queries are sent to the tasks in blocks of bounded size,
with one pass of counting and one of scoring for each block.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausekit.llm import words as W
from clausekit.llm.stage import drop, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_BYTES = 2 << 20
BLOCK_TERMS = 1 << 20       # (item, term) rows of a block: 16 MB
BLOCK_ITEMS = 50_000
#: Terms are the maximal runs of other bytes: digits, letters, everything outside ASCII.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@dataclass
class Queries:
    """A block of items; the terms of item i are ``vocabulary[term[first[i]:first[i + 1]]]``."""

    items: np.ndarray
    first: np.ndarray
    term: np.ndarray
    vocabulary: np.ndarray      # uint64, sorted


@dataclass
class Shard:
    """Postings sorted by term, and the number of terms of every document."""

    term: np.ndarray
    doc: np.ndarray
    tf: np.ndarray
    n: np.ndarray


def _table() -> np.ndarray:
    t = W.byte_table(separators=b"")
    t[list(SEPARATORS)] = 0x20
    return t


def _pieces(data: np.ndarray, table: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A long text cut between terms into pieces of ``limit`` bytes (a longer term is one piece)."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + limit)
        if hi < len(data):
            gaps = np.flatnonzero(table[data[lo:hi]] == 0x20)
            while not len(gaps) and hi < len(data):
                more = np.flatnonzero(table[data[hi:hi + limit]] == 0x20)
                gaps, hi = more + hi - lo, min(len(data), hi + limit)
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else len(data)
        yield data[lo:hi]
        lo = hi


def _count(words: W.Words, vocabulary: np.ndarray) -> Shard:
    n = np.diff(words.first)
    at = np.searchsorted(vocabulary, words.hash)
    at[at == len(vocabulary)] = 0
    hit = np.flatnonzero(vocabulary[at] == words.hash) if len(vocabulary) else np.zeros(0, np.int64)
    key, tf = np.unique(at[hit] * len(n) + words.doc[hit], return_counts=True)
    return Shard(key // max(1, len(n)), key % max(1, len(n)), tf, n)


def _shards(column: pa.Array, vocabulary: np.ndarray, table: np.ndarray, limit: int) -> Iterator[tuple[int, Shard]]:
    """(first row, shard) for every run of texts; a text longer than ``limit`` is a
    shard of its own, counted piece by piece."""
    for lo, hi, data, off in W.chunks(column, limit):
        if len(data) <= limit:
            yield lo, _count(W.split_words(data, off, table), vocabulary)
            continue
        n, tf = 0, np.zeros(len(vocabulary), np.int64)
        for part in _pieces(data, table, limit):
            one = _count(W.split_words(part, np.array([0, len(part)]), table), vocabulary)
            n += int(one.n[0])
            tf[one.term] += one.tf
        term = np.flatnonzero(tf)
        yield lo, Shard(term, np.zeros(len(term), np.int64), tf[term], np.array([n]))


def _counted(vocabulary: np.ndarray, limit: int):
    """(term, documents that hold it); term -1: documents with a term, -2: terms."""
    def run(batches):
        table, df, sums = _table(), np.zeros(len(vocabulary), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for _, s in _shards(b.column(1), vocabulary, table, limit):
                df += np.bincount(s.term, minlength=len(df))
                sums += np.count_nonzero(s.n), s.n.sum()
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([held, [-1, -2]])),
                                          pa.array(np.concatenate([df[held], sums]))], ["term", "n"])
    return run


def _impacts(s: Shard, weight: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What every posting adds to the score of its document."""
    if int(s.n.max(initial=0)) * documents * 90 < 1 << 63:
        m = 10 + 90 * s.n * documents // max(1, terms)
    else:
        m = np.array([10 + 90 * int(x) * documents // terms for x in s.n], np.int64)
    return weight[s.term] * (1_000_000_000 * s.tf // (1000 * s.tf + 8 * m[s.doc]))


class _Best:
    """The best k (score, document) of every item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.score, self.doc = k, [np.zeros(0, np.int64)] * items, [np.zeros(0, np.int64)] * items

    def least(self, i: int) -> int:
        """A score below this cannot enter."""
        return int(self.score[i][-1]) if len(self.score[i]) == self.k else 1

    def add(self, i: int, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score[i], score]), np.concatenate([self.doc[i], doc])
        top = np.lexsort((doc, -score))[:self.k]
        self.score[i], self.doc[i] = score[top], doc[top]


def evaluate(terms: np.ndarray, start: np.ndarray, doc: np.ndarray, impact: np.ndarray, most: np.ndarray,
             documents: int, k: int, least: int) -> np.ndarray:
    """Scores of the documents of a shard for one item, right for all that can be
    among the best k and not below ``least``; 0 for those without an accumulator.

    ``terms`` go from the rarest to the commonest; ``start`` cuts the postings
    (doc, impact) by term; ``most`` is the largest impact of every term."""
    score = np.zeros(documents, np.int64)
    rest = np.cumsum(most[terms][::-1])[::-1]
    made = None     # the accumulators, once no more are made
    for j, t in enumerate(terms):
        if made is None:
            kth = max(least, int(np.partition(score, -k)[-k])) if j and documents >= k else least
            if rest[j] < kth:
                made = score > 0
        d, x = doc[start[t]:start[t + 1]], impact[start[t]:start[t + 1]]
        if made is not None:
            on = made[d]
            d, x = d[on], x[on]
        score[d] += x
    return score


def _ranked(q: Queries, weight: np.ndarray, order: list[np.ndarray], documents: int, terms: int, k: int, limit: int):
    """(item, document, score): the best k of every item in this task."""
    def run(batches):
        table, best = _table(), _Best(len(q.items), k)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, s in _shards(b.column(1), q.vocabulary, table, limit):
                if not len(s.term):
                    continue
                start = np.searchsorted(s.term, np.arange(len(q.vocabulary) + 1))
                impact = _impacts(s, weight, documents, terms)
                most = np.zeros(len(q.vocabulary), np.int64)
                np.maximum.at(most, s.term, impact)
                for i, own in enumerate(order):
                    own = own[most[own] > 0]
                    least = best.least(i)
                    if not len(own) or most[own].sum() < least:
                        continue
                    score = evaluate(own, start, s.doc, impact, most, len(s.n), k, least)
                    d = np.flatnonzero(score >= least)
                    if len(d) > k:
                        d = d[score[d] >= np.partition(score[d], -k)[-k]]
                    if len(d):
                        best.add(i, score[d], ids[lo + d])
        n = [len(x) for x in best.doc]
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.items, n)), pa.array(flat(best.doc)), pa.array(flat(best.score))],
                                         ["item", "doc", "score"])
    return run


def _item_terms(batches):
    table = _table()
    for b in batches:
        for lo, hi, data, off in W.chunks(b.column(1), SHARD_BYTES):
            w = W.split_words(data, off, table)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + w.doc)), pa.array(w.hash.view(np.int64))], ["item", "term"])


def _blocks(terms: DataFrame) -> Iterator[Queries]:
    """Queries of bounded size from rows (item, term): items are numbered in ranges by
    their sizes, only one block at a time is in the driver."""
    sizes = staged(terms.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "items")
    lower = None
    while True:
        left = sizes if lower is None else sizes.where(F.col("item") > lower)
        head = left.orderBy("item").limit(BLOCK_ITEMS).toArrow()
        if not head.num_rows:
            break
        items, total = head["item"].to_numpy(), np.cumsum(head["n"].to_numpy())
        upper = int(items[max(0, int(np.searchsorted(total, BLOCK_TERMS, "right")) - 1)])
        part = terms.where(F.col("item") <= upper) if lower is None else terms.where((F.col("item") > lower) & (F.col("item") <= upper))
        rows = part.toArrow()
        item, term = rows["item"].to_numpy(), rows["term"].to_numpy().view(np.uint64)
        vocabulary, term = np.unique(term, return_inverse=True)
        by = np.lexsort((term, item))
        own, n = np.unique(item, return_counts=True)
        yield Queries(own, np.concatenate([[0], np.cumsum(n)]), term[by], vocabulary)
        lower = upper
    drop(sizes)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(``item_col``, rank, ``id_col``, score): the ``k`` highest-scoring documents of every item.

    Terms are maximal runs of digits, letters and everything outside ASCII, A-Z
    lower-cased.  With N documents that hold a term, L terms in all, n in the document,
    df documents that hold the term and tf its occurrences in the document, an item's
    score sums floor(1000 ln((2N+2)/(2df+1))) * (10^9 tf div (1000 tf + 8 m)) over its
    distinct terms, where m = 10 + (90 n N div L).  Equal scores go by ascending id;
    documents without a positive score are not listed, so an item may have fewer
    than k rows or none.

    Null and term-free texts are no documents and match nothing; rows that share an
    id are ranked each by itself; rows with a null id count in the statistics but
    cannot be listed.  Rows that share an item id are one item; a null item id is
    left out.  Ids are integers.  Other columns are ignored."""
    spark = docs.sparkSession
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    queries = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("bigint").alias("id"), F.col(item_text_col).alias("text"))
    terms = staged(queries.mapInArrow(_item_terms, "item bigint, term bigint").distinct(), "terms")
    parts = []
    for q in _blocks(terms):
        seen = (d.mapInArrow(_counted(q.vocabulary, shard_bytes), "term bigint, n bigint")
                .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
        n = dict(zip(seen["term"].to_pylist(), seen["n"].to_pylist()))
        total, length = n.pop(-1, 0), n.pop(-2, 0)
        df = np.zeros(len(q.vocabulary), np.int64)
        df[np.array(list(n), np.int64)] = list(n.values())
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        order = [own[np.argsort(df[own], kind="stable")] for own in np.split(q.term, q.first[1:-1])]
        found = d.where("id is not null").mapInArrow(_ranked(q, weight, order, total, length, k, shard_bytes),
                                                     "item bigint, doc bigint, score bigint")
        parts.append(staged(found, "ranked"))
    drop(terms)
    if not parts:
        return spark.createDataFrame([], f"{item_col} bigint, rank int, {id_col} bigint, score bigint")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return rows.withColumn("rank", best).where(F.col("rank") <= k).select(
        F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
