"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is good or bad.  Its features are binned counts of its own
bytes and words and those of the lines before and after it; neighbouring labels
are tied by a 2 x 2 transition.  The field is trained in numpy on a bounded
sample of labelled documents (each line takes its document's label), and a
document's score is the mean of the lines' forward-backward marginals of
"good", weighted by the lines' lengths in characters.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausekit.llm import words as W
from clausekit.llm.arrow import with_scores

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PER_CLASS = 3000        # labelled documents of either class used for training
EPOCHS, BATCH, RATE, L2 = 12, 256, 0.05, 1e-4

#: Byte classes counted in a line.
LOWER, UPPER, DIGIT, SPACE, BANG, SYMBOL, PIPE, STOP, PUNCT, CONT, LEAD, N_CLASS = range(12)
#: Bin edges of the line features, in the order of ``_line_features``.
EDGES = [np.array(e) for e in (
    [.05, .2, .5, .8],              # upper-case share of letters
    [.002, .02, .1, .3],            # symbols of #*$%&<> for each character
    [.002, .02, .1],                # vertical bars for each character
    [.002, .02, .1],                # exclamation marks for each character
    [.01, .05, .2, .5],             # digits for each character
    [.2, .4, .6, .8, .95],          # distinct words for each word
    [.02, .1, .3, .7],              # words equal to the one before
    [2.5, 3.5, 4.5, 5.5, 7, 10],    # characters for each word
    [1.5, 3.5, 8.5, 16.5, 40.5, 120.5],  # words
    [.005, .02, .05, .1, .2],       # full stops for each character
    [.5],                           # ends like a sentence
    [.5],                           # equal to an earlier line of the text
)]
WIDTH = [len(e) + 1 for e in EDGES]
#: One block of weights for the line itself, one each for the line before and
#: after; the last bin of every neighbour feature stands for "no such line".
OWN = np.concatenate([[0], np.cumsum(WIDTH)])
N_WEIGHTS = 3 * int(OWN[-1]) + 2


def _classes() -> np.ndarray:
    t = np.full(256, PUNCT, np.uint8)
    t[97:123], t[65:91], t[48:58] = LOWER, UPPER, DIGIT
    t[[9, 10, 11, 12, 13, 32]] = SPACE
    t[ord("!")], t[ord("|")] = BANG, PIPE
    t[[ord(c) for c in "#*$%&<>"]] = SYMBOL
    t[[ord(c) for c in ".?"]] = STOP
    t[128:192], t[192:] = CONT, LEAD
    return t


def _line_features(data: np.ndarray, off: np.ndarray):
    """(bins: lines x features, characters, first line of every text)."""
    nl = np.flatnonzero(data == 10) + 1
    start = np.unique(np.concatenate([off[:-1], nl]))
    start = start[start < len(data)]
    n = len(start)
    size = np.diff(np.append(start, len(data)))
    cls = _classes()[data]
    c3 = np.flatnonzero(data[:-1] == 0xC3)      # upper-case Latin letters of two bytes
    cls[c3[(data[c3 + 1] >= 0x80) & (data[c3 + 1] <= 0x9E)]] = UPPER
    line = np.repeat(np.arange(n), size)
    count = np.bincount(line * N_CLASS + cls, minlength=n * N_CLASS).reshape(n, N_CLASS).astype(np.float64)
    chars = count.sum(1) - count[:, CONT] - (data[start + size - 1] == 10)
    w = W.split_words(data, off, W.byte_table(lower=False))
    own = np.searchsorted(start, w.start, "right") - 1
    nw = np.bincount(own, minlength=n).astype(np.float64)
    key = np.sort((own.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    again = np.zeros(len(own), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (own[1:] == own[:-1])
    repeats = np.bincount(own[again], minlength=n)
    at = np.arange(len(own)) - np.searchsorted(own, own)
    sums = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(W.mix64(w.hash + at.astype(np.uint64)), out=sums[1:])
    cut = np.searchsorted(own, np.arange(n + 1))
    text = np.searchsorted(off, start, "right") - 1
    same = W.mix64((sums[cut[1:]] - sums[cut[:-1]]) ^ W.mix64(text.astype(np.uint64)))
    order = np.argsort(same, kind="stable")
    copy = np.zeros(n, bool)
    copy[order[1:]] = (same[order[1:]] == same[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    last = np.zeros(n, np.uint8)
    has = nw > 0
    last[has] = data[w.end[cut[1:][has] - 1] - 1]
    c, words = np.maximum(chars, 1), np.maximum(nw, 1)
    values = (count[:, UPPER] / np.maximum(count[:, UPPER] + count[:, LOWER] + count[:, LEAD], 1),
              count[:, SYMBOL] / c, count[:, PIPE] / c, count[:, BANG] / c, count[:, DIGIT] / c,
              distinct / words, repeats / words, (c - count[:, SPACE]) / words, nw, count[:, STOP] / c,
              np.isin(last, np.frombuffer(b".!?:\"')", np.uint8)).astype(float), copy.astype(float))
    bins = np.stack([np.searchsorted(e, v, "right") for e, v in zip(EDGES, values)], 1).astype(np.uint8)
    keep = nw > 0                                  # lines without words carry no label
    return bins[keep], chars[keep], np.searchsorted(text[keep], np.arange(len(off)))


def _index(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weight indices of every line: own, before, after."""
    n, block = len(bins), int(OWN[-1])
    own = bins.astype(np.int64) + OWN[:-1]
    before, after = np.empty_like(own), np.empty_like(own)
    before[1:], after[:-1] = own[:-1] + block, own[1:] + 2 * block
    before[first[:-1][np.diff(first) > 0]] = 3 * block
    after[first[1:][np.diff(first) > 0] - 1] = 3 * block + 1
    return np.concatenate([own, before, after], 1) if n else np.zeros((0, 3 * own.shape[1]), np.int64)


def _marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(good) of every line, and the expected transitions if ``pairs``.  All
    texts advance together, longest first; two states, in probabilities scaled
    at every step."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, at = n[order], first[:-1][order]
    emit = np.stack([1 / (1 + np.exp(np.clip(score, -30, 30))), 1 / (1 + np.exp(-np.clip(score, -30, 30)))], 1)
    t = np.exp(trans)
    top = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(top), "left")   # texts longer than step j
    fwd, bwd = np.empty_like(emit), np.empty_like(emit)
    a = emit[at[:active[0]]] if top else emit
    for j in range(top):
        k = active[j]
        a = (a[:k] @ t) * emit[at[:k] + j] if j else a
        a = a / a.sum(1, keepdims=True)
        fwd[at[:k] + j] = a
    b = np.ones((len(n), 2))
    for j in range(top - 1, -1, -1):
        k = active[j]
        nxt = active[j + 1] if j + 1 < top else 0
        if nxt:
            m = (emit[at[:nxt] + j + 1] * b[:nxt]) @ t.T
            b[:nxt] = m / m.sum(1, keepdims=True)
        bwd[at[:k] + j] = b[:k]
    post = fwd * bwd
    post /= post.sum(1, keepdims=True)
    if not pairs:
        return post[:, 1], None
    inner = np.ones(len(score), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    i = np.flatnonzero(inner)
    joint = fwd[i][:, :, None] * t[None] * (emit[i + 1] * bwd[i + 1])[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return post[:, 1], joint.sum(0)


class LineCRF:
    def __init__(self):
        self.weights = np.zeros(N_WEIGHTS)
        self.trans = np.zeros((2, 2))
        self.prior = 0.5

    def fit(self, bins, first, labels):
        """Conditional likelihood of the line labels, by Adam over mini-batches."""
        labels = np.asarray(labels)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        rng = np.random.default_rng(6)
        params = np.concatenate([self.weights, self.trans.ravel()])
        m, v, step = np.zeros_like(params), np.zeros_like(params), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), BATCH):
                docs = order[lo:lo + BATCH]
                n = np.diff(first)[docs]
                f = np.concatenate([[0], np.cumsum(n)])
                if not f[-1]:
                    continue
                lines = np.repeat(first[:-1][docs] - f[:-1], n) + np.arange(f[-1])
                idx = _index(bins[lines], f)
                y = np.repeat(labels[docs], n)
                trans = params[N_WEIGHTS:].reshape(2, 2)
                p, joint = _marginals(params[idx].sum(1), f, trans, True)
                g = np.bincount(idx.ravel(), np.repeat(p - y, idx.shape[1]), minlength=N_WEIGHTS)
                seen = np.zeros((2, 2))
                for c in (0, 1):
                    seen[c, c] = (n[(labels[docs] == c) & (n > 0)] - 1).sum()
                g = np.concatenate([g, (joint - seen).ravel()]) / len(docs) + L2 * params
                step += 1
                m, v = .9 * m + .1 * g, .999 * v + .001 * g * g
                params = params - RATE * (m / (1 - .9 ** step)) / (np.sqrt(v / (1 - .999 ** step)) + 1e-8)
        self.weights, self.trans = params[:N_WEIGHTS], params[N_WEIGHTS:].reshape(2, 2)
        return self

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for lo, hi, data, off in W.chunks(column):
            if not len(data):
                out[lo:hi] = self.prior
                continue
            bins, chars, first = _line_features(data, off)
            p, _ = _marginals(self.weights[_index(bins, first)].sum(1), first, self.trans)
            own = np.repeat(np.arange(hi - lo), np.diff(first))
            weight = np.bincount(own, chars, minlength=hi - lo)
            good = np.bincount(own, chars * p, minlength=hi - lo)
            out[lo:hi] = np.where(weight > 0, good / np.maximum(weight, 1e-9), self.prior)
        return np.clip(out, 0, 1)


def _training_rows(batches):
    for b in batches:
        for lo, hi, data, off in W.chunks(b.column(0)):
            bins, _, first = _line_features(data, off) if len(data) else (np.zeros((0, len(EDGES)), np.uint8), 0,
                                                                         np.zeros(hi - lo + 1, int))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bins[first[i]:first[i + 1]].tobytes() for i in range(hi - lo)], pa.binary()),
                 b.column(1).slice(lo, hi - lo)], ["bins", "label"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held: int,
                    per_class: int) -> DataFrame:
    """(text, label): at most ``per_class`` documents of either label, in hash
    order of their ids, none with crc32(doc_id) mod ``modulus`` = ``held``."""
    rows = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
            .where("doc_id is not null and label in (0, 1)")
            .where(F.crc32(F.col("doc_id").cast("string")) % modulus != held)
            .groupBy("doc_id").agg(F.max("label").alias("label")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = None
    for c in (0, 1):
        part = rows.where(F.col("label") == c).orderBy(*order).limit(per_class)
        pick = part if pick is None else pick.unionByName(part)
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return text.join(F.broadcast(pick), "doc_id").select("text", "label")   # at most 2 * per_class rows


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> LineCRF:
    """The field fitted on at most ``per_class`` labelled documents of either
    class outside the held-out fold; only their binned features (12 bytes a
    line) come to the driver.  No labels: a field without preference."""
    sample = labelled_sample(docs, labels, "quality", 5, 0, per_class)
    rows = sample.mapInArrow(_training_rows, "bins binary, label int").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["bins"])))
    bins = [np.frombuffer(r["bins"], np.uint8).reshape(-1, len(EDGES)) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bins])]).astype(np.int64)
    flat = np.concatenate(bins) if bins else np.zeros((0, len(EDGES)), np.uint8)
    return LineCRF().fit(flat, first, [r["label"] for r in rows])


def quality_scores(docs: DataFrame, model: LineCRF, text_col: str = "text",
                   out_col: str = "quality_score") -> DataFrame:
    """``docs`` with the quality score of every whole text, 0 to 1.  Null, empty
    and word-free texts get the share of good documents in the training sample
    (0.5 without one).  All other columns and repeated rows stay as they are."""
    return with_scores(docs, text_col, out_col, lambda: model.scores)
