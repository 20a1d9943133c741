"""Toxicity: averaged subword embeddings under a linear softmax.

A word is its character n-grams (3 to 5 UTF-8 bytes, with word boundaries) and
itself, hashed into rows of an embedding table; a window of words is the mean of
the rows, and a linear softmax over two classes reads it.  Table and softmax are
trained jointly in numpy, so a misspelling that no training text holds still
shares most of its vectors with the word it comes from.

A text is toxic if one passage is, so it is read in half-overlapping windows (of
words that differ) over its whole length and scored by its strongest window.  Only documents are
labelled: in every epoch each toxic text trains on its strongest windows so far
(at first also on others, so that no pattern is settled on too early), each clean
one on its strongest (the likeliest mistakes) and some others.  A
logistic scale fitted on documents left out of that training maps the strongest
window's margin to a probability.

After training the softmax folds into the table: a window's margin is the mean of
one number per n-gram, so scoring is one lookup per n-gram.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from clausekit.llm import words as W
from clausekit.llm.arrow import with_scores
from clausekit.llm.quality_crf import labelled_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PER_CLASS = 2500
BUCKET_BITS, DIM = 18, 8
SIZES = (3, 4, 5)
HALF = 8                 # a window is two halves of this many words, repeated ones counted once
FLOOR = 2 * HALF * 12    # n-grams that a window counts as at least
ODDS = 1.0               # weight of all toxic texts against all clean ones in the scale
SUPPORT = 3              # toxic texts that an n-gram must occur in
EPOCHS, EXPLORE, BATCH, RATE = 12, 8, 2048, 0.05
POSITIVE, NEGATIVE = 4, 12  # windows of a text that train in an epoch
_P = 0x9E3779B97F4A7C15 | 1


def _table() -> np.ndarray:
    keep = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | {0x24, 0x40, 0x2A, 0x27}
    return W.byte_table(separators=bytes(b for b in range(128) if b not in keep))


def _spaced(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space before each and one at the end; start of each."""
    size = w.end - w.start
    at = np.cumsum(size + 1) - size
    out = np.full(int(size.sum() + len(size) + 1), 0x20, np.uint8)
    src = np.repeat(w.start - at, size) + (np.arange(size.sum()) + np.repeat(np.arange(len(size)), size) + 1)
    out[np.repeat(at, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))] = w.data[src]
    return out, at


def _gram_positions(b: np.ndarray, n: int):
    """(position, bucket) of the n-byte grams that do not run over a word's end."""
    m = len(b) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = np.zeros(m, bool)
    for j in range(1, n - 1):
        inner |= b[j:j + m] == 0x20
    at = np.flatnonzero(~inner & ~((b[:m] == 0x20) & (b[n - 1:] == 0x20)))
    code = W._code()
    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h = h * np.uint64(_P) + code[b[at + j]]
    return at, (W.mix64(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _windows(first: np.ndarray):
    """Blocks of HALF words: (first word, text) and, per block, whether the next
    block belongs to the same text."""
    n = -(-np.diff(first) // HALF)
    text = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(first[:-1], n) + k * HALF
    more = np.zeros(len(text), bool)
    more[:-1] = text[1:] == text[:-1]
    return start, text, more


def _fresh(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a word is the first of its kind in its half of a window."""
    start, _, _ = _windows(first)
    block = np.searchsorted(start, np.arange(len(h)), "right")
    fresh = np.ones(len(h), bool)
    for j in range(1, HALF):
        fresh[j:] &= (h[j:] != h[:-j]) | (block[j:] != block[:-j])
    return fresh


def _margins(value: np.ndarray, count: np.ndarray, first: np.ndarray):
    """Mean value of every window: (margin, block, text); the last half of a text
    of several halves is covered by the window before it.  A window counts as
    FLOOR n-grams at least: a few words alone are weak evidence."""
    start, text, more = _windows(first)
    if not len(start):
        return np.zeros(0), start, text
    v, c = np.add.reduceat(value, start), np.add.reduceat(count, start)
    v[:-1] += np.where(more[:-1], v[1:], 0)
    c[:-1] += np.where(more[:-1], c[1:], 0)
    prior = np.zeros(len(text), bool)
    prior[1:] = text[1:] == text[:-1]
    keep = more | ~prior
    return (v / np.maximum(c, FLOOR))[keep], start[keep], text[keep]


class SubwordSoftmax:
    def __init__(self):
        self.gram = np.zeros(1 << BUCKET_BITS, np.float32)  # margin of every n-gram
        self.bias, self.scale, self.shift = 0.0, 1.0, 0.0

    # ---- training --------------------------------------------------------
    def fit(self, texts: list[str], labels: list[int]):
        y = np.asarray(labels)
        if not len(y) or y.min() == y.max():
            self.scale, self.shift = 0.0, -4.0 if not len(y) or not y.max() else 4.0
            return self
        hashes, first, grams = [], [0], {}
        at_word = 0
        for _, _, data, off in W.chunks(pc.utf8_lower(pa.array(texts, pa.large_string())), 1 << 19):
            w = W.split_words(data, off, _table())
            u, where = np.unique(w.hash, return_index=True)
            new = np.array([i for i, h in zip(where, u) if int(h) not in grams], np.int64)
            new.sort()
            if len(new):
                part = W.Words(w.hash[new], w.start[new], w.end[new], np.array([0, len(new)]), w.data, w.offsets)
                b, at = _spaced(part)
                pos, bucket = zip(*(_gram_positions(b, n) for n in SIZES))
                owner = np.searchsorted(at - 1, np.concatenate(pos), "right") - 1
                bucket = np.concatenate([*bucket, self._word_bucket(part.hash)])
                owner = np.concatenate([owner, np.arange(len(new))])
                order = np.argsort(owner, kind="stable")
                for h, g in zip(part.hash, np.split(bucket[order], np.cumsum(np.bincount(owner, minlength=len(new)))[:-1])):
                    grams[int(h)] = g
            hashes.append(w.hash)
            first += (w.first[1:] + at_word).tolist()
            at_word += len(w.hash)
        first = np.array(first)
        words = np.concatenate(hashes)
        fresh = _fresh(words, first)
        vocab, ids = np.unique(words, return_inverse=True)
        ids = ids.astype(np.int32)
        lists = [grams[int(h)] for h in vocab]
        size = np.array([len(g) for g in lists])
        flat, begin = np.concatenate(lists).astype(np.int32), np.cumsum(size) - size
        del words, hashes, vocab, lists, grams
        known = self._shared_grams(ids, first, y == 1, flat, begin, size)
        rng = np.random.default_rng(2)
        fold = rng.permutation(len(y)) % 5 == 0            # left out for the scale
        emb = np.zeros((1 << BUCKET_BITS, DIM), np.float32)   # an n-gram never seen says nothing
        soft, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        soft[:, 1], soft[:, 0] = rng.normal(0, .3, DIM), rng.normal(0, .3, DIM)
        state = [[np.zeros_like(p), np.zeros(1)] for p in (emb, soft, bias)]
        step = 0

        def word_margin():
            g = emb @ (soft[:, 1] - soft[:, 0])
            return np.add.reduceat(g[flat], begin)[ids] * fresh, size[ids].astype(np.float64) * fresh

        for epoch in range(EPOCHS):
            v, c = word_margin()
            margin, start, text = _margins(v.astype(np.float64), c, first)
            noise = rng.random(len(margin))
            strong = margin + (1e3 * noise if epoch == 0 else 0)
            order = np.lexsort((-strong, text))
            rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
            toxic = y[text[order]] == 1
            other = np.lexsort((noise, text))
            some = np.where(y[text[other]] == 0, NEGATIVE // 2, POSITIVE if epoch < EXPLORE else 0)
            pick = np.concatenate([order[toxic & (rank < POSITIVE)], order[~toxic & (rank < NEGATIVE // 2)],
                                   other[rank < some]])
            pick = rng.permutation(pick[~fold[text[pick]]])
            share = np.bincount(y[text[pick]], minlength=2) / max(1, len(pick))
            weight = 0.5 / np.maximum(share, 1e-3)          # both classes weigh alike
            for lo in range(0, len(pick), BATCH):
                p = pick[lo:lo + BATCH]
                a = start[p]
                z = np.minimum(a + 2 * HALF, first[text[p] + 1])
                at = np.repeat(a - np.cumsum(z - a) + (z - a), z - a) + np.arange((z - a).sum())
                owner = np.repeat(np.arange(len(p)), z - a)[fresh[at]]
                word = ids[at[fresh[at]]]
                gs = size[word]
                g = flat[np.repeat(begin[word] - np.cumsum(gs) + gs, gs) + np.arange(gs.sum())]
                owner = np.repeat(owner, gs)
                cut = np.searchsorted(owner, np.arange(len(p)))
                n = np.maximum(np.bincount(owner, minlength=len(p)), FLOOR)[:, None]
                x = np.add.reduceat(emb[g], cut, axis=0) / n
                logit = x @ soft + bias
                prob = np.exp(logit - logit.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                prob[np.arange(len(p)), y[text[p]]] -= 1
                prob *= weight[y[text[p]], None] / len(p)
                dx = (prob @ soft.T) / n
                ge = np.stack([np.bincount(g, dx[owner, k], minlength=len(emb)) for k in range(DIM)], 1)
                ge[~known] = 0
                step += 1
                for param, grad, (m, s) in zip((emb, soft, bias), (ge, x.T @ prob, prob.sum(0)), state):
                    m *= .9
                    m += .1 * grad
                    # one scale for a whole parameter: an n-gram of one text moves less than
                    # one that many texts share, so texts are not learnt by heart
                    s *= .99
                    s += .01 * float((grad * grad).sum() / max(1, np.count_nonzero(grad)))
                    param -= RATE * (m / (1 - .9 ** step)) / (np.sqrt(s / (1 - .99 ** step)) + 1e-12)
        self.gram = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])
        v, c = word_margin()
        margin, _, text = _margins(v.astype(np.float64), c, first)
        top = np.full(len(y), -30.0)
        np.maximum.at(top, text, margin)
        held = fold & (np.diff(first) > 0)
        self._calibrate(top[held] + self.bias, y[held])
        return self

    @staticmethod
    def _shared_grams(ids, first, toxic, flat, begin, size) -> np.ndarray:
        """Whether an n-gram occurs in SUPPORT toxic texts at least: what marks one text
        alone is no pattern, and stays without a say."""
        found = np.zeros(1 << BUCKET_BITS, np.int32)
        for t in np.flatnonzero(toxic):     # text by text: what is held is one text's n-grams
            word = np.unique(ids[first[t]:first[t + 1]])
            n = size[word]
            found[flat[np.repeat(begin[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]] += 1
        return found >= min(SUPPORT, max(1, int(toxic.sum()) // 20))

    def _calibrate(self, x: np.ndarray, y: np.ndarray):
        """Logistic scale by Newton steps with a small ridge; a step that does not lower
        the loss is halved (far margins make the curvature vanish).  Toxic texts count
        as much as ODDS for each clean one: they are rare, and missing one costs more."""
        f, ridge, w = np.stack([x, np.ones_like(x)], 1), 1e-2, np.array([1.0, 0.0])
        counts = np.bincount(y, minlength=2)
        each = np.where(y == 1, ODDS * counts[0] / max(1, counts[1]), 1.0)

        def loss(w):
            z = f @ w
            return float(np.sum(each * (np.logaddexp(0, z) - y * z)) + ridge / 2 * np.sum((w - [1, 0]) ** 2))

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            grad = f.T @ (each * (p - y)) + ridge * (w - [1, 0])
            step = np.linalg.solve(f.T @ (f * (each * p * (1 - p))[:, None]) + ridge * np.eye(2), grad)
            size, now = 1.0, loss(w)
            while size > 1e-6 and loss(w - size * step) > now:
                size /= 2
            w = w - size * step
            if size * np.abs(step).max() < 1e-6:
                break
        self.scale, self.shift = float(max(w[0], 1e-3)), float(w[1])

    @staticmethod
    def _word_bucket(h: np.ndarray) -> np.ndarray:
        return (W.mix64(h ^ np.uint64(0xA5A5A5A5)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    # ---- scoring ---------------------------------------------------------
    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for lo, hi, data, off in W.chunks(pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))):
            w = W.split_words(data, off, _table())
            if not len(w.hash):
                continue
            b, at = _spaced(w)
            value, count = np.zeros(len(b)), np.zeros(len(b), np.int32)
            for n in SIZES:
                pos, bucket = _gram_positions(b, n)
                value[pos] += self.gram[bucket]
                count[pos] += 1
            v = np.add.reduceat(value, at - 1) + self.gram[self._word_bucket(w.hash)]
            c = np.add.reduceat(count, at - 1) + 1
            fresh = _fresh(w.hash, w.first)
            margin, _, text = _margins(v * fresh, c * fresh.astype(np.float64), w.first)
            top = np.full(hi - lo, -np.inf)
            np.maximum.at(top, text, margin)
            x = np.clip(self.scale * (top + self.bias) + self.shift, -40, 40)
            out[lo:hi] = np.where(np.isfinite(top), 1 / (1 + np.exp(-x)), 0.0)
        return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> SubwordSoftmax:
    """The model fitted on at most ``per_class`` labelled documents of either
    class outside the held-out fold (whole texts, gathered at the driver, where
    numpy trains).  Without both labels it scores every text alike."""
    rows = labelled_sample(docs, labels, "toxic", 3, 1, per_class).where("text is not null").collect()
    rows.sort(key=lambda r: (r["label"], r["text"]))
    texts, marks = [r["text"] for r in rows], [r["label"] for r in rows]
    del rows
    return SubwordSoftmax().fit(texts, marks)


def toxicity_scores(docs: DataFrame, model: SubwordSoftmax, text_col: str = "text",
                    out_col: str = "toxicity") -> DataFrame:
    """``docs`` with the toxicity of every whole text, 0 to 1; null, empty and
    word-free texts get 0.  All other columns and repeated rows stay."""
    return with_scores(docs, text_col, out_col, lambda: model.scores)
