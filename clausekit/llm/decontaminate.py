"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Edit distance is over words (lower-cased, punctuation dropped; every character of
a script written without spaces is a word).  The CGK
random walk reads a window of words: at step j it emits the word under the
pointer and advances by a random bit that depends on (j, word).  Two windows a
few edits apart walk in step again after each edit, so their emitted sequences
differ in few places (Hamming distance); a bit sample keeps a few steps of one
walk as a key, and windows with equal keys are candidates.  Walks are repeated
until simulated copies at the largest accepted distance are found with the
target recall at every edit count of a class, on the shortest items that allow
it.  Every candidate is then verified by exact edit distance.

Windows have a length by class (4, 6, 12 or 24 words; an item belongs to the
longest class that fits it with one stride to spare).  Documents
are windowed at a stride of a third of the length; the items, the small side,
are windowed at every offset, so an unchanged occurrence always has a document
window that starts in step with an item window.  A walk of that window may still
run past the item's end, where the document goes on with other words; one more
key, a hash of all words of the window, is equal for unchanged copies whatever
follows, so these are found always.  Items of one to three words are
their own window and match by that key alone.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausekit.llm import words as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_EDITED_WORDS = 4    # shorter items match unchanged only
ITEM_BLOCK = 2000       # items whose keys one pass over the documents carries
BITS = 4                # steps of a walk that make one key
SAMPLES = 3             # keys from each walk
MAX_WALKS = 64
LONGEST_WINDOW = 24     # words; longer items have more windows instead
COPIES = 1000           # simulated copies for each edit count
BLOCK = 1 << 15         # windows walked at once

OUT = "doc_id bigint, item_id bigint, distance int, n_item_words int, start_word bigint, end_word bigint"


def _table() -> np.ndarray:
    keep = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B))
    return W.byte_table(separators=bytes(b for b in range(128) if b not in keep))


def _marks() -> str:
    """Character class of all punctuation, symbols and spaces beyond ASCII."""
    out, lo = [], None
    for c in range(0x80, 0x110000):
        mark = unicodedata.category(chr(c))[0] in "PSZ" or c < 0xA0 or c in (0x200B, 0x2060, 0xFEFF)
        if mark and lo is None:
            lo = c
        elif not mark and lo is not None:
            out.append(f"\\x{{{lo:X}}}-\\x{{{c - 1:X}}}")
            lo = None
    return "[" + "".join(out) + "]+"


#: Scripts written without spaces; 30FC and FF70 are the length mark of both kana.
UNSPACED = (r"[\p{Han}\p{Hiragana}\p{Katakana}\x{30FC}\x{FF70}\p{Bopomofo}\p{Yi}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
            r"\p{Tai_Le}\p{New_Tai_Lue}\p{Tai_Tham}\p{Balinese}\p{Javanese}]")
MARKS = _marks()


def spaced(column: pa.Array) -> pa.Array:
    """The texts with a space for every run of punctuation beyond ASCII and around
    every character of an unspaced script."""
    column = column.cast(pa.large_string())
    if pc.all(pc.string_is_ascii(column)).as_py() is not False:
        return column
    column = pc.replace_substring_regex(column, MARKS, " ")
    return pc.replace_substring_regex(column, f"({UNSPACED})", r" \1 ")


def word_hashes(column: pa.Array):
    for lo, hi, data, off in W.chunks(pc.utf8_lower(spaced(column))):
        yield lo, hi, W.split_words(data, off, _table())


def class_of(n: int) -> tuple[int, int]:
    """(window length, stride) for an item of n words."""
    best, w = (min(n, 4), 1), 6
    while n >= w + w // 3 - 1 and w <= LONGEST_WINDOW:
        best, w = (w, w // 3), w * 2
    return best


@dataclass
class Walk:
    length: int
    stride: int
    mult: np.ndarray           # one odd multiplier per step
    samples: list[np.ndarray]  # sorted steps of each key

    @classmethod
    def draw(cls, length: int, stride: int, number: int) -> Walk:
        rng = np.random.default_rng([length, number])
        steps = length + length // 2
        mult = rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return cls(length, stride, mult,
                   [np.sort(rng.choice(steps, BITS, replace=False)) for _ in range(SAMPLES)])

    def keys(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(sample, window) keys of the windows of ``h`` at ``starts``."""
        out = np.empty((SAMPLES, len(starts)), np.uint64)
        top = int(max(s[-1] for s in self.samples))
        base = np.uint64(0x9E3779B97F4A7C15)
        for lo in range(0, len(starts), BLOCK):
            p = starts[lo:lo + BLOCK].astype(np.int64)
            sym = np.empty(len(p), np.uint64)
            bit = np.empty(len(p), np.uint64)
            key = np.zeros((SAMPLES, len(p)), np.uint64)
            for j in range(top + 1):
                np.take(h, p, out=sym, mode="clip")
                for k, s in enumerate(self.samples):
                    if j in s:
                        key[k] *= base
                        key[k] += sym
                if j < top:
                    np.multiply(sym, self.mult[j], out=bit)
                    bit >>= np.uint64(63)
                    p += bit.view(np.int64)
            out[:, lo:lo + BLOCK] = key
        salt = W.mix64(np.array([self.mult[0]], np.uint64))[0]
        return W.mix64(out.ravel() ^ (salt + np.repeat(np.arange(SAMPLES, dtype=np.uint64), len(starts)))).reshape(out.shape)


@dataclass
class Whole:
    """The hash of all words of a window as its only key."""

    length: int
    stride: int

    def keys(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        p, inv = W._powers(len(h) + 1)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * p[:len(h)], out=sums[1:])
        key = (sums[starts + self.length] - sums[starts]) * inv[starts]
        return W.mix64(key + np.uint64(self.length))[None, :]


def _starts(first: np.ndarray, length: int, stride: int) -> np.ndarray:
    """Word positions of the windows of every text, each text from its first word."""
    n = np.maximum(0, (np.diff(first) - length) // stride + 1)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first[:-1], n) + k * stride


class Index:
    """Keys of one block of items, sorted, with a small bit filter in front: the
    whole windows, then the walks."""

    def __init__(self, ids, hashes, ratio: float, target: float, walks: int | None = None):
        self.ids, self.items, self.ratio = ids, hashes, ratio
        by_class: dict[tuple[int, int], list[int]] = {}
        for i, h in enumerate(hashes):
            if len(h):
                by_class.setdefault(class_of(len(h)), []).append(i)
        self.parts = []
        for cls in sorted(by_class):
            mine = by_class[cls]
            if cls[0] < MIN_EDITED_WORDS:
                need = dict.fromkeys(mine, 0)
            else:
                need = dict.fromkeys(mine, walks) if walks else self._calibrate(cls, mine, target)
            self.parts.append([self._part(Whole(*cls), {i: self.items[i] for i in mine})]
                              + [self._part(Walk.draw(*cls, k), {i: self.items[i] for i in mine if need[i] > k})
                                 for k in range(max(need.values()))])

    def allowed(self, i: int) -> int:
        n = len(self.items[i])
        return int(self.ratio * n) if n >= MIN_EDITED_WORDS else 0

    @staticmethod
    def _part(walk: Walk | Whole, mine: dict[int, np.ndarray]):
        pad = np.full(2 * walk.length, 1, np.uint64)
        flat, starts, item, off, at = [], [], [], [], 0
        for i, words in mine.items():
            m = max(1, len(words) - walk.length + 1)
            if isinstance(walk, Whole):
                m = min(m, walk.stride)     # an unchanged copy has a window at one of these
            starts.append(at + np.arange(m))
            item.append(np.full(m, i))
            off.append(np.arange(m))
            flat += [words, pad]
            at += len(words) + len(pad)
        keys = walk.keys(np.concatenate(flat), np.concatenate(starts))
        item, off = np.tile(np.concatenate(item), len(keys)), np.tile(np.concatenate(off), len(keys))
        keys = keys.ravel()
        order = np.argsort(keys, kind="stable")
        return walk, keys[order], item[order].astype(np.int32), off[order].astype(np.int32)

    @staticmethod
    def _filter(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
        """Bit filter over the top bits of the keys, made where it is used."""
        size = min(24, max(16, int(len(keys)).bit_length() + 5))
        shift = np.uint64(64 - size)
        bits = np.zeros(1 << size, bool)
        bits[(keys >> shift).astype(np.int64)] = True
        return bits, shift

    def _calibrate(self, cls, mine, target: float) -> dict[int, int]:
        """Walks that every item needs so that copies with the most accepted edits
        are found with probability ``target``, from simulated copies.  Of the items
        with one edit count the shortest are the hardest (densest edits, fewest
        windows), so for every edit count copies of its items, cut to the
        shortest length, have to reach the target by one standard error."""
        by_edits: dict[int, list[int]] = {}
        for i in mine:
            by_edits.setdefault(self.allowed(i), []).append(i)
        need, walks = target + (target * (1 - target) / COPIES) ** 0.5, {}
        for edits, group in sorted(by_edits.items()):
            size = min(len(self.items[i]) for i in group)
            rng = np.random.default_rng([7, *cls, edits])
            truth = np.array(group)[rng.integers(len(group), size=COPIES)]
            cut = {i: self.items[i][:size] for i in np.unique(truth).tolist()}
            docs, lo, hi = zip(*(self._copy(cut[i], edits, cls, rng) for i in truth.tolist()))
            first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
            h, lo, hi = np.concatenate(docs), first[:-1] + lo, first[:-1] + hi
            found = np.zeros(len(docs), bool)
            for r in range(MAX_WALKS + 1):
                walk = Walk.draw(*cls, r - 1) if r else Whole(*cls)
                doc, item, pos = self._probe(self._part(walk, cut), h, first)
                found[doc[(truth[doc] == item) & (lo[doc] <= pos) & (pos <= hi[doc])]] = True
                if found.mean() >= need:
                    break
            else:
                raise ValueError(f"target_recall {target} is out of reach: {MAX_WALKS} walks find {found.mean():.3f} of the copies "
                                 f"of {size} words with {edits} edits; ask for less recall or a smaller max_ratio")
            walks |= dict.fromkeys(group, r)
        return walks

    @staticmethod
    def _copy(words, edits: int, cls, rng):
        """(an item after random edits, between unrelated words; the first and the
        last word position from which ``verify`` still sees all of it)."""
        w = list(words)
        for place, kind, new in zip(rng.random(edits), rng.integers(3, size=edits), rng.integers(1, 1 << 62, edits, dtype=np.uint64)):
            at = int(place * len(w))
            if kind == 0:
                w[at] = new
            elif kind == 1:
                w.insert(at, new)
            elif len(w) > 1:
                del w[at]
        lead = rng.integers(1, 1 << 62, int(rng.integers(cls[1])), dtype=np.uint64)
        tail = rng.integers(1, 1 << 62, 2 * cls[0], dtype=np.uint64)
        slack = edits + 1
        return (np.concatenate([lead, np.array(w, np.uint64), tail]),
                len(lead) + len(w) - len(words) - slack, len(lead) + slack)

    @staticmethod
    def _probe(part, h, first):
        """(text, item, word position where the item would start)."""
        walk, keys, item, off = part
        starts = _starts(first, walk.length, walk.stride)
        if not len(starts):
            z = np.zeros(0, np.int64)
            return z, z, z
        bits, shift = Index._filter(keys)
        pos, which = [], []
        for row in walk.keys(h, starts):
            hit = np.flatnonzero(bits[(row >> shift).astype(np.int64)])
            lo, hi = np.searchsorted(keys, row[hit], "left"), np.searchsorted(keys, row[hit], "right")
            n = hi - lo
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos.append(np.repeat(starts[hit], n))
            which.append(np.repeat(lo, n) + k)
        pos, which = np.concatenate(pos), np.concatenate(which)
        doc = np.searchsorted(first, pos, "right") - 1
        return doc, item[which], pos - off[which]

    def matches(self, w: W.Words):
        """(text, item, distance, first word, last word + 1), the best of each pair."""
        found = [self._probe(p, w.hash, w.first) for parts in self.parts for p in parts]
        if not found or not sum(len(f[0]) for f in found):
            return []
        doc, item, pos = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((pos, doc, item))
        doc, item, pos = doc[order], item[order], pos[order]
        new = np.ones(len(doc), bool)
        same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])
        size = np.array([len(q) for q in self.items])
        # a window of a short item is all of it: its first place is its best
        new[1:] = ~same | ((pos[1:] != pos[:-1]) & (size[item[1:]] >= MIN_EDITED_WORDS))
        doc, item, pos = doc[new], item[new], pos[new]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        edges = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            i = int(item[a])
            q, t = self.items[i], self.allowed(i)
            for lo in range(a, b, 2048):
                d, p = doc[lo:min(b, lo + 2048)], pos[lo:min(b, lo + 2048)]
                for row in verify(q, t, w.hash, w.first[d], w.first[d + 1], p):
                    key, value = (int(d[row[0]]), i), row[1:]
                    if key not in best or value < best[key]:
                        best[key] = value
        return [(k[0], k[1], *v) for k, v in sorted(best.items())]


def distances(q: np.ndarray, text: np.ndarray, free_start: bool) -> np.ndarray:
    """Edit distance of ``q`` to the best piece of each row of ``text`` that ends
    before column j (from any start, or from column 0); column j = 0 .. width."""
    rows, width = text.shape
    n = len(q)
    idx = np.arange(n + 1, dtype=np.int32)
    d = np.broadcast_to(idx, (rows, n + 1)).copy()
    out = np.empty((rows, width + 1), np.int32)
    out[:, 0] = n
    for j in range(width):
        cost = (text[:, j, None] != q[None, :]).astype(np.int32)
        e = d + 1
        np.minimum(e[:, 1:], d[:, :-1] + cost, out=e[:, 1:])
        e[:, 0] = 0 if free_start else j + 1
        d = np.minimum.accumulate(e - idx, axis=1) + idx   # insertions along q
        out[:, j + 1] = d[:, n]
    return out


def verify(q, t, h, lo, hi, pos):
    """(candidate, distance, first, end) for candidates within ``t`` edits;
    positions are relative to the text's first word."""
    n, width = len(q), len(q) + 2 * t + 2
    col = (pos - t - 1)[:, None] + np.arange(width)[None, :]
    inside = (col >= lo[:, None]) & (col < hi[:, None])
    text = np.where(inside, h[np.clip(col, 0, len(h) - 1)], np.uint64(0))
    dist = distances(q, text, True)
    low = dist.min(axis=1)
    ok = np.flatnonzero(low <= t)
    if not len(ok):
        return []
    text, low, lo, pos = text[ok], low[ok], lo[ok], pos[ok]
    end = (dist[ok] == low[:, None]).argmax(axis=1)
    back = np.zeros_like(text)
    for r, e in enumerate(end):
        back[r, :e] = text[r, :e][::-1]
    size = (distances(q[::-1], back, False) == low[:, None]).argmax(axis=1)
    first = pos - t - 1 + end - size - lo
    return list(zip(ok.tolist(), low.tolist(), first.tolist(), (first + size).tolist()))


def _scan(index: Index):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, _, w in word_hashes(b.column(1)):
                hits = index.matches(w)
                if hits:
                    d, i, dist, s, e = zip(*hits)
                    i = np.array(i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo + np.array(d)].astype(np.int64)), pa.array(index.ids[i]),
                         pa.array(np.array(dist, np.int32)),
                         pa.array(np.array([len(index.items[k]) for k in i], np.int32)),
                         pa.array(np.array(s, np.int64)), pa.array(np.array(e, np.int64))],
                        ["doc_id", "item_id", "distance", "n_item_words", "start_word", "end_word"])
    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", max_ratio: float = 0.15,
                 target_recall: float = 0.99, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, distance, n_item_words, start_word, end_word): every
    (document, item) where a piece of the document is within ``max_ratio`` times
    the item's words in word edits, with its nearest piece (ties: the first).

    ``items`` is the query set: it is taken in blocks of about ``item_block``
    items, one pass over the documents each, so memory is bounded however many
    there are.  Unchanged occurrences are always found; copies at the largest
    distance with probability ``target_recall`` whatever the item's length (a
    target out of reach of ``MAX_WALKS`` walks is an error).  Items of one to three
    words match unchanged only; null or empty texts and rows with
    a null id match nothing.  Repeated rows of an id give one row per item, its nearest."""
    d = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    q = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("bigint").alias("id"), F.col(item_text_col).alias("text")).distinct()
    n_blocks = max(1, -(-q.count() // item_block))
    spark = docs.sparkSession
    out = spark.createDataFrame([], OUT)
    for k in range(n_blocks):
        rows = q.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == k).orderBy("id", "text").collect()
        hashes = [None] * len(rows)
        for lo, hi, w in word_hashes(pa.array([r["text"] for r in rows], pa.large_string())):
            for i in range(lo, hi):
                hashes[i] = w.hash[w.first[i - lo]:w.first[i - lo + 1]].copy()
        index = Index(np.array([r["id"] for r in rows], np.int64), hashes, max_ratio, target_recall)
        if index.parts:
            out = out.unionByName(d.mapInArrow(_scan(index), OUT))
    near = F.min(F.struct("distance", "start_word", "end_word", "n_item_words")).alias("m")
    return (out.groupBy("doc_id", "item_id").agg(near)
            .select("doc_id", "item_id", "m.distance", "m.n_item_words", "m.start_word", "m.end_word"))
