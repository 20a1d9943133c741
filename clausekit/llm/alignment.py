"""Alignment of the tokens of two tokenizers, and how often token pairs are linked.

Both token sequences of a text cover the same bytes.  Byte offsets where tokens of
both end cut the text into groups, found by divide and conquer: the common end
nearest to the middle of an interval is located by bisection, both halves are
searched the same way, and an interval without one is a leaf group.

A text is first cut where both tokenizers must cut: before a space that follows
another character than a space and precedes one that is no white space (neither
vocabulary has a token across it).  Such units repeat, so each block of documents
tokenizes and aligns its distinct units once; documents are put together from them.

The count of an id pair (documents that hold it linked) is summed from one row for
each pair and block.  Each block's pairs then meet the counts and come back to the
block, never to single documents, and a block is bounded by its bytes of text.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausekit.llm import words as W
from clausekit.llm.stage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20       # text of the documents that share a table of units
CALL_BYTES = 1 << 16        # text given to a tokenizer at once, and hashed at once
CALLS = 3                   # such texts in one call
LISTED = 1 << 20           # pairs of documents that are told apart at once
WIDE = 4096                 # links of a group that are listed one by one
SPACE = 0x20
_READY = W._Cache()


# ------------------------------------------------------------------ tokenizers

def byte_level(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of every token of a byte-level vocabulary: its 256 letters stand for the
    printable bytes themselves and, from U+0100 on, for the others in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
    return out


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:-1], 16)]) if is_byte else piece.replace("▁", " ").encode()


def _solid(byte):
    """Whether a character that begins with ``byte`` is surely no white space: white
    space outside ASCII begins with one of four bytes."""
    return (byte > SPACE) & (byte < 0x7F) | (byte >= 0x80) & ~np.isin(byte, (0xC2, 0xE1, 0xE2, 0xE3))


def _crosses(token: bytes) -> bool:
    return any(x == SPACE != before and (not after or _solid(after[0]))
               for i, (before, x) in enumerate(zip(token, token[1:])) for after in [token[i + 2:]])


class Vocabulary:
    """Token bytes by id, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        # whether no token goes on over a place where units are cut
        self.separable = not any(_crosses(t) for t in tokens)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.start[ids], self.size[ids])]


class Tokenizers:
    """The two tokenizers, made once in every worker from the bytes of their files."""

    def __init__(self, file_a: bytes, file_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self._a = Tokenizer.from_str(file_a.decode())
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        spec = json.loads(file_a)
        vocabulary = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = range(self._b.get_piece_size())
        self.a = Vocabulary(byte_level(vocabulary))
        self.b = Vocabulary([piece_bytes(self._b.id_to_piece(i), self._b.is_byte(i)) for i in n])
        self.separable = self.a.separable and self.b.separable

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self._a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self._b.encode([t[1:] for t in texts], num_threads=1)]


def _tokenizers(files: tuple[bytes, bytes]) -> Tokenizers:
    if "t" not in _READY or _READY["of"] != files:
        _READY["t"], _READY["of"] = Tokenizers(*files), files
    return _READY["t"]


# ------------------------------------------------------------------ arrays

def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i] + 1, ... of all runs, one after the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)


def ends_of(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in every run first[i]:first[i + 1]."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def shared_cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Offsets in both of two rising arrays of token ends, by divide and conquer.

    All open intervals of ``a`` take a step at once: each tries the end next nearest to
    its middle and looks for it in ``b`` by bisection.  A common end divides its
    interval, and what has been tried is in neither half; an interval with nothing
    left to try is a leaf.  Every end is tried once."""
    found, after = np.zeros(len(a), bool), np.append(b, -1)
    lo, hi = np.zeros(1, np.int64), np.full(1, len(a), np.int64)
    left = right = (lo + hi) // 2       # left:right have been tried
    while True:
        some = (left > lo) | (right < hi)
        lo, hi, left, right = lo[some], hi[some], left[some], right[some]
        if not len(lo):
            return a[found]
        middle = (lo + hi) // 2
        down = (left > lo) & ((right >= hi) | (right - middle > middle - left))
        at = np.where(down, left - 1, right)
        place = np.searchsorted(b, a[at])
        hit = after[place] == a[at]
        found[at[hit]] = True
        left, right = np.where(down, at, left), np.where(down, right, at + 1)
        miss = ~hit
        # halves: from lo to what has been tried, and from there to hi
        new_lo, new_hi = np.concatenate([lo[hit], right[hit]]), np.concatenate([left[hit], hi[hit]])
        lo, hi = np.concatenate([lo[miss], new_lo]), np.concatenate([hi[miss], new_hi])
        centre = (new_lo + new_hi) // 2
        left, right = np.concatenate([left[miss], centre]), np.concatenate([right[miss], centre])


# ------------------------------------------------------------------ units

def _unit_starts(text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the units of texts laid end to end, each beginning with a space;
    whether a unit may follow any other that does not end with a space)."""
    after = np.empty_like(text)
    after[:-1], after[-1:] = text[1:], SPACE
    solid = _solid(after)
    before = np.empty_like(text)
    before[1:], before[:1] = text[:-1], SPACE
    cut = (text == SPACE) & solid & (before != SPACE)
    cut[first] = True
    start = np.flatnonzero(cut)
    return start, solid[start]


def _hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the units, a bounded run of bytes at a time."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CALL_BYTES * 4, "right")))
        lo, hi = start[i], end[j - 1]
        p, inverse = W._powers(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(W._code()[text[lo:hi]] * p[:hi - lo], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = W.mix64((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


@dataclass
class Units:
    """Tokens of units; those of unit u are a[first_a[u]:first_a[u + 1]], and so for b.
    A unit whose tokens do not give its bytes back has none and is not ``whole``."""

    a: np.ndarray
    first_a: np.ndarray
    b: np.ndarray
    first_b: np.ndarray
    whole: np.ndarray


def _tokenized(t: Tokenizers, text: np.ndarray, start: np.ndarray, size: np.ndarray, joins: np.ndarray) -> Units:
    """Units that may follow each other are given to the tokenizers in runs."""
    queue, run = [], []
    room = CALL_BYTES
    by_join = np.argsort(~joins, kind="stable")
    for u, n, j in zip(by_join.tolist(), size[by_join].tolist(), joins[by_join].tolist()):
        if run and (not j or n > room):
            queue.append(run)
            run, room = [], CALL_BYTES
        run.append(u)
        room -= n
    queue += [run] if run else []
    order, sizes, ids, whole = [], ([], []), ([], []), np.ones(len(start), bool)
    while queue:
        call, queue = queue[:CALLS], queue[CALLS:]
        runs = [np.array(r, np.int64) for r in call]
        data = [text[ragged(start[r], size[r])] for r in runs]
        strings = [d.tobytes().decode() for d in data]
        again = []
        for r, d, a, b in zip(runs, data, t.encode_a(strings), t.encode_b(strings)):
            same = all(v.size[x].sum() == len(d) and np.array_equal(v.joined(x), d) for v, x in ((t.a, a), (t.b, b)))
            if not same and len(r) > 1:
                again += [[u] for u in r.tolist()]
                continue
            order.append(r)
            cut = np.concatenate([[0], np.cumsum(size[r])])
            for k, (v, x) in enumerate(((t.a, a), (t.b, b))):
                if not same:
                    whole[r] = False
                    x = x[:0]
                # tokens end where units end
                sizes[k].append(np.diff(np.searchsorted(np.cumsum(v.size[x]), cut, "right")) if same else np.zeros(1, np.int64))
                ids[k].append(x)
        queue = again + queue
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    place = np.empty(len(start), np.int64)
    place[flat(order)] = np.arange(len(start))
    out = []
    for k in (0, 1):
        n, x = flat(sizes[k]), flat(ids[k])
        own = n[place]
        out += [x[ragged((np.cumsum(n) - n)[place], own)], np.concatenate([[0], np.cumsum(own)])]
    return Units(*out, whole)


@dataclass
class Groups:
    """Groups of all units in order; group g has the tokens a[first_a[g]:first_a[g + 1]]
    and b[first_b[g]:first_b[g + 1]], unit u the groups first[u]:first[u + 1]."""

    first: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray


def _grouped(t: Tokenizers, u: Units) -> Groups:
    ends_a, ends_b = np.cumsum(t.a.size[u.a]), np.cumsum(t.b.size[u.b])
    cuts = shared_cuts(ends_a, ends_b)
    unit_end = np.concatenate([[0], ends_a])[u.first_a]
    edge = lambda ends: np.concatenate([[0], np.searchsorted(ends, cuts, "right")])
    return Groups(np.searchsorted(cuts, unit_end, "right"), edge(ends_a), edge(ends_b))


def _links(u: Units, g: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, pair, times) of all links; pair = A id << 32 | B id.  In wide groups
    equal ids are counted before they are paired."""
    na, nb = np.diff(g.first_a), np.diff(g.first_b)
    unit = np.repeat(np.arange(len(g.first) - 1), np.diff(g.first))
    n = na * nb
    few = np.flatnonzero(n <= WIDE)
    m = n[few]
    k = ragged(np.zeros(len(few), np.int64), m)
    width = np.repeat(nb[few], m)
    pair = u.a[np.repeat(g.first_a[few], m) + k // width] << 32 | u.b[np.repeat(g.first_b[few], m) + k % width]
    out = [(np.repeat(unit[few], m), pair, np.ones(len(pair), np.int64))]
    for i in np.flatnonzero(n > WIDE):
        a, ca = np.unique(u.a[g.first_a[i]:g.first_a[i + 1]], return_counts=True)
        b, cb = np.unique(u.b[g.first_b[i]:g.first_b[i + 1]], return_counts=True)
        out.append((np.full(len(a) * len(b), unit[i]), (a[:, None] << 32 | b).ravel(), (ca[:, None] * cb).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out))


def _written(u: Units, g: Groups) -> list[bytes]:
    """The groups of every unit as text: ids comma-joined, the sides of a group divided
    by a bar, groups by semicolons."""
    na, nb = np.diff(g.first_a), np.diff(g.first_b)
    of_a, of_b = (np.repeat(np.arange(len(na)), x) for x in (na, nb))
    # an A token stands after all B tokens of earlier groups, a B token after the A tokens of its own
    token, mark = np.empty(len(u.a) + len(u.b), np.int64), np.full(len(u.a) + len(u.b), ord(","), np.uint8)
    at_a, at_b = np.arange(len(u.a)) + g.first_b[of_a], np.arange(len(u.b)) + g.first_a[of_b + 1]
    token[at_a], token[at_b] = u.a, u.b
    mark[g.first_a[1:] - 1 + g.first_b[:-1]] = ord("|")
    mark[g.first_b[1:] - 1 + g.first_a[1:]] = ord(";")
    names = [str(i).encode() for i in range(int(token.max(initial=0)) + 1)]
    v = Vocabulary([x + b"," for x in names])
    size = v.size[token]
    text, end = v.joined(token), np.cumsum(size)
    text[end - 1] = mark
    edge = np.concatenate([[0], end])[u.first_a + u.first_b]
    text = text.tobytes()
    return [text[x:y - 1] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]


# ------------------------------------------------------------------ blocks

def _packed(**columns) -> bytes:
    batch = pa.record_batch([pa.array(v) for v in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    t = pa.ipc.open_stream(data).read_all()
    return {c: t[c].to_numpy() for c in t.column_names}


def _block(t: Tokenizers, ids: pa.Array, data: np.ndarray, off: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """(columns of the payload row, pairs, documents that hold each)."""
    docs = np.flatnonzero(np.diff(off))     # empty texts have no tokens
    text = np.frombuffer(b"".join(b" " + data[x:y].tobytes() for x, y in zip(off[docs], off[docs + 1])), np.uint8)
    first = np.concatenate([off[docs] + np.arange(len(docs)), [len(text)]])
    start, joins = _unit_starts(text, first[:-1]) if len(docs) else (np.zeros(0, np.int64), np.zeros(0, bool))
    if not t.separable:
        start, joins = first[:-1], np.zeros(len(docs), bool)
    end = np.concatenate([start[1:], [len(text)]]) if len(start) else start
    joins = joins & (text[end - 1] != SPACE)
    key = _hashes(text, start, end)
    _, one, unit = np.unique(key, return_index=True, return_inverse=True)
    u = _tokenized(t, text, start[one], (end - start)[one], joins[one])
    g = _grouped(t, u)
    edge = np.searchsorted(start, first)
    owner = np.repeat(np.arange(len(docs)), np.diff(edge))
    whole = np.ones(len(docs), bool)
    whole[owner[~u.whole[unit]]] = False

    linked, pair, _ = _links(u, g)
    links = np.diff(g.first_a) * np.diff(g.first_b)
    per_unit = {"n_a": np.diff(u.first_a), "n_b": np.diff(u.first_b), "n_groups": np.diff(g.first), "n_links": ends_of(g.first, links)}
    digest = np.full(len(off) - 1, "", object)
    written = _written(u, g)
    for i in np.flatnonzero(whole).tolist():
        digest[docs[i]] = hashlib.sha256(b";".join([written[x] for x in unit[edge[i]:edge[i + 1]].tolist()])).hexdigest()
    columns = {"sha": digest.tolist()}
    for name, v in per_unit.items():
        full = np.zeros(len(off) - 1, np.int64)
        full[docs] = np.where(whole, ends_of(edge, v[unit]), 0)
        columns[name] = full
    # every document's distinct units, with their number
    held = owner[whole[owner]] * max(1, len(one)) + unit[whole[owner]]
    held, times = np.unique(held, return_counts=True)
    who, what = held // max(1, len(one)), held % max(1, len(one))
    n_held = np.zeros(len(off) - 1, np.int64)
    n_held[docs] = np.bincount(who, minlength=len(docs))
    # documents by pair
    pairs, which = np.unique(pair, return_inverse=True)
    by = np.argsort(linked, kind="stable")
    linked, which = linked[by], which[by]
    of = np.searchsorted(linked, np.arange(len(one) + 1))
    size = np.diff(of)[what]
    counts, step = np.zeros(len(pairs), np.int64), max(1, len(what) // (1 + int(size.sum()) // LISTED))
    cuts = np.unique(np.concatenate([np.searchsorted(who, who[np.arange(0, len(who), step)]), [len(who)]]))
    for x, y in zip(cuts[:-1], cuts[1:]):
        both = np.repeat(who[x:y], size[x:y]) * len(pairs) + which[ragged(of[what[x:y]], size[x:y])]
        counts += np.bincount(np.unique(both) % len(pairs), minlength=len(pairs))
    seen = counts > 0
    delta = np.diff(what, prepend=0).astype(np.int32)
    payload = {
        "ids": _packed(id=ids, **columns, n_held=n_held),
        "held": _packed(unit=delta, times=times.astype(np.int32)),
        "tokens_a": _packed(x=u.a.astype(np.int32)), "tokens_b": _packed(x=u.b.astype(np.int32)),
        "sizes": _packed(a=np.diff(u.first_a).astype(np.int32), b=np.diff(u.first_b).astype(np.int32))}
    return payload, pairs[seen], counts[seen]


STAGED = "block string, pair bigint, n bigint, ids binary, held binary, tokens_a binary, tokens_b binary, sizes binary"
PAYLOAD = ("ids", "held", "tokens_a", "tokens_b", "sizes")
RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _blocks(files: tuple[bytes, bytes], limit: int):
    def run(batches):
        t, part, seq = _tokenizers(files), TaskContext.get().partitionId(), 0
        schema = pa.schema([("block", pa.string()), ("pair", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in PAYLOAD]])
        for b in batches:
            for lo, hi, data, off in W.chunks(b.column(1), limit):
                payload, pairs, counts = _block(t, b.column(0).slice(lo, hi - lo), data, off)
                name, n = f"{part}-{seq}", len(pairs)
                seq += 1
                empty = [pa.nulls(n, pa.binary())] * len(PAYLOAD)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(pairs, pa.int64()), pa.array(counts, pa.int64()), *empty], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                                                  *[pa.array([payload[c]], pa.binary()) for c in PAYLOAD]], schema=schema)
    return run


def _finished(files: tuple[bytes, bytes]):
    """From a block's payload and the counts of its pairs to a row for every document."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = _tokenizers(files)
        pair, count, best = (right[c].to_numpy() for c in ("pair", "n", "best"))
        by = np.argsort(pair)
        pair, count, best = pair[by], count[by], best[by].astype(np.int64)
        out = []
        for row in left.select(list(PAYLOAD)).to_pylist():
            ids, held, sizes = (_unpacked(row[c]) for c in ("ids", "held", "sizes"))
            edge = lambda n: np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            u = Units(_unpacked(row["tokens_a"])["x"].astype(np.int64), edge(sizes["a"]),
                      _unpacked(row["tokens_b"])["x"].astype(np.int64), edge(sizes["b"]), None)
            unit, links, times = _links(u, _grouped(t, u))
            # pairs that only documents without tokens hold are not counted
            at = np.minimum(np.searchsorted(pair, links), max(0, len(pair) - 1))
            known = pair[at] == links if len(pair) else np.zeros(len(links), bool)
            unit, at, times = unit[known], at[known], times[known]
            sums = np.zeros((2, len(sizes["a"])), np.int64)
            np.add.at(sums[0], unit, best[at] * times)
            np.add.at(sums[1], unit, count[at] * times)
            what, first = np.cumsum(held["unit"], dtype=np.int64), edge(ids["n_held"])
            cols = [pa.array(ids[c], pa.int64()) for c in RESULT[:4]]
            cols += [pa.array(ends_of(first, s[what] * held["times"]), pa.int64()) for s in sums]
            table = pa.ipc.open_stream(row["ids"]).read_all()
            out.append(pa.table([table["id"].cast(pa.int64()), *cols, table["sha"].cast(pa.string())], names=["id", *RESULT, "sha"]))
        return pa.concat_tables(out)
    return run


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every
    row: tokens of space+text by the byte-level tokenizer A and of the text by the piece
    tokenizer B (which adds the space), their groups, the A-B token pairs within groups
    (links), links whose count is the highest of their A id, and the sum of the links'
    counts.  The count of an id pair is the number of rows that hold it linked.

    Null and empty texts, and texts that the tokens of either do not give back byte for
    byte (a literal U+2581), have zeros and an empty digest.  Repeated rows and ids each
    get a row and each count; null ids stay null; an empty table gives an empty one.
    Ids are integers.  Other columns are ignored.  ``tokenizers`` is a folder that the
    driver reads; its files travel with the tasks."""
    files = tuple(open(os.path.join(tokenizers, f), "rb").read() for f in (FILE_A, FILE_B))
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = staged(d.mapInArrow(_blocks(files, block_bytes), STAGED), "aligned")
    pairs = rows.where("pair is not null").select("block", "pair", "n")
    # an A id has at most as many pairs as B has ids
    counts = (pairs.groupBy("pair").agg(F.sum("n").alias("n"))
              .withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))))
    met = pairs.select(F.col("block").alias("place"), "pair").join(counts, "pair")
    schema = ", ".join(["id bigint", *(f"{c} bigint" for c in RESULT), "sha string"])
    out = (rows.where("ids is not null").select("block", *PAYLOAD).groupBy("block").cogroup(met.groupBy("place"))
           .applyInArrow(_finished(files), schema))
    return out.select(F.col("id").alias(id_col), *RESULT, F.col("sha").alias("groups_sha256"))
