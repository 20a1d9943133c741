"""Token alignment against a plain Python version of its definition."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausekit.llm import alignment as A
from clausekit.llm.alignment import align_tokens, shared_cuts

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Plain:
    """Whole texts through both tokenizers, bytes read from their own files."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(f"{A.TOKENIZERS}/{A.FILE_A}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{A.TOKENIZERS}/{A.FILE_B}")
        spec = json.load(open(f"{A.TOKENIZERS}/{A.FILE_A}"))
        self.a_bytes = A.byte_level(spec["model"]["vocab"])

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, self.b.id_to_piece(i)) for i in b)]
        bytes_a = [self.a_bytes[i] for i in a]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return []
        ends = [set(np.cumsum([len(x) for x in s]).tolist()) for s in (bytes_a, bytes_b)]
        shared, out = sorted(ends[0] & ends[1]), []
        for s, ids in ((bytes_a, a), (bytes_b, b)):
            at, place = [], np.cumsum([len(x) for x in s]).tolist()
            k = 0
            for cut in shared:
                n = k
                while n < len(ids) and place[n] <= cut:
                    n += 1
                at.append(ids[k:n])
                k = n
            out.append(at)
        return list(zip(*out))


def brute(rows):
    plain = Plain()
    found = [(i, plain.groups(t)) for i, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    count = Counter(p for c in links for p in c)
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, g), c in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [8 << 20, 30_000])
def test_against_brute_force(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(align_tokens(docs.repartition(3), block_bytes=block)) == want


ODD = ["", None, " ", "  ", "\n", "a", " a", "a ", "two  spaces", "tab\tand\r\nlines \n x", " x   y 　z", "x  y",
       "literal ▁ mark and more", "<s> </s> <unk> <|endoftext|> [0x41] <0x41>", "日本語の文章。 空白 と", "\U0001F600\U0001F601 \U0001F469‍\U0001F467",
       "é ́x", "it's 's 'll we'LL", "a" * 5000, " " * 300, "=" * 700 + " " + "-" * 33, "\x00 nul \x7f \x1c\x1f x", "été à l’été", "ab " * 3000]


def test_edge_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "a"), (None, "a b"), (77, "it's repeated"), (78, "it's repeated")]
    df = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id int, text string, n_a double")
    assert got(align_tokens(df, block_bytes=500)) == brute(rows)
    assert got(align_tokens(df.limit(0))) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans(), st.integers(1, 9))))
def test_cuts_are_the_common_ends(steps):
    at, a, b = 0, [], []
    for in_a, in_b, n in steps:
        at += n
        a += [at] * in_a
        b += [at] * in_b
    found = shared_cuts(np.array(a, np.int64), np.array(b, np.int64))
    assert found.tolist() == sorted(set(a) & set(b))


@pytest.fixture(scope="module")
def tokenizers():
    return A.Tokenizers(*(open(f"{A.TOKENIZERS}/{f}", "rb").read() for f in (A.FILE_A, A.FILE_B)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sé。  　 ́\n\t1-.,日\U0001F600\x1c\x85"), max_size=25), max_size=5))
def test_units_are_tokenized_as_their_text(tokenizers, texts):
    """Tokens of the units, one after the other, are those of the whole text."""
    texts = [t for t in texts if t]
    data = "".join(" " + t for t in texts)
    text = np.frombuffer(data.encode(), np.uint8)
    first = np.cumsum([0] + [len((" " + t).encode()) for t in texts])
    if not texts:
        return
    start, joins = A._unit_starts(text, first[:-1])
    end = np.append(start[1:], len(text))
    u = A._tokenized(tokenizers, text, start, end - start, joins & (text[end - 1] != 0x20))
    cut = np.searchsorted(start, first)
    for i, t in enumerate(texts):
        if u.whole[cut[i]:cut[i + 1]].all():
            assert u.a[u.first_a[cut[i]]:u.first_a[cut[i + 1]]].tolist() == tokenizers.encode_a([" " + t])[0].tolist()
            assert u.b[u.first_b[cut[i]]:u.first_b[cut[i + 1]]].tolist() == tokenizers.encode_b([" " + t])[0].tolist()


def test_wide_groups_count_equal_ids_once():
    u = A.Units(np.array([1] * 90 + [2] * 10), np.array([0, 100]), np.array([7] * 50 + [8] * 50), np.array([0, 100]), None)
    g = A.Groups(np.array([0, 1]), np.array([0, 100]), np.array([0, 100]))
    unit, pair, times = A._links(u, g)
    assert dict(zip(pair.tolist(), times.tolist())) == {1 << 32 | 7: 4500, 1 << 32 | 8: 4500, 2 << 32 | 7: 500, 2 << 32 | 8: 500}
