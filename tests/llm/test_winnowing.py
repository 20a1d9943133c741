"""Fingerprints against a plain Python version, the guarantee, and edge rows."""

import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from clausekit.llm.queries import QUERIES
from clausekit.llm.winnowing import POSITION, UNSPACED, compare_neighbours, fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
LETTERS = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), UNSPACED)
WORD = re.compile(f"[{LETTERS}]|[^\x20\x09-\x0d{LETTERS}]+")


def run_hash(words):
    """Spark's xxhash64 of an array of the words' xxhash64, upper 33 bits."""
    h = 42
    for x in words:
        h = xxhash.xxh64(struct.pack("<Q", xxhash.xxh64(x.encode(), 42).intdigest()), h).intdigest()
    h -= (h >> 63) << 64
    return h >> 31


def entries(text, k=5, w=8):
    words = WORD.findall(text.lower())
    if not words:
        return []
    runs = [run_hash(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    out = set()
    for i in range(max(1, len(runs) - w + 1)):
        low = min(runs[i:i + w])
        out.add(max(j for j in range(i, min(i + w, len(runs))) if runs[j] == low))
    return [(runs[j], j) for j in sorted(out)]


def near(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """rows (id, text), already in the order asked for."""
    out, found = [], [entries(t) for _, t in rows]
    for i, (key, text) in enumerate(rows):
        j = (i + 1) % len(rows)
        half = len(text) // 2
        edited = text[:len(text) - half] + rows[j][1][:half]
        e = entries(edited)
        as_text = lambda x: ",".join(f"{h}:{p}" for h, p in x)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(found[i]), as_text(e),
                    near(found[i], e), near(found[i], found[j])))
    return out


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = QUERIES["op11_document_fingerprints"](spark, SF)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_edge_rows(spark):
    """Null and empty texts, whole repeated rows, repeated ids, null ids, one long
    text, unspaced scripts, a clashing extra column."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, long), (6, "間" * 40 + " 三つ"), (7, "A b  c\u00e9 d e f g h i j k l m"),
            (8, "same text here"), (8, "same text here"), (8, "same text here"), (9, "x" * 200_000), (10, "\U0001F600 " * 30)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, n_chars string")
    got = compare_neighbours(docs)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(brute([(i, t or "") for i, t in rows]))
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "x"), (1, "y")], "doc_id bigint, text string")
    out = compare_neighbours(odd).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "None", "None"]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    one = compare_neighbours(spark.createDataFrame([(5, "only one")], "doc_id int, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"onlyonly").hexdigest()
    assert compare_neighbours(docs.limit(0)).collect() == []


def test_ties_take_the_rightmost(spark):
    """All runs are equal: each window keeps its last."""
    df = spark.createDataFrame([(" ".join(["la"] * 20),)], "t string").select(fingerprint(F.col("t")).alias("e"))
    assert [v & POSITION for v in df.first().e] == list(range(7, 16))


@pytest.mark.parametrize("shared", [12, 13, 40])
def test_guarantee(spark, shared):
    """w + k - 1 = 12 words in common: an entry in common, at the place of the words."""
    common = [f"c{i}" for i in range(shared)]
    rows = [(i, " ".join([f"a{i}_{j}" for j in range(i)] + common + [f"b{i}_{j}" for j in range(3 * i)])) for i in range(25)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", fingerprint(F.col("t")).alias("e")).collect()
    inside = [{(v >> 31, (v & POSITION) - r.i) for v in r.e if 0 <= (v & POSITION) - r.i <= shared - 5} for r in got]
    assert set.intersection(*inside)
