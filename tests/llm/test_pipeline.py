"""The whole pipeline against plain Python on the small tables."""

import hashlib
import math
import re

import pyarrow as pa

import corpus_pipeline
from clausekit.llm import quality_crf, stages
from clausekit.llm.mixing import POWERS, ROUNDS
from clausekit.llm.secrets import ASSIGN, HEX
from conftest import SF001
from test_brute_force import nearest, shingles

IDENT = r"(?i:username|user|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@+/_.-]+)"


def masked(t):
    """Strong spans, united where they overlap; the fixture has no weak links that count."""
    got = [(m.start(), m.end()) for m in re.finditer(ASSIGN, t) if len(m[2]) >= 8]
    ids = [(m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    got += ids + [(m.start(), m.end()) for m in re.finditer(HEX, t)]
    strong = list(got)
    over = lambda a, b: a[0] < b[1] and b[0] < a[1]
    near = lambda a, b: b[0] <= a[1] + 200 and a[0] <= b[1] + 200
    free = lambda s: not any(over(s, x) for x in strong)
    named = [m.span() for m in re.finditer(IDENT, t) if len(m[1]) >= 3]
    weak = [m.span() for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t)
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and free(m.span())]
    ends = [m.span() for m in re.finditer(r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?::[0-9]{1,5})?", t)
            if free(m.span())]
    known = [s for s in named if free(s)]
    secret = [s for s in weak + [x for x in strong if x not in ids] if not any(over(s, x) for x in named)]
    holders = known + ids
    got += [s for s in weak if s in secret and any(near(s, x) for x in holders)]
    got += [s for s in known if any(near(s, x) for x in secret)]
    got += [s for s in ends if any(near(s, x) for x in holders) and any(near(s, x) for x in secret)]
    out, at = "", 0
    for a, b in sorted(got):
        if a >= at:
            out += t[at:a] + "[SECRET]"
        at = max(at, b)
    return out + t[at:]


def draw(i):
    return int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality_crf.train(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    ids = sorted(rows)
    score = dict(zip(ids, model.scores(pa.array([rows[i].text for i in ids], pa.large_string()))))
    kept = [i for i in ids if score[i] >= 0.3]
    assert 0 < len(kept) < len(ids)
    sets = {i: shingles(rows[i].text) for i in kept}
    comp = {i: i for i in kept}
    for a in kept:
        for b in kept:
            if b < a and (n := len(sets[a] & sets[b])) and 100 * n >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    kept = [i for i in kept if comp[i] == i]
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    words = {i: re.findall(r"[^\W_]+", rows[i].text.lower()) for i in kept}
    clean = []
    for i in kept:
        have = set(words[i])
        close = [q for q in items if len(q) >= 4 and sum(w in have for w in q) >= 0.8 * len(q)]
        if not any(nearest(q, words[i]) <= int(0.15 * len(q)) for q in close):
            clean.append(i)
    text = {i: masked(rows[i].text) for i in clean}
    size = {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", text[i]) if w]) for i in clean}

    def topic(i):
        if 10 * text[i].count("|") >= size[i]:
            return "tabular"
        return "brief" if size[i] < 100 else "article" if size[i] < 1000 else "long"

    cell = {i: (rows[i].source, rows[i].lang, topic(i)) for i in clean if size[i]}
    tokens = {}
    for i, c in cell.items():
        tokens[c] = tokens.get(c, 0) + size[i]
    total = sum(tokens.values())
    target = []
    for k, dim in enumerate(("source", "lang", "topic")):
        t = {}
        for c, n in tokens.items():
            t[c[k]] = t.get(c[k], 0) + n
        p = {x: n ** POWERS[dim] for x, n in t.items()}
        target.append({x: v / sum(p.values()) for x, v in p.items()})
    w = {c: float(n) for c, n in tokens.items()}
    for _ in range(ROUNDS):
        for k in range(3):
            s = {}
            for c, v in w.items():
                s[c[k]] = s.get(c[k], 0) + v
            w = {c: v * target[k][c[k]] / s[c[k]] for c, v in w.items()}
    want = {}
    for i, c in cell.items():
        rate = round(w[c] * 0.5 * total / tokens[c], 6)
        n = math.floor(rate) + (draw(i) < rate - math.floor(rate))
        if n:
            want[i] = (text[i], len(text[i]), n)
    got = {r.doc_id: (r.text, r.n_chars, r.n_copies) for r in corpus_pipeline.run(spark, SF001).collect()}
    assert got == want


def test_stage_contract():
    assert len(corpus_pipeline.STAGES) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)


def test_near_duplicates_keeps_other_texts_of_an_id(spark):
    """An id with two unrelated texts keeps both; equal rows, near copies and copies
    under another id go; rows without an id stay."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(f"{p}{x}" for x in words) for p in "abc")
    near = a + " more"
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (3, near, "x"), (1, a, "y"), (4, b, "x"), (5, None, "x"), (5, "", "x"), (None, a, "x"), (None, a, "x")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, "extra") for i, t, s in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string")
    got = stages.near_duplicates(spark, docs, None)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, (r.text or "")[:2], r.source) for r in got.collect())) == sorted(
        [(1, "aw", "x"), (1, "bw", "x"), (2, "cw", "x"), (5, "", "x"), (0, "aw", "x"), (0, "aw", "x")])
