"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
t AS (SELECT doc_id, unnest(sh) AS sh FROM s),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
         WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
e AS MATERIALIZED (SELECT x, y FROM link UNION SELECT y, x FROM link),
r(x, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x WHERE r.c < e.y)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY ALL
"""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE["op3_quality_rules"] = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i,
         unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS g FROM w WHERE len(ws) >= 3),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT)
      - CAST(len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT)
      AS n_dup_lines,
    CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (
  SELECT lang, source, unnest(['word_length', 'symbols', 'repeats', 'dup_lines']) AS rule,
    unnest([100 * word_chars // n_words, 1000 * n_symbols // n_words, 1000 * n_repeat_words // n_words,
            1000 * n_dup_lines // n_words]) AS v
  FROM b WHERE NOT base_failed),
s AS (SELECT lang, source, rule, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) AS value, count(*) AS n
      FROM v GROUP BY ALL),
q1 AS (SELECT lang, source, rule, value, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY value) AS u,
              sum(n) OVER (PARTITION BY lang, source, rule) AS a FROM s),
own AS (SELECT lang, source, rule, max(a) AS n, min(value) FILTER (4 * u >= a) AS q25, min(value) FILTER (4 * u >= 3 * a) AS q75
        FROM q1 GROUP BY ALL),
s2 AS (SELECT lang, rule, value, sum(n) AS n FROM s GROUP BY ALL),
q2 AS (SELECT lang, rule, value, sum(n) OVER (PARTITION BY lang, rule ORDER BY value) AS u,
              sum(n) OVER (PARTITION BY lang, rule) AS a FROM s2),
by_lang AS (SELECT lang, rule, max(a) AS n, min(value) FILTER (4 * u >= a) AS q25, min(value) FILTER (4 * u >= 3 * a) AS q75
            FROM q2 GROUP BY ALL),
s3 AS (SELECT rule, value, sum(n) AS n FROM s GROUP BY ALL),
q3 AS (SELECT rule, value, sum(n) OVER (PARTITION BY rule ORDER BY value) AS u, sum(n) OVER (PARTITION BY rule) AS a FROM s3),
every AS (SELECT rule, min(value) FILTER (4 * u >= a) AS q25, min(value) FILTER (4 * u >= 3 * a) AS q75 FROM q3 GROUP BY ALL),
f AS (
  SELECT own.lang, own.source, own.rule,
    CASE WHEN own.n >= 100 THEN own.q25 WHEN l.n >= 100 THEN l.q25 ELSE e.q25 END AS lo,
    CASE WHEN own.n >= 100 THEN own.q75 WHEN l.n >= 100 THEN l.q75 ELSE e.q75 END AS hi
  FROM own JOIN by_lang l ON l.lang IS NOT DISTINCT FROM own.lang AND l.rule = own.rule JOIN every e ON e.rule = own.rule),
x AS (
  SELECT b.*, f.rule, CASE f.rule
      WHEN 'word_length' THEN 100 * word_chars // n_words < lo - 4 * (hi - lo) - 100 OR 100 * word_chars // n_words > hi + 4 * (hi - lo) + 100
      WHEN 'symbols' THEN 1000 * n_symbols // n_words > hi + 4 * (hi - lo) + 100
      WHEN 'repeats' THEN 1000 * n_repeat_words // n_words > hi + 4 * (hi - lo) + 100
      ELSE 1000 * n_dup_lines // n_words > hi + 4 * (hi - lo) + 20 END AS bad
  FROM b LEFT JOIN f ON NOT base_failed AND f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT bool_or(coalesce(bad, FALSE)) AS kept,
  coalesce(string_agg(rule, ',' ORDER BY CASE rule WHEN 'word_length' THEN 0 WHEN 'symbols' THEN 1 WHEN 'repeats' THEN 2 ELSE 3 END)
           FILTER (bad), '') AS failed_rules
FROM x GROUP BY doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
"""


def _spans(kind: str, order: int, pattern: str, value: int, keep: str) -> str:
    """Spans of one pattern: an end is the length of all pieces and matches so far."""
    p = pattern.replace("'", "''")
    return (f"SELECT doc_id, '{kind}' AS k, {order} AS o, e - length(m) AS s, e FROM (SELECT *, CAST(sum(length(c) + length(m)) "
            f"OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, "
            f"unnest(ms) AS m, unnest(vs) AS v, unnest(cs[1:len(ms)]) AS c FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS ms, "
            f"regexp_extract_all(t, '{p}', {value}) AS vs, regexp_split_to_array(t, '{p}') AS cs FROM d))) WHERE {keep}")


_KEY = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])")
_NAME = ("([Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee]|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]"
         "|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]_?[Ii][Dd])")
_STRONG = " UNION ALL ".join([
    _spans("assign", 0, _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length(v) >= 8"),
    _spans("access", 1, "AKIA[A-Z0-9]+", 0, "length(m) >= 16"),
    _spans("hex", 2, "[0-9a-f]+", 0, "length(m) >= 32")])
_PARTS = " UNION ALL ".join([
    _spans("identifier", 3, _NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 2, "length(v) >= 3"),
    _spans("weak", 4, "[A-Za-z0-9+/_=-]{20,}", 0, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"),
    _spans("endpoint", 5, r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?::[0-9]{1,5})?", 0, "true")])
_NEAR = "i.doc_id = wk.doc_id AND i.s <= wk.e + 200 AND wk.s <= i.e + 200"

ORACLE["op4_secret_scan"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
st AS MATERIALIZED ({_STRONG}),
pa AS MATERIALIZED ({_PARTS}),
wk AS MATERIALIZED (SELECT * FROM pa WHERE NOT EXISTS (
  SELECT 1 FROM st WHERE st.doc_id = pa.doc_id AND st.s < pa.e AND pa.s < st.e)),
ids AS MATERIALIZED (SELECT * FROM wk WHERE k = 'identifier' UNION ALL SELECT * FROM st WHERE k = 'access'),
sec AS MATERIALIZED (SELECT * FROM (SELECT * FROM wk WHERE k = 'weak' UNION ALL SELECT * FROM st WHERE k IN ('assign', 'hex')) q
  WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.doc_id = q.doc_id AND pa.k = 'identifier' AND pa.s < q.e AND q.s < pa.e)),
ex AS (
  SELECT * FROM sec wk WHERE k = 'weak' AND EXISTS (SELECT 1 FROM ids i WHERE {_NEAR})
  UNION ALL SELECT * FROM wk WHERE k = 'identifier' AND EXISTS (SELECT 1 FROM sec i WHERE {_NEAR})
  UNION ALL SELECT * FROM wk WHERE k = 'endpoint' AND EXISTS (SELECT 1 FROM ids i WHERE {_NEAR})
    AND EXISTS (SELECT 1 FROM sec i WHERE {_NEAR})),
al AS (SELECT * FROM st UNION ALL SELECT * FROM ex),
sb AS (SELECT doc_id, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) AS z, count(*) FILTER (k = 'assign') AS n1,
         count(*) FILTER (k = 'access') AS n2, count(*) FILTER (k = 'hex') AS n3 FROM st GROUP BY doc_id),
sa AS (SELECT doc_id, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) AS z FROM al GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n1, 0) AS BIGINT) AS n_assign, CAST(coalesce(n2, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n3, 0) AS BIGINT) AS n_hex, sha256(coalesce(sb.z, '')) AS base_sha256, coalesce(sa.z, '') AS spans
FROM d LEFT JOIN sb USING (doc_id) LEFT JOIN sa USING (doc_id)
"""

ORACLE["op9_suffix_array_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(range(0, len(ws) - 49)) AS s,
    unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS h
  FROM w WHERE len(ws) >= 50),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS lo, max(doc_id) OVER (PARTITION BY h) AS hi FROM g)
      WHERE lo <> hi),
b AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 1 ELSE 0 END AS cut FROM r),
k AS (SELECT doc_id, s, sum(cut) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM b)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start_word, CAST(max(s) + 50 AS BIGINT) AS end_word,
  CAST(max(s) + 50 - min(s) AS BIGINT) AS n_words FROM k GROUP BY doc_id, run
"""


def _mixing() -> str:
    sql = r"""
WITH d AS (
  SELECT doc_id, lang, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
e AS (
  SELECT *, CASE WHEN 10 * len(regexp_extract_all(text, '[|]')) >= n_tokens AND n_tokens > 0 THEN 'tabular'
    WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM d),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM e WHERE n_tokens > 0 GROUP BY ALL),
"""
    for dim, power in (("source", 0.5), ("lang", 0.7), ("topic", 0.8)):
        sql += (f"t_{dim} AS (SELECT {dim}, p / sum(p) OVER () AS t FROM "
                f"(SELECT {dim}, pow(sum(tokens), {power}) AS p FROM c GROUP BY {dim})),\n")
    sql += "w0 AS MATERIALIZED (SELECT *, tokens AS w FROM c),\n"
    k = 0
    for _ in range(20):
        for dim in ("source", "lang", "topic"):
            k += 1
            sql += (f"w{k} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, x.tokens, x.w * t.t / sum(x.w) OVER (PARTITION BY x.{dim}) "
                    f"AS w FROM w{k - 1} x JOIN t_{dim} t ON t.{dim} IS NOT DISTINCT FROM x.{dim}),\n")
    return sql + rf"""
r AS (SELECT source, lang, topic, round(w * (0.5 * (SELECT sum(tokens) FROM c)) / tokens, 6) AS rate FROM w{k}),
o AS (
  SELECT e.doc_id, e.lang, e.source, e.n_tokens, e.topic, r.rate,
    CAST(floor(rate) + CASE WHEN CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0
      < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS n_copies
  FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source AND e.lang IS NOT DISTINCT FROM r.lang AND e.topic = r.topic
  WHERE n_tokens > 0)
SELECT * FROM o WHERE n_copies > 0
"""


ORACLE["op10_source_mixing"] = _mixing()


def _terms(table: str, key: str) -> str:
    return rf"""SELECT {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {table} WHERE text IS NOT NULL"""


ORACLE["op13_ranked_search"] = f"""
WITH dt AS MATERIALIZED ({_terms("documents", "doc_id")}),
q AS (SELECT DISTINCT * FROM ({_terms("benchmark", "item_id")})),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, c GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
