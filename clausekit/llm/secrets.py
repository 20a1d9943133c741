"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns are reported by themselves.  Weak parts (identifiers, high-
entropy strings, endpoints) are common in harmless text; they are reported only
when complementary parts lie within a scope of each other:

* a weak secret, if an identifier (strong or weak) is in scope;
* a weak identifier, if a secret (strong or weak) is in scope;
* an endpoint, if both an identifier and a secret are in scope.

Two spans are in scope when at most ``scope`` code points lie between them.
The link is an interval join: spans are cut into bins of positions and joined on
(document, bin) as a semi-join, so no pairs are made however many parts a text
holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausekit.llm.stage import staged, unused

SCOPE = 200
BIN = 512
MASK = "[SECRET]"


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(any_case(k) for k in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"   # the runs of [0-9a-f]+ that have 32 characters or more
NAMES = "|".join(any_case(k) for k in ("username", "user", "login", "account", "client_?id", "access_?key_?id"))
IDENTIFIER = f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9@+/_.-]+)"
ENDPOINT = "https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?::[0-9]{1,5})?"
WEAK = "[A-Za-z0-9+/_=-]{20,}"
#: kind -> (order among spans with one start, pattern, condition on the whole match {m} and its value {v})
STRONG = {"assign": (0, ASSIGN, "length({v}) >= 8"), "access": (1, ACCESS, "length({m}) >= 16"), "hex": (2, HEX, "true")}
PARTS = {"identifier": (3, IDENTIFIER, "length({v}) >= 3"), "weak": (4, WEAK, "{m} rlike '[0-9]' and {m} rlike '[A-Za-z]'"),
         "endpoint": (5, ENDPOINT, "true")}
SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(kind: str, order: int, pattern: str, keep: str, text: str = "text") -> Column:
    """Spans of the leftmost non-overlapping matches: a match starts where the
    pieces between matches and the matches before it end."""
    p = _quote(pattern)
    found = f"regexp_extract_all({text}, {p}, 0)"
    value = f"regexp_extract_all({text}, {p}, 2)" if "[:=]" in pattern else found
    end = "a.at + length(x.`0`) + length(x.`1`)"
    found = f"""aggregate(
        arrays_zip(slice(split({text}, {p}, -1), 1, size({found})), {found}, {value}),
        struct(0 as at, cast(array() as {SPAN}) as got),
        (a, x) -> struct({end} as at,
            if({keep.format(m="x.`1`", v="x.`2`")},
               array_append(a.got, struct(a.at + length(x.`0`) as start, {order} as ord, {end} as end, '{kind}' as kind)),
               a.got) as got),
        a -> a.got)"""
    return F.expr(f"if({text} rlike {p}, {found}, cast(array() as {SPAN}))")


def _all(kinds: dict) -> Column:
    return F.concat(*[spans(k, *v) for k, v in kinds.items()])


def _bins(lo: str, hi: str) -> Column:
    return F.explode(F.expr(f"sequence(cast(floor(({lo}) / {BIN}) as int), cast(floor(({hi}) / {BIN}) as int))"))


def _in_scope(part: DataFrame, other: DataFrame, scope: int) -> DataFrame:
    """The rows of ``part`` that have a row of ``other`` of their text in scope."""
    a = part.withColumn("bin", _bins(f"start - {scope}", f"end + {scope}"))
    b = other.select(F.col("key").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), _bins("start", "end").alias("b"))
    return (a.join(b, (F.col("key") == F.col("k")) & (F.col("bin") == F.col("b"))
                   & (F.col("s") <= F.col("end") + scope) & (F.col("start") <= F.col("e") + scope), "left_semi")
            .drop("bin").distinct())


def parsed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, base, parts) of every row; ``key`` names a (id, text)."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.md5("text"))
    return staged(d.select("id", key.alias("key"), F.array_sort(_all(STRONG)).alias("base"), _all(PARTS).alias("parts")),
                  "secrets")


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, extra): the weak parts of each text that the links confirm."""
    one = rows.where("size(parts) > 0").dropDuplicates(["key"])
    weak = one.select("key", "base", F.explode("parts").alias("p")).where(
        "not exists(base, x -> x.start < p.end and p.start < x.end)").select("key", "p.*")
    strong = one.select("key", F.explode("base").alias("p")).select("key", "p.*")
    ids = weak.where("kind = 'identifier'").unionByName(strong.where("kind = 'access'"))
    secrets = weak.where("kind = 'weak'").unionByName(strong.where("kind in ('assign', 'hex')"))
    # an identifier's value may look like a secret: a part is no complement of itself
    alone = F.expr("not exists(ids, x -> x.start < end and start < x.end)")
    own = one.select("key", F.filter("parts", lambda x: x["kind"] == "identifier").alias("ids"))
    secrets = secrets.join(own, "key").where(alone).drop("ids")
    found = _in_scope(weak.where("kind = 'identifier'"), secrets, scope)
    found = found.unionByName(_in_scope(secrets.where("kind = 'weak'"), ids, scope))
    ends = _in_scope(_in_scope(weak.where("kind = 'endpoint'"), ids, scope), secrets, scope)
    return found.unionByName(ends).groupBy("key").agg(
        F.collect_list(F.struct("start", "ord", "end", "kind")).alias("extra"))


def _joined(c: str) -> Column:
    return F.expr(f"array_join(transform({c}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for every row of ``docs``: id, counts of strong spans by kind, a
    digest of the strong spans, all spans.  A null text counts as empty; null
    ids keep their row; repeated rows have equal results; other columns are
    ignored.  Spans are kind:start:end in code points, end exclusive, by start
    and then kind."""
    rows = parsed(docs, id_col, text_col)
    n = {k: F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in STRONG}
    out = rows.join(linked(rows, scope), "key", "left")
    both = F.array_sort(F.concat("base", F.coalesce("extra", F.expr(f"cast(array() as {SPAN})"))))
    return (out.withColumn("every", both)
            .select(F.col("id").alias(id_col), *n.values(), F.sha2(_joined("base"), 256).alias("base_sha256"),
                    _joined("every").alias("spans")))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every found span replaced by ``[SECRET]`` (overlapping spans
    by one).  Rows, other columns and texts without spans stay as they are."""
    rows = parsed(docs, id_col, text_col)
    own, got = unused(docs, "_key"), unused(docs, "_spans")
    found = (rows.dropDuplicates(["key"]).join(linked(rows, scope), "key", "left")
             .select(F.col("key").alias(own), F.array_sort(F.concat("base", F.coalesce(
                 "extra", F.expr(f"cast(array() as {SPAN})")))).alias(got)).where(f"size({got}) > 0"))
    t = f"`{text_col}`"
    clean = F.expr(f"""if({got} is null, {t}, aggregate({got}, struct('' as out, 0 as at),
        (a, x) -> struct(
            if(x.start >= a.at, concat(a.out, substring({t}, a.at + 1, x.start - a.at), '{MASK}'), a.out) as out,
            greatest(a.at, x.end) as at),
        a -> concat(a.out, substring({t}, a.at + 1))))""")
    key = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                      F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    out = docs.withColumn(own, key).join(found, own, "left")
    return out.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
