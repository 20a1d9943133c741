"""Document fingerprints by winnowing: a hash for every run of ``k`` words, the
smallest of every ``w`` neighbouring runs chosen, the rightmost on ties, and its
position kept.

Two texts that share w + k - 1 words in a row share a fingerprint entry (the
guarantee), and the kept positions say where.  Everything is one column
expression over one row: no shuffle, no Python.  Words are hashed segment by
segment, so that a long text holds its hashes in memory but not its words.

Only the comparison of neighbours moves rows.  The order of the documents is
found on (id, digest) alone; each text crosses one exchange by its digest, and the
part of it that its predecessor needs crosses one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausekit.llm.stage import staged

K = 5                   # words in a run
W = 8                   # runs in a window: texts with 12 words in common share an entry
SEGMENT = 1 << 16       # characters whose words are held at once
POSITION = (1 << 31) - 1
SPACE = r"\x20\x09-\x0D"
#: Letters of scripts that are written without spaces; each counts as a word.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _word_hashes(text: Column) -> Column:
    segments = F.regexp_extract_all(F.lower(text), F.lit(f"(?s).{{1,{SEGMENT}}}[^{SPACE}{UNSPACED}]*"), F.lit(0))
    word = F.lit(f"[{UNSPACED}]|[^{SPACE}{UNSPACED}]+")
    return F.flatten(F.transform(segments, lambda s: F.transform(
        F.regexp_extract_all(s, word, F.lit(0)), lambda x: F.xxhash64(x))))


def _entry(run_hash: Column, position) -> Column:
    """33 bits of hash over 31 bits that fall as the position grows: the smallest
    entry is the smallest hash, at its rightmost place."""
    return run_hash.bitwiseAND(F.lit(~POSITION)).bitwiseOR(F.lit(POSITION) - position)


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """array<bigint> of the entries of ``text``, by position: 33 bits of hash, then 31
    bits of position (the first word of the run).

    Words are lower-cased runs of non-white-space, or single letters of unspaced
    scripts.  A text of fewer than k words is one run, one of fewer than w runs is
    one window; null texts and texts without words have no entries."""
    def runs(h):
        n = F.size(h)
        many = F.transform(F.slice(h, 1, F.greatest(n - (k - 1), F.lit(1))),
                           lambda _, i: _entry(F.xxhash64(F.slice(h, i + 1, k)), i))
        return F.when(n >= k, many).when(n > 0, F.array(_entry(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))

    def chosen(g):
        n = F.size(g)
        many = F.array_distinct(F.transform(F.slice(g, 1, F.greatest(n - (w - 1), F.lit(1))),
                                            lambda _, i: F.array_min(F.slice(g, i + 1, w))))
        return F.when(n > w, many).when(n > 0, F.array(F.array_min(g))).otherwise(g)

    picked = _let(_let(_word_hashes(F.coalesce(text, F.lit(""))), runs), chosen)
    return F.transform(picked, lambda v: v.bitwiseXOR(F.lit(POSITION)))


def hashes(entries: Column) -> Column:
    """The upper 32 bits of the hash of every entry."""
    return F.transform(entries, lambda v: F.shiftright(v, 32).cast("int"))


def as_text(entries: Column) -> Column:
    """``hash:position`` of every entry, comma-joined."""
    return F.array_join(F.transform(entries, lambda v: F.concat_ws(
        ":", F.shiftright(v, 31).cast("string"), v.bitwiseAND(F.lit(POSITION)).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of entry hashes; 1 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def _order(rows: DataFrame) -> DataFrame:
    """From rows (id, key, n): one row for every key, with the number of its copies,
    the key before it by (id, key) and that one's n; the first follows the last.
    Ranges of keys are dealt out evenly; of each range only its two ends meet."""
    keys = staged(rows.groupBy("id", "key").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "keys")
    keys = staged(keys.repartitionByRange("id", "key").withColumn("part", F.spark_partition_id()), "order")
    at = F.struct("id", "key", "n")
    ends = keys.groupBy("part").agg(F.max(at).alias("last"))
    by_part = Window.orderBy("part")    # a row for each range
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(by_part), F.last("last").over(whole)).alias("edge"))
    inside = F.lag(F.struct("key", "n")).over(Window.partitionBy("part").orderBy("id", "key"))
    return (keys.withColumn("before", inside).join(ends, "part")
            .select("key", "id", "n", "copies", F.coalesce("before.key", "edge.key").alias("prev"),
                    F.coalesce("before.n", "edge.n").alias("prev_n")))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       k: int = K, w: int = W) -> DataFrame:
    """For every row of ``docs``: (``id_col``, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's, by ascending id, the first after
    the last; near_* are the likeness of the document's entries to those of the
    edited text and of the next document.  Null texts count as empty.  Null ids
    come first; rows that share an id follow each other by digest of their texts,
    and a row repeated in full is its own next but for the last copy.  An empty
    table gives an empty one.  Other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.md5(F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit("-")), "text")))
    order = staged(_order(rows.select("id", "key", F.length("text").alias("n"))), "neighbours")
    texts = rows.select("key", "text").withColumn("entries", fingerprint(F.col("text"), k, w)).dropDuplicates(["key"])

    head = texts.join(order.select("key", "prev", "prev_n"), "key").select(
        F.col("prev").alias("key"), F.expr("left(text, cast(prev_n div 2 as int))").alias("next_head"), hashes(F.col("entries")).alias("next_hashes"))
    own = texts.join(order.select("key", "id", "n", "copies"), "key").join(head, "key")
    # all copies of a row but the last are their own next
    own = own.select("*", F.posexplode(F.expr("if(copies > 1, array(copies - 1, 1L), array(1L))")).alias("which", "times"))
    again = (F.col("copies") > 1) & (F.col("which") == 0)
    own = own.select(
        "id", "n", "times", "text", "entries",
        F.when(again, F.expr("left(text, cast(n div 2 as int))")).otherwise(F.col("next_head")).alias("head"),
        F.when(again, hashes(F.col("entries"))).otherwise(F.col("next_hashes")).alias("next_hashes"))
    edited = own.withColumn("edited", F.concat(F.expr("left(text, cast(n - n div 2 as int))"), "head"))
    edited = edited.withColumn("edited_entries", fingerprint(F.col("edited"), k, w))
    mine = hashes(F.col("entries"))
    return (edited.select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("entries")).alias("fingerprint"), as_text(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(mine, hashes(F.col("edited_entries"))).alias("near_edited"),
        likeness(mine, F.col("next_hashes")).alias("near_next"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("copy")).drop("copy"))
