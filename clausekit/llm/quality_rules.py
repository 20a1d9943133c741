"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each rule measures one whole number per document (shares are in thousandths).
Its cut-offs are not fixed: they come from quantile sketches kept per language
and source.  A sketch is a histogram of values rounded down to six significant
bits, so it is exact below 64, within 1/32 above, has at most some hundred
buckets, is the same whatever the partitioning, and merges by adding counts:
the sketch of a language is the sum of its sources', that of the corpus the sum
of all.  A group's fence is q25 - k * (q75 - q25) - slack to
q75 + k * (q75 - q25) + slack; documents outside it are not kept.  Groups with
fewer than ``min_group`` documents use their language's sketch, and small
languages the corpus's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausekit.llm.stage import staged

MIN_GROUP = 100
SPREAD = 4
#: rule -> (value, lower fence applies, slack)
RULES = {
    "word_length": ("100 * word_chars div n_words", True, 100),
    "symbols": ("1000 * n_symbols div n_words", False, 100),
    "repeats": ("1000 * n_repeat_words div n_words", False, 100),
    "dup_lines": ("1000 * n_dup_lines div n_words", False, 20),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words() -> Column:
    """Words inside three-word windows that occur twice or more: windows are
    sorted by hash, equal neighbours mark their positions, and each marked
    position adds the words it covers that the next one does not."""
    return F.expr("""if(size(w) < 3 or size(array_distinct(g)) = size(g), 0L,
        aggregate(array_sort(array_append(transform(filter(z,
                (x, i) -> (i > 0 and z[i - 1].g = x.g) or (i + 1 < size(z) and z[i + 1].g = x.g)), x -> x.`1`), 2147483647)),
            struct(-1 as last, 0L as n),
            (a, p) -> struct(p as last, if(a.last < 0, 0L, a.n + least(3, cast(p as bigint) - a.last)) as n),
            a -> a.n))""")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, source, measures) of every row."""
    d = docs.select(F.col(id_col).alias("id"), "lang", "source", F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("w", F.expr(r"array_remove(split(t, '[\\x20\\x09-\\x0D]+'), '')"))
    d = d.withColumn("g", F.expr("if(size(w) < 3, cast(array() as array<bigint>), "
                                 "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"))
    d = d.withColumn("z", F.expr("if(size(array_distinct(g)) = size(g), null, array_sort(arrays_zip(g, sequence(0, size(g) - 1))))"))
    lines = r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    return d.select(
        "id", "lang", "source", F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(w, '')) as bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(t, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr(f"transform(array({lines}), x -> cast(size(x) - size(array_distinct(x)) as bigint))[0]").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rule, value, n): the quantile sketches of the groups."""
    rules = F.expr("stack({}, {}) as (rule, v)".format(
        len(RULES), ", ".join(f"'{r}', cast({v} as bigint)" for r, (v, _, _) in RULES.items())))
    v = rows.where("not base_failed").select("lang", "source", rules)
    six = F.expr("greatest(0, length(bin(v)) - 6)")
    return (v.withColumn("s", six).withColumn("value", F.expr("shiftleft(shiftright(v, s), s)"))
            .groupBy("lang", "source", "rule", "value").agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, n, q25, q75) of the sketches merged by ``keys``: the smallest
    value that at least a quarter, three quarters of the documents do not exceed."""
    m = sketch.groupBy(*keys, "rule", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    m = m.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("all", F.sum("n").over(group))
    return m.groupBy(*keys, "rule").agg(
        F.max("all").alias("n"), F.min(F.when(F.expr("4 * upto >= all"), F.col("value"))).alias("q25"),
        F.min(F.when(F.expr("4 * upto >= 3 * all"), F.col("value"))).alias("q75"))


def fences(sketch: DataFrame, min_group: int, spread: int) -> DataFrame:
    """(lang, source, <rule>_lo, <rule>_hi) for every group of the sketches."""
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("rule").alias("lr"), F.col("n").alias("ln"),
                                              F.col("q25").alias("l25"), F.col("q75").alias("l75"))
    every = quartiles(sketch, []).select(F.col("rule").alias("ar"), F.col("q25").alias("a25"), F.col("q75").alias("a75"))
    f = (own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rule") == F.col("lr")))
         .join(every, F.col("rule") == F.col("ar")))
    for q in ("25", "75"):
        f = f.withColumn(f"f{q}", F.when(F.col("n") >= min_group, F.col(f"q{q}"))
                         .when(F.col("ln") >= min_group, F.col(f"l{q}")).otherwise(F.col(f"a{q}")))
    out = []
    for r, (_, low, slack) in RULES.items():
        this = F.col("rule") == r
        if low:
            out.append(F.max(F.when(this, F.expr(f"f25 - {spread} * (f75 - f25) - {slack}"))).alias(f"{r}_lo"))
        out.append(F.max(F.when(this, F.expr(f"f75 + {spread} * (f75 - f25) + {slack}"))).alias(f"{r}_hi"))
    return f.groupBy("lang", "source").agg(*out)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """One row for every row of ``docs``: id, the measures, base_failed, kept and
    ``failed_rules`` (comma list, empty if kept or if base_failed).  A null text
    has no words; null languages and sources form groups of their own; repeated
    rows each count; an empty table gives an empty one; other columns are
    ignored."""
    rows = measured(docs, id_col, text_col)
    rows = rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    rows = staged(rows, "measured")
    f = fences(sketches(rows), min_group, spread).select(
        F.col("lang").alias("fl"), F.col("source").alias("fs"), *[c for r, (_, low, _) in RULES.items()
                                                                 for c in ([f"{r}_lo"] if low else []) + [f"{r}_hi"]])
    out = rows.join(f, F.col("lang").eqNullSafe(F.col("fl")) & F.col("source").eqNullSafe(F.col("fs")), "left")
    bad = [F.when(F.expr((f"{v} < {r}_lo or " if low else "") + f"{v} > {r}_hi"), F.lit(r))
           for r, (v, low, _) in RULES.items()]
    out = out.withColumn("failed_rules", F.when(F.col("base_failed"), "").otherwise(F.concat_ws(",", *bad)))
    return out.select(F.col("id").alias(id_col), *MEASURES, "base_failed",
                      F.expr("not base_failed and failed_rules = ''").alias("kept"), "failed_rules")
