"""Mixing sources to target weights by iterative proportional fitting, in
DataFrame functions (a small cell table that needs many rounds ends at the driver).

Tokens are summed per cell (source, language, topic) on the map side.  The cell
table is raked: weights are scaled in turn so that their sums over each source,
language and topic equal that marginal's target, in stages of rounds until every
marginal is within a tolerance of its target.  Targets that no weights meet (a
source that occurs in one language only, say, may ask for more than the language
does) end in a warning that names the worst marginal, or an error.  A document
is then drawn floor(r) times, and once more with the probability that is left,
where r is its cell's raked weight per token; the draw is a hash of its id, so
it is the same on every run.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausekit.llm.stage import drop, staged, unused

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 20             # at least
ROUNDS_PER_STAGE = 5
MAX_ROUNDS = 20_000
#: Largest relative error of a marginal's share of the weights.
TOLERANCE = 1e-4
#: Raking gives up when this many rounds have not taken a hundredth off the error.
STALLED = 500
#: Cell tables up to this many rows go on at the driver after the first ``ROUNDS``.
DRIVER_CELLS = 200_000
#: Marginal targets: token share to this power, then scaled to one; 0 is uniform.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def n_tokens(text: str = "text") -> Column:
    return F.expr(f"cast(coalesce(regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0) as bigint)")


def form_topic(text: str = "text", tokens: str = "n_tokens") -> Column:
    """A topic by the text's form, for corpora without a topic column."""
    return F.expr(f"""case when 10 * regexp_count({text}, '[|]') >= {tokens} and {tokens} > 0 then 'tabular'
        when {tokens} < 100 then 'brief' when {tokens} < 1000 then 'article' else 'long' end""")


def _shares(cells: DataFrame, dim: str, power: float, target: DataFrame | None) -> DataFrame:
    """(_k, _p): target weight of every value of ``dim`` that has tokens, from
    ``target`` (columns ``dim`` and weight), or its tokens to a power."""
    share = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0")
    if target is None:
        return share.select(F.col(dim).alias("_k"), F.pow(F.col("t").cast("double"), F.lit(float(power))).alias("_p"))
    asked = target.groupBy(F.col(dim).alias("_k")).agg(F.sum(F.col("weight").cast("double")).alias("_p")).where("_p > 0")
    found = asked.join(share, F.col("_k").eqNullSafe(F.col(dim)), "left")
    lost = found.agg(F.sum(F.when(F.col("t").isNull(), F.col("_p"))).alias("lost"), F.sum("_p").alias("all")).first()
    if lost["lost"] and cells.limit(1).count():
        warnings.warn(f"{lost['lost'] / lost['all']:.4f} of the target weight of {dim} is for values without tokens; "
                      "the others share it", stacklevel=3)
    return found.where(F.col("t").isNotNull()).select("_k", "_p")


def marginal_errors(raked: DataFrame) -> DataFrame:
    """(dimension, value, target, share, error): how far the weights' share of every
    value is from its target, relative to the target."""
    out = None
    for dim in DIMENSIONS:
        one = (raked.where(F.col(f"target_{dim}") > 0).groupBy(F.col(dim).cast("string").alias("value"))
               .agg(F.max(f"target_{dim}").alias("target"), F.sum("weight").alias("share"))
               .select(F.lit(dim).alias("dimension"), "value", "target", "share",
                       F.abs(F.col("share") / F.col("target") - 1).alias("error")))
        out = one if out is None else out.unionByName(one)
    return out


def _worst(raked: DataFrame):
    return marginal_errors(raked).orderBy(F.desc("error"), "dimension", "value").first()


def _finish(cells: pa.Table, tolerance: float, max_rounds: int) -> pa.Table:
    """More rounds over a small cell table, until its marginals are met, it stalls
    or ``max_rounds`` are done."""
    codes = [cells[d].combine_chunks().dictionary_encode("encode").indices.to_numpy() for d in DIMENSIONS]
    target = [cells[f"target_{d}"].to_numpy() for d in DIMENSIONS]
    w, errors = cells["weight"].to_numpy().copy(), []
    for done in range(1, max_rounds + 1):
        for c, t in zip(codes, target):
            s = np.bincount(c, w)[c]
            w = np.divide(w * t, s, out=np.zeros_like(w), where=s > 0)
        errors.append(max(np.abs(np.bincount(c, w)[c][t > 0] / t[t > 0] - 1).max(initial=0.0) for c, t in zip(codes, target)))
        if errors[-1] <= tolerance or (done > STALLED and errors[-1] > 0.99 * errors[-1 - STALLED]):
            break
    return cells.set_column(cells.column_names.index("weight"), "weight", pa.array(w))


def rake(cells: DataFrame, powers: Mapping[str, float], rounds: int = ROUNDS, tolerance: float = TOLERANCE,
         targets: Mapping[str, DataFrame] | None = None, strict: bool = False, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with a column ``weight`` whose sums
    meet the targets of every marginal within ``tolerance``, relative to the target,
    after ``rounds`` rounds or more.  ``targets`` may give a table (the dimension's
    column, weight) for any dimension; values that it leaves out get no weight.
    Targets that cannot be met are a warning, with ``strict`` an error.  Null keys
    are values of their own."""
    w = cells
    for dim in DIMENSIONS:
        share = _shares(cells, dim, {**POWERS, **powers}[dim], (targets or {}).get(dim))
        total = share.agg(F.sum("_p")).first()[0] or 1.0
        share = share.select("_k", (F.col("_p") / F.lit(float(total))).alias(f"target_{dim}"))
        w = w.join(share, F.col(dim).eqNullSafe(F.col("_k")), "left").drop("_k")
    w = staged(w.fillna(0.0, [f"target_{dim}" for dim in DIMENSIONS]).withColumn("weight", F.col("tokens").cast("double")), "cells")
    done, errors = 0, []
    while True:
        n, more = w, min(ROUNDS_PER_STAGE, rounds - done) if done < rounds else ROUNDS_PER_STAGE
        for _ in range(more):
            for dim in DIMENSIONS:
                by = Window.partitionBy(dim)
                scaled = F.col("weight") * F.col(f"target_{dim}") / F.nullif(F.sum("weight").over(by), F.lit(0.0))
                n = n.withColumn("weight", F.coalesce(scaled, F.lit(0.0)))
        n = staged(n, "cells")
        drop(w)
        w, done = n, done + more
        if done < rounds:
            continue
        worst = _worst(w)
        if worst is None or worst["error"] <= tolerance:
            return w
        errors.append(worst["error"])
        back = STALLED // ROUNDS_PER_STAGE
        small = len(errors) == 1 and w.count() <= DRIVER_CELLS
        if small:
            n = staged(w.sparkSession.createDataFrame(_finish(w.toArrow(), tolerance, max_rounds), w.schema), "cells")
            drop(w)
            w = n
            worst = _worst(w)
            if worst["error"] <= tolerance:
                return w
        if small or done >= max_rounds or (len(errors) > back and errors[-1] > 0.99 * errors[-1 - back]):
            text = (f"targets not met, no weights come closer: {worst['dimension']} {worst['value']!r} has {worst['share']:.6f} "
                    f"of the tokens instead of {worst['target']:.6f}")
            if strict:
                raise ValueError(text)
            warnings.warn(text, stacklevel=2)
            return w


def draw(id_col: str) -> Column:
    """A number in [0, 1) from the first 32 bits of the id's MD5."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10)
    return h.cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = 0.5,
        powers: dict[str, float] | None = None, rounds: int = ROUNDS, topic: Column | None = None,
        tolerance: float = TOLERANCE, targets: Mapping[str, DataFrame] | None = None, strict: bool = False) -> DataFrame:
    """The drawn rows of ``docs`` with columns n_tokens, topic, rate (expected
    copies) and n_copies (copies to take, at least 1), which replace columns of
    those names.  The expected tokens are ``fraction`` of the input's, shared
    out to the raked targets: those of ``targets`` (a table of the dimension's column
    and weight for source, lang or topic), else the input's shares to ``powers``.  Texts without words have no tokens to share and
    are not drawn; null sources, languages and ids are values of their own;
    repeated rows of an id are drawn alike; an empty table gives an empty one."""
    own = ("n_tokens", "topic", "rate", "n_copies")
    cols = [c for c in docs.columns if c not in own]
    d = docs.select(*[F.col(f"`{c}`") for c in cols], n_tokens(f"`{text_col}`").alias("n_tokens"))
    d = d.withColumn("topic", topic if topic is not None else form_topic(f"`{text_col}`"))
    cells = staged(d.where("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "tokens")
    raked = rake(cells, powers or POWERS, rounds, tolerance, targets, strict)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    keys = [unused(d, f"_{c}") for c in DIMENSIONS]
    rate = raked.select(*[F.col(c).alias(k) for c, k in zip(DIMENSIONS, keys)],
                        F.round(F.col("weight") * F.lit(float(fraction * total)) / F.col("tokens"), 6).alias("rate"))
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(DIMENSIONS, keys)]
    out = d.where("n_tokens > 0").join(rate, on[0] & on[1] & on[2]).drop(*keys)
    copies = F.floor("rate") + F.when(draw(id_col) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.withColumn("n_copies", copies.cast("bigint")).where("n_copies > 0")
