"""n-gram Jaccard join by prefix filtering under several global token orders.

Let t be the threshold and n the size of a set.  Sets that reach it share at least
ceil(t*n) shingles, so under *every* global order of the shingles they share l
within their first n - ceil(t*n) + l (the l-prefix).  Candidates come from equal
shingles in the prefixes under the first order, with l a twentieth of the set, so
that a common passage alone makes no candidate; they must also share a prefix
shingle under each further order, and are then verified on the whole sets.

The orders put frequent shingles last.  Frequency is that in a fixed share of the
distinct sets (chosen by digest) over the whole input, however many tasks it is
spread over; any order is valid, so it affects cost only, never results.

Groups of copies are never expanded into pairs:

1. documents with equal sets are one class, known by a digest of the set;
2. a class stays only if its prefix meets others often enough, and if enough of
   its whole set occurs in other such classes: the overlap with any partner is at
   most that count;
3. every class is compared with one hub, the class of its buckets (a bucket holds
   the classes with one prefix shingle) that shares the largest part of its set,
   which for edited copies is the one closest to their origin; the links give
   components, and then one member of every component in a bucket is compared
   with the hub, until no more components meet;
4. only pairs of *different* components that pass the bounds are then verified,
   so no link between different sets is lost.

Frequent shingles are dealt out in 32 parts wherever rows meet by shingle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausekit.llm import words as W
from clausekit.llm.components import components
from clausekit.llm.stage import bitmap, drop, in_bitmap, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 32             # one set in so many counts for the frequencies
SLOT_BITS = 22          # table of frequency levels: 4 MB
FREQUENT = 1 << 18      # shingles that it holds at most, so that few others share their slots
ID_BITS = 23            # bitmap of candidate documents: 1 MB
FEW = 1000              # ids of candidates that a filter names one by one
SEEDS = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)


TOKEN_BITS, SALT_BITS, PLACE_BITS = 46, 6, 12   # a bucket key: shingle, part, place in the set
SHARE = 20              # l is a SHARE-th of the set
WIDE = 8                # components in a bucket that are still told apart


def prefix_length(n, percent: int, least):
    """Length of the l-prefix of a set of n for l = ``least``."""
    return np.minimum(n, n - (percent * n + 99) // 100 + least)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, distinct shingles sorted within each text, offsets)."""
    table = W.byte_table()
    for lo, hi, data, off in W.chunks(column):
        w = W.split_words(data, off, table)
        h, d = W.grams(w, n)
        if len(d) and (np.diff(d) < 0).any():   # short texts were appended
            k = np.argsort(d, kind="stable")
            h, d = h[k], d[k]
        cut = np.searchsorted(d, np.arange(hi - lo + 1))
        for a, b in zip(cut[:-1], cut[1:]):
            h[a:b].sort()
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[keep], d[keep]
        yield lo, hi, h, np.searchsorted(d, np.arange(hi - lo + 1))


def _digests(h: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of every set."""
    out = []
    for seed in (1, 2):
        s = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(W.mix64(h ^ W.mix64(np.array([seed], np.uint64))[0]), out=s[1:])
        out.append(W.mix64(s[cut[1:]] - s[cut[:-1]] + np.diff(cut).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _profile(n: int):
    """Rows (kind 0: id, size, digests) of all texts, and (kind 1: shingle, digest) of the
    sets whose shingles are counted."""
    def run(batches):
        names = ["kind", "id", "n", "d1", "d2"]
        for b in batches:
            for lo, hi, h, cut in _sets(b.column(1), n):
                d1, d2 = _digests(h, cut)
                m = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), b.column(0).slice(lo, m), pa.array(np.diff(cut).astype(np.int64)),
                     pa.array(d1), pa.array(d2)], names)
                of = np.repeat(d1, np.diff(cut))
                counts = (of >> np.int64(40)) % SAMPLE == 0
                k = int(counts.sum())
                if k:
                    z = np.zeros(k, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(h[counts].view(np.int64)),
                                                      pa.array(z), pa.array(of[counts]), pa.array(z)], names)
    return run


def _level(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Frequency level of shingles (0: not frequent)."""
    return levels[(h & np.uint64(len(levels) - 1)).astype(np.int64)]


def _ranked(h: np.ndarray, cut: np.ndarray, levels: np.ndarray, seed: int) -> np.ndarray:
    """Index that sorts every set by (frequency level, seeded hash)."""
    key = (_level(h, levels).astype(np.uint64) << np.uint64(58)) | ((W.mix64(h ^ np.uint64(seed)) if seed else h) >> np.uint64(6))
    out = np.empty(len(h), np.int64)
    for a, b in zip(cut[:-1], cut[1:]):
        out[a:b] = a + np.argsort(key[a:b], kind="stable")
    return out


def _prefix_index(cut: np.ndarray, percent: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, place) of every prefix entry of every set; ``share`` 0: l = 1."""
    size = np.diff(cut)
    least = (size + share - 1) // share if share else 1
    p = np.where(size > 0, prefix_length(size, percent, least), 0)
    owner = np.repeat(np.arange(len(size)), p)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(p) - p, p)
    return owner, place


def _prefixes(n: int, percent: int, levels: np.ndarray):
    """(bucket key, class).  A shingle counts by its top 46 bits: two that agree in
    them can only add candidates."""
    def run(batches):
        for b in batches:
            for lo, hi, h, cut in _sets(b.column(1), n):
                d1, _ = _digests(h, cut)
                owner, place = _prefix_index(cut, percent, SHARE)
                tok = h[_ranked(h, cut, levels, SEEDS[0])][cut[owner] + place]
                level = _level(tok, levels)
                d = d1[owner]
                part = np.where(level > 0, 1 + (d & 31), 0).astype(np.uint64)
                at = ((place << PLACE_BITS) // np.diff(cut)[owner]).astype(np.uint64)
                key = (tok >> np.uint64(64 - TOKEN_BITS) << np.uint64(SALT_BITS + PLACE_BITS)) | (part << np.uint64(PLACE_BITS)) | at
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(d)], ["key", "d1"])
    return run


def _shared(shift: int, salt_bits: int):
    """From rows (key, owner) sorted by both: (shingle, owner) of the buckets that
    hold more than one owner, and of all parts of divided buckets; repeated rows
    count once.  ``shift`` low bits do not count for the bucket, the next
    ``salt_bits`` are its part.  A bucket may span batches: all that is kept of it
    is its first owner."""
    def run(batches):
        open_bucket, hub, held, last = None, None, False, None

        def out(bucket, owner):
            return pa.RecordBatch.from_arrays([pa.array(bucket >> np.int64(salt_bits)), pa.array(owner)], ["tok", "d1"])

        for b in batches:
            if not b.num_rows:
                continue
            key, owner = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            once[0] = last != (key[0], owner[0])
            last = (key[-1], owner[-1])
            key, owner = key[once], owner[once]
            if not len(key):
                continue
            bucket = key >> np.int64(shift)
            new = np.ones(len(bucket), bool)
            new[1:] = bucket[1:] != bucket[:-1]
            first, which = np.flatnonzero(new), np.cumsum(new) - 1
            hubs = owner[first]
            goes_on = open_bucket is not None and bucket[0] == open_bucket
            if goes_on:
                hubs[0] = hub
            keep = (bucket[first] & ((1 << salt_bits) - 1)) > 0
            keep[which[owner != hubs[which]]] = True
            if goes_on and held and keep[0]:
                yield out(np.array([open_bucket]), np.array([hub]))   # the owner of all its rows so far
            elif goes_on and not held:
                keep[0] = True
            rows = keep[which]
            yield out(bucket[rows], owner[rows])
            open_bucket, hub, held = bucket[-1], hubs[-1], not keep[-1]
    return run


def _light(levels: np.ndarray):
    """(shingle, id) of the shingles that are not frequent."""
    def run(batches):
        for b in batches:
            toks = b.column(1)
            h = toks.flatten().to_numpy(zero_copy_only=False)
            own = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(toks.offsets.to_numpy()))
            ok = _level(h.view(np.uint64), levels) == 0
            yield pa.RecordBatch.from_arrays([pa.array(h[ok]), pa.array(own[ok])], ["key", "d1"])
    return run


def _full(n: int, percent: int, levels: np.ndarray, ids: np.ndarray):
    """Whole sets, and prefixes under the further orders, of the documents in ``ids``."""
    def run(batches):
        for b in batches:
            keep = np.flatnonzero(in_bitmap(ids, b.column(0).to_numpy(zero_copy_only=False)))
            if not len(keep):
                continue
            b = b.take(pa.array(keep))
            for lo, hi, h, cut in _sets(b.column(1), n):
                d1, _ = _digests(h, cut)
                owner, place = _prefix_index(cut, percent, 0)
                po = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                sig = [pa.ListArray.from_arrays(pa.array(po), pa.array(
                    (h[_ranked(h, cut, levels, s)][cut[owner] + place] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                    for s in SEEDS[1:]]
                toks = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(h.view(np.int64)))
                heavy = np.zeros(len(h) + 1, np.int64)
                np.cumsum(_level(h, levels) > 0, out=heavy[1:])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(d1), pa.array(np.diff(cut).astype(np.int64)),
                     pa.array(heavy[cut[1:]] - heavy[cut[:-1]]), *sig, toks], ["id", "k", "n", "heavy", "p2", "p3", "toks"])
    return run


def _levels(prof: DataFrame) -> np.ndarray:
    """Table of log2 frequencies by the low bits of a shingle; 0: found in one counted set
    at most.  The most frequent FREQUENT shingles, by whole levels, so the driver
    gets that many rows at most."""
    seen = prof.where("kind = 1").select("id", "d1").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    seen = staged(seen.where("n > 1").select("id", F.least(F.floor(F.log2("n")), F.lit(62)).cast("int").alias("level")), "frequent")
    least, total = 63, 0
    for r in sorted(seen.groupBy("level").count().collect(), reverse=True):
        total += r["count"]
        if total > FREQUENT:
            break
        least = r.level
    rows = (seen.where(F.col("level") >= least).groupBy(F.col("id").bitwiseAND((1 << SLOT_BITS) - 1).alias("slot"))
            .agg(F.max("level").alias("level")).toArrow())
    drop(seen)
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    out[rows["slot"].to_numpy()] = rows["level"].to_numpy()
    return out


def _listed(ids: np.ndarray):
    """Rows whose first column is in the bitmap."""
    def run(batches):
        for b in batches:
            keep = np.flatnonzero(in_bitmap(ids, b.column(0).to_numpy(zero_copy_only=False)))
            if len(keep):
                yield b.take(pa.array(keep))
    return run


def _named(sets: DataFrame, ids: np.ndarray) -> DataFrame:
    """Sets whose id is in the bitmap; few bits are spelled out in the filter, so that a
    round with few pairs need not bring all sets to Python."""
    at = np.flatnonzero(np.unpackbits(ids.view(np.uint8), bitorder="little"))
    if len(at) > FEW:
        return sets.mapInArrow(_listed(ids), sets.schema)
    return sets.where(f"pmod(id, {1 << ID_BITS}L) in ({', '.join(map(str, at))})" if len(at) else "false")


def _verify(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links among staged candidate pairs (a, b): first the prefix filters of the
    further orders, intersected, then whole sets.  A bitmap keeps sets that no pair
    names out of the shuffles."""
    ids = bitmap(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), "id", ID_BITS)
    sig, full = full.select("id", "p2", "p3"), full.select("id", "toks")
    sig, full = _named(sig, ids), _named(full, ids)
    for side in ("a", "b"):
        pairs = pairs.join(sig.select(F.col("id").alias(side), F.col("p2").alias(f"{side}2"),
                                      F.col("p3").alias(f"{side}3")), side)
    pairs = pairs.where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(full.select(F.col("id").alias(side), F.col("toks").alias(f"{side}t")), side)
    both = F.size(F.array_intersect("at", "bt"))
    pairs = pairs.select("a", "b", both.alias("i"), (F.size("at") + F.size("bt") - both).alias("u"))
    return pairs.where(F.col("i") * 100 >= F.col("u") * percent).select("a", "b")


def _as_links(comp: DataFrame) -> DataFrame:
    return comp.select(F.col("id").alias("a"), F.col("component").alias("b"))


def _mixed(member: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Members of the buckets that hold more than one component ``g``, without the
    documents that have too few of them: a link with another component takes
    as many shared buckets as one with another set, and all of them are mixed."""
    m = member.join(comp, "id", "left").select(*member.columns, F.coalesce("component", "id").alias("g"))
    two = m.groupBy("tok").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi").select("tok")
    mixed = staged(m.join(two, "tok", "left_semi"), "mixed")
    enough = (mixed.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
              .where(F.expr(f"k >= ceil(ceil({percent} * n / 100D) / {SHARE}D)")).select("id"))
    out = staged(mixed.join(enough, "id", "left_semi"), "mixed")
    drop(mixed)
    return out


def _with_hubs(mixed: DataFrame) -> DataFrame:
    """(a, b): the best member of every component of a bucket, and the best hub it
    meets there; best is the largest shared part of the set."""
    best = F.max(F.struct("share", "id"))
    ends = mixed.groupBy("tok", "g").agg(best.alias("m"))
    hubs = ends.groupBy("tok").agg(F.max("m").alias("hub"))
    met = ends.join(hubs, "tok").where("m != hub").groupBy(F.col("m.id").alias("x")).agg(F.max("hub").alias("hub"))
    return met.select(F.least("x", "hub.id").alias("a"), F.greatest("x", "hub.id").alias("b")).distinct()


def _feasible(mixed: DataFrame, percent: int) -> DataFrame:
    """(id, g): the documents that meet one other component in as many buckets as a
    link with a member of it takes.  Outside the prefixes two sets of n and m have at
    most ``rest`` = the larger of n - l-prefix and m - l-prefix shingles in common, so
    they need overlap - rest shared buckets; the need is least at the ends of the
    sizes that the component offers.  Buckets of more than WIDE components are not
    told apart by component: each counts for every one of them."""
    met = mixed.select("tok", F.col("g").alias("h")).distinct()
    wide = met.groupBy("tok").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") > WIDE).select("tok")
    extra = (mixed.join(wide, "tok", "left_semi").groupBy("id")
             .agg(F.count(F.lit(1)).alias("w"), F.min("n").alias("n"), F.first("g").alias("g")))
    surely = extra.where(F.expr(f"w >= ceil(ceil({percent} * n / 100D) / {SHARE}D)")).select("id", "g")
    met = met.join(wide, "tok", "left_anti")
    of = mixed.groupBy(F.col("g").alias("h")).agg(F.min("n").alias("small"), F.max("n").alias("large"), F.max("c").alias("most"))
    m = (mixed.join(met, "tok").where("g != h").groupBy("id", "g", "h")
         .agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.max("c").alias("c")).join(of, "h"))
    m = m.join(extra.select("id", "w"), "id", "left").withColumn("k", F.col("k") + F.coalesce("w", F.lit(0)))
    m = m.withColumn("lo", F.expr(f"greatest(small, ceil({percent} * n / 100D))")).withColumn(
        "hi", F.expr(f"least(large, floor(100 * n / {percent}D))"))
    part, rest = percent / (100 + percent), percent / 100 - 1 / SHARE
    need = " , ".join(f"{part} * (n + {v}) - {rest} * greatest(n, {v}) - 2" for v in ("lo", "hi"))
    return (m.where("lo <= hi").where(F.expr(f"k >= least({need})")).where(F.expr(f"k * {SHARE} >= least(n, lo)"))
            .where(F.expr(f"{100 + percent} * least(c, most) >= {percent} * (n + lo)")).select("id", "g")
            .unionByName(surely).distinct())


def _untried(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """Candidate pairs, staged, that no earlier round has verified: one that was no link
    then is none now, and one that was is within a component."""
    if tried:
        before = pairs.sparkSession.read.schema(pairs.schema).parquet(*[t._stage_path for t in tried])
        pairs = pairs.join(before.hint("merge"), ["a", "b"], "left_anti")
    tried.append(staged(pairs, "pairs"))
    return tried[-1]


def _crossing(mixed: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """What is left: pairs (a, b) of different components.  For the few documents
    concerned the shingles are ordered by their exact frequency among them, rarest
    first; a shared prefix shingle at places i and j leaves room for at most
    min(n_a - i, n_b - j) common ones."""
    own = staged(_feasible(mixed, percent), "feasible")
    t = full.join(own, "id").select("id", "n", "k", "g", F.explode("toks").alias("tok"))
    of = t.groupBy("tok").agg(F.min(F.struct("id", "k")).alias("one"), F.max(F.struct("id", "k")).alias("two"),
                              F.count(F.lit(1)).alias("df"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    of = of.where("one != two")
    t = t.join(of.select("tok", "df", (F.col("lo") != F.col("hi")).alias("across")), "tok")
    # shingles of one set only stand before all others: only their number matters
    shared = Window.partitionBy("id", "k")
    t = t.withColumn("pos", F.col("n") - F.count(F.lit(1)).over(shared) + F.row_number().over(shared.orderBy("df", "tok")) - 1)
    t = staged(t.where(F.expr(f"across and pos <= n - ceil({percent} * n / 100D)")).select("tok", "id", "n", "g", "pos"),
               "rare")
    x, y = t.alias("x"), t.alias("y")
    return (x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.g") != F.col("y.g"))
                   & F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
                   & F.expr(f"{100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n)"))
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       n: int = 5, percent: int = 75) -> DataFrame:
    """(``id_col``, n_shingles, component_id) for every row of ``docs``.

    Words are runs of non-white-space after lower-casing A-Z; a set holds the
    distinct ``n``-word shingles, or the whole sequence of a shorter text.  Two
    documents link when 100 * intersection >= percent * union; component_id is
    the smallest id reachable by links.  Null and word-free texts have an empty
    set and link with nothing; rows with a null id take no part and get a null
    component.  Repeated rows each get a row.  Ids are expected to name one text:
    rows of one id with different texts share a component, and whether they are
    worth comparing is judged by the id's largest text.  Other columns are ignored."""
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    prof = staged(d.mapInArrow(_profile(n), "kind int, id bigint, n bigint, d1 bigint, d2 bigint"), "profile")
    rows = prof.where("kind = 0").drop("kind")
    levels = _levels(prof)
    known = d.where("id is not null and text is not null")

    # classes: one representative (smallest id) for each set
    classes = rows.where("n > 0 and id is not null").groupBy("d1", "d2").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"))

    pre = known.mapInArrow(_prefixes(n, percent, levels), "key bigint, d1 bigint")
    pre = pre.repartition(F.shiftright("key", PLACE_BITS)).sortWithinPartitions("key", "d1")
    pre = staged(pre.mapInArrow(_shared(PLACE_BITS, SALT_BITS), "tok bigint, d1 bigint"), "prefix")
    # a set shares l prefix shingles with any partner, l that of the smaller set
    least = F.expr(f"ceil(ceil({percent} * n / 100D) / {SHARE}D)")
    able = (pre.groupBy("d1").agg(F.count(F.lit(1)).alias("m"))
            .join(classes.select("d1", "rep", "n"), "d1").where(F.col("m") >= least))
    able = staged(able.select("d1", F.col("rep").alias("id")), "able")
    full = staged(known.mapInArrow(
        _full(n, percent, levels, bitmap(able, "id", ID_BITS)),
        "id bigint, k bigint, n bigint, heavy bigint, p2 array<int>, p3 array<int>, toks array<bigint>"), "sets")
    # ... and at most the shingles that occur in other such sets
    light = full.select("id", "toks").mapInArrow(_light(levels), "key bigint, d1 bigint")
    light = light.repartition("key").sortWithinPartitions("key", "d1").mapInArrow(_shared(0, 0), "tok bigint, d1 bigint")
    light = light.groupBy(F.col("d1").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    known_sets = (full.groupBy("id").agg(F.max("n").alias("n"), F.max("heavy").alias("heavy")).join(light, "id", "left")
                  .select("id", "n", (F.coalesce("c", F.lit(0)) + F.col("heavy")).alias("c")))
    strong = known_sets.where(f"100 * c >= {percent} * n").withColumn("share", F.expr("1000 * c div n"))
    member = staged(pre.join(able.join(strong, "id"), "d1").drop("d1"), "buckets")

    mixed = member.withColumn("g", F.col("id"))
    tried: list[DataFrame] = []
    links = staged(_verify(_untried(_with_hubs(mixed), tried), full, percent), "links")
    while True:
        comp = staged(components(links), "components")
        mixed = _mixed(member, comp, percent)
        drop(member)
        member = mixed.drop("g")    # a bucket of one component stays one
        member._stage_path = mixed._stage_path
        more = staged(_verify(_untried(_with_hubs(mixed), tried), full, percent), "links")
        if more.isEmpty():
            drop(more, links)
            break
        links, old = staged(_as_links(comp).unionByName(more), "links"), links
        drop(comp, more, old)
    cross = _crossing(mixed, full, percent)
    more = staged(_verify(_untried(cross, tried), full, percent), "links")
    final = components(_as_links(comp).unionByName(more)).withColumnRenamed("id", "rep")
    by_class = staged(classes.join(final, "rep", "left")
                      .select("d1", "d2", F.coalesce("component", "rep").alias("component_id")), "classes")
    drop(pre, able, mixed, more, comp, full, *tried)
    out = rows.join(by_class, ["d1", "d2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
                      .alias("component_id"))
