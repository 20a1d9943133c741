"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans.  A
window is the system turn, a limited tail of the span before, and the span itself;
its tokens stay within the budget unless a single turn does not fit.  Loss falls on
the assistant turns of the span only: the system turn and repeated history are
context, so every assistant text is a target exactly once.

A turn is written ``<turn role>``, a line end, the text, ``</turn>``, a line end.  In
texts a backslash becomes two and ``<`` becomes ``\\l``, so no text can hold a mark,
and reading is exact.

A long conversation is no hot group: prefix sums run over blocks of turns, and the
blocks' offsets over one row for each block.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausekit.llm.stage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUDGET, HISTORY, OVERHEAD = 2048, 256, 4
BLOCK = 256
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def count_tokens(turns: DataFrame, path: str | None) -> DataFrame:
    """``turns`` with n_tokens: by the tokenizer file at ``path`` (on every executor),
    or one token for each run of word characters or other sign without one."""
    if path is None:
        n = F.expr("regexp_count(text, '[\\\\p{L}\\\\p{N}]+|[^\\\\p{L}\\\\p{N}\\\\s]')")
        return turns.withColumn("n_tokens", n.cast("int") + OVERHEAD)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            n = []
            for lo in range(0, len(texts), 256):
                n += [len(e.ids) + OVERHEAD for e in tok.encode_batch(texts[lo:lo + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32())], [*b.schema.names, "n_tokens"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema.fields)
    return turns.mapInArrow(run, ddl + ", n_tokens int")


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def _escaped_role(c: Column) -> Column:
    return F.replace(F.replace(escaped(c), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


_BACK = {"l": "<", "g": ">", "n": "\n", "\\": "\\"}


def unescaped(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], s, flags=re.S)


def format_chat(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY,
                tokenizer: str | None = TOKENIZER) -> DataFrame:
    """(conv_id, window, formatted, n_context, loss_start, loss_end, n_tokens): the
    windows of every conversation in order.  ``n_context`` leading turns repeat what
    another window holds; the loss spans are code points of ``formatted``.

    Turns are ordered by turn, role and text, nulls first; null texts and roles count
    as empty; a null conv_id is a conversation of its own; repeated rows are turns of
    their own.  The system turn is the first turn if its role is "system".  A turn
    beyond the budget stands whole in its window.  Other columns are ignored."""
    t = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # tokens are counted once; several branches read them
    t = staged(count_tokens(t, tokenizer).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK)), "tokens")
    # places and prefix sums: blocks first, then turns inside blocks
    blocks = t.groupBy("conv", "block").agg(F.sum("n_tokens").alias("sum"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv").alias("c"), F.col("block").alias("b"),
                           F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum0"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    t = t.join(blocks, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = (t.withColumn("place", F.col("n0") + F.row_number().over(inside))
         .withColumn("upto", F.col("sum0") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    system = F.expr("place = 1 and role = 'system'")
    t = t.withColumn("system", system).drop("sum0", "n0", "block", "turn")
    whole = t.groupBy("conv").agg(
        F.coalesce(F.max(F.when(F.col("system"), F.col("n_tokens"))), F.lit(0)).alias("s"),
        F.coalesce(F.max(F.when(~F.col("system"), F.col("n_tokens"))), F.lit(0)).alias("m"))
    whole = whole.select(F.col("conv").alias("c"), "s",
                         F.greatest(F.lit(1), F.lit(budget - history) - F.col("s") - F.col("m")).alias("room"))
    t = t.join(whole, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    t = t.withColumn("start", F.col("upto") - F.col("n_tokens") - F.col("s"))
    t = t.withColumn("span", F.when(F.col("system"), 0).otherwise(F.floor(F.col("start") / F.col("room"))).cast("bigint"))
    t = staged(t.select("conv", "span", "place", "role", "text", "n_tokens", "system", "start"), "spans")
    # context: the tail of the span before, and the system turn
    spans = t.where(~F.col("system")).groupBy("conv", "span").agg(F.min("start").alias("first"))
    in_order = Window.partitionBy("conv").orderBy("span")
    spans = spans.select(F.col("conv").alias("c"), F.col("span").alias("k"), F.lead("span").over(in_order).alias("next"),
                         F.lead("first").over(in_order).alias("next_first"))
    cols = ["conv", "span", "place", "role", "text", "n_tokens"]
    own = t.select(*cols, F.lit(False).alias("context"))
    tail = (t.where(~F.col("system")).join(spans, F.col("conv").eqNullSafe(F.col("c")) & (F.col("span") == F.col("k")))
            .where(F.col("next_first") - F.col("start") <= history)
            .select("conv", F.col("next").alias("span"), *cols[2:], F.lit(True).alias("context")))
    again = (t.where("system").drop("span").join(spans, F.col("conv").eqNullSafe(F.col("c"))).where("k > 0")
             .select("conv", F.col("k").alias("span"), *cols[2:], F.lit(True).alias("context")))
    rows = own.unionByName(tail).unionByName(again)
    rows = rows.select("conv", "span", "place", "n_tokens", "context", (F.col("role") == "assistant").alias("says"),
                       F.concat(F.lit("<turn "), _escaped_role(F.col("role")), F.lit(">\n")).alias("head"),
                       escaped(F.col("text")).alias("body"))
    w = rows.groupBy("conv", "span").agg(
        F.array_sort(F.collect_list(F.struct("place", "context", "says", "head", "body"))).alias("t"),
        F.sum(F.col("context").cast("int")).alias("n_context"), F.sum("n_tokens").alias("n_tokens"))
    end = "</turn>\n"
    made = F.expr(f"""aggregate(t, struct(0L as at, cast(array() as array<bigint>) as a, cast(array() as array<bigint>) as b),
        (s, x) -> struct(s.at + length(x.head) + length(x.body) + {len(end)} as at,
            if(x.says and not x.context, array_append(s.a, s.at + length(x.head)), s.a) as a,
            if(x.says and not x.context, array_append(s.b, s.at + length(x.head) + length(x.body)), s.b) as b))""")
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(end))), "")
    return w.withColumn("loss", made).select(
        F.col("conv").alias("conv_id"), F.col("span").alias("window"), text.alias("formatted"),
        F.col("n_context").cast("int").alias("n_context"), F.col("loss.a").alias("loss_start"),
        F.col("loss.b").alias("loss_end"), F.col("n_tokens").cast("bigint").alias("n_tokens"))


_TURN = re.compile(r"<turn ([^>]*)>\n([^<]*)</turn>\n")


def read_back(windows: DataFrame) -> DataFrame:
    """One row for each conversation, from the formatted text and its loss spans alone:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.  Windows
    are sorted within partitions and streamed, so a task holds one window at a time;
    a digest of a whole conversation is sequential by nature."""
    def run(batches):
        key, state = None, None

        def row():
            return pa.RecordBatch.from_pylist([{
                "conv_id": key[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}], schema)

        for b in batches:
            for r in b.to_pylist():
                if key != (r["conv_id"],):
                    if key is not None:
                        yield row()
                    key, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = r["formatted"]
                at = 0
                for i, m in enumerate(_TURN.finditer(text)):
                    if m.start() != at:
                        raise ValueError(f"unreadable window of conversation {r['conv_id']}")
                    at = m.end()
                    if i >= r["n_context"]:
                        state[0] += 1
                        state[1].update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode("utf-8", "surrogatepass"))
                if at != len(text):
                    raise ValueError(f"unreadable window of conversation {r['conv_id']}")
                for a, z in zip(r["loss_start"], r["loss_end"]):
                    said = unescaped(text[a:z])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
        if key is not None:
            yield row()

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    w = windows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "window", "formatted", "n_context", "loss_start", "loss_end")
    w = w.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return w.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                             "loss_sha256 string, formatted_chars bigint")
