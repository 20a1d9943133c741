"""Training-set construction: instruction/response, chat, tokens, masks, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausekit.functions import templates as tpl
from clausekit.functions import tokens as tk
from clausekit.operators.ordinal import dense_ordinal

# Chat rendering defaults: a common header / end-of-turn marker layout.  The tokenizer's
# own template is not part of the reference; callers pass theirs.
CHAT_BOS = "<|begin_of_text|>"
CHAT_HEADER_START = "<|start_header_id|>"
CHAT_HEADER_END = "<|end_header_id|>\n\n"
CHAT_EOT = "<|eot_id|>"

_TARGET_LINE = r"\n *\*\*Target Clause Type:\*\* [^\n]*"


def instruction_response(labelled: DataFrame, include_type_in_prompt: bool = True) -> DataFrame:
    """Add ``instruction``, ``response`` and ``full_text``.

    ``include_type_in_prompt=False`` removes the target-type line from the
    context so the type is only in the response (the reference leaked it)."""
    ctx = F.col("enriched_context")
    if not include_type_in_prompt:
        ctx = F.regexp_replace(ctx, _TARGET_LINE, "")
    instr = tpl.instruction(ctx)
    resp = tpl.response("clause_type", "risk_level", "risk_reason", "plain_summary")
    return labelled.withColumns({"instruction": instr, "response": resp,
                                 "full_text": tpl.full_text(instr, resp)})


def chat_messages(instruction="instruction", response="response") -> Column:
    i = F.col(instruction) if isinstance(instruction, str) else instruction
    r = F.col(response) if isinstance(response, str) else response
    return F.array(F.struct(F.lit("user").alias("role"), i.alias("content")),
                   F.struct(F.lit("assistant").alias("role"), r.alias("content")))


def render_chat(messages, bos: str = CHAT_BOS, header_start: str = CHAT_HEADER_START,
                header_end: str = CHAT_HEADER_END, eot: str = CHAT_EOT) -> Column:
    """Messages through a chat template, no generation prompt."""
    m = F.col(messages) if isinstance(messages, str) else messages
    parts = F.transform(m, lambda x: F.concat(F.lit(header_start), x["role"], F.lit(header_end),
                                              x["content"], F.lit(eot)))
    return F.concat(F.lit(bos), F.array_join(parts, ""))


def tokenize(df: DataFrame, text_col: str, tokenizer=tk.hash_tokenize,
             max_length: int = tk.MAX_LENGTH) -> DataFrame:
    """``input_ids`` (truncated) and ``attention_mask`` of ones; no padding."""
    ids = tk.truncate(tokenizer(F.col(text_col)), max_length)
    return df.withColumn("input_ids", ids).withColumn("attention_mask", tk.attention_mask(F.col("input_ids")))


def format_for_training(df: DataFrame, text_col: str = "chat_text", response_col: str = "response",
                        tokenizer=tk.hash_tokenize, max_length: int = tk.MAX_LENGTH,
                        response_suffix_len: int = 0) -> DataFrame:
    """Token rows: ``input_ids, attention_mask, labels`` with the instruction
    masked.  Raw text columns are dropped (lazy ``select``, no batch loop)."""
    t = tokenize(df, text_col, tokenizer, max_length)
    # the response length is a column of its own: referenced inside the mask
    # lambda, an inline expression would be re-evaluated for every element
    t = t.withColumn("_n_resp", F.size(tk.truncate(tokenizer(F.col(response_col)), max_length)))
    t = t.withColumn("labels", tk.mask_instruction_n(F.col("input_ids"), F.col("_n_resp"),
                                                     response_suffix_len))
    keep = [c for c in df.columns if c not in (text_col, response_col, "instruction", "full_text")]
    return t.select(*keep, "input_ids", "attention_mask", "labels")


def pad_batches(df: DataFrame, batch_size: int = 1, order_cols=("ord",), pad_id: int = 0,
                multiple: int = tk.PAD_MULTIPLE) -> DataFrame:
    """Dynamic right padding per batch: ids padded with ``pad_id``, labels
    with ``-100``, attention with 0, to the batch's longest row rounded up to
    ``multiple``.  Batches are consecutive rows in ``order_cols`` order, numbered
    ``batch_id``; rows that share all of them stand in any order.

    Only (order, length) is put in order (``dense_ordinal``); token arrays pass one
    exchange, by hash of the order columns, and are padded where they meet their
    batch."""
    order = list(order_cols)
    rows = df.withColumn("_size", F.coalesce(F.size("input_ids"), F.lit(0)))
    places = dense_ordinal(rows.select(*order, "_size"), order, "_idx")
    whole = Window.partitionBy("batch_id")   # at most batch_size rows each
    places = places.withColumn("batch_id", F.floor(F.col("_idx") / batch_size))
    places = places.withColumn("_len", tk.padded_length(F.max("_size").over(whole), multiple))
    on = [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(order)]
    cells = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    if places.groupBy(*order).count().where("count > 1").isEmpty():
        b = rows.join(places.select(*cells, "batch_id", "_len"), on, "inner")
    else:   # rows that share their place are told apart by length, then by number: one exchange more
        same = Window.partitionBy(*order, "_size")
        places = places.withColumn("_onth", F.row_number().over(same.orderBy("_idx")))
        rows = rows.withColumn("_nth", F.row_number().over(same.orderBy(F.lit(1))))
        on += [F.col("_size") == F.col("_osize"), F.col("_nth") == F.col("_onth")]
        b = rows.join(places.select(*cells, F.col("_size").alias("_osize"), "_onth", "batch_id", "_len"), on, "inner")
    return b.select(*[F.col(f"`{c}`") for c in df.columns], "batch_id", "_len").withColumns({
        "input_ids": tk.pad_right("input_ids", F.col("_len"), pad_id),
        "attention_mask": tk.pad_right("attention_mask", F.col("_len"), 0),
        "labels": tk.pad_right("labels", F.col("_len"), tk.IGNORE_INDEX),
    }).drop("_len")
