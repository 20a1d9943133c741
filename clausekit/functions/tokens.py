"""Token columns: ids, truncation, attention masks, instruction masks, padding.

The default tokenizer is native: whitespace words mapped to stable integer ids
by hashing (the first 6 hex digits of the word's md5, 0..16,777,215).  Any
other tokenizer plugs in as a column function ``text -> array<int>`` (for a
real vocabulary wrap it in an Arrow ``pandas_udf``).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausekit.functions.text import words

# ---------------------------------------------------------------------------
# Fixed values (must match the reference)
MAX_LENGTH = 2048          # tokenizer truncation limit
IGNORE_INDEX = -100        # label id the loss ignores
PAD_MULTIPLE = 8           # collator pads each batch up to a multiple of 8
# ---------------------------------------------------------------------------

Tokenizer = Callable[[Column], Column]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_id(tok: Column) -> Column:
    return F.conv(F.substring(F.md5(tok), 1, 6), 16, 10).cast("int")


def hash_tokenize(text) -> Column:
    """Whitespace tokenizer with hashed ids, ``array<int>``."""
    return F.transform(words(_c(text)), token_id)


def truncate(ids, max_length: int = MAX_LENGTH) -> Column:
    return F.slice(_c(ids), 1, max_length)


def attention_mask(ids) -> Column:
    return F.array_repeat(F.lit(1), F.size(_c(ids)))


def response_start(n_full: Column, n_resp: Column) -> Column:
    """Python slice start for ``labels[n_full - n_resp:]``: a negative start
    counts from the end and is clamped at 0."""
    start = n_full - n_resp
    return F.when(start >= 0, start).otherwise(F.greatest(n_full + start, F.lit(0)))


def mask_instruction(full_ids, resp_ids, response_suffix_len: int = 0) -> Column:
    """Labels = ``-100`` everywhere except the last ``len(resp_ids)``
    positions (shifted left by ``response_suffix_len`` template tokens)."""
    return mask_instruction_n(full_ids, F.size(_c(resp_ids)), response_suffix_len)


def mask_instruction_n(full_ids, n_resp: Column, response_suffix_len: int = 0) -> Column:
    """As ``mask_instruction`` with the response token count given.  Pass a
    plain column: the start is evaluated per element inside the lambda."""
    full = _c(full_ids)
    start = response_start(F.size(full), n_resp + F.lit(response_suffix_len))
    return F.transform(full, lambda x, i: F.when(i >= start, x).otherwise(F.lit(IGNORE_INDEX)))


def learnable_count(labels) -> Column:
    return F.size(F.filter(_c(labels), lambda x: x != IGNORE_INDEX))


def padded_length(max_len: Column, multiple: int = PAD_MULTIPLE) -> Column:
    return (F.ceil(max_len / F.lit(multiple)) * F.lit(multiple)).cast("int")


def pad_right(arr, target_len: Column, pad_value: int) -> Column:
    a = _c(arr)
    return F.concat(a, F.array_repeat(F.lit(pad_value), target_len - F.size(a)))


def udf_tokenizer(encode: Callable[[str], list[int]]) -> Tokenizer:
    """Wrap a Python ``encode(text) -> ids`` (e.g. a BPE tokenizer's encode)
    as a tokenizer column function: one Arrow-batched ``pandas_udf`` per
    batch, the encoder loaded once per Python worker.  Null text gives null."""
    from clausekit._ship import ensure_shipped

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [int(i) for i in encode(t)])

    def tokenizer(text: Column) -> Column:
        ensure_shipped()
        return _encode(text)

    return tokenizer
