"""Subword tokenizers from rank files, as column functions ``text -> array<int>``.

A rank file has a line for every token: its bytes in base64 and its id.  The driver
reads it and the vocabulary travels with the tasks; every worker builds its encoder
once.  A batch of texts becomes one Arrow list column: a flat array of ids and the
offsets of the texts, without a Python object for a token.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausekit.functions.tokens import Tokenizer

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is cut before the merges: contractions, words, numbers and marks with the
#: space before them, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, object] = {}


def _encoder(ranks: bytes, pattern: str):
    key = hashlib.md5(ranks + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def list_column(parts: list[np.ndarray | None]) -> pa.Array:
    """An Arrow list column from one id array for every row (None: null)."""
    size = np.array([0 if p is None else len(p) for p in parts], np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *[p for p in parts if p is not None]]).astype(np.int32)
    null = pa.array(np.array([p is None for p in parts], bool))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat), mask=null)


def subword_tokenizer(rank_file: str = RANK_FILE, pattern: str = PATTERN) -> Tokenizer:
    """The tokenizer of a rank file.  Strings of special tokens are ordinary text; null
    text gives null, empty text no ids."""
    from clausekit._ship import ensure_shipped
    with open(rank_file, "rb") as f:
        ranks = f.read()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        e = _encoder(ranks, pattern)
        return list_column([None if t is None else e.encode_to_numpy(t, disallowed_special=()) for t in texts.to_pylist()])

    def tokenizer(text: Column) -> Column:
        ensure_shipped()
        return encode(text)

    return tokenizer
