"""Arrow helpers for operators that add columns to whole rows."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def with_scores(df: DataFrame, text_col: str, out_col: str,
                make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """``df`` with a double column ``out_col`` (replacing one of that name)
    computed from ``text_col``; ``make`` is called once in every task."""
    cols = [c for c in df.columns if c != out_col]
    df = df.select(*[f"`{c}`" for c in cols])
    at = cols.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches):
        score = make()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(b.column(at)), pa.float64())],
                                                 [*cols, out_col])
    return df.mapInArrow(run, schema)
