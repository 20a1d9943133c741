"""Batch labelling with a user-supplied model callable.

* ``label_prompts``: (system, user) prompt columns, native.
* ``parse_reply``: strict reply validation (``json.loads`` semantics: no
  trailing text, duplicate keys allowed, last wins) in one Arrow
  ``pandas_udf``; Spark's ``from_json`` is laxer, so it cannot be used here.
* ``label_batch``: ``mapInPandas`` harness; one labeller per partition,
  retries with a pause, default label after the last failure.  Partition
  count is the concurrency (rate) limit.
* ``incremental_todo`` / ``label_incremental``: resume by key digest (anti-join
  against what is already written), one call per distinct key, append-only
  Parquet committed slice by slice, read back before reuse so a non-deterministic
  labeller is never recomputed by lineage.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausekit._ship import ensure_shipped
from clausekit.functions import templates as tpl
from clausekit.functions.text import contains_ci
from clausekit.operators.sample import content_key, remaining

# ---------------------------------------------------------------------------
# Fixed values (must match the reference)
RISK_LEVELS = ["HIGH", "MEDIUM", "LOW"]
REQUIRED_KEYS = ["risk_level", "risk_reason", "plain_summary"]
DEFAULT_RISK = "MEDIUM"
DEFAULT_REASON = "Could not generate label after retries"
DEFAULT_SUMMARY = "Could not generate summary after retries"
FAILED_MARK = "could not generate"
MAX_RETRIES = 3
RETRY_PAUSE_S = 3.0
# ---------------------------------------------------------------------------

STATUS_OK = "ok"
STATUS_JSON = "json_error"
STATUS_FORMAT = "invalid_format"
STATUS_ERROR = "error"

PARSED = T.StructType([
    T.StructField("risk_level", T.StringType()),
    T.StructField("risk_reason", T.StringType()),
    T.StructField("plain_summary", T.StringType()),
    T.StructField("parse_status", T.StringType()),
])


def _text(v):
    if v is None:
        return None
    return v if isinstance(v, str) else json.dumps(v)


def parse_reply_py(reply) -> tuple:
    """Strict parse of one reply -> (risk_level, risk_reason, plain_summary,
    status).  Status classes follow the reference's exception ladder."""
    try:
        parsed = json.loads(reply.strip())
        for k in REQUIRED_KEYS:
            assert k in parsed
        assert parsed["risk_level"] in RISK_LEVELS
        return (parsed["risk_level"], _text(parsed["risk_reason"]),
                _text(parsed["plain_summary"]), STATUS_OK)
    except json.JSONDecodeError:
        return (None, None, None, STATUS_JSON)
    except AssertionError:
        return (None, None, None, STATUS_FORMAT)
    except Exception:  # noqa: BLE001 - the reference's catch-all class
        return (None, None, None, STATUS_ERROR)


@F.pandas_udf(PARSED)
def _parse_udf(replies: pd.Series) -> pd.DataFrame:
    out = [parse_reply_py(r) for r in replies]
    return pd.DataFrame(out, columns=[f.name for f in PARSED.fields])


def parse_reply(reply) -> Column:
    """``struct<risk_level, risk_reason, plain_summary, parse_status>``."""
    ensure_shipped()
    return _parse_udf(F.col(reply) if isinstance(reply, str) else reply)


def label_prompts(df: DataFrame, ctx_col: str = "enriched_context",
                  system_prompt: str = tpl.LABEL_SYSTEM_PROMPT) -> DataFrame:
    return df.withColumn("system_prompt", F.lit(system_prompt)).withColumn(
        "user_prompt", tpl.label_user_prompt(F.col(ctx_col)))


def with_default(parsed: Column) -> Column:
    """The parsed label, or the default label when parsing failed."""
    ok = parsed["parse_status"] == STATUS_OK
    return F.struct(
        F.when(ok, parsed["risk_level"]).otherwise(F.lit(DEFAULT_RISK)).alias("risk_level"),
        F.when(ok, parsed["risk_reason"]).otherwise(F.lit(DEFAULT_REASON)).alias("risk_reason"),
        F.when(ok, parsed["plain_summary"]).otherwise(F.lit(DEFAULT_SUMMARY)).alias("plain_summary"),
        parsed["parse_status"].alias("parse_status"),
    )


def failure_counts(parsed_df: DataFrame, status_col: str = "parse_status") -> DataFrame:
    return parsed_df.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))


def labelled_rows(df: DataFrame, label_col: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """The 7-column labelled row, after any columns to ``keep``."""
    return df.select(*keep, "contract_name", "clause_type", "clause_text", "enriched_context",
                     F.col(f"{label_col}.risk_level").alias("risk_level"),
                     F.col(f"{label_col}.risk_reason").alias("risk_reason"),
                     F.col(f"{label_col}.plain_summary").alias("plain_summary"))


def clean_labels(df: DataFrame) -> DataFrame:
    """Drop rows whose reason or summary says the label failed (null text
    is kept)."""
    return df.where(~contains_ci("risk_reason", FAILED_MARK) & ~contains_ci("plain_summary", FAILED_MARK))


def rerun_required(df: DataFrame) -> DataFrame:
    """Rows whose summary failed and must be labelled again."""
    return df.where(contains_ci("plain_summary", FAILED_MARK))


def incremental_todo(todo: DataFrame, done: DataFrame, key: str = "enriched_context") -> DataFrame:
    """Rows not labelled yet: resume by key (its digest), not by row count."""
    return remaining(todo, done, key, mode="anti")


def one_per_key(todo: DataFrame, key: str = "enriched_context") -> DataFrame:
    """One row for every key, the smallest by row hash: equal prompts are sent to
    the model once.  Decided on digests; a row is payload of one join."""
    rows = todo.withColumn("_k", content_key(key)).withColumn("_h", content_key(*todo.columns))
    first = rows.groupBy("_k").agg(F.min("_h").alias("_h"))
    return rows.join(first, ["_k", "_h"], "left_semi").dropDuplicates(["_k"]).select(*todo.columns)


def unlabelled(todo: DataFrame, done: DataFrame, key: str = "enriched_context") -> DataFrame:
    """One row for every key, null too, that ``done`` does not hold."""
    taken = done.select(content_key(key).alias("_k")).distinct()
    rows = todo.withColumn("_k", content_key(key)).join(taken, "_k", "left_anti").select(*todo.columns)
    return one_per_key(rows, key)


def label_fields() -> list[T.StructField]:
    """The columns that labelling adds."""
    return [T.StructField(c, T.IntegerType() if c == "attempts" else T.StringType()) for c in LABEL_COLUMNS]


LABEL_COLUMNS = ["risk_level", "risk_reason", "plain_summary", "parse_status", "attempts"]


def with_labels(rows: DataFrame, done: DataFrame, key: str = "enriched_context") -> DataFrame:
    """Every row of ``rows`` whose key (null too) ``done`` holds, with that key's
    label: the labelled table has one row a key, this gives back all of them."""
    one = done.groupBy(content_key(key).alias("_k")).agg(F.min(F.struct(*LABEL_COLUMNS)).alias("_l"))
    joined = rows.withColumn("_k", content_key(key)).join(one, "_k")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"_l.{c}").alias(c) for c in LABEL_COLUMNS])


Labeller = Callable[[str, str], str]


def label_batch(df: DataFrame, make_labeller: Callable[[], Labeller],
                ctx_col: str = "enriched_context", max_retries: int = MAX_RETRIES,
                pause_s: float = RETRY_PAUSE_S, pause_between_s: float = 0.0,
                concurrency: int | None = None,
                system_prompt: str = tpl.LABEL_SYSTEM_PROMPT) -> DataFrame:
    """Label every row with ``make_labeller()(system_prompt, user_prompt)``.

    ``make_labeller`` is picklable and is called once per partition (one
    client per task).  Each reply is parsed strictly; a failed attempt is
    retried after ``pause_s`` up to ``max_retries`` times, then the default
    label is used.  ``concurrency`` caps the number of partitions, i.e. of
    clients calling the service at once (the rate limit); ``pause_between_s``
    spaces the calls of one client.  Output adds ``risk_level, risk_reason,
    plain_summary, parse_status, attempts``."""
    ensure_shipped(df.sparkSession)
    out_schema = T.StructType([*df.schema.fields, *label_fields()])
    system = system_prompt
    head, tail = tpl.LABEL_USER_HEAD, tpl.LABEL_USER_TAIL

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = make_labeller()
        for pdf in batches:
            res = []
            for ctx in pdf[ctx_col]:
                user = head + ("" if ctx is None else str(ctx)) + tail
                status, n = STATUS_ERROR, 0
                label = (DEFAULT_RISK, DEFAULT_REASON, DEFAULT_SUMMARY)
                for attempt in range(max_retries):
                    n = attempt + 1
                    try:
                        reply = labeller(system, user)
                    except Exception:  # noqa: BLE001
                        reply = None
                    r, why, summ, status = parse_reply_py(reply)
                    if status == STATUS_OK:
                        label = (r, why, summ)
                        break
                    if pause_s:
                        time.sleep(pause_s)
                if pause_between_s:
                    time.sleep(pause_between_s)
                res.append((*label, status, n))
            lab = pd.DataFrame(res, columns=["risk_level", "risk_reason", "plain_summary",
                                             "parse_status", "attempts"], index=pdf.index)
            yield pd.concat([pdf, lab], axis=1)

    src = df.repartition(concurrency) if concurrency else df
    return src.mapInPandas(run, out_schema)


def label_incremental(todo: DataFrame, done_path: str, make_labeller: Callable[[], Labeller],
                      key: str = "enriched_context", commits: int = 8, every_row: bool = False, **kw) -> DataFrame:
    """``operators.label_runs.label_incremental``."""
    from clausekit.operators import label_runs
    return label_runs.label_incremental(todo, done_path, make_labeller, key, commits, every_row, **kw)
