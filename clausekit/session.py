"""Spark session helpers.

The library never creates its own session inside operators; callers pass one.
``get_session`` is for scripts, tests and the bench: it sets the handful of
options the engine relies on (UTC, AQE with skew handling, legacy charsets
for cp1252 CSV) and a checkpoint folder only when the cluster has not named
one already.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "clausekit") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # cp1252 master CSV files need the legacy charset list in Spark 4
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CLAUSEKIT_DRIVER_MEMORY", "16g"))
    )
    event_dir = os.environ.get("CLAUSEKIT_EVENT_LOG_DIR")
    if event_dir:  # stage/task timings for profiling, written to a scratch folder
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_dir))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a scratch one only when
    the session has none (local tests). On a cluster the shared folder named in
    ``spark.checkpoint.dir`` is used as is."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's setting applies
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster") from None
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(reliable checkpoints and streaming state are written there)")
        conf_dir = tempfile.mkdtemp(prefix="clausekit-ckpt-")  # local mode / tests only
    sc.setCheckpointDir(conf_dir)
    return conf_dir
