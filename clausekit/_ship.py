"""Make the package importable in Python workers.

Pandas UDFs and ``mapInPandas`` functions of this package are pickled by
reference, so every executor's Python worker must be able to import
``clausekit``.  On a cluster, ship it the standard way (``spark-submit
--py-files clausekit.zip`` or install it in the executors' environment).  In
local mode ``ensure_shipped`` zips the package once and adds it with
``addPyFile``, so scripts and tests work from any working directory."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

_LOCK = threading.Lock()
_SHIPPED: set[int] = set()
_ZIP: list[str] = []


def _zip_package() -> str:
    if _ZIP:
        return _ZIP[0]
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="clausekit-pkg-"), "clausekit.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(dirpath, f)
                    z.write(p, os.path.relpath(p, root))
    _ZIP.append(out)
    return out


def ensure_shipped(spark: SparkSession | None = None) -> None:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (Spark Connect): deployed with the job
        return
    if not sc.master.startswith("local"):
        return  # cluster: the package is deployed with the job (--py-files)
    key = id(sc._jsc)
    with _LOCK:
        if key in _SHIPPED:
            return
        sc.addPyFile(_zip_package())
        _SHIPPED.add(key)
