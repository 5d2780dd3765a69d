"""Sessions, and the package on the executors."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Where that setting is absent, a local session takes a temporary folder of this machine; a cluster can't.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    found = getattr(spark, "_tallow_shared", None)
    if found is None:
        found = "file://" + tempfile.mkdtemp(prefix="tallow-")
        spark._tallow_shared = found
    return found


def session(name: str = "tallow", **conf: str) -> SparkSession:
    """A session with what the library relies on: UTC, adaptive plans. Settings already made elsewhere win."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Spark's own defaults for batches, and what may take their place: long texts need small ones.
_BATCH = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def release() -> None:
    """Gives freed memory of a Python worker back to the machine; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Opts a session in to smaller Parquet and Arrow batches, where it still has Spark's defaults. No operator does so by
    itself; programs over long texts that must run in little memory may. The session keeps the settings."""
    for key, (default, small) in _BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, small)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once a context: a zip of its sources as a py-file."""
    sc = spark.sparkContext
    if getattr(sc, "_tallow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tallow-"), "tallow_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tallow", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tallow_shipped = True
