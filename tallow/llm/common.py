"""What the operators share: the shared folder, tables in it, reading inputs, hashing ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark only (any store that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tallow-{name}-{uuid.uuid4().hex[:12]}"


#: Up to so many bytes a side of a join is broadcast, where its size is known; beyond, both sides are shuffled.
MOST_BROADCAST = 32 << 20


#: Paths of stored tables that have not been discarded.
_kept: list[str] = []


def tables() -> list[str]:
    """The paths of all stored tables that have not been discarded."""
    return list(_kept)


def sweep(spark: SparkSession, *needed: DataFrame, others: list[str] = ()) -> None:
    """Discards all stored tables but the needed ones and others: for a program that knows what it still reads."""
    still = {p for t in needed for p in getattr(t, "_tallow_paths", [])} | set(others)
    for path in [p for p in _kept if p not in still]:
        remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = new_dir(df.sparkSession, name)
    _kept.append(path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tallow_paths = [path]
    return table


def holding(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, known to read these stored tables only, so that discarding it discards them."""
    df._tallow_paths = [p for t in tables for p in getattr(t, "_tallow_paths", [])]
    return df


def discard(*tables: DataFrame | None) -> None:
    """Removes stored tables that nothing reads any more. Others (and None) are left alone."""
    for table in tables:
        for path in getattr(table, "_tallow_paths", []):
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if path in _kept:
        _kept.remove(path)


def small(side: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A side of a join, broadcast if its rows, of row_bytes at most, are known to fit in MOST_BROADCAST."""
    return F.broadcast(side) if rows * row_bytes <= MOST_BROADCAST else side


def id_crc(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")))


def fresh(df: DataFrame, name: str) -> str:
    """A name for a scratch column that none of df's columns has or begins with, whatever the case."""
    taken = [c.lower() for c in df.columns]
    name = f"__{name}"
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name
