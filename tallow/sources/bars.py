"""Bars from the input tables, and the same as SQL: columns sym, ts, o, h, l, c, v (doubles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import bars_from_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sym, ts, seq, price, size from the events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


def hourly(spark: SparkSession, sf_dir: str, hours: int = 1) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), f"{hours} hours").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def hourly_sql(hours: int = 1) -> str:
    """DuckDB: epoch-aligned bars of the events."""
    width = f"{hours} hours"
    bucket = f"time_bucket(interval '{width}', ts, timestamp '1970-01-01')"
    return f"select event_type as sym, {bucket} as ts, first(value order by ts, event_id) as o, max(value) as h, min(value) as l, last(value order by ts, event_id) as c, count(*)::double as v from events group by event_type, {bucket}"
