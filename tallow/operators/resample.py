"""Resampling: ticks to bars, bars to coarser bars (complete buckets only, or all), and timeframes."""

from __future__ import annotations

import re

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"m": 60, "h": 3600, "d": 86400}


def timeframe_seconds(timeframe: str) -> int:
    """'5m', '1h', '1d' in seconds."""
    m = re.fullmatch(r"([1-9]\d*)([mhd])", timeframe)
    if not m:
        raise ValueError(f"not a timeframe: {timeframe!r}")
    return int(m[1]) * _UNITS[m[2]]


def bucket(ts: str | Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of a timestamp."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_seconds(c.cast("timestamp")) / seconds) * seconds)


def place(ticks: DataFrame) -> Column:
    """The order of ticks by (ts, seq), null numbers first: of whole numbers as one decimal, which aggregates without a sort, so that a
    task holds a row a bar and not its ticks."""
    if dict(ticks.dtypes)["seq"] not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct("ts", "seq")
    seq = F.coalesce(F.col("seq").cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)))
    return F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(18,0)") * F.lit(Decimal(2**64)) + seq


def bars_from_ticks(ticks: DataFrame, width: str) -> DataFrame:
    """sym, ts, o, h, l, c, v: first and last price by (ts, seq), one shuffle with partial aggregation."""
    at = place(ticks)
    g = ticks.groupBy("sym", F.window("ts", width).alias("w"))
    bars = g.agg(F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.sum("size").alias("v"))
    return bars.select("sym", F.col("w.start").alias("ts"), "o", "h", "l", "c", "v")


def confirmed(bars: DataFrame, source: str, target: str, boundary: str | None = None, optional: tuple[str, ...] = ()) -> DataFrame:
    """Coarser bars of exactly their expected source bars, which close by `boundary` (a timestamp literal).

    Prices by time, sums in decimals; a sum over an optional column is null if any of its values is. A
    duplicate source bar raises; a bar off the source's grid makes its bucket incomplete. `dropped` counts these.
    """
    return _buckets(bars, source, target, boundary, optional).filter("whole").drop("whole")


def dropped(bars: DataFrame, source: str, target: str, boundary: str | None = None) -> DataFrame:
    """sym, kept, dropped: how many buckets `confirmed` keeps, and how many it leaves out as incomplete."""
    whole = F.col("whole").cast("bigint")
    return _buckets(bars, source, target, boundary, ()).groupBy("sym").agg(F.sum(whole).alias("kept"), F.sum(1 - whole).alias("dropped"))


def _buckets(bars: DataFrame, source: str, target: str, boundary: str | None, optional: tuple[str, ...]) -> DataFrame:
    fine, wide = timeframe_seconds(source), timeframe_seconds(target)
    if wide % fine:
        raise ValueError(f"{target} is not made of {source}")
    b = bars.withColumn("bucket", bucket("ts", wide))
    if boundary is not None:
        b = b.filter(F.col("bucket") + F.make_dt_interval(secs=F.lit(wide)) <= F.lit(boundary).cast("timestamp"))
    sums = [F.sum(F.col("v").cast("decimal(28,8)")).cast("double").alias("v")]
    sums += [F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in optional]
    g = b.groupBy("sym", "bucket").agg(F.min_by("o", "ts").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "ts").alias("c"), *sums, F.count("*").alias("n"), F.count_distinct("ts").alias("d"), F.count_if(F.unix_micros(F.col("ts").cast("timestamp")) % (fine * 1_000_000) == 0).alias("on_grid"))
    g = g.withColumn("n", F.when(F.col("n") == F.col("d"), F.col("n")).otherwise(F.raise_error(F.lit("duplicate source bar")).cast("bigint")))
    whole = (F.col("n") == wide // fine) & (F.col("on_grid") == F.col("n"))
    return g.select("sym", F.col("bucket").alias("ts"), "o", "h", "l", "c", "v", *optional, whole.alias("whole"))


def rolled_up(bars: DataFrame, target: str) -> DataFrame:
    """Coarser bars of whatever source bars are there; nulls do not count."""
    g = bars.groupBy("sym", bucket("ts", timeframe_seconds(target)).alias("bucket"))
    out = g.agg(F.min_by("o", "ts").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "ts").alias("c"), F.sum("v").alias("v"), F.count("*").alias("n"))
    return out.withColumnRenamed("bucket", "ts")
