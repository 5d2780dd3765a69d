"""Gaps and coverage of series on a regular grid (columns sym, ts; a step in seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import PART, part_of
from .resample import bucket

#: Seconds between funding times, which are at UTC 0, 8 and 16 o'clock.
FUNDING = 28_800


def _series():
    return Window.partitionBy("sym").orderBy("ts")


def previous(rows: DataFrame, order: str, part: Column) -> DataFrame:
    """rows with `before`, the ts of the row before each along `order`. A window holds one part of a series; the last row of
    earlier parts is carried, a row a part."""
    near = F.lag(F.struct("ts")).over(Window.partitionBy("sym", "part").orderBy(order))
    far = F.last("edge", ignorenulls=True).over(Window.partitionBy("sym").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parted = rows.withColumn("part", part)
    edges = parted.groupBy("sym", "part").agg(F.max_by(F.struct("ts"), order).alias("edge")).select(F.col("sym").alias("of_sym"), F.col("part").alias("of_part"), far.alias("far"))
    met = parted.withColumn("near", near).join(edges, F.col("sym").eqNullSafe(F.col("of_sym")) & F.col("part").eqNullSafe(F.col("of_part")))
    return met.select(*rows.columns, F.coalesce("near", "far")["ts"].alias("before"))


def steps_missing(bars: DataFrame, step: int, seconds: float = PART) -> DataFrame:
    """sym, ts, missing: rows before which that many steps are missing."""
    return missing_ranges(bars, step, seconds).select("sym", (F.col("last_ts") + F.make_dt_interval(secs=F.lit(step))).alias("ts"), F.col("steps").alias("missing"))


def missing_ranges(bars: DataFrame, step: int, seconds: float = PART) -> DataFrame:
    """Runs of steps without a bar, between the bars around them: sym, first_ts, last_ts, steps. Bars may repeat."""
    met = previous(bars.select("sym", "ts"), "ts", part_of("ts", seconds))
    absent = (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("before").cast("timestamp"))) / step - 1
    one = F.make_dt_interval(secs=F.lit(step))
    return met.select("sym", (F.col("before") + one).alias("first_ts"), (F.col("ts") - one).alias("last_ts"), absent.cast("bigint").alias("steps")).filter("steps > 0")


def order_faults(rows: DataFrame, order: str, rows_a_part: int = 1 << 16) -> DataFrame:
    """sym, duplicates, regressions of ts along another order, a whole number without gaps of note."""
    met = previous(rows.select("sym", "ts", order), order, F.floor(F.col(order) / rows_a_part))
    tagged = met.select("sym", (F.col("ts") == F.col("before")).cast("int").alias("same"), (F.col("ts") < F.col("before")).cast("int").alias("back"))
    return tagged.groupBy("sym").agg(F.coalesce(F.sum("same"), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("back"), F.lit(0)).alias("regressions"))


def grid(bars: DataFrame, step: int) -> DataFrame:
    """sym, ts of every step between the first and last bar of each series."""
    ends = bars.groupBy("sym").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    return ends.select("sym", F.explode(F.sequence("a", "b", F.make_dt_interval(secs=F.lit(step)))).alias("ts")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def absent(bars: DataFrame, step: int) -> DataFrame:
    """sym, ts of the steps that have no bar."""
    return grid(bars, step).join(bars.select("sym", "ts"), ["sym", "ts"], "left_anti")


def ranges(points: DataFrame, step: int) -> DataFrame:
    """Runs of consecutive steps: sym, first_ts, last_ts, steps."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    island = seconds - F.row_number().over(_series()) * step
    runs = points.withColumn("island", island).groupBy("sym", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("steps"))
    return runs.drop("island")


def contract(bars: DataFrame, step: int, wide: int) -> DataFrame:
    """Coarse buckets that lack bars: sym, bucket, missing, kind (normal: all of its steps; partial: some)."""
    per = absent(bars, step).groupBy("sym", bucket("ts", wide).cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("missing"))
    return per.withColumn("kind", F.when(F.col("missing") == wide // step, "normal").otherwise("partial"))


def coverage(bars: DataFrame, step: int, least: float = 0.95, longest_seconds: int = 86_400) -> DataFrame:
    """sym, bars, expected, missing, coverage, longest_gap (seconds), acceptable, and of the funding times after the first
    bar's opening up to the last one's close: funding_boundaries, funding_missing (the bar that closes there is absent) and
    funding_unobservable (so is the bar behind it, and no price is known)."""
    at = lambda c: F.unix_seconds(c.cast("timestamp"))
    first, last = at(F.min("ts")), at(F.max("ts"))
    boundaries = F.floor((last + step) / FUNDING) - F.floor(first / FUNDING)
    has = bars.groupBy("sym").agg(F.count("*").alias("bars"), ((last - first) / step + 1).cast("bigint").alias("expected"), boundaries.alias("funding_boundaries"))
    # of a run of absent bars, by what its bars' openings and closes span: no run is expanded
    opens, closes = at(F.col("last_ts")), at(F.col("first_ts")) + step
    between = lambda low, high: F.greatest(F.floor(high / FUNDING) - F.ceil(low / FUNDING) + 1, F.lit(0))
    worst = missing_ranges(bars, step).groupBy(F.col("sym").alias("of_sym")).agg((F.max("steps") * step).alias("longest_gap"), F.sum(between(closes, opens + step)).alias("funding_missing"), F.sum(between(closes, opens)).alias("funding_unobservable"))
    out = has.join(worst, F.col("sym").eqNullSafe(F.col("of_sym")), "left").drop("of_sym").fillna(0, ["longest_gap", "funding_missing", "funding_unobservable"])
    out = out.withColumn("missing", F.greatest(F.col("expected") - F.col("bars"), F.lit(0))).withColumn("coverage", F.least(F.lit(1.0), F.round(F.col("bars") / F.col("expected"), 6)))
    return out.withColumn("acceptable", (F.col("coverage") >= least) & (F.col("longest_gap") <= longest_seconds))


def inventory(bars: DataFrame) -> DataFrame:
    return bars.groupBy("sym").agg(F.min("ts").alias("available_from"), F.max("ts").alias("available_to"), F.count("*").alias("row_count"))


def merged_inventory(old: DataFrame, delta: DataFrame) -> DataFrame:
    """An inventory and the inventory of rows added since."""
    return old.unionByName(delta).groupBy("sym").agg(F.min("available_from").alias("available_from"), F.max("available_to").alias("available_to"), F.sum("row_count").alias("row_count"))
