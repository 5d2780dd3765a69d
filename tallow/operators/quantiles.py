"""Exact quantiles of groups of any size by distributed selection.

A quantile is one or two ranks. Each rank has a range of values that holds it, at first the group's whole range. A pass counts the range's values
in equal buckets and goes on with the one that holds the rank, until a range has so few different values that they can be
sorted. What leaves a task is a count a bucket; no buffer holds a group's values, and equal values are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
#: Different values that one window sorts.
FEW = 1 << 14


def exact_quantiles(df: DataFrame, group: str, value: str, quantiles: dict[str, float], few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """group and a column a quantile: interpolated between the two ranks around q * (n - 1). Nulls do not count; a group of nulls has no row.

    A refined range lies in the driver's plan only as a table of (group, rank): groups may be many.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    ends = counted.groupBy("g").agg(F.sum("n").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("different"))
    at = lambda q: F.lit(float(q)) * (F.col("rows") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(q)), F.ceil(at(q))) for q in quantiles.values()))))
    spans = ends.withColumn("rank", F.explode(ranks)).select("g", "rank", "rows", "low", "high", F.lit(0).cast("bigint").alias("before"), "different")
    spans = spans.checkpoint() if _checkpoints(df) else spans.persist()
    inside = lambda s: counted.join(s.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of")) & (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))).drop("of")
    while not spans.filter(F.col("different") > few).isEmpty():
        wide = inside(spans.filter(F.col("different") > few).drop("different"))
        # the fraction first, so that no difference of large values overflows
        place = (F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bucket = F.least(F.floor(place * buckets), F.lit(buckets - 1)).alias("bucket")
        per = wide.groupBy("g", "rank", "rows", "before", bucket).agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("different"))
        upto = F.sum("n").over(Window.partitionBy("g", "rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        per = per.withColumn("end", F.col("before") + upto).withColumn("before", F.col("end") - F.col("n"))
        hit = per.filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("end"))).select(*spans.columns)
        spans = spans.filter(F.col("different") <= few).unionByName(hit)
        spans = spans.checkpoint() if _checkpoints(df) else spans.persist()
    upto = F.sum("n").over(Window.partitionBy("g", "rank").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    sorted_few = inside(spans).withColumn("end", F.col("before") + upto)
    hit = sorted_few.filter((F.col("end") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("end")))
    found = hit.groupBy("g", "rows").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    out = []
    for name, q in quantiles.items():
        low, high, part = F.col("at")[F.floor(at(q))], F.col("at")[F.ceil(at(q))], at(q) - F.floor(at(q))
        out.append((low + (high - low) * part).alias(name))
    return found.select(F.col("g").alias(group), *out)


def _checkpoints(df: DataFrame) -> bool:
    """Whether the session has a folder for checkpoints; setting it from spark.checkpoint.dir if that names one."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return True
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    return bool(named)
