"""Alignment of series: as-of, window lookups, pairs, the next bar, what follows a point, overlapping intervals.

Lookups along time go in two levels. Within a series and a part of time a window finds the last (next) value; what lies before
(behind) the part is an edge, a row a series and part, carried over parts. No window holds rows of more than one part, so
a series with most of the rows is the work of as many tasks as it has parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of time that a part spans.
PART = 7 * 86_400


def part_of(on: str | Column, seconds: float) -> Column:
    """The number of the part of time that a row lies in."""
    return F.floor(F.unix_micros((F.col(on) if isinstance(on, str) else on).cast("timestamp")) / int(seconds * 1_000_000))


def _both(left: DataFrame, right: DataFrame, columns: list[str], on: str, by: list[str], payload: Column, seconds: float) -> DataFrame:
    """Rows of both sides: columns (null on the right but for on and by), __v (null on the left), __left, __part."""
    kind = right.select(payload.alias("v")).schema["v"].dataType
    a = left.select(*columns, F.lit(None).cast(kind).alias("__v"), F.lit(1).alias("__left"))
    b = right.select(*(F.col(c) if c in (on, *by) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns), payload.alias("__v"), F.lit(0).alias("__left"))
    return a.unionByName(b).withColumn("__part", part_of(on, seconds))


def _lookup(both: DataFrame, columns: list[str], on: str, by: list[str], ahead: bool, strictly: bool = True) -> DataFrame:
    """The left rows with __v, the last value of the right side at or before each, or the first behind it (at it, if not strictly)."""
    known, along = F.when(F.col("__v").isNotNull(), F.col(on)), Window.partitionBy(*by).orderBy("__part")
    if ahead:
        # backwards, so that the frame grows a row at a time
        first = F.col("__left").desc() if strictly else F.col("__left").asc()
        inside = Window.partitionBy(*by, "__part").orderBy(F.col(on).desc(), first)
        edge, far = F.min_by("__v", known), F.first("__edge", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    else:
        inside = Window.partitionBy(*by, "__part").orderBy(on, "__left")
        edge, far = F.max_by("__v", known), F.last("__edge", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    near = F.last("__v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    edges = both.groupBy(*by, "__part").agg(edge.alias("__edge")).select(*(F.col(c).alias(f"__of_{c}") for c in (*by, "__part")), far.alias("__far"))
    met = both.withColumn("__near", near).filter("__left = 1").join(edges, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*by, "__part")])
    return met.select(*columns, F.coalesce("__near", "__far").alias("__v"))


def as_of(left: DataFrame, right: DataFrame, value: str, on: str = "ts", by: str = "sym", out: str | None = None, seconds: float = PART) -> DataFrame:
    """left with the last `value` (nulls pass) of right at or before each row."""
    columns = left.columns
    found = _lookup(_both(left, right, columns, on, [by], F.col(value), seconds), columns, on, [by], ahead=False)
    return found.select(*columns, F.col("__v").alias(out or value))


def next_bar(orders: DataFrame, bars: DataFrame, on: str = "ts", by: str = "sym", columns: tuple[str, ...] = ("o",), seconds: float = PART) -> DataFrame:
    """orders with the time and prices of the first bar strictly after each."""
    kept = orders.columns
    bar = F.struct(F.col(on).alias("next_ts"), *(F.col(c).alias(f"next_{c}") for c in columns))
    found = _lookup(_both(orders, bars, kept, on, [by], bar, seconds), kept, on, [by], ahead=True)
    return found.select(*kept, "__v.*")


def first_within(points: DataFrame, rows: DataFrame, seconds: int, value: str, fallback: float | None = None, on: str = "ts") -> DataFrame:
    """points (unique ts) with the earliest `value` of rows in [ts, ts + seconds), else the fallback; source tells which."""
    kept = points.columns
    met = F.struct(F.col(on).alias("at"), F.col(value).cast("double").alias("v"))
    found = _lookup(_both(points, rows.filter(F.col(value).isNotNull()), kept, on, [], met, PART), kept, on, [], ahead=True, strictly=False)
    soon = F.unix_micros(F.col("__v.at").cast("timestamp")) < F.unix_micros(F.col(on).cast("timestamp")) + seconds * 1_000_000
    v = F.when(soon, F.col("__v.v"))
    return found.select(*kept, F.coalesce(v, F.lit(fallback).cast("double")).alias("v"), F.when(v.isNotNull(), "measured").otherwise("fallback").alias("source"))


def following(points: DataFrame, rows: DataFrame, seconds: int, value: str, key: str, on: str = "ts", by: str = "sym") -> DataFrame:
    """points with o, h, l, c, n: first, highest, lowest and last `value` (by time, then key) of rows in (ts, ts + seconds], and their
    number; points without any are left out.

    Time is cut into blocks of that length, so what follows a point is the rest of its block and the beginning of the next one. Both are
    running values, backwards and forwards through a block: work grows with the rows, however many lie in a block.
    """
    kept = points.columns
    place = F.struct(F.unix_micros(F.col(on).cast("timestamp")).alias("t"), F.col(key).alias("k"))
    facts = {"first": F.min_by("__x", "__place"), "high": F.max("__x"), "low": F.min("__x"), "last": F.max_by("__x", "__place"), "n": F.count("__place")}
    micros = F.unix_micros(F.col(on).cast("timestamp"))
    width = seconds * 1_000_000
    data = rows.select(by, F.col(value).alias("__x"), place.alias("__place"), micros.alias("__t"), F.floor(micros / width).alias("__block"), F.lit(0).alias("__point"))
    asked = points.withColumn("__t", micros).withColumn("__block", F.floor(F.col("__t") / width)).withColumn("__point", F.lit(1))
    both = data.unionByName(asked, allowMissingColumns=True)
    # the rest of the block, strictly behind: backwards in time, by value of time
    rest = Window.partitionBy(by, "__block").orderBy(F.col("__t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    behind = both.select("*", F.struct(*(f.over(rest).alias(k) for k, f in facts.items())).alias("__rest")).filter("__point = 1").drop("__x", "__place")
    # the beginning of the next block, up to and with the end of the span
    again = data.unionByName(behind.withColumns({"__t": F.col("__t") + width, "__block": F.col("__block") + 1}), allowMissingColumns=True)
    head = Window.partitionBy(by, "__block").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = again.select("*", F.struct(*(f.over(head).alias(k) for k, f in facts.items())).alias("__head")).filter("__point = 1")
    r, h = (lambda k: F.col(f"__rest.{k}")), (lambda k: F.col(f"__head.{k}"))
    out = {"o": F.coalesce(r("first"), h("first")), "h": F.greatest(r("high"), h("high")), "l": F.least(r("low"), h("low")), "c": F.coalesce(h("last"), r("last")), "n": r("n") + h("n")}
    return ahead.select(*kept, *(x.alias(k) for k, x in out.items())).filter("n > 0")


def paired(bars: DataFrame, primary: str, reference: str) -> DataFrame:
    """The primary series with the reference's close as c2, on the bars that both have."""
    ref = bars.filter(F.col("sym") == reference).select("ts", F.col("c").alias("c2"))
    return bars.filter(F.col("sym") == primary).join(ref, "ts")


def overlaps(spans: DataFrame, episodes: DataFrame, seconds: int = 86_400 * 30) -> DataFrame:
    """Pairs of rows (start, end each) that share an instant, by time buckets, each pair once.

    A pair is made in the bucket of the later of the two starts only; both sides are spread over the buckets they touch.
    """
    cut = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    spread = lambda d, s, e: d.withColumn("b", F.explode(F.sequence(cut(s), cut(e))))
    a, b = spread(spans, "start", "end"), spread(episodes, "from_ts", "to_ts")
    met = a.join(b, "b").filter("start <= to_ts and end >= from_ts")
    return met.filter(F.col("b") == F.greatest(cut("start"), cut("from_ts"))).drop("b")
