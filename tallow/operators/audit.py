"""Audits and derivations over evidence tables: faults as rows, none where all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unequal(df: DataFrame, key: str, left: Column, right: Column, name: str, tolerance: float = 0.0) -> DataFrame:
    """check_name, key of rows whose two sides differ by more than the tolerance."""
    return df.filter(F.abs(left - right) > tolerance).select(F.lit(name).alias("check_name"), F.col(key).cast("string").alias("ref"))


def out_of_order(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows in which a time is not before the next one; one row a broken pair."""
    broken = lambda a, b: df.filter(F.col(a) > F.col(b)).select(F.lit(f"{a}>{b}").alias("check_name"), F.col(key).cast("string").alias("ref"))
    return reduce(DataFrame.unionByName, (broken(a, b) for a, b in zip(columns, columns[1:])))


def orphans(child: DataFrame, parent: DataFrame, foreign: str, primary: str) -> DataFrame:
    return child.filter(F.col(foreign).isNotNull()).join(parent.select(F.col(primary).alias(foreign)).distinct(), foreign, "left_anti")


def difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys and side (missing or surplus) of two sets."""
    a, b = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    missing = a.join(b, keys, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("surplus")))


def outcome(gross: Column, net: Column, r: Column) -> Column:
    return F.when((gross > 0) & (net <= 0), "cost_churn").when(r >= 2, "top_winner").when(net > 0, "normal_winner").when(r <= -1, "tail_loser").otherwise("small_loser")


def chart_rows(equity: DataFrame) -> DataFrame:
    """seq, series_name, ts, value: two rows a point, numbered 2k - 1 and 2k by the point's number."""
    two = F.explode(F.array(F.struct(F.lit("equity").alias("s"), F.col("equity").alias("v"), F.lit(1).alias("k")), F.struct(F.lit("drawdown").alias("s"), F.col("drawdown").alias("v"), F.lit(0).alias("k"))))
    return equity.select("seq", "ts", two.alias("x")).select((F.col("seq") * 2 - F.col("x.k")).alias("seq"), F.col("x.s").alias("series_name"), "ts", F.col("x.v").alias("value"))


def episodes(equity: DataFrame, kind: str = "drawdown", by: str = "sym", order: str = "seq", rows_a_part: int = 1 << 16) -> DataFrame:
    """by, anchor, first, last, recovery (orders; null while open), depth of runs below the running peak (or above the running trough).

    Anchor: first row of the plateau before the run; recovery: the first row back at the anchor's level. A series is cut into
    parts of rows_a_part numbers of `order`; a part starts with the peak, the last value, the plateau and the run
    that the parts before it leave, a row a part each, so that no window is longer than a part.
    """
    sign = 1 if kind == "drawdown" else -1
    at = Window.partitionBy(by, "part").orderBy(order)
    past, parts = at.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by).orderBy("part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    e = equity.withColumn("v", F.col("equity") * sign).withColumn("part", F.floor(F.col(order) / rows_a_part))
    edges = e.groupBy(by, "part").agg(F.max("v").alias("top"), F.max_by("v", order).alias("end"), F.min(order).alias("start"))
    edges = edges.select(by, "part", F.max("top").over(before).alias("peak_in"), F.lag("end").over(parts).alias("v_in"), F.lead("start").over(parts).alias("start_out"))
    e = e.join(edges, [by, "part"]).withColumn("peak", F.greatest(F.max("v").over(past), F.col("peak_in")))
    e = e.withColumn("under", (F.col("v") < F.col("peak")).cast("int"))
    e = e.withColumn("peak_was", F.coalesce(F.lag("peak").over(at), F.col("peak_in")))
    e = e.withColumn("was_under", F.coalesce(F.lag("under").over(at), (F.col("v_in") < F.col("peak_in")).cast("int"), F.lit(0)))
    # a plateau begins at a row at the peak that the row before is not on, or that ends a run
    fresh = (F.col("under") == 0) & ((F.col("was_under") == 1) | F.col("peak_was").isNull() | (F.col("peak") > F.col("peak_was")))
    e = e.withColumn("fresh", F.when(fresh, F.col(order))).withColumn("begun", F.when((F.col("under") == 1) & (F.col("was_under") == 0), F.col(order)))
    left = e.groupBy(by, "part").agg(F.max("fresh").alias("fresh"), F.max("begun").alias("begun"))
    left = left.select(by, "part", F.max("fresh").over(before).alias("anchor_in"), F.max("begun").over(before).alias("run_in"))
    e = e.join(left, [by, "part"]).withColumn("anchor", F.coalesce(F.max("fresh").over(past), F.col("anchor_in"))).withColumn("run", F.coalesce(F.max("begun").over(past), F.col("run_in")))
    e = e.withColumn("next", F.coalesce(F.lead(order).over(at), F.col("start_out")))
    g = e.filter("under = 1").groupBy(by, "run").agg(F.min("anchor").alias("anchor"), F.min(order).alias("first"), F.max(order).alias("last"), F.max_by("next", order).alias("recovery"), F.first("peak").alias("level"), F.min("v").alias("low"), F.min_by(order, F.struct("v", order)).alias("extreme"))
    return g.withColumn("depth", F.round(F.try_divide(F.abs(F.col("low") - F.col("level")), F.abs("level")), 9)).select(by, "anchor", "first", "extreme", "last", "recovery", "depth")


# ---- of a simulation's journal: each gives the rows at fault


def lagging(journal: DataFrame, most_seconds: float) -> DataFrame:
    """Fills later than most_seconds after their decision."""
    lag = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("decision_ts").cast("timestamp"))
    return journal.filter("kind = 'fill'").withColumn("lag_ms", F.floor(lag / 1000)).filter(F.col("lag_ms") > most_seconds * 1000).select("run_id", "sym", "seq", "reason", "lag_ms")


def undecided(journal: DataFrame) -> DataFrame:
    """Fills without a decision that are not the end of the data."""
    return journal.filter("kind = 'fill' and decision_ts is null and reason is distinct from 'END_OF_DATA'").select("run_id", "sym", "seq", "reason")


def costs_not_once(trades: DataFrame, journal: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Trades whose fees or slippage are not those of their fills."""
    of = journal.filter("kind = 'fill'").groupBy("run_id", "sym", "trade_id").agg(F.sum("fee").alias("own_fees"), F.sum("slippage").alias("own_slippage"))
    both = trades.join(of, ["run_id", "sym", "trade_id"], "left")
    off = lambda a, b: F.abs(F.col(a) - F.coalesce(b, F.lit(0.0))) > tolerance
    return both.filter(off("fees", "own_fees") | off("slippage", "own_slippage")).select("run_id", "sym", "trade_id")


def slippage_off(journal: DataFrame, unit: float = 1e-8) -> DataFrame:
    """Fills whose slippage is not price against reference times quantity, to what rounding the price may cost."""
    f = journal.filter("kind = 'fill'")
    return f.filter(F.abs(F.abs(F.col("price") - F.col("reference")) * F.col("quantity") - F.col("slippage")) > (F.col("quantity") + 1) * unit).select("run_id", "sym", "seq")


def funding_off(trades: DataFrame, journal: DataFrame) -> DataFrame:
    """run_id, sym, trade_id, at, fault of the funding times in (entry, exit] that are not paid, of payments at other times,
    and of payments whose sign is not that of side and rate."""
    step = 8 * 3600
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    first, last = F.floor(second("entry_ts") / step) + 1, F.floor(second("exit_ts") / step)
    due = trades.select("run_id", "sym", "trade_id", F.explode(F.when(first <= last, F.sequence(first, last))).alias("k"))
    paid = journal.filter("kind = 'funding'").select("run_id", "sym", "trade_id", F.floor(second("ts") / step).alias("k"), (F.signum("amount") * F.signum(F.col("side") * F.col("rate")) < 0).alias("wrong"), F.lit(True).alias("there"))
    both = due.withColumn("due", F.lit(True)).join(paid, ["run_id", "sym", "trade_id", "k"], "full")
    fault = F.when(F.col("there").isNull(), "not_paid").when(F.col("due").isNull(), "not_due").when(F.col("wrong"), "wrong_sign")
    return both.withColumn("fault", fault).filter("fault is not null").select("run_id", "sym", "trade_id", F.timestamp_seconds(F.col("k") * step).cast("timestamp_ntz").alias("at"), "fault")


def net_off(trades: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Trades whose net is not gross less all costs."""
    return trades.filter(F.abs(F.col("net") - (F.col("gross") - F.col("fees") - F.col("slippage") - F.col("funding"))) > tolerance).select("run_id", "sym", "trade_id")


def phases(trades: DataFrame, extremes: DataFrame) -> DataFrame:
    """run_id, sym, trade_id, phase, ts, r: entry, exit, and the worst and best of each trade (of the entry, if no bar followed)."""
    t = trades.join(extremes, ["run_id", "sym", "trade_id"], "left")
    one = lambda name, ts, r: F.struct(F.lit(name).alias("phase"), ts.alias("ts"), r.cast("double").alias("r"))
    r = lambda c: F.col(c) / F.nullif(F.col("r0"), F.lit(0.0))
    four = F.array(one("entry", F.col("entry_ts"), F.lit(None)), one("exit", F.col("exit_ts"), F.lit(None)), one("mae", F.coalesce("mae_ts", "entry_ts"), r("mae")), one("mfe", F.coalesce("mfe_ts", "entry_ts"), r("mfe")))
    return t.select("run_id", "sym", "trade_id", F.explode(four).alias("x")).select("run_id", "sym", "trade_id", "x.*")


def phases_missing(trades: DataFrame, found: DataFrame) -> DataFrame:
    """Trades with the phases that they lack."""
    have = found.groupBy("run_id", "sym", "trade_id").agg(F.collect_set("phase").alias("have"))
    lacking = F.array_except(F.array(*map(F.lit, ("entry", "exit", "mae", "mfe"))), F.coalesce("have", F.array().cast("array<string>")))
    return trades.join(have, ["run_id", "sym", "trade_id"], "left").withColumn("lacking", F.array_join(F.array_sort(lacking), ",")).filter("lacking <> ''").select("run_id", "sym", "trade_id", "lacking")


def snapshot_off(snapshot: DataFrame, actual: DataFrame) -> DataFrame:
    """sym, fault of a table of sources (sym, bars, expected, missing, coverage) that does not agree with itself or with the
    same made from the bars."""
    a = actual.select("sym", F.col("bars").alias("own_bars"), F.col("coverage").alias("own_coverage"))
    faults = [("count", F.col("bars") + F.col("missing") != F.col("expected")), ("coverage", F.abs(F.col("coverage") - F.least(F.lit(1.0), F.round(F.col("bars") / F.col("expected"), 6))) > 1e-9), ("rows", F.col("own_bars").isNull() | (F.col("bars") != F.col("own_bars"))), ("source", F.col("bars") <= 0)]
    named = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in faults)))
    return snapshot.join(a, "sym", "left").withColumn("fault", F.explode(named)).select("sym", "fault")


#: The checks that every run must pass, and one that counts where it was made.
REQUIRED = ("accounting_identity", "timestamp_order", "cost_once", "net_of_cost", "deterministic", "evidence_complete")
OPTIONAL = ("trailing_parity",)


def integrity(runs: DataFrame, found: str = "checks") -> DataFrame:
    """runs (a map of check to boolean) with failed, the required ones that are not true and the optional ones that are
    false, in order, and passed."""
    c = F.col(found)
    bad = [F.when(~F.coalesce(c[n], F.lit(False)), F.lit(n)) for n in REQUIRED] + [F.when(F.map_contains_key(c, n) & ~F.coalesce(c[n], F.lit(False)), F.lit(n)) for n in OPTIONAL]
    failed = F.array_compact(F.array(*bad))
    return runs.withColumn("failed", F.array_join(failed, ",")).withColumn("passed", F.size(failed) == 0)


def orphaned(runs: DataFrame) -> DataFrame:
    """runs (status, config_hash): those that run without a hash have lost their process."""
    return runs.withColumn("status", F.when((F.col("status") == "RUNNING") & F.col("config_hash").isNull(), "ORPHANED").otherwise(F.col("status")))


def checks(journal: DataFrame, trades: DataFrame, bar_seconds: int) -> DataFrame:
    """check_name, passed, sample_ref of a journal."""
    e = journal.filter("kind = 'equity'")
    ref = F.concat_ws("/", *(F.col(c).cast("string") for c in ("run_id", "sym")))
    none = lambda df, name, key: df.select(F.lit(name).alias("check_name"), F.concat_ws("/", ref, F.col(key).cast("string")).alias("ref"))
    found = [
        none(e.filter("abs(cash + margin + unrealized - equity) > 1e-7"), "accounting_identity", "seq"),
        none(lagging(journal, bar_seconds), "timestamp_order", "seq"),
        none(undecided(journal), "timestamp_order", "seq"),
        none(costs_not_once(trades, journal), "cost_once", "trade_id"),
        none(slippage_off(journal), "cost_once", "seq"),
        none(funding_off(trades, journal), "cost_once", "trade_id"),
        none(net_off(trades), "net_of_cost", "trade_id"),
    ]
    faults = reduce(DataFrame.unionByName, found).groupBy("check_name").agg(F.min("ref").alias("sample_ref"))
    names = journal.sparkSession.createDataFrame([(n,) for n in REQUIRED[:4]], "check_name string")
    return names.join(F.broadcast(faults), "check_name", "left").select("check_name", F.col("sample_ref").isNull().alias("passed"), "sample_ref")
