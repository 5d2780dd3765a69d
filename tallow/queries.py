"""The queries over the input tables by inventory ID, and the same as DuckDB SQL.

Statements that read alike in both dialects are kept once, with {table} for the input tables.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import replay
from .functions import numbers
from .operators import align, audit, catalog, gaps, hashtree, indicators, metrics, money, patterns, quantiles, resample, resampling, simulate
from .plans.layers import Average, Plan, as_sql, on_spark
from .session import ship
from .sources import bars as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BARS = sources.hourly_sql()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def statement(name: str, text: str, spark_text: str | None = None) -> None:
    """A statement of both dialects (or Spark's own reading of it)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = spark_text or text
        frames = {t: sources.table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in s}
        if "{bars}" in s:
            frames["bars"] = sources.hourly(spark, sf_dir)
        return spark.sql(s, **frames)

    QUERIES[name] = run
    duck = text.replace("{bars}", f"({BARS})")
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", duck)


def _split(columns: str) -> list[str]:
    """A list of SQL columns as expressions, cut at commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for ch in columns:
        quoted ^= ch == "'"
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


# ---- indicators and patterns


def _series_query(name: str, plan: Plan, paired: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = sources.hourly(spark, sf_dir)
        return on_spark(plan, align.paired(bars, "view", "click") if paired else bars)

    QUERIES[name] = run
    if plan.in_sql():
        source = f"select a.*, b.c as c2 from ({BARS}) a join ({BARS}) b on a.ts = b.ts where a.sym = 'view' and b.sym = 'click'" if paired else BARS
        ORACLES[name] = as_sql(plan, source)


_PRIMITIVES = {"prm_sma": "prm_01", "prm_rma": "prm_03", "prm_wma": "prm_05", "prm_tr": "prm_06", "prm_prices": "prm_07", "prm_stdev": "prm_08", "prm_hh_ll": "prm_09", "prm_cumulative": "prm_10", "prm_mom": "prm_11", "prm_roc": "prm_12", "prm_linreg": "prm_13", "prm_publish_after": "prm_15", "prm_streak": "prm_16", "prm_percent_rank": "prm_17"}
for _name, _make in indicators.REGISTRY.items():
    if _name == "ema_":
        for _n in (9, 21, 55, 200):
            _series_query(f"ind_ema_{_n}", _make(_n))
        _series_query("ind_ema", _make(21))
        _series_query("prm_02", _make(10))
    else:
        _series_query(_PRIMITIVES.get(_name, f"ind_{_name}"), _make(), _name in indicators.PAIRED)
_series_query("prm_04", Plan(["value"]).scan(Average("value", "c", 5, 0.3)))
_series_query("prm_14", Plan(["value"]).add(value="case when v - 3 = 0 then 7e0 else c / (v - 3) end"))
for _name in patterns.NAMES:
    _series_query(f"pat_{_name}", patterns.plan((_name,)))
_series_query("pattern_all", patterns.plan(tuple(patterns.CONDITIONS)))


@query("prm_18")
def turtle_n(spark, sf_dir):
    """Average true range of complete days, by Wilder."""
    daily = resample.rolled_up(sources.hourly(spark, sf_dir), "1d").drop("n").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return on_spark(indicators.REGISTRY["atr"](20), daily)


ORACLES["prm_18"] = as_sql(indicators.REGISTRY["atr"](20), f"select sym, time_bucket(interval '1 day', ts, timestamp '1970-01-01') as ts, first(o order by ts) as o, max(h) as h, min(l) as l, last(c order by ts) as c, sum(v) as v from ({BARS}) group by 1, 2")

# ---- resampling, gaps, coverage

_FOUR = f"select sym, time_bucket(interval '4 hours', ts, timestamp '1970-01-01') as ts, first(o order by ts) as o, max(h) as h, min(l) as l, last(c order by ts) as c, sum(v) as v, count(*) as n from ({BARS}) group by 1, 2"


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query("res_01", f"select sym, ts, o, h, l, c, v from ({_FOUR}) where n = 4")
def res_01(spark, sf_dir):
    return _ntz(resample.confirmed(sources.hourly(spark, sf_dir), "1h", "4h"))


@query("res_02", f"select * from ({BARS})")
def res_02(spark, sf_dir):
    return sources.hourly(spark, sf_dir)


@query("res_03", f"select sym, ts, o, h, l, c, v, count(*) over () as total from ({_FOUR}) where n = 4 and ts < timestamp '2024-01-20 00:00:00'")
def res_03(spark, sf_dir):
    kept = resample.confirmed(sources.hourly(spark, sf_dir), "1h", "4h", boundary="2024-01-20 00:00:00")
    return _ntz(kept.join(F.broadcast(kept.agg(F.count("*").alias("total")))))


@query("res_04", f"select * from ({_FOUR})")
def res_04(spark, sf_dir):
    return _ntz(resample.rolled_up(sources.hourly(spark, sf_dir), "4h"))


_GRID = f"select sym, unnest(generate_series(a, b, interval '1 hour')) as ts from (select sym, min(ts) as a, max(ts) as b from ({BARS}) group by sym)"
_ABSENT = f"select g.sym, g.ts from ({_GRID}) g anti join ({BARS}) b on g.sym = b.sym and g.ts = b.ts"
_RANGES = f"select sym, min(ts) as first_ts, max(ts) as last_ts, count(*) as steps from (select *, epoch(ts) - 3600 * row_number() over (partition by sym order by ts) as island from ({_ABSENT})) group by sym, island"


@query("gap_01", f"select sym, ts, missing from (select sym, ts, ((epoch(ts) - epoch(lag(ts) over (partition by sym order by ts))) / 3600 - 1)::bigint as missing from ({BARS})) where missing > 0")
def gap_01(spark, sf_dir):
    return gaps.steps_missing(sources.hourly(spark, sf_dir), 3600)


@query("gap_02", "select event_type as sym, coalesce(sum((ts = p)::int), 0)::bigint as duplicates, coalesce(sum((ts < p)::int), 0)::bigint as regressions from (select event_type, ts, lag(ts) over (partition by event_type order by event_id) as p from events) group by event_type")
def gap_02(spark, sf_dir):
    return gaps.order_faults(sources.table(spark, sf_dir, "events").withColumnRenamed("event_type", "sym"), "event_id")


@query("gap_03", f"select sym, time_bucket(interval '4 hours', ts, timestamp '1970-01-01') as bucket, count(*) as missing, case when count(*) = 4 then 'normal' else 'partial' end as kind from ({_ABSENT}) group by 1, 2")
def gap_03(spark, sf_dir):
    return gaps.contract(sources.hourly(spark, sf_dir), 3600, 14_400)


@query("gap_04", _RANGES)
def gap_04(spark, sf_dir):
    return gaps.missing_ranges(sources.hourly(spark, sf_dir), 3600)


_LONGEST = f"select sym, max(steps) * 3600 as longest_gap from ({_RANGES}) group by sym"
_UNSEEN = f"select a.sym, count(*) as funding_missing, count(b.ts) as funding_unobservable from ({_ABSENT}) a left join ({_ABSENT}) b on a.sym = b.sym and b.ts = a.ts + interval '1 hour' where (epoch(a.ts)::bigint + 3600) % 28800 = 0 group by a.sym"
_SPAN = f"select sym, count(*) as bars, ((epoch(max(ts)) - epoch(min(ts))) / 3600 + 1)::bigint as expected, ((epoch(max(ts))::bigint + 3600) // 28800 - epoch(min(ts))::bigint // 28800)::bigint as funding_boundaries from ({BARS}) group by sym"


@query("gap_05", f"select sym, bars, expected, coalesce(longest_gap, 0)::bigint as longest_gap, greatest(expected - bars, 0) as missing, coverage, coverage >= 0.95 and coalesce(longest_gap, 0) <= 86400 as acceptable, funding_boundaries, coalesce(funding_missing, 0)::bigint as funding_missing, coalesce(funding_unobservable, 0)::bigint as funding_unobservable from (select *, least(1.0::double, round(bars / expected, 6)) as coverage from ({_SPAN})) left join ({_LONGEST}) using (sym) left join ({_UNSEEN}) using (sym)")
def gap_05(spark, sf_dir):
    """Coverage of each series, and the funding times whose price no bar tells."""
    return gaps.coverage(sources.hourly(spark, sf_dir), 3600)


_INVENTORY = f"select sym, min(ts) as available_from, max(ts) as available_to, count(*) as row_count from ({BARS}) group by sym"


@query("gap_06", _INVENTORY)
def gap_06(spark, sf_dir):
    return gaps.inventory(sources.hourly(spark, sf_dir))


statement("gap_07", "select sym, n, expected, greatest(0, expected - n) as missing, least(1e0, n / expected) as ratio from (select sym, count(*) as n, cast((max(hours) - min(hours)) + 1 as bigint) as expected from (select event_type as sym, floor(extract(epoch from ts) / 3600) as hours from {events}) t group by sym) u", "select sym, n, expected, greatest(0, expected - n) as missing, least(1e0, n / expected) as ratio from (select sym, count(*) as n, cast((max(hours) - min(hours)) + 1 as bigint) as expected from (select event_type as sym, floor(unix_seconds(cast(ts as timestamp)) / 3600) as hours from {events}) t group by sym) u")


@query("gap_08", f"select sym, ts from ({_ABSENT}) where ts > timestamp '2024-01-15 00:00:00'")
def gap_08(spark, sf_dir):
    """Absent hours not yet reported, those up to the high-water mark having been."""
    absent = gaps.absent(sources.hourly(spark, sf_dir), 3600)
    reported = absent.filter("ts <= timestamp_ntz '2024-01-15 00:00:00'")
    return catalog.inserted_if_absent(reported, absent, ["sym", "ts"])


# ---- sources and sinks

statement("src_01", "select event_id, ts, value from {events} where event_type = 'view' and ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-12 00:00:00'", "select event_id, ts, value from {events} where event_type = 'view' and ts >= timestamp_ntz '2024-01-05 00:00:00' and ts < timestamp_ntz '2024-01-12 00:00:00'")


@query("src_02", f"select sym, ts, o, h, l, c, v from ({_FOUR}) where n = 4 and sym = 'view' and ts + interval '4 hours' <= timestamp '2024-01-12 00:00:00'")
def src_02(spark, sf_dir):
    view = sources.hourly(spark, sf_dir).filter("sym = 'view'")
    return _ntz(resample.confirmed(view, "1h", "4h", boundary="2024-01-12 00:00:00"))


statement("src_03", "select event_type, count(*) as n, cast(sum(case when p is not null and ts <= p then 1 else 0 end) as bigint) as faults from (select event_type, ts, lag(ts) over (partition by event_type order by ts, event_id) as p from {events}) t group by event_type")
statement("src_04", "select event_id, event_type, value from {events} where event_id > 9000")
statement("src_05", "select event_type, max(ts) as latest from {events} group by event_type")
_EIGHTS = "select distinct time_bucket(interval '8 hours', ts, timestamp '1970-01-01') as ts from events"


def _within(value: str) -> str:
    return f"select ts, coalesce(v, 0.0001::double) as v, case when v is null then 'fallback' else 'measured' end as source from ({_EIGHTS}) p left join (select p.ts as at, first({value} order by e.ts) as v from ({_EIGHTS}) p join events e on e.ts >= p.ts and e.ts < p.ts + interval '900 seconds' where {value} is not null group by p.ts) m on m.at = p.ts"


def _lookup(spark, sf_dir, value: str):
    events = sources.table(spark, sf_dir, "events")
    points = events.select(resample.bucket("ts", 28_800).cast("timestamp_ntz").alias("ts")).distinct()
    return align.first_within(points, events.selectExpr("ts", f"{value} as x"), 900, "x", 0.0001)


@query("src_06", _within("value"))
def src_06(spark, sf_dir):
    return _lookup(spark, sf_dir, "value")


@query("src_07", _within("nullif(round(value), 0)"))
def src_07(spark, sf_dir):
    return _lookup(spark, sf_dir, "nullif(round(value), 0)")


statement("src_09", "select sym, ts, c from {bars} where ts + interval '1 hour' <= timestamp '2024-01-20 12:30:00'", "select sym, ts, c from {bars} where ts + interval '1 hour' <= timestamp_ntz '2024-01-20 12:30:00'")
statement("src_12", "select event_id, event_type from {events} where event_id > 5000 order by event_id limit 50")
_OLD, _NEW = "select o_orderkey, o_totalprice from orders where o_orderkey % 3 <> 0", "select o_orderkey, o_totalprice + 1 as o_totalprice from orders where o_orderkey % 2 = 0"


def _old_new(spark, sf_dir):
    o = sources.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)


@query("snk_01", f"select * from ({_NEW}) union all select * from ({_OLD}) a anti join ({_NEW}) b using (o_orderkey)")
def snk_01(spark, sf_dir):
    return catalog.upserted(*_old_new(spark, sf_dir), ["o_orderkey"])




@query("snk_03", f"select * from ({_NEW}) a anti join ({_OLD}) b using (o_orderkey)")
def snk_03(spark, sf_dir):
    return catalog.inserted_if_absent(*_old_new(spark, sf_dir), ["o_orderkey"])


@query("snk_08", f"select * from ({_FOUR}) where ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-12 00:00:00'")
def snk_08(spark, sf_dir):
    touched = sources.hourly(spark, sf_dir).filter("ts >= timestamp_ntz '2024-01-10 00:00:00' and ts < timestamp_ntz '2024-01-12 00:00:00'")
    return _ntz(resample.rolled_up(touched, "4h"))


@query("snk_09", _INVENTORY)
def snk_09(spark, sf_dir):
    bars, at = sources.hourly(spark, sf_dir), "timestamp_ntz '2024-01-15 00:00:00'"
    return gaps.merged_inventory(gaps.inventory(bars.filter(f"ts < {at}")), gaps.inventory(bars.filter(f"ts >= {at}")))



# ---- filters, projections, pages


@query("flt_01", "select * from orders where o_orderstatus = 'F' and o_totalprice >= 100000 and o_totalprice <= 300000")
def flt_01(spark, sf_dir):
    return catalog.matching(sources.table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": None}, {"o_totalprice": 100_000}, {"o_totalprice": 300_000})


@query("flt_02", "select event_id, value from events where event_id > 200 and event_type = 'click'")
def flt_02(spark, sf_dir):
    e = sources.table(spark, sf_dir, "events").filter("event_id > 200")
    return catalog.matching(e, {"event_type": "click", "user_id": None}).select("event_id", "value")


statement("flt_03", "select sym, ts from {bars} where ts + interval '1 hour' <= timestamp '2024-01-08 05:00:00'", "select sym, ts from {bars} where ts + interval '1 hour' <= timestamp_ntz '2024-01-08 05:00:00'")
_TS = {"spark": "timestamp_ntz", "duck": "timestamp"}
_SLICE = "select sym, ts, c, 'evaluation' as part from {{bars}} where ts >= {0} '2024-01-10 00:00:00' and ts + interval '1 hour' <= {0} '2024-01-12 00:00:00' union all select sym, ts, c, 'preload' as part from (select *, row_number() over (partition by sym order by ts desc) as back from {{bars}} where ts + interval '1 hour' <= {0} '2024-01-10 00:00:00') t where back <= 20"
statement("flt_04", _SLICE.format("timestamp").replace("{{", "{").replace("}}", "}"), _SLICE.format("timestamp_ntz").replace("{{", "{").replace("}}", "}"))


statement("prj_01", "select o_orderkey, o_orderstatus, o_totalprice from {orders}")
statement("prj_02", "select l_orderkey, l_linenumber, l_partkey, cast(cast(round(l_extendedprice * 100) as bigint) * 1000000 as bigint) as scaled, cast(cast(round(l_extendedprice * 100) as bigint) as decimal(28, 8)) / 100 = cast(l_extendedprice as decimal(28, 8)) as restored, l_linenumber = 1 as first_line from {lineitem}")
statement("prj_03", "select p_partkey, case when substr(p_name, 1, 4) = 'pat_' then null else p_retailprice end as value, case when substr(p_name, 1, 4) = 'pat_' then p_name end as value_json from {part}")


@query("pag_01", "select *, (select count(*) from orders) as total from (select o_orderkey, o_totalprice, o_orderdate from orders order by o_totalprice desc, o_orderkey desc limit 25 offset 50)")
def pag_01(spark, sf_dir):
    o = sources.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return catalog.offset_page(o, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").desc()], 25, 50)


@query("pag_02", "select event_id, event_type, value from events where event_id > 777 order by event_id limit 51")
def pag_02(spark, sf_dir):
    return catalog.keyset_page(sources.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id", 777, 50)


# ---- joins

statement("joi_01", "select c_custkey, c_name, o_orderkey, o_totalprice from {customer} left join {orders} on o_custkey = c_custkey")
statement("joi_02", "select c_custkey from {customer} where exists (select 1 from {orders} where o_custkey = c_custkey and o_orderstatus = 'P')")
statement("joi_03", "select c_custkey from {customer} left join (select distinct o_custkey from {orders} where o_orderstatus = 'P') o on o_custkey = c_custkey where o_custkey is null")
statement("joi_04", "select o_orderkey from {orders} where o_orderstatus <> 'P' and not exists (select 1 from {lineitem} where l_orderkey = o_orderkey)")
statement("joi_05", "select o_orderkey, l_linenumber, l_partkey, l_suppkey from {orders} join {lineitem} on l_orderkey = o_orderkey where l_shipdate > o_orderdate + interval '30 days'", "select o_orderkey, l_linenumber, l_partkey, l_suppkey from {orders} join {lineitem} on l_orderkey = o_orderkey where l_shipdate > o_orderdate + interval 30 days")
statement("joi_06", "select s.s_suppkey, coalesce(a.n_name, '') as home, coalesce(b.n_name, '') as other from {supplier} s left join {nation} a on a.n_nationkey = s.s_nationkey left join {nation} b on b.n_nationkey = s.s_nationkey + 1")
statement("joi_07", "select n_name, r_name from {nation} join {region} on r_regionkey = n_regionkey")
statement("joi_08", "select s_name, n_name from {supplier} join {nation} on n_nationkey = s_nationkey where s_acctbal > 0")
statement("joi_09", "select w.k from (values (1), (2), (3), (999999999), (1000000000)) as w(k) left join {orders} on o_orderkey = w.k where o_orderkey is null")
_SPANS = "select o_orderkey, o_orderdate as start, o_orderdate + interval '2 days' as \"end\" from orders"
_EPISODES = "select row_number() over (order by d) as episode, d as from_ts, d + interval '10 days' as to_ts from (select distinct o_orderdate as d from orders where extract(day from o_orderdate) = 1)"


@query("joi_10", f"select o_orderkey, start, \"end\", episode, from_ts, to_ts from ({_SPANS}) s join ({_EPISODES}) e on start <= to_ts and \"end\" >= from_ts")
def joi_10(spark, sf_dir):
    """Orders with the episodes that they overlap. Episodes are numbered in one task: there is one a month at most."""
    o = sources.table(spark, sf_dir, "orders")
    spans = o.selectExpr("o_orderkey", "o_orderdate as start", "o_orderdate + interval 2 days as end")
    days = o.filter("day(o_orderdate) = 1").selectExpr("o_orderdate as d").distinct()
    return align.overlaps(spans, days.selectExpr("row_number() over (order by d) as episode", "d as from_ts", "d + interval 10 days as to_ts").withColumn("episode", F.col("episode").cast("bigint")))


@query("joi_11", f"select b.sym, b.ts, b.c, d.c as wide from ({BARS}) b asof left join (select sym, ts + interval '4 hours' as ts, c from ({_FOUR}) where n = 4) d on b.sym = d.sym and b.ts >= d.ts")
def joi_11(spark, sf_dir):
    bars = sources.hourly(spark, sf_dir)
    wide = _ntz(resample.confirmed(bars, "1h", "4h").selectExpr("sym", "ts + interval 4 hours as ts", "c as wide"))
    return align.as_of(bars.select("sym", "ts", "c"), wide, "wide")


@query("joi_12", f"select a.sym, a.ts, a.c, b.c as c2 from ({BARS}) a join ({BARS}) b on a.ts = b.ts where a.sym = 'view' and b.sym = 'click'")
def joi_12(spark, sf_dir):
    return align.paired(sources.hourly(spark, sf_dir), "view", "click").select("sym", "ts", "c", "c2")


@query("joi_13", f"select e.event_type as sym, e.event_id, e.ts, b.ts as next_ts, b.o as next_o from events e asof left join ({BARS}) b on e.event_type = b.sym and e.ts < b.ts")
def joi_13(spark, sf_dir):
    e = sources.table(spark, sf_dir, "events").selectExpr("event_type as sym", "event_id", "ts")
    return align.next_bar(e, sources.hourly(spark, sf_dir))


@query("joi_14", "select e.event_id, first(t.value order by t.ts, t.event_id) as o, max(t.value) as h, min(t.value) as l, last(t.value order by t.ts, t.event_id) as c, count(*) as n from events e join events t on t.event_type = e.event_type and t.ts > e.ts and t.ts <= e.ts + interval '1 hour' group by e.event_id")
def joi_14(spark, sf_dir):
    """The candle of the hour after each signal."""
    e = sources.table(spark, sf_dir, "events")
    signals = e.select("event_id", "event_type", "ts")
    return align.following(signals, e, 3600, "value", "event_id", by="event_type").select("event_id", "o", "h", "l", "c", "n")


statement("joi_15", "select e.event_id, b.c from {events} e join {bars} b on b.sym = e.event_type and b.ts = date_trunc('hour', e.ts)")


@query("joi_16", "select w.position, o.o_orderkey, o.o_totalprice from (values (0::bigint, 30), (1, 10), (2, 20)) as w(position, k) join orders o on o.o_orderkey = w.k")
def joi_16(spark, sf_dir):
    return catalog.compared(sources.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", [30, 10, 20]).select("position", F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_totalprice")


statement("joi_17", "select n_name, x.c_custkey, x.c_acctbal from {nation} n, lateral (select c_custkey, c_acctbal from {customer} c where c.c_nationkey = n.n_nationkey order by c_acctbal desc, c_custkey limit 1) x")
statement("joi_18", "select p_partkey, m.k from {part} left join (select k2, min(k) as k from (select l_partkey as k2, l_orderkey as k from {lineitem} where l_returnflag = 'A' union all select l_partkey as k2, l_orderkey as k from {lineitem} where l_returnflag = 'R') u group by k2) m on m.k2 = p_partkey")

# ---- aggregations


@query("agg_01", "select 'c_mktsegment' as kind, c_mktsegment as value, count(*) as n from customer group by all union all select 'c_nationkey', c_nationkey::varchar, count(*) from customer group by all")
def agg_01(spark, sf_dir):
    return catalog.facets(sources.table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


statement("agg_02", "select event_type, min(ts) as a, max(ts) as b, count(*) as n from {events} group by event_type")
statement("agg_03", "select event_type, min_by(value, event_id) as first_value, max_by(value, event_id) as last_value from {events} group by event_type")
statement("agg_04", "select l_returnflag, l_linestatus, case when count(x) = count(*) then sum(x) end as strict_sum, cast(sum(x) as bigint) as loose_sum from (select l_returnflag, l_linestatus, case when l_returnflag = 'A' and l_quantity = 7 then null else cast(l_quantity as bigint) end as x from {lineitem}) t group by l_returnflag, l_linestatus")
statement("agg_05", "select o_orderstatus, bool_and(o_totalprice > 1000) as every, bool_or(o_totalprice > 400000) as some from {orders} group by o_orderstatus")
statement("agg_06", "select sym, min_by(o, ts) as first_o, max_by(c, ts) as last_c from {bars} group by sym")
_TRADES = "select o_orderkey as trade_id, o_orderdate as ts, o_totalprice - 250000 as net, 10000e0 as r0 from orders"


def _trades(spark, sf_dir):
    return sources.table(spark, sf_dir, "orders").selectExpr("o_orderkey as trade_id", "o_orderdate as ts", "o_totalprice - 250000 as net", "10000D as r0")


_CENTS = "1000000000000 + sum(cast(round(o_totalprice * 100) as bigint) - 25000000) over (order by o_orderdate, o_orderkey rows unbounded preceding)"
_EQUITY = f"select o_orderkey as seq, o_orderdate as ts, ({_CENTS}) / 100e0 as equity from orders"


def _equity(spark, sf_dir):
    """A running balance: sums by day first, then within the day."""
    o = sources.table(spark, sf_dir, "orders").selectExpr("o_orderkey as seq", "o_orderdate as ts", "cast(round(o_totalprice * 100) as bigint) - 25000000 as cents")
    days = o.groupBy("ts").agg(F.sum("cents").alias("day")).selectExpr("ts", "sum(day) over (order by ts rows between unbounded preceding and 1 preceding) as before")
    return o.join(F.broadcast(days), "ts").selectExpr("seq", "ts", "(1000000000000 + coalesce(before, 0) + sum(cents) over (partition by ts order by seq rows unbounded preceding)) / 100D as equity")


_OF_TRADES = f"select count(*) as trade_count, avg((net > 0)::int) as win_rate, sum(net) filter (net > 0) / sum(-net) filter (net < 0) as pf, avg(net) filter (net > 0) / avg(-net) filter (net < 0) as payoff, avg(net / r0) as expectancy_r, sqrt(least(count(*), 100)) * avg(net / r0) / stddev_samp(net / r0) as sqn from ({_TRADES})"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("agg_08", f"select trade_count, round(win_rate, 6) as win_rate, round(pf, 6) as pf, round(payoff, 6) as payoff, round(win_rate - (1 - win_rate) / payoff, 6) as kelly, round(expectancy_r, 6) as expectancy_r, round(sqn, 6) as sqn from ({_OF_TRADES})")
def agg_08(spark, sf_dir):
    return _rounded(metrics.of_trades(_trades(spark, sf_dir)))


#: Groups with and without losses, with few trades and with many, and trades without an initial risk.
_GROUPED = "o_orderkey as trade_id, case when o_orderpriority = '5-LOW' then abs(o_totalprice - 250000) else o_totalprice - 250000 end as net, case when o_orderkey % 10 = 0 then 0e0 else 10000e0 end as r0, o_orderpriority, o_custkey % 600 as book"


def _grouped(spark, sf_dir):
    return sources.table(spark, sf_dir, "orders").selectExpr(*_split(_GROUPED))


@query("met_01", f"select o_orderpriority, round(win_rate, 6) as win_rate, lost is null as unbounded, round(won / lost, 6) as pf, round(mean_won / mean_lost, 6) as payoff from (select o_orderpriority, avg((net > 0)::int) as win_rate, sum(net) filter (net > 0) as won, sum(-net) filter (net < 0) as lost, avg(net) filter (net > 0) as mean_won, avg(-net) filter (net < 0) as mean_lost from (select {_GROUPED} from orders) group by 1)")
def met_01(spark, sf_dir):
    """Profit factor and payoff; without a loss they are unbounded."""
    m = metrics.of_trades(_grouped(spark, sf_dir), "o_orderpriority")
    finite = lambda c: F.round(F.when(F.abs(c) != float("inf"), F.col(c)), 6).alias(c)
    return m.select("o_orderpriority", F.round("win_rate", 6).alias("win_rate"), (F.col("pf") == float("inf")).alias("unbounded"), finite("pf"), finite("payoff"))


@query("met_07", f"select trade_id, case when r0 > 0 then round(net / r0, 9) end as r from (select {_GROUPED} from orders)")
def met_07(spark, sf_dir):
    return metrics.r_multiples(_grouped(spark, sf_dir)).select("trade_id", F.round("r", 9).alias("r"))


@query("met_08", f"select book, case when n >= 30 then round(sqrt(least(n, 100)) * m / sd, 6) end as sqn from (select book, count(r) as n, avg(r) as m, stddev_samp(r) as sd from (select book, case when r0 > 0 then net / r0 end as r from (select {_GROUPED} from orders)) group by book)")
def met_08(spark, sf_dir):
    """System quality of books of some 25 trades; none below 30."""
    return metrics.of_trades(_grouped(spark, sf_dir), "book").select("book", F.round("sqn", 6).alias("sqn"))


@query("met_09", f"select book, case when lost > 0 and won > 0 then round(w - (1 - w) / (won / lost), 6) when lost > 0 then null else round(w, 6) end as kelly from (select book, avg((net > 0)::int) as w, coalesce(avg(net) filter (net > 0), 0) as won, coalesce(avg(-net) filter (net < 0), 0) as lost from (select {_GROUPED} from orders) group by book)")
def met_09(spark, sf_dir):
    return metrics.of_trades(_grouped(spark, sf_dir), "book").select("book", F.round("kelly", 6).alias("kelly"))


_DAILY = f"select ts::date as day, last(equity order by ts, seq) as equity from ({_EQUITY}) group by 1"
_RETURNS = f"select day, equity / lag(equity) over (order by day) - 1 as r from ({_DAILY}) qualify r is not null"


@query("agg_09", _DAILY)
def agg_09(spark, sf_dir):
    return metrics.daily(_equity(spark, sf_dir), ("ts", "seq"))


@query("agg_10", "select o_orderstatus, quantile_cont(o_totalprice, 0.05) as p05, quantile_cont(o_totalprice, 0.95) as p95 from orders group by o_orderstatus")
def agg_10(spark, sf_dir):
    return quantiles.exact_quantiles(sources.table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", {"p05": 0.05, "p95": 0.95}, few=512)


_BIN = "case when x < 0 or x > 500000 then -1 when x = 500000 then 9 else cast(floor(x / 50000) as int) end"
statement("agg_11", f"select {_BIN} as bin, count(*) as n from (select o_totalprice as x from {{orders}}) t group by 1")
statement("agg_12", "select o_orderpriority, count(*) as n from {orders} group by o_orderpriority")
statement("agg_13", "select max(p_retailprice) as best, min(p_retailprice) as worst, max(p_size) as most from {part}")


@query("agg_14", "select 'k' as name, count(distinct json_extract_string(props, '$.k')) as \"values\" from events")
def agg_14(spark, sf_dir):
    return catalog.varied(sources.table(spark, sf_dir, "events"), "event_id", "props")


statement("agg_15", "select p_brand, max(case when p_size <= 10 then p_retailprice end) as small, max(case when p_size between 11 and 30 then p_retailprice end) as medium, max(case when p_size > 30 then p_retailprice end) as large from {part} group by p_brand", "select * from (select p_brand, p_retailprice, case when p_size <= 10 then 'small' when p_size <= 30 then 'medium' else 'large' end as size from {part}) pivot (max(p_retailprice) for size in ('small', 'medium', 'large'))")
statement("agg_16", "select event_type, min_by(event_id, value * 1000000 + event_id) as at, min(value) as depth from {events} group by event_type", "select event_type, min_by(event_id, value * 1000000 + event_id) as at, min(value) as depth from {events} group by event_type")
statement("agg_17", "select event_type, date_trunc('second', ts) as ts, max_by(value, event_id) as value from {events} group by event_type, date_trunc('second', ts)")


_ORDER_ROW, _EVENT_ROW = ["o_orderkey", "o_custkey", "o_orderpriority"], ["event_id", "user_id", "props"]


def _text(columns: list[str]) -> str:
    return " || chr(31) || ".join(f"coalesce({c}::varchar, '')" for c in columns)


@query("agg_18", hashtree.as_sql("orders", _text(_ORDER_ROW), "o_orderstatus", 64))
def agg_18(spark, sf_dir):
    return hashtree.content_hash(sources.table(spark, sf_dir, "orders"), _ORDER_ROW, "o_orderstatus", 64)


@query("agg_19", hashtree.as_sql("events", _text(_EVENT_ROW), "event_type", 64))
def agg_19(spark, sf_dir):
    return hashtree.content_hash(sources.table(spark, sf_dir, "events"), _EVENT_ROW, "event_type", 64)


@query("aud_14_difference", "select event_type, event_id, user_id, case event_id % 3 when 0 then 1 when 1 then -1 else 2 end::bigint as surplus from events where event_id % 1999 = 7 and event_id % 3 < 2 union all select event_type, event_id, user_id + 1, -1 from events where event_id % 1999 = 7 and event_id % 3 = 2 union all select event_type, event_id, user_id, 1 from events where event_id % 1999 = 7 and event_id % 3 = 2")
def aud_14_difference(spark, sf_dir):
    """Two tables of events that differ in rows left out, repeated or changed here and there: found by their trees."""
    a = sources.table(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    odd = "event_id % 1999 = 7"
    changed = a.filter(f"{odd} and event_id % 3 = 2").withColumn("user_id", F.col("user_id") + 1)
    b = a.filter(f"not ({odd} and event_id % 3 <> 1)").unionByName(changed).unionByName(a.filter(f"{odd} and event_id % 3 = 1"))
    return hashtree.difference(a, b, ["event_type", "event_id", "user_id"], "event_type", 64)


statement("agg_20", "select o_orderstatus, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') as priorities from {orders} group by o_orderstatus", "select o_orderstatus, array_join(sort_array(collect_set(o_orderpriority)), ',') as priorities from {orders} group by o_orderstatus")

# ---- metrics and validation


@query("met_02", f"select round(sqrt(365) * avg(r) / stddev_samp(r), 6) as sharpe, round(sqrt(365) * avg(r) / sqrt(avg(power(least(r, 0), 2))), 6) as sortino from ({_RETURNS})")
def met_02(spark, sf_dir):
    return _rounded(metrics.of_returns(metrics.daily_returns(_equity(spark, sf_dir), ("ts", "seq"))))


@query("met_03", f"select round(sqrt(365) * (avg(r) - 0.0001) / sqrt(avg(power(least(r - 0.0001, 0), 2))), 6) as sortino from ({_RETURNS})")
def met_03(spark, sf_dir):
    """Sortino against a target of one ten-thousandth a day."""
    return _rounded(metrics.of_returns(metrics.daily_returns(_equity(spark, sf_dir), ("ts", "seq")), 0.0001).select("sortino"))


_DRAWN = "select *, equity / max(equity) over (order by ts, seq rows unbounded preceding) - 1 as d from ({0})"
_OF_D = "select round(mdd, 9) as mdd, round(ulcer, 6) as ulcer, round(cagr, 9) as cagr, round(cagr / abs(mdd), 6) as mar from (select min(d) as mdd, sqrt(avg(power(100 * d, 2))) as ulcer, power(last(equity order by ts, seq) / first(equity order by ts, seq), 1 / ((epoch(max(ts)) - epoch(min(ts))) / 31536000)) - 1 as cagr from ({0}))"


@query("met_04", _OF_D.format(_DRAWN.format(_EQUITY)))
def met_04(spark, sf_dir):
    d = metrics.of_drawdowns(_equity(spark, sf_dir), ("ts", "seq"))
    return d.select(F.round("mdd", 9).alias("mdd"), F.round("ulcer", 6).alias("ulcer"), F.round("cagr", 9).alias("cagr"), F.round("mar", 6).alias("mar"))


@query("met_05", f"select part, case when t1 > t0 then round(power(b / a, 1 / ((epoch(t1) - epoch(t0)) / 31536000)) - 1, 9) end as cagr from (select date_trunc('year', ts)::timestamp as part, first(equity order by ts, seq) as a, last(equity order by ts, seq) as b, min(ts) as t0, max(ts) as t1 from ({_EQUITY}) group by 1)")
def met_05(spark, sf_dir):
    """Growth of every year."""
    g = metrics.growth(_equity(spark, sf_dir), ("ts", "seq"))
    return g.select(F.col("part").cast("timestamp_ntz").alias("part"), F.round("cagr", 9).alias("cagr"))


_LATE = f"select * from ({_EQUITY}) where ts >= (select max(o_orderdate) - interval '3 years' from orders)"


@query("met_06", f"select mar as calmar from ({_OF_D.format(_DRAWN.format(_LATE))})")
def met_06(spark, sf_dir):
    return _rounded(metrics.calmar(_equity(spark, sf_dir), ("ts", "seq")))


def _multiples(trades: DataFrame, run) -> DataFrame:
    """run_id, trade_id, r: the R multiples of each run."""
    return trades.select(run.alias("run_id"), "trade_id", (F.col("net") / F.col("r0")).alias("r"))


@query("met_10")
def met_10(spark, sf_dir):
    """Risk of ruin: paths end where they are ruined."""
    return resampling.risk_of_ruin(_multiples(_trades(spark, sf_dir), F.lit("run")))


@query("val_03")
def val_03(spark, sf_dir):
    return resampling.monte_carlo(_multiples(_trades(spark, sf_dir), F.date_format("ts", "yyyy")))


_CELLS = "select o_custkey % 10 as cell, count(*) as trade_count, sum(case when o_totalprice > 250000 then o_totalprice - 250000 end) / sum(case when o_totalprice < 250000 then 250000 - o_totalprice end) as pf, 1.5e0 as sortino, 0.9e0 as calmar, cast(null as double) as sqn, -0.1e0 as mdd, 0e0 as ror, 0.2e0 as expectancy_r from {0} group by 1"


@query("met_11", f"select cell, array_to_string(list_filter([case when trade_count < 30 then 'trade_count' end, case when coalesce(pf < 1.3, true) then 'pf' end, 'sqn'], lambda x: x is not null), ',') as failed, false as passed from ({_CELLS.format('orders')})")
def met_11(spark, sf_dir):
    cells = spark.sql(_CELLS.format("{orders}"), orders=sources.table(spark, sf_dir, "orders"))
    return metrics.gate(cells).select("cell", F.array_join("failed", ",").alias("failed"), "passed")


statement_metrics = "select o_orderpriority, avg(case when o_totalprice > 250000 then 1 else 0 end) as win_rate, avg(case when o_totalprice > 250000 then o_totalprice - 250000 end) / avg(case when o_totalprice < 250000 then 250000 - o_totalprice end) as payoff from {0} group by 1"


@query("met_12", f"select o_orderpriority, case when win_rate < 0.50 - 0.01 or win_rate > 0.52 + 0.01 or payoff < 0.95 - 0.01 or payoff > 1.0 + 0.01 then 'reject' else 'in_range' end as status from ({statement_metrics.format('orders')})")
def met_12(spark, sf_dir):
    m = spark.sql(statement_metrics.format("{orders}"), orders=sources.table(spark, sf_dir, "orders"))
    return metrics.envelope(m, (0.50, 0.52), (0.95, 1.0), 0.01, established=True).select("o_orderpriority", "status")


@query("met_13", f"select o_orderpriority, win_rate >= 0.5 and payoff >= 0.97 as passed from ({statement_metrics.format('orders')})")
def met_13(spark, sf_dir):
    """Both gates after each other on a table of metrics: thresholds, then the envelope."""
    m = spark.sql(statement_metrics.format("{orders}"), orders=sources.table(spark, sf_dir, "orders"))
    second = metrics.envelope(m.filter("win_rate >= 0.5"), (0.5, 1.0), (0.97, 100.0), 0.0, established=True).filter("status <> 'reject'")
    return m.join(second.select("o_orderpriority", F.lit(True).alias("ok")), "o_orderpriority", "left").select("o_orderpriority", F.coalesce("ok", F.lit(False)).alias("passed"))


@query("met_14", "select o_orderkey, case when o_totalprice >= 400000 then 'promote' when o_totalprice <= 50000 and o_custkey % 2 <> 0 then 'abandon' when o_totalprice <= 50000 then 'retest' else 'partial_keep' end as route from orders")
def met_14(spark, sf_dir):
    rows = sources.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice as observed_value", "400000D as success_threshold", "50000D as failure_threshold", "true as higher_is_better", "o_custkey % 2 = 0 as edge_distinguishable")
    return metrics.routed(rows).select("o_orderkey", "route")




@query("val_01", f"select segment, round(pf, 6) as pf from (select case when ts < timestamp '1999-01-01' then 'in' else 'out' end as segment, sum(net) filter (net > 0) / sum(-net) filter (net < 0) as pf from ({_TRADES}) group by 1)")
def val_01(spark, sf_dir):
    t = _trades(spark, sf_dir).withColumn("segment", F.when(F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz"), "in").otherwise("out"))
    net = F.col("net")
    return t.groupBy("segment").agg(F.round(F.sum(F.when(net > 0, net)) / F.sum(F.when(net < 0, -net)), 6).alias("pf"))


@query("val_02", f"select fold, trades, round(pf, 6) as pf, round(1 - round(pf, 6) / lag(round(pf, 6)) over (order by fold), 6) as degradation from (select least(floor((epoch_us(ts) - epoch_us(t0)) * 5 / (epoch_us(t1) - epoch_us(t0))), 4)::bigint as fold, count(*) as trades, sum(net) filter (net > 0) / sum(-net) filter (net < 0) as pf from ({_TRADES}), (select min(o_orderdate) as t0, max(o_orderdate) as t1 from orders) group by 1)")
def val_02(spark, sf_dir):
    return metrics.folds(_trades(spark, sf_dir), 5)


_PSR_T = "(1 / (1 + 0.2316419e0 * abs(z)))"
_PSR_UP = f"exp(-z * z / 2) / sqrt(2 * pi()) * {_PSR_T} * (0.319381530e0 + {_PSR_T} * (-0.356563782e0 + {_PSR_T} * (1.781477937e0 + {_PSR_T} * (-1.821255978e0 + {_PSR_T} * 1.330274429e0))))"


@query("val_04", f"with r as ({_RETURNS}), m as (select avg(r) as m, stddev_samp(r) as sd, count(*) as n from r), k as (select m, sd, n, avg(power((r - m) / sd, 3)) as skew, avg(power((r - m) / sd, 4)) as kurt from r, m group by m, sd, n), z as (select m / sd * sqrt(n - 1) / sqrt(1 - skew * (m / sd) + (kurt - 1) / 4 * power(m / sd, 2)) as z from k) select round(case when z >= 0 then 1 - {_PSR_UP} else {_PSR_UP} end, 6) as psr from z")
def val_04(spark, sf_dir):
    return _rounded(metrics.sharpe_probability(metrics.daily_returns(_equity(spark, sf_dir), ("ts", "seq"))))




@query("val_06")
def val_06(spark, sf_dir):
    f = metrics.folds(_trades(spark, sf_dir), 5).agg(F.to_json(F.array_sort(F.collect_list(F.struct("fold", "pf", "degradation")))).alias("folds"))
    p = metrics.sharpe_probability(metrics.daily_returns(_equity(spark, sf_dir), ("ts", "seq")))
    m = resampling.monte_carlo(_multiples(_trades(spark, sf_dir), F.lit("run"))).select("p05", "p95", "ruin")
    return f.crossJoin(_rounded(p)).crossJoin(m)


@query("val_07", "select a.x, b.y from (values (9), (21)) a(x), (values (21), (55), (200)) b(y) where a.x < b.y")
def val_07(spark, sf_dir):
    return spark.createDataFrame([(c["x"], c["y"]) for c in simulate.grid_of(x=[9, 21], y=[21, 55, 200]) if c["x"] < c["y"]], "x int, y int")


# ---- simulation


def _signals(spark, sf_dir):
    plan = indicators.Plan(["f", "s"]).scan(indicators.ema("f", "c", 9), indicators.ema("s", "c", 21))
    bars = sources.hourly(spark, sf_dir)
    ema = on_spark(plan, bars)
    return bars.join(ema, ["sym", "ts"]).selectExpr("sym", "ts", "o", "h", "l", "c", "case when s is null then null when f > s then 1 when f < s then -1 else 0 end as signal")


#: Stops near and far, leverage that the isolated margin bounds, and a risk above the limit.
_RUNS = {"base": simulate.Rules(), "wide": simulate.Rules(distance=0.05, reward=None), "levered": simulate.Rules(distance=0.004, leverage=5), "reckless": simulate.Rules(risk=0.02)}
_EMAS = Plan(["f", "s"]).scan(indicators.ema("f", "c", 9), indicators.ema("s", "c", 21))
_SIGNAL = "case when s is null then null when f > s then 1 when f < s then -1 else 0 end"
#: Measured funding rates of two thirds of the funding times.
_RATE = "((k % 5) - 1) / 10000e0"


def _journal(spark, sf_dir):
    bars = _signals(spark, sf_dir)
    times = bars.selectExpr("sym", "unix_seconds(cast(ts as timestamp)) + 3600 as t").filter("t % 28800 = 0").selectExpr("sym", "t div 28800 as k", "cast(timestamp_seconds(t) as timestamp_ntz) as at")
    rates = times.filter("k % 3 <> 0").selectExpr("sym", "at", "((k % 5) - 1) / 10000D as rate")
    return simulate.journal(simulate.with_rates(bars, rates, 3600), _RUNS)


_SOURCE = f"select sym, ts, o, h, l, c, {_SIGNAL} as signal, case when k % 3 <> 0 then {_RATE} end as rate from (select *, ((epoch(ts) + 3600) / 28800)::bigint as k from ({BARS}) join ({as_sql(_EMAS, BARS)}) using (sym, ts))"
_REPLAY = replay.steps(_SOURCE, _RUNS)
_AT = "make_timestamp((round({0}, 3) * 1000000)::bigint) as {1}"
_TRADE_COLUMNS = {"entry_ts": _AT.format("entry_t", "entry_ts"), "exit_ts": _AT.format("exit_t", "exit_ts"), "quantity": "round(quantity, 5) as quantity", "r0": "round(r0, 2) as r0"} | {c: f"round({c}, 4) as {c}" for c in ("entry_price", "exit_price", "entry_reference", "exit_reference")} | {c: f"round({c}, 2) + 0 as {c}" for c in ("gross", "fees", "slippage", "funding", "net")}


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as the SQL shows them: money to cents, prices to 4 places, quantities to 5."""
    digits = {"quantity": 5} | {c: 4 for c in ("entry_price", "exit_price", "entry_reference", "exit_reference", "reference", "price")}
    return df.select(*((F.round(c, digits.get(c, 2)) + 0.0).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in columns))


def _of_trades(name: str, *columns: str, where: str = "true") -> None:
    """A view of the simulated trades of all runs."""
    shown = ", ".join(_TRADE_COLUMNS.get(c, c) for c in columns)

    @query(name, f"{_REPLAY} select run_id, sym, trade_id, {shown} from trade where {where}")
    def view(spark, sf_dir):
        return _shown(simulate.trades(_journal(spark, sf_dir)).filter(where), "run_id", "sym", "trade_id", *columns)


_of_trades("sim_01", "side", "entry_ts", "entry_price", "quantity", "exit_ts", "exit_price", "exit_reason", "net")
_of_trades("sim_09", "quantity", "entry_price", "entry_reference", "r0")
_of_trades("sim_10", "side", "exit_ts", "exit_price", "exit_reason", where="exit_reason in ('STOP_LOSS', 'TAKE_PROFIT', 'LIQUIDATION')")
_of_trades("sim_14", "exit_ts", "exit_reference", "exit_price", "exit_reason", where="exit_reason in ('DATA_GAP', 'END_OF_DATA')")
_of_trades("sim_19", "gross", "fees", "slippage", "funding", "net", "r0")
_FILLS = "select run_id, sym, trade_id, 'entry' as action, null as reason, entry_t as \"at\", entry_reference as reference, entry_price as price, quantity, fee_in as fee, slip_in as slippage, false as gap, dts_in as dts, i from entry union all select g.run_id, g.sym, g.trade_id, 'exit', why, \"at\", ref, g.price, e.quantity, fee, slip, gap, dts, g.i from gone g join entry e using (run_id, sym, trade_id)"


@query("sim_02", f"{_REPLAY} select run_id, sym, trade_id, action, {_AT.format('"at"', 'ts')}, round(reference, 4) as reference, round(price, 4) as price, gap from ({_FILLS}) where (action = 'entry' or reason in ('SIGNAL', 'REVERSAL'))")
def sim_02(spark, sf_dir):
    """What happens at the open: orders of the close before, exits before entries."""
    fills = _journal(spark, sf_dir).filter("kind = 'fill' and (action = 'entry' or reason in ('SIGNAL', 'REVERSAL'))")
    return _shown(fills, "run_id", "sym", "trade_id", "action", "ts", "reference", "price", "gap")


@query("sim_03", f"{_REPLAY} select run_id, sym, {_AT.format('t + 3600', 'ts')}, act as action, signal as side from st where act in ('enter', 'reverse') union all select run_id, sym, {_AT.format('t + 3600', 'ts')}, act, x2side from st where act = 'exit'")
def sim_03(spark, sf_dir):
    """What is decided at the close."""
    return _journal(spark, sf_dir).filter("kind = 'decision' and action <> 'skip'").select("run_id", "sym", "ts", "action", "side")


_LEVELS = "event_id, value as price, case when event_id % 4 = 0 then null when event_id % 2 = 0 then value - 1 else value + 1 end as stop, case when event_id % 8 = 0 then null when event_id % 4 = 0 then value + 2 - event_id % 3 * 2 + 0.5 end as target, cast(event_id % 3 - 1 as int) as held"


@query("sim_04", f"select event_id, case when stop is null and target is null then 'exit' when held <> 0 and held <> wanted then 'reverse' else 'enter' end as action, case when stop is null and target is null then null else wanted end as side from (select *, case when stop is not null then case when stop < price then 1 else -1 end else case when target > price then 1 else -1 end end as wanted from (select {_LEVELS} from events))")
def sim_04(spark, sf_dir):
    e = sources.table(spark, sf_dir, "events").selectExpr(*_split(_LEVELS))
    return e.select("event_id", simulate.intent(F.col("price"), F.col("stop"), F.col("target"), F.col("held")).alias("i")).select("event_id", "i.action", "i.side")


@query("sim_05", f"{_REPLAY} select run_id, sym, act as action, coalesce(why, '') as reason, count(*) as n from (select run_id, sym, act, why from st where act is not null union all select run_id, sym, 'skip', 'available_margin' from st where refused) group by all")
def sim_05(spark, sf_dir):
    """Decisions by what came of them; skips by their reasons."""
    return _journal(spark, sf_dir).filter("kind = 'decision'").groupBy("run_id", "sym", "action", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


_ORDERS = "event_id as order_id, event_type as sym, ts, case event_id % 4 when 0 then 'market' when 1 then 'limit' when 2 then 'stop' else 'take_profit' end as kind, cast(1 - event_id % 2 * 2 as int) as side, floor(value * (0.9e0 + event_id % 5 * 0.05e0) * 100) / 100 as level, 1 + event_id % 9 as quantity"
_TRIGGER = "case when kind = 'market' then o when kind in ('limit', 'take_profit') and side > 0 and l <= level then least(o, level) when kind in ('limit', 'take_profit') and side < 0 and h >= level then greatest(o, level) when kind = 'stop' and side > 0 and h >= level then greatest(o, level) when kind = 'stop' and side < 0 and l <= level then least(o, level) end"


@query("sim_06", f"select order_id, bar_ts, reference, coalesce(gap, false) and reference is not null as gap, price, round(price * quantity * 0.0005::double, 3) as fee from (select *, round_even(reference * (1 + side * case when gap then 0.001::double else 0.0005::double end), 8) as price from (select *, kind in ('limit', 'stop') and reference <> level as gap from (select *, {_TRIGGER} as reference from (select q.*, b.ts as bar_ts, b.o, b.h, b.l from (select {_ORDERS} from events) q asof left join ({BARS}) b on q.sym = b.sym and q.ts < b.ts))))")
def sim_06(spark, sf_dir):
    """Resting orders of every kind against the bar after them."""
    orders = sources.table(spark, sf_dir, "events").selectExpr(*_split(_ORDERS))
    m = simulate.matched(orders, sources.hourly(spark, sf_dir))
    return m.select("order_id", "bar_ts", "reference", "gap", "price", F.round("fee", 3).alias("fee"))


@query("sim_08", f"{_REPLAY} select run_id, sym, trade_id, round(quantity, 5) as quantity, quantity < round(asked, 8) as truncated from (select e.*, pq_ as asked from entry e join (select run_id, sym, i, lag(pq) over (partition by run_id, sym order by i) as pq_ from st) using (run_id, sym, i))")
def sim_08(spark, sf_dir):
    """Entries whose quantity risk or margin bounds."""
    return _shown(_journal(spark, sf_dir).filter("kind = 'fill' and action = 'entry'"), "run_id", "sym", "trade_id", "quantity", "truncated")


@query("sim_12", f"{_REPLAY} select run_id, sym, trade_id, {_AT.format('"at"', 'ts')}, round(price, 4) as price, round(rate, 6) as rate, round(paid, 4) + 0 as amount, case when measured then 'measured' else 'fallback' end as source from (select *, (\"at\" / 28800)::bigint % 3 <> 0 as measured from paid)")
def sim_12(spark, sf_dir):
    """Funding at every funding time of an open position."""
    f = _journal(spark, sf_dir).filter("kind = 'funding'")
    return f.select("run_id", "sym", "trade_id", "ts", F.round("reference", 4).alias("price"), F.round("rate", 6).alias("rate"), (F.round("amount", 4) + 0.0).alias("amount"), F.col("reason").alias("source"))


@query("sim_13", f"{_REPLAY} select run_id, sym, {_AT.format('t + 3600', 'ts')}, round(margin2, 2) as margin, round(due, 4) + 0 as due, round(paid, 4) + 0 as paid from (select st.run_id, st.sym, st.t, st.x2margin as margin2, fdue as due, fpaid as paid from st where fon and not x2on)")
def sim_13(spark, sf_dir):
    """What funding leaves of the isolated margin, of positions that outlast the bar."""
    kept = _journal(spark, sf_dir)
    marks = kept.filter("kind = 'equity' and side <> 0").select("run_id", "sym", "ts", "margin")
    f = kept.filter("kind = 'funding'").select("run_id", "sym", "ts", (F.round("theoretical", 4) + 0.0).alias("due"), (F.round("amount", 4) + 0.0).alias("paid"))
    return marks.join(f, ["run_id", "sym", "ts"]).select("run_id", "sym", "ts", F.round("margin", 2).alias("margin"), "due", "paid")


_BAD = "direction * (case when direction > 0 then l else h end - entry_reference) * quantity"
_GOOD = "direction * (case when direction > 0 then h else l end - entry_reference) * quantity"


@query("sim_20", f"{_REPLAY} select run_id, sym, trade_id, round(min(bad), 2) as mae, round(max(good), 2) as mfe from (select t.*, {_BAD} as bad, {_GOOD} as good from trade t join b on b.sym = t.sym and b.t > t.entry_t and b.t < t.exit_t - 0.0015) group by all")
def sim_20(spark, sf_dir):
    done = simulate.trades(_journal(spark, sf_dir))
    return simulate.excursions(done, sources.hourly(spark, sf_dir)).select("run_id", "sym", "trade_id", F.round("mae", 2).alias("mae"), F.round("mfe", 2).alias("mfe"))


_MARKS = "select run_id, sym, i, 0 as late, t + 3600 as at, x2cash as cash, x2margin + upl as position, equity from st where i > 0 union all select run_id, sym, i, 1, t + 3600.001, cash, 0, cash from st where x3on and x3why = 'END_OF_DATA'"


@query("sim_21", f"{_REPLAY} select run_id, sym, {_AT.format('"at"', 'ts')}, round(equity, 2) as equity, round(peak, 2) as peak, round(equity / peak - 1, 6) as drawdown from (select *, max(equity) over (partition by run_id, sym order by i, late rows unbounded preceding) as peak from ({_MARKS}))")
def sim_21(spark, sf_dir):
    e = simulate.equity_curve(_journal(spark, sf_dir))
    return e.select("run_id", "sym", "ts", F.round("equity", 2).alias("equity"), F.round("peak", 2).alias("peak"), F.round("drawdown", 6).alias("drawdown"))


@query("sim_22", f"{_REPLAY} select run_id, sym, count(*) as marks, count(*) filter (abs(cash + position - equity) > 1e-6) as broken from ({_MARKS}) group by all")
def sim_22(spark, sf_dir):
    """Cash and position make the equity, at every mark of every run."""
    e = simulate.equity_curve(_journal(spark, sf_dir))
    bad = audit.unequal(e.withColumn("key", F.concat_ws("/", "run_id", "sym", "seq")), "key", F.col("cash") + F.col("position"), F.col("equity"), "accounting", 1e-7).select(F.split("ref", "/").alias("k")).select(F.col("k")[0].alias("run_id"), F.col("k")[1].alias("sym"))
    n = bad.groupBy("run_id", "sym").agg(F.count("*").alias("broken"))
    return e.groupBy("run_id", "sym").agg(F.count("*").alias("marks")).join(n, ["run_id", "sym"], "left").select("run_id", "sym", "marks", F.coalesce("broken", F.lit(0)).cast("bigint").alias("broken"))


@query("sim_28", f"select sym, ts, {_SIGNAL} as signal from ({as_sql(_EMAS, BARS)})")
def sim_28(spark, sf_dir):
    """The reference strategy: the regime of two averages."""
    return _signals(spark, sf_dir).select("sym", "ts", "signal")


def _swept(spark, sf_dir):
    cells = {f"{c['distance']}/{c['reward']}": simulate.Rules(**c) for c in simulate.grid_of(distance=[0.01, 0.02, 0.04], reward=[1.0, 2.0])}
    return simulate.trades(simulate.journal(_signals(spark, sf_dir), cells, runs_a_task=2))


_CELL_RUNS = {f"{d}/{r}": simulate.Rules(distance=d, reward=r) for d in (0.01, 0.02, 0.04) for r in (1.0, 2.0)}
_BARE = f"select sym, ts, o, h, l, c, {_SIGNAL} as signal, null::double as rate from ({BARS}) join ({as_sql(_EMAS, BARS)}) using (sym, ts)"


@query("val_08", f"{replay.steps(_BARE, _CELL_RUNS)} select run_id, count(*) as n, round(sum(net), 2) as net from trade group by all")
def val_08(spark, sf_dir):
    """Every cell of a grid of rules, in one pass over the bars."""
    return _swept(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.sum("net"), 2).alias("net"))


@query("sim_07", "select event_id, case when event_type = 'view' then case when low <= 50 then least(50, value) end when event_type = 'click' then case when value + 5 >= 50 then greatest(50, value) end else value end as price from (select *, value - 5 as low from events)")
def sim_07(spark, sf_dir):
    e = sources.table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "value as o", "value + 5 as h", "value - 5 as l")
    kind = F.when(F.col("event_type") == "view", "limit").when(F.col("event_type") == "click", "stop").otherwise("market")
    return e.select("event_id", simulate.trigger_price(kind, F.lit(True), F.lit(50.0)).alias("price"))


@query("sim_15", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_extendedprice * 0.0004, 8) as fee from lineitem")
def sim_15(spark, sf_dir):
    return sources.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", simulate.fee(F.col("l_extendedprice"), 0.0004).alias("fee"))


@query("sim_16", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((0.0004::double / 2 + 0.1 * l_quantity / 1000) * case when l_returnflag = 'A' then 2 else 1 end, 9) as rate from lineitem")
def sim_16(spark, sf_dir):
    rate = simulate.slippage_rate(F.col("l_quantity"), spread=0.0004, impact=0.1, liquidity=1000.0, gap=F.col("l_returnflag") == "A")
    return sources.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(rate, 9).alias("rate"))


@query("sim_17", "select o_orderkey, round(case when o_orderstatus = 'F' then o_totalprice * (1 - 1 / 5 + 0.004) else o_totalprice * (1 + 1 / 5 - 0.004) end, 6) as liquidation from orders")
def sim_17(spark, sf_dir):
    return sources.table(spark, sf_dir, "orders").select("o_orderkey", F.round(simulate.liquidation_price(F.col("o_totalprice"), F.lit(5), 0.004, F.col("o_orderstatus") == "F"), 6).alias("liquidation"))


@query("sim_18", "select event_id, (unnest(generate_series(floor(epoch(ts) / 28800)::bigint + 1, floor(epoch(ts + interval '20 hours') / 28800)::bigint)) * 28800)::double as at from events")
def sim_18(spark, sf_dir):
    return _boundaries(sources.table(spark, sf_dir, "events"))


def _boundaries(events: DataFrame) -> DataFrame:
    e = events.selectExpr("event_id", "ts as entry_ts", "ts + interval 20 hours as exit_ts")
    return simulate.funding_boundaries(e).select("event_id", F.unix_seconds("boundary").cast("double").alias("at"))


_STAKES = "o_orderkey, o_totalprice as equity, o_orderkey % 12 / 1000e0 as risk, 1e0 + o_custkey % 7 as distance, 0.3e0 + o_custkey % 60 / 100e0 as p, o_totalprice / 250000e0 - 0.02e0 as payoff"


@query("sim_23", f"select o_orderkey, case when risk > 0 and risk <= 0.01 and equity > 0 then round(risk * equity / distance, 9) end as size from (select {_STAKES} from orders)")
def sim_23(spark, sf_dir):
    o = sources.table(spark, sf_dir, "orders").selectExpr(*_split(_STAKES.replace("e0", "D")))
    return o.select("o_orderkey", F.round(money.risk_size(F.col("risk"), F.col("equity"), F.col("distance")), 9).alias("size"))


@query("sim_24", f"select o_orderkey, round(equity * 0.2, 6) as allotted, case when risk > 0 and risk <= 0.01 then round(risk * equity / distance, 9) end as unit, round(equity + distance * 1.5, 6) as last_unit, case when payoff > 0 then round(p - (1 - p) / payoff, 6) end as kelly, case when payoff > 0 then round(greatest(0, p - (1 - p) / payoff) * 0.5, 6) else 0 end as half from (select {_STAKES} from orders)")
def sim_24(spark, sf_dir):
    o = sources.table(spark, sf_dir, "orders").selectExpr(*_split(_STAKES.replace("e0", "D")))
    own, n, full = F.col("equity"), F.col("distance"), money.kelly(F.col("p"), F.col("payoff"))
    steps = money.ladder(own, n, F.lit(1))
    return o.select("o_orderkey", F.round(money.wallet_share(own), 6).alias("allotted"), F.round(money.unit(F.col("risk"), own, n), 9).alias("unit"), F.round(steps[3], 6).alias("last_unit"), F.round(full, 6).alias("kelly"), F.round(money.capped(full), 6).alias("half"))


_LIMITS = {"market": 0.02, "group": 120.0, "direction": 300.0}
_RISKS = "o_custkey as market, o_orderpriority as grp, case when o_orderkey % 2 = 0 then 'LONG' else 'SHORT' end as direction, cast(o_totalprice / 1e7 as decimal(28, 12)) as risk"


@query("sim_25", f"select scope, name, round(total, 9) as total, total <= most as allowed from (select scope, name, sum(risk)::double as total, case scope when 'market' then 0.02 when 'group' then 120 else 300 end * (1 + power(2e0, -52)) as most from (select unnest(['market', 'group', 'direction']) as scope, unnest([market::varchar, grp, direction]) as name, risk from (select {_RISKS} from orders)) group by all)")
def sim_25(spark, sf_dir):
    e = money.exposure(sources.table(spark, sf_dir, "orders").selectExpr(*_split(_RISKS)), _LIMITS)
    return e.select("scope", "name", F.round("total", 9).alias("total"), "allowed")


_DAYS = f"select sym, time_bucket(interval '1 day', ts, timestamp '1970-01-01') as ts, first(o order by ts) as o, max(h) as h, min(l) as l, last(c order by ts) as c, sum(v) as v from ({BARS}) group by 1, 2"
_VOLATILE = f"select p.*, a.value as atr, n.value as n from (select sym, ts, c, case when extract(hour from ts) % 2 = 0 then 1 else -1 end as side, 4000e0 + 1000 * extract(hour from ts) as cash from ({BARS})) p join ({as_sql(indicators.REGISTRY['atr'](14), BARS)}) a using (sym, ts) asof left join (select sym, ts + interval '23 hours' as ts, value from ({as_sql(indicators.REGISTRY['atr'](20), _DAYS)})) n on p.sym = n.sym and p.ts >= n.ts"


def _planned_sql(policy: str) -> str:
    if policy == "turtle":
        inner = "select *, c - side * 2 * n as stop, null::double as target, 1000 / (2 * n) as quantity, greatest(1, ceil(c * 1000 / (2 * n) / cash)) as leverage, 2 * n as distance from v"
        why = "case when not coalesce(distance > 0, false) then 'no_distance' when stop <= 0 then 'price_not_positive' when leverage > 5 then 'leverage' when side * (c * (1 - side * (1 / leverage - 0.004)) - stop) >= 0 then 'liquidation_before_stop' end"
    else:
        quantity = "1000 / (2 * atr)" if policy == "manual" else "cash * 0.2 / c"
        inner = f"select *, c - side * 2 * atr as stop, c + side * 4 * atr as target, {quantity} as quantity, 1 as leverage, 2 * atr as distance from v"
        why = "case when not coalesce(distance > 0, false) then 'no_distance' when stop <= 0 or target <= 0 then 'price_not_positive' end"
    return f"select sym, ts, '{policy}' as policy, case when why is null then round(stop, 5) end as stop, case when why is null then round(target, 5) end as target, case when why is null then round(quantity, 5) end as quantity, case when why is null then leverage::int end as leverage, why as refusal from (select *, {why} as why from ({inner}))"


@query("sim_26", f"with v as ({_VOLATILE}) " + " union all ".join(map(_planned_sql, ("manual", "turtle", "wallet_share"))))
def sim_26(spark, sf_dir):
    """Entry plans of every policy on every bar; the turtle's N is that of the last whole day."""
    bars = sources.hourly(spark, sf_dir)
    daily = resample.rolled_up(bars, "1d").drop("n").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    n = on_spark(indicators.REGISTRY["atr"](20), daily).selectExpr("sym", "ts + interval 23 hours as ts", "value as n")
    points = bars.join(on_spark(indicators.REGISTRY["atr"](14), bars), ["sym", "ts"]).selectExpr("sym", "ts", "c", "value as atr", "case when hour(ts) % 2 = 0 then 1 else -1 end as side", "4000D + 1000 * hour(ts) as cash")
    v = align.as_of(points, n, "n")
    made = [F.struct(F.lit(p.name).alias("policy"), p.plan(F.col("side"), F.col("c"), F.col("n" if p.needs[2] == "1d" else "atr"), F.lit(100_000.0), F.col("cash")).alias("p")) for p in (money.Manual(), money.Turtle(), money.WalletShare())]
    plans = v.select("sym", "ts", F.explode(F.array(*made)).alias("x"))
    return plans.select("sym", "ts", "x.policy", F.round("x.p.stop", 5).alias("stop"), F.round("x.p.target", 5).alias("target"), F.round("x.p.quantity", 5).alias("quantity"), "x.p.leverage", "x.p.refusal")


@query("sim_27", "select o_orderkey, round_even(o_totalprice * case when o_orderpriority = '1-URGENT' then 0.0002::double else 0.0005::double end, 6) as fee, round_even(o_totalprice * 0.0005::double * case when o_orderstatus = 'F' then 2 else 1 end, 6) as entry_slip, round_even(o_totalprice * 0.0001::double, 6) as exit_slip, round(o_totalprice * 0.004::double, 6) as maintenance from orders")
def sim_27(spark, sf_dir):
    """Costs by the defaults, a venue's own rate where it has one."""
    o = sources.table(spark, sf_dir, "orders")
    costs = simulate.costed(o.select("o_orderkey", F.col("o_totalprice").alias("notional"), F.when(F.col("o_orderpriority") == "1-URGENT", 0.0002).alias("fee_rate"), (F.col("o_orderstatus") == "F").alias("gap")))
    return costs.select("o_orderkey", *(F.round(c, 6).alias(c) for c in ("fee", "entry_slip", "exit_slip", "maintenance")))


_ASKED = "event_id, case when event_id % 50 = 0 then lower(event_type) else upper(event_type) end as sym, case when event_id % 40 = 0 then 'live' else 'paper' end as mode, event_id % 3 = 0 as spot, cast(1 - event_id % 2 * 2 as int) as side, user_id * 1e0 as quantity, value as price, case when event_id % 30 = 0 then null else value * 0.98 end as stop, 50000e0 as equity, event_id % 11 / 1000e0 as market_risk, event_id % 5 / 100e0 as total_risk, event_id % 7 / 200e0 as direction_risk"


@query("sim_30", f"select event_id, case when mode <> 'paper' then 'paper_only' when sym <> upper(sym) then 'symbol_not_canonical' when sym not in ('VIEW', 'CLICK', 'SIGNUP') then 'symbol_not_allowed' when spot and side < 0 then 'spot_short_not_supported' when quantity > 400 then 'max_order_quantity' when quantity * price > 20000 then 'max_order_notional' when stop is null then 'protective_stop_required' when abs(price - stop) * quantity > 50000 * 0.01 * (1 + 1e-9) then 'one_r_limit' when market_risk + 0.005e0 > 0.012e0 * (1 + power(2e0, -52)) or total_risk + 0.005e0 > 0.04e0 * (1 + power(2e0, -52)) or direction_risk + 0.005e0 > 0.03e0 * (1 + power(2e0, -52)) then 'exposure_limit' end as reason from (select {_ASKED} from events)")
def sim_30(spark, sf_dir):
    e = sources.table(spark, sf_dir, "events").selectExpr(*_split(_ASKED.replace("e0", "D")))
    guard = simulate.Guard(allowed=("VIEW", "CLICK", "SIGNUP"), most_quantity=400, most_notional=20_000, risk=0.005, market_limit=0.012, group_limit=0.04, direction_limit=0.03)
    return guard.judged(e).select("event_id", "reason")


# ---- audits and derivations


@query("aud_01", "select 'identity' as check_name, o_orderkey::varchar as ref from orders where abs(o_totalprice - round(o_totalprice)) > 0.4")
def aud_01(spark, sf_dir):
    return audit.unequal(sources.table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice"), F.round("o_totalprice"), "identity", 0.4)


@query("aud_02", "select 'a>b' as check_name, o_orderkey::varchar as ref from orders where o_custkey > o_orderkey union all select 'b>c', o_orderkey::varchar from orders where o_orderkey > 9000")
def aud_02(spark, sf_dir):
    o = sources.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey as a", "o_orderkey as b", "9000L as c")
    return audit.out_of_order(o, "o_orderkey", ["a", "b", "c"])




statement("aud_10", "select sym, count(*) as n, cast(sum(case when p is not null and ts <= p then 1 else 0 end) as bigint) as faults from (select sym, ts, lag(ts) over (partition by sym order by ts) as p from {bars}) t group by sym")


@query("aud_13", "select o_orderkey, o_custkey from orders anti join (select * from customer where c_acctbal > 0) c on c_custkey = o_custkey")
def aud_13(spark, sf_dir):
    return audit.orphans(sources.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), sources.table(spark, sf_dir, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


statement("aud_14", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey desc) as n from {orders}) t where n = 1")
statement("aud_15", "select o_orderkey, sha256(concat_ws(chr(31), cast(o_orderkey as varchar), o_orderstatus, o_orderpriority)) as config_hash from {orders}", "select o_orderkey, sha2(concat_ws(char(31), cast(o_orderkey as string), o_orderstatus, o_orderpriority), 256) as config_hash from {orders}")


@query("der_01", f"select 2 * seq - k as seq, series_name, ts, value from (select seq, ts, unnest([1, 0]) as k, unnest(['equity', 'drawdown']) as series_name, unnest([equity, round(d, 9)]) as value from ({_DRAWN.format(_EQUITY)}))")
def der_01(spark, sf_dir):
    d = metrics.drawdowns(_equity(spark, sf_dir), order=("ts", "seq")).withColumn("drawdown", F.round("drawdown", 9))
    return audit.chart_rows(d)


@query("der_02", f"select trade_id, case when net + 5000 > 0 and net <= 0 then 'cost_churn' when net / r0 >= 2 then 'top_winner' when net > 0 then 'normal_winner' when net / r0 <= -1 then 'tail_loser' else 'small_loser' end as bucket from ({_TRADES})")
def der_02(spark, sf_dir):
    net = F.col("net")
    return _trades(spark, sf_dir).select("trade_id", audit.outcome(net + 5000, net, net / F.col("r0")).alias("bucket"))


def _episodes_sql(kind: str) -> str:
    v = "equity" if kind == "drawdown" else "-equity"
    w = "over (partition by sym order by seq rows unbounded preceding)"
    o = "over (partition by sym order by seq)"
    return f"""select '{kind}' as kind, sym, min(anchor) as anchor, min(seq) as first, arg_min(seq, (v, seq)) as extreme, max(seq) as last, nullif(arg_max(coalesce(nxt, -1), seq), -1) as recovery, round(abs(min(v) - min(peak)) / nullif(abs(min(peak)), 0), 9) as depth from (
      select *, last_value(fresh ignore nulls) {w} as anchor, sum(case when under = 1 and was = 0 then 1 else 0 end) {w} as run from (
        select *, case when under = 0 and (was = 1 or lag(peak) {o} is null or peak > lag(peak) {o}) then seq end as fresh from (
          select *, coalesce(lag(under) {o}, 0) as was, lead(seq) {o} as nxt from (
            select *, case when v < peak then 1 else 0 end as under from (
              select sym, seq, v, max(v) {w} as peak from (select event_type as sym, event_id as seq, {v}::double as v from (select *, round(value)::bigint as equity from events)))))))
      where under = 1 group by sym, run"""


@query("der_03", f"{_episodes_sql('drawdown')} union all {_episodes_sql('runup')}")
def der_03(spark, sf_dir):
    e = sources.table(spark, sf_dir, "events").selectExpr("event_type as sym", "event_id as seq", "cast(round(value) as bigint) as equity")
    return audit.episodes(e).withColumn("kind", F.lit("drawdown")).unionByName(audit.episodes(e, "runup").withColumn("kind", F.lit("runup")))



# ---- orders, sets, scalars

statement("ord_01", "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc nulls last, o_orderkey desc limit 100")
statement("ord_02", "select event_type, min(ts) as earliest from {events} group by event_type")
statement("ord_03", "select o_orderkey from {orders} order by o_orderdate, o_custkey, o_orderkey limit 500")
statement("ord_04", "select sym, ts, c from {bars} order by c, sym, ts limit 50")
statement("set_01", "select n_nationkey as k, 'nation' as kind from {nation} union all select r_regionkey, 'region' from {region}")
statement("set_03", "select c_nationkey as k from {customer} except select s_nationkey from {supplier} where s_acctbal > 5000")
statement("set_04", "select distinct o_orderpriority from {orders}")

@query("fun_math", "select event_id, round(sqrt(value), 6) as a, round(ln(value), 6) as b, round(log10(value), 6) as c, round(exp(value / 1000), 6) as d, round(atan(value), 6) as e, round(sin(value), 6) as f, cast(floor(value) as bigint) as g, abs(-value) as h from events")
def fun_math(spark, sf_dir):
    """Of nothing and less Spark's logarithms are null, those of the SQL infinite and no number."""
    ship(spark)
    v, to_six = F.col("value"), lambda x: numbers.rounded(x, 6)
    log = lambda f: F.when(v > 0, f(v)).when(v == 0, F.lit(-math.inf)).when(v < 0, F.lit(math.nan))
    return sources.table(spark, sf_dir, "events").select("event_id", to_six(F.sqrt(v)).alias("a"), to_six(log(F.ln)).alias("b"), to_six(log(F.log10)).alias("c"), to_six(numbers.exp(v / 1000)).alias("d"), to_six(F.atan(v)).alias("e"), to_six(F.sin(v)).alias("f"), F.floor(v).cast("bigint").alias("g"), F.abs(-v).alias("h"))


statement("fun_time", "select event_id, date_trunc('hour', ts) as hour, ts + interval '5 minutes' as later, cast(extract(hour from ts) as int) as h from {events}")
statement("fun_text", "select c_custkey, substr(c_name, 1, 4) as a, upper(c_name) as b, lower(c_mktsegment) as c from {customer}")
statement("fun_conditional", "select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') as a, greatest(o_custkey, o_orderkey) as b, least(o_custkey, o_orderkey) as c, o_orderstatus is distinct from 'F' as d from {orders}")
statement("fun_json", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from {events}", "select event_id, cast(get_json_object(props, '$.k') as int) as k from {events}")

# ---- registry

from .plans import registry  # noqa: E402

_BATCH = registry.merged({n: registry.plan_of(n) for n in ("ema", "rsi", "macd", "bollinger_bands", "dmi", "pat_doji", "pat_engulfing")})
_series_query("reg_01", _BATCH)


# ---- paged sources, plugins, wallets

from .operators import plugins  # noqa: E402
from .sources.paged import paged_bars  # noqa: E402

_MINUTES = "select s.sym, timestamp '2024-01-01' + m * interval '1 minute' as ts, b::double as o, (b + 2)::double as h, (b - 2)::double as l, (b + 1)::double as c, (1 + k % 5)::double as v from (select m, 28401120 + m as k from range(2000) t(m)) cross join (values ('aa'), ('bbb')) s(sym), lateral (select 100 + (k * 31 + length(s.sym) * 7) % 50 as b) where k % 97 <> 0"


@query("src_08", _MINUTES)
def src_08(spark, sf_dir):
    """Minute bars from a paged provider, ranges read in parallel."""
    since = 28_401_120 * 60
    return paged_bars(spark, "tallow.sources.paged:arithmetic", ["aa", "bbb"], since, since + 2000 * 60, parts=3, page=100)




@query("udf_08", "select coalesce(a.name, b.name) as name, case when b.name is null then 'only_registered' when a.name is null then 'only_deployed' when a.version = b.version then 'matched' else 'version_mismatch' end as state from (select p_name || p_partkey as name, p_size as version from part where p_partkey % 3 <> 0) a full join (select p_name || p_partkey as name, case when p_partkey % 5 = 0 then 0 else p_size end as version from part where p_partkey % 2 = 0) b on a.name = b.name")
def udf_08(spark, sf_dir):
    p = sources.table(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_name || p_partkey as name", "p_size as version")
    return plugins.reconciled(p.filter("k % 3 <> 0"), p.filter("k % 2 = 0").selectExpr("name", "case when k % 5 = 0 then 0 else version end as version"))

from . import queries_evidence, queries_service, queries_streams  # noqa: E402, F401
