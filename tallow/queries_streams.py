"""Streaming queries: streams of small files in the shared folder, read in the order they were written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from .plans.layers import Average, Plan, as_sql
from .queries import BARS, _ntz, query
from .queries_evidence import _FILLED, _FILLED_FOUR, _filled
from .session import shared_dir, ship
from .sources import bars as sources
from .streaming import bars as streaming
from .streaming import alignment, inventory, store, wallet

_CLOSED = f"select * from ({BARS}) where ts + interval '1 hour' <= (select max(ts) - interval '1 minute' from events)"


def _base(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"


def _ticks(events: DataFrame) -> DataFrame:
    return events.selectExpr("event_type as sym", "cast(ts as timestamp) as ts", "event_id as seq", "value as price", "1D as size")


def _in_turn(spark: SparkSession, base: str, *frames: DataFrame) -> DataFrame:
    """A stream whose batches are the frames, a file each."""
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{base}/in/{i}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{base}/in")


def _run(writer, base: str) -> None:
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def _once(spark: SparkSession, base: str, stream: DataFrame, keys: list[str], days: str | None = "ts") -> DataFrame:
    """What a stream gives, each key once, read back from its store."""
    ship(spark)
    with streaming.keyed_state(spark):
        _run(stream.writeStream.foreachBatch(streaming.append_once(f"{base}/out", keys, days)), base)
    return _ntz(streaming.kept_once(spark, f"{base}/out", stream.schema))


@query("str_01", "select event_id, make_timestamp(((floor((epoch_us(ts) - 2000000) / 60000000)::bigint + 1) * 60 + 2) * 1000000) as poll from events")
def str_01(spark, sf_dir):
    """When to look next: two seconds past the minute. A query's own trigger is that of its processing time."""
    e = sources.table(spark, sf_dir, "events")
    return _ntz(e.select("event_id", streaming.next_poll(F.col("ts")).alias("poll")))


@query("str_02", _CLOSED)
def str_02(spark, sf_dir):
    """Bars of a stream: those that the watermark has passed."""
    base = _base(spark)
    events = sources.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _once(spark, base, streaming.streamed_bars(_ticks(stream)), ["sym", "ts"])


@query("str_03", _CLOSED)
def str_03(spark, sf_dir):
    """Only finished bars are seen, and a bar once finished stays: ticks of the first ten days that come two batches after all others,
    with other prices, are too late for the watermark."""
    base, ticks = _base(spark), _ticks(sources.table(spark, sf_dir, "events"))
    late = ticks.filter("ts < timestamp '2024-01-11 00:00:00'").withColumn("price", F.col("price") + 1000)
    return _once(spark, base, streaming.streamed_bars(_in_turn(spark, base, ticks, ticks.filter("false"), late)), ["sym", "ts"])


def _late(spark, sf_dir, base: str) -> DataFrame:
    """The ticks in two batches: every tenth comes late."""
    ticks = _ticks(sources.table(spark, sf_dir, "events"))
    return _in_turn(spark, base, ticks.filter("seq % 10 <> 0"), ticks.filter("seq % 10 = 0"))


@query("str_04", f"select * from ({BARS})")
def str_04(spark, sf_dir):
    """Late ticks correct stored bars: every batch makes the days that it touches anew, and reads and writes no others."""
    base = _base(spark)
    held = store.DayStore(spark, base + "/store")
    _run(_late(spark, sf_dir, base).writeStream.foreachBatch(held.write), base)
    return _ntz(held.bars().drop("day"))


@query("snk_08_refresh", f"select sym, time_bucket(interval '4 hours', ts, timestamp '1970-01-01') as ts, first(o order by ts) as o, max(h) as h, min(l) as l, last(c order by ts) as c, sum(v) as v from ({BARS}) group by 1, 2 having time_bucket(interval '4 hours', min(ts), timestamp '1970-01-01')::date between (select max(ts)::date - 6 from events) and (select max(ts)::date from events)")
def snk_08_refresh(spark, sf_dir):
    """Four-hour bars of the last seven days, made anew from stored bars after late ticks and a compaction."""
    base = _base(spark)
    held = store.DayStore(spark, base + "/store")
    _run(_late(spark, sf_dir, base).writeStream.foreachBatch(held.write), base)
    until = held.bars().agg(F.max("day")).first()[0]
    held.compact([until])
    held.write(held.ticks([until]).drop("day", "batch"), 9)  # the day again: nothing changes
    held.refresh("4h", until, 7)
    return _ntz(held.bars(name="4h").drop("day"))


@query("str_12", f"select * from ({BARS})")
def str_12(spark, sf_dir):
    """A rollup kept as state in update mode: every batch puts the bars that it changed in the place of the old ones."""
    base = _base(spark)
    _run(streaming.rolling_bars(_late(spark, sf_dir, base)).writeStream.outputMode("update").foreachBatch(streaming.put(f"{base}/bars")), base)
    return _ntz(streaming.stored_bars(spark, f"{base}/bars"))


def _average_sql(source: str, n: int) -> str:
    return f"select sym, ts, value from ({as_sql(Plan(['value']).scan(Average('value', 'c', n, 2 / (n + 1))), source)}) where value is not null"


def _halves(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    b = bars.withColumn("ts", F.col("ts").cast("timestamp"))
    return b.filter("ts < timestamp '2024-01-15 00:00:00'"), b.filter("ts >= timestamp '2024-01-15 00:00:00'")


@query("str_05", _average_sql(BARS, 9))
def str_05(spark, sf_dir):
    """The recursive average kept as state from batch to batch."""
    base = _base(spark)
    stream = _in_turn(spark, base, *_halves(sources.hourly(spark, sf_dir)))
    got = _once(spark, base, streaming.streamed_average(stream, 9), ["sym", "ts"])
    return got.withColumn("value", F.round("value", 6))


@query("str_06", f"select * from ({_average_sql(BARS, 9)}) where ts >= timestamp '2024-01-15 00:00:00'")
def str_06(spark, sf_dir):
    """A stream warmed up from the history before it."""
    base = _base(spark)
    history, rest = _halves(sources.hourly(spark, sf_dir))
    seeds = streaming.seeded(history.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 9)
    got = _once(spark, base, streaming.streamed_average(_in_turn(spark, base, rest), 9, seeds=seeds), ["sym", "ts"])
    return got.withColumn("value", F.round("value", 6))


_ISLANDS = f"select sym || '/' || island as sym, ts, o, h, l, c, v from (select *, sum(case when p is null or ts - p > interval '1 hour' then 1 else 0 end) over (partition by sym order by ts) as island from (select *, lag(ts) over (partition by sym order by ts) as p from ({BARS})))"


@query("str_07", f"select split_part(sym, '/', 1) as sym, ts, value from ({_average_sql(_ISLANDS, 5)})")
def str_07(spark, sf_dir):
    """A gap in a series ends its state: the average warms up anew."""
    base = _base(spark)
    stream = _in_turn(spark, base, *_halves(sources.hourly(spark, sf_dir)))
    got = _once(spark, base, streaming.streamed_average(stream, 5, step_seconds=3600), ["sym", "ts"])
    return got.withColumn("value", F.round("value", 6))


@query("str_08", "select event_id, event_type, ts from events")
def str_08(spark, sf_dir):
    """A sink by unique keys: the second batch repeats half of the first, the third all."""
    base, e = _base(spark), sources.table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return _once(spark, base, _in_turn(spark, base, e.filter("event_id % 3 <> 0"), e.filter("event_id % 2 = 0"), e), ["event_id"])


def _signals(e: DataFrame) -> DataFrame:
    return e.selectExpr("concat('w', event_id % 5) as wallet", "event_id as signal_id", "event_type as sym", "cast(event_id % 3 - 1 as int) as side", "value + 1 as open")


@query("str_09", "select 'w' || event_id % 5 as wallet, event_id as signal_id from events")
def str_09(spark, sf_dir):
    """A receipt for each signal that a wallet consumes, however often it comes."""
    base, s = _base(spark), _signals(sources.table(spark, sf_dir, "events"))
    middle = s.agg(F.expr("cast(max(signal_id) div 2 as bigint)")).first()[0]
    stream = _in_turn(spark, base, s.filter(F.col("signal_id") <= middle), s.filter(F.col("signal_id") > middle - 100), s)
    return _once(spark, base, streaming.receipts(stream), ["wallet", "signal_id"], None)


@query("str_10", f"select b.sym, b.ts, b.c, d.c as wide from ({_FILLED}) b asof left join (select sym, ts + interval '4 hours' as ts, c from ({_FILLED_FOUR})) d on b.sym = d.sym and b.ts >= d.ts")
def str_10(spark, sf_dir):
    """Bars of two timeframes: the wide ones that a batch completes are there before its bars are judged."""
    base, bars = _base(spark), _filled(spark, sf_dir)
    cut = "timestamp_ntz '2024-01-15 02:00:00'"
    _run(_in_turn(spark, base, bars.filter(f"ts < {cut}"), bars.filter(f"ts >= {cut}")).writeStream.foreachBatch(streaming.advanced(base, "1h", "4h")), base)
    return _ntz(streaming.read_batches(spark, f"{base}/out"))


@query("str_11", f"select sym, ts, ((epoch(ts) - epoch(p)) / 3600 - 1)::bigint as missing from (select sym, ts, lag(ts) over (partition by sym order by ts) as p from ({BARS}) where sym <> 'error') where epoch(ts) - epoch(p) > 3600")
def str_11(spark, sf_dir):
    """Bars taken in once: a foreign series is refused, bars that come again are old, missing steps are logged."""
    base, bars = _base(spark), sources.hourly(spark, sf_dir)
    first = bars.filter("ts < timestamp_ntz '2024-01-15 00:00:00'")
    _run(_in_turn(spark, base, first, bars).writeStream.foreachBatch(streaming.ingested(base, ("view", "click", "signup", "purchase"), 3600)), base)
    return streaming.read_batches(spark, f"{base}/gaps")


@query("snk_07", "select kind, n from (select 'rows' as kind, count(*) as n from events union all select 'stored', 2 union all select 'refused', 2)")
def snk_07(spark, sf_dir):
    """Batches kept in whole or not at all: those that come again are refused."""
    root, s = _base(spark), _signals(sources.table(spark, sf_dir, "events"))
    keep = wallet.store(root)
    done = [keep(s.filter(f"signal_id % 2 = {k}"), n) for n, k in ((0, 0), (0, 0), (1, 1), (1, 0))]
    rows = streaming.read_batches(spark, root).agg(F.count("*").alias("n")).select(F.lit("rows").alias("kind"), "n")
    return rows.unionByName(spark.createDataFrame([("stored", done.count(True)), ("refused", done.count(False))], "kind string, n bigint"))


@query("sim_29")
def sim_29(spark, sf_dir):
    """Paper wallets over a stream of signals made from the events."""
    base = _base(spark)
    events = sources.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    fills = wallet.wallet_fills(_signals(stream), allowed=("view", "click", "signup", "purchase"))
    return _once(spark, base, fills, ["wallet", "signal_id", "side"], None)




@query("snk_09_deletes", f"select sym, min(ts) as available_from, max(ts) as available_to, count(*) as row_count from ({BARS}) where extract(day from ts) not in (1, 2, 31) and extract(hour from ts) <> 5 group by sym")
def snk_09_deletes(spark, sf_dir):
    """The inventory of bars under inserts and deletes: some deletes come before their inserts, some take the first and last rows."""
    base, bars = _base(spark), sources.hourly(spark, sf_dir).select("sym", "ts")
    change = lambda where, op: bars.filter(where).selectExpr("sym", "ts", f"'{op}' as op")
    half = "ts < timestamp_ntz '2024-01-15 00:00:00'"
    batches = (change("hour(ts) = 5", "delete"), change(half, "insert"), change(f"day(ts) in (1, 2) and hour(ts) <> 5 and {half}", "delete"), change(f"not ({half})", "insert"), change(f"(day(ts) = 31 or day(ts) in (1, 2) and not ({half})) and hour(ts) <> 5", "delete"))
    held = inventory.Inventory(spark, base + "/held", parts=4)
    _run(_in_turn(spark, base, *batches).writeStream.foreachBatch(held.write), base)
    return _ntz(held.rows())


@query("joi_14_stream", f"select e.event_id, b.ts as bar_ts, b.o, b.h, b.l, b.c, b.v from events e left join ({BARS}) b on b.sym = e.event_type and b.ts = time_bucket(interval '1 hour', e.ts, timestamp '1970-01-01') + interval '1 hour' where b.ts is not null or e.ts + interval '1 hour' < (select least(max(e.ts), max(b.ts)) - interval '1 minute' from events e, ({BARS}) b)")
def joi_14_stream(spark, sf_dir):
    """Signals and the candle after each, both streams: a join by interval whose state the watermarks bound."""
    base = _base(spark)
    e = sources.table(spark, sf_dir, "events").selectExpr("event_id", "event_type as sym", "cast(ts as timestamp) as ts")
    cut = "timestamp '2024-01-15 00:00:00'"
    signals = _in_turn(spark, base + "/signals", e.filter(f"ts < {cut}"), e.filter(f"ts >= {cut}"))
    bars = _in_turn(spark, base + "/bars", *_halves(sources.hourly(spark, sf_dir)))
    return _once(spark, base, alignment.next_candles(signals, bars), ["event_id"], None).drop("sym", "ts")


@query("gap_08_silent", "select sym, since from (select event_type as sym, ts as since, lead(ts) over (partition by event_type order by ts) as n from events) where n - since > interval '2 hours' or (n is null and since + interval '2 hours' < (select max(ts) - interval '1 minute' from events))")
def gap_08_silent(spark, sf_dir):
    """Series that fall silent for two hours, told by timers; one that stops for good, without a further row of it."""
    base = _base(spark)
    e = sources.table(spark, sf_dir, "events").selectExpr("event_type as sym", "cast(ts as timestamp) as ts")
    cut = "timestamp '2024-01-15 00:00:00'"
    stream = _in_turn(spark, base, e.filter(f"ts < {cut}"), e.filter(f"ts >= {cut}"))
    return _once(spark, base, alignment.silences(stream, 7200), ["sym", "since"], None)


@query("src_04_stream", "select event_id, event_type, value from events")
def src_04_stream(spark, sf_dir):
    """Events by a source with offsets: a run up to the middle, then one from its checkpoint on."""
    ship(spark)
    base, path = _base(spark), f"{sf_dir}/events.parquet"
    spark.dataSource.register(alignment.EventSource)
    events = sources.table(spark, sf_dir, "events")
    middle = events.agg(F.expr("cast(max(event_id) div 2 as bigint)")).first()[0]
    schema = events.select("event_id", "event_type", "value").schema
    for options in ({"upto": str(middle)}, {}):
        stream = spark.readStream.format("tallow_events").schema(schema).options(path=path, ids_a_partition="4000", **options).load()
        _run(stream.writeStream.foreachBatch(streaming.put(f"{base}/out")), base)
    return streaming.read_batches(spark, f"{base}/out")
