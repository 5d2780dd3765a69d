"""Day stores, silences, interval joins and the source with offsets, batch by batch."""

import datetime as dt

import pytest

from tallow.streaming import alignment, store
from tallow.streaming import bars as streaming

T0 = dt.datetime(2024, 3, 1)


def stream_of(spark, base, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{base}/in")


def run(writer, base):
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def test_a_batch_reads_and_writes_only_its_days(spark, tmp_path):
    held = store.DayStore(spark, f"file://{tmp_path}/store")
    tick = lambda d, h, seq, p: ("a", T0 + dt.timedelta(days=d, hours=h), seq, p, 1.0)
    schema = "sym string, ts timestamp, seq long, price double, size double"
    held.write(spark.createDataFrame([tick(d, h, 10 * d + h, 1.0) for d in range(5) for h in (1, 2)], schema), 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store/bars").rglob("*.parquet")}
    late = spark.createDataFrame([tick(2, 1, 99, 9.0), tick(2, 2, 22, 5.0)], schema)
    for _ in range(2):  # a replay does no harm
        held.write(late, 1)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "store/bars").rglob("*.parquet")}
    assert {p.parent.name for p in before.keys() ^ after.keys()} == {"day=2024-03-03"}
    got = {(r.ts.day, r.ts.hour): (r.o, r.h, r.c, r.v) for r in held.bars().collect()}
    assert len(got) == 10 and got[3, 1] == (1.0, 9.0, 9.0, 2.0) and got[3, 2] == (5.0, 5.0, 5.0, 1.0) and got[4, 1] == (1.0, 1.0, 1.0, 1.0)
    plan = held.made([dt.date(2024, 3, 3)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [day" in plan or "(day#" in plan.split("PartitionFilters")[1][:80]
    held.compact([dt.date(2024, 3, 3)])
    assert len([p for p in (tmp_path / "store/ticks/day=2024-03-03").iterdir() if p.name.startswith("batch=")]) == 1
    assert sorted(map(str, held.made([dt.date(2024, 3, 3)]).collect())) == sorted(map(str, held.bars([dt.date(2024, 3, 3)]).select(*held.made([dt.date(2024, 3, 3)]).columns).collect()))
    held.refresh("2d", dt.date(2024, 3, 5), 4)
    wide = {r.ts.day: (r.o, r.h, r.v) for r in held.bars(name="2d").collect()}
    assert all(v[2] in (2.0, 4.0, 5.0) for v in wide.values()) and max(v[1] for v in wide.values()) == 9.0


def test_silence_is_told_once_and_without_a_further_row(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[("a", at(0)), ("a", at(5)), ("b", at(0))], [("b", at(300)), ("a", at(500))], [("b", at(900)), ("b", at(905))], [("b", at(1400))]]
    with streaming.keyed_state(spark):
        out = alignment.silences(stream_of(spark, tmp_path, batches, "sym string, ts timestamp"), 3600)
        run(out.writeStream.foreachBatch(streaming.put(f"{tmp_path}/out")), tmp_path)
    got = sorted((r.sym, int((r.since - T0).total_seconds() // 60)) for r in streaming.read_batches(spark, f"{tmp_path}/out").collect())
    assert got == [("a", 5), ("a", 500), ("b", 0), ("b", 300), ("b", 905)]


def test_signals_meet_the_next_candle_or_none(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    signals = [[(1, "a", at(10)), (2, "a", at(60)), (3, "b", at(20))], [(4, "a", at(130)), (5, "a", at(2000))], [(6, "a", at(1)), (7, "a", at(5000))]]
    bars = [[("a", at(60), 1.0, 1.0, 1.0, 1.0, 1.0), ("a", at(120), 2.0, 2.0, 2.0, 2.0, 1.0)], [("b", at(2040), 3.0, 3.0, 3.0, 3.0, 1.0)], [("a", at(5040), 4.0, 4.0, 4.0, 4.0, 1.0)]]
    s = stream_of(spark, tmp_path / "s", signals, "id long, sym string, ts timestamp")
    b = stream_of(spark, tmp_path / "b", bars, "sym string, ts timestamp, o double, h double, l double, c double, v double")
    run(alignment.next_candles(s, b).writeStream.foreachBatch(streaming.put(f"{tmp_path}/out")), tmp_path)
    got = {r.id: r.o for r in streaming.read_batches(spark, f"{tmp_path}/out").collect()}
    assert got == {1: 1.0, 2: 2.0, 3: None, 4: None, 5: None, 7: 4.0}  # 6 came behind the watermark


@pytest.mark.parametrize("ids", [3, 1000])
def test_the_source_goes_on_where_it_stopped(spark, tmp_path, ids):
    spark.dataSource.register(alignment.EventSource)
    spark.range(100).selectExpr("id as event_id", "concat('x', id) as name", "0 as unused").repartition(3).write.parquet(f"{tmp_path}/t")
    for upto in ({"upto": "40"}, {"upto": "40"}, {"upto": "41"}, {}, {}):
        s = spark.readStream.format("tallow_events").schema("event_id long, name string").options(path=f"{tmp_path}/t", ids_a_partition=str(ids), **upto).load()
        run(s.writeStream.foreachBatch(streaming.put(f"{tmp_path}/out")), tmp_path)
    assert sorted(tuple(r) for r in streaming.read_batches(spark, f"{tmp_path}/out").collect()) == [(i, f"x{i}") for i in range(100)]


def test_a_stream_that_gives_nothing_is_an_empty_table(spark, tmp_path):
    """Series without a silence: no batch has rows, and the table has none."""
    from datetime import datetime, timedelta

    from tallow.queries import QUERIES

    rows = [(i, datetime(2024, 1, 14, 20) + timedelta(minutes=i), "view", 1.0, "{}") for i in range(600)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["gap_08_silent"](spark, str(tmp_path))
    assert got.columns == ["sym", "since"] and got.collect() == []


def test_signals_meet_candles_by_blocks(spark):
    """The join has a key beside the series, so that a signal is not held against all its candles; candles may lie off the grid."""
    from tallow.streaming import alignment

    at = lambda text: f"timestamp '2024-01-01 {text}'"
    signals = spark.sql("select * from values " + ", ".join(f"({i}, 'a', {at(t)})" for i, t in enumerate(("00:10:00", "00:30:00", "01:29:59", "03:00:00"))) + " as t(id, sym, ts)")
    bars = spark.sql("select sym, ts, 1d as o, 1d as h, 1d as l, c, 1d as v from values " + ", ".join(f"('a', {at(t)}, {c}d)" for c, t in enumerate(("00:30:00", "01:30:00", "04:00:00"))) + " as t(sym, ts, c)")
    joined = alignment.next_candles(signals, bars)
    assert {(r.id, r.c) for r in joined.collect()} == {(0, 0.0), (1, 1.0), (2, 1.0), (3, 2.0)} and joined.count() == 4
    assert "__of" not in joined.columns and "__block" in joined._jdf.queryExecution().analyzed().toString()


def test_receipts_come_in_pieces():
    """A wallet's batch of any length is not one frame; ids of several parts come once, those not above the last one never."""
    import numpy as np
    import pandas as pd

    from tallow.streaming.bars import _Consumed

    class Last:
        value = (4,)

        def exists(self):
            return True

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    consumed = _Consumed()
    consumed.last = Last()
    parts = [pd.DataFrame({"signal_id": np.arange(90_000)}), pd.DataFrame({"signal_id": np.arange(150_000, 50_000, -1)})]
    out = list(consumed.handleInputRows(("w",), iter(parts), None))
    assert max(map(len, out)) <= 1 << 16 and pd.concat(out)["signal_id"].tolist() == list(range(5, 150_001)) and consumed.last.value == (150_000,)
    assert list(consumed.handleInputRows(("w",), iter(parts), None)) == [] and list(consumed.handleInputRows(("w",), iter([]), None)) == []


def test_days_of_a_batch_are_written_in_pieces(spark, tmp_path):
    """One file of ticks is not sorted by one task for its folders."""
    import glob

    from tallow.streaming import store

    ticks = spark.range(4000, numPartitions=1).selectExpr("'a' as sym", "timestamp '2024-01-01 00:00:00' as ts", "id as seq", "1d as price", "1d as size")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as within a stream
    try:
        store.DayStore(spark, f"file://{tmp_path}/held").write(ticks, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(glob.glob(f"{tmp_path}/held/ticks/day=2024-01-01/batch=0/*.parquet")) > 1
