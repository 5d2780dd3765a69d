"""Simulation, metrics, resampling, streaming."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallow.operators import audit, catalog, gaps, metrics, resample, simulate
from tallow.session import ship
from tallow.streaming import bars as streaming

T0 = dt.datetime(2024, 1, 1)


def bar(i, o, h, low, c, signal, **more):
    return {"ts": T0 + dt.timedelta(hours=i), "o": o, "h": h, "l": low, "c": c, "signal": signal, **more}


def kinds(rows, rules=simulate.Rules(), kind="fill"):
    return [r for r in simulate.journal_of(rows, rules) if r["kind"] == kind]


def test_money_of_one_trade():
    # fixed values: the golden trade and its money
    flat = [bar(i, 100.0, 100.0, 100.0, 100.0, None) for i in range(9)]
    rows = [*flat, bar(9, 100.0, 100.0, 100.0, 100.0, 1, distance=2.0), bar(10, 100.0, 101.0, 99.5, 100.5, None), bar(11, 100.5, 105.0, 100.0, 104.5, None), bar(12, 104.5, 105.0, 104.0, 104.5, None)]
    entry, done = kinds(rows, simulate.Rules(capital=10_000, fee=0.0004))
    assert (entry["price"], entry["quantity"], entry["stop"], entry["target"]) == (100.05, 50.0, 98.0, 104.0)
    assert (done["price"], done["reason"], entry["fee"] + done["fee"], entry["slippage"] + done["slippage"]) == (103.9896, "TAKE_PROFIT", pytest.approx(4.080792), 3.02)
    assert done["cash"] == pytest.approx(10_192.899208) and done["ts"] == rows[12]["ts"]


def test_signals_fill_on_the_next_bar_and_gaps_close():
    flat = [bar(i, 100.0, 100.5, 99.5, 100.0, None) for i in range(3)]
    rows = [*flat, bar(3, 100.0, 100.5, 99.5, 100.0, 1), bar(4, 101.0, 101.5, 100.5, 101.0, 1), bar(9, 101.0, 101.5, 100.5, 101.0, 1)]
    entry, gone = kinds(rows)
    ms = dt.timedelta(milliseconds=1)
    assert entry["ts"] == rows[4]["ts"] + ms and (gone["reason"], gone["ts"]) == ("DATA_GAP", rows[4]["ts"] + dt.timedelta(hours=1) + ms)
    assert [d["reason"] or d["action"] for d in kinds(rows, kind="decision")] == ["enter", "pyramiding_disabled", "end_of_data"]
    alone = [bar(0, 100.0, 100.0, 100.0, 100.0, 0), bar(1, 100.0, 100.0, 100.0, 100.0, 1), bar(5, 100.0, 100.0, 100.0, 100.0, 1)]
    assert [d["reason"] for d in kinds(alone, kind="decision")] == ["no_position", "next_candle_gap", "end_of_data"]
    assert [d["reason"] for d in kinds(alone, simulate.Rules(risk=0.02), "decision")] == ["no_position", "exposure_limit", "exposure_limit"]
    assert [d["reason"] for d in kinds([bar(0, 100.0, 100.0, 100.0, 100.0, -1)], simulate.Rules(spot=True), "decision")] == ["spot_short_not_supported"]


def test_stop_before_target_and_end_of_data():
    rows = [bar(0, 100.0, 100.0, 100.0, 100.0, 1), bar(1, 100.0, 100.5, 99.9, 100.0, 1), bar(2, 100.0, 120.0, 90.0, 100.0, 0), bar(3, 100.0, 100.0, 100.0, 100.0, 0)]
    assert kinds(rows)[1]["reason"] == "STOP_LOSS"
    rows = [bar(i, 100.0, 100.5, 99.9, 100.0, 1) for i in range(4)]
    assert kinds(rows)[1]["reason"] == "END_OF_DATA"
    assert kinds([bar(0, 100.0, 100.0, 100.0, 100.0, 1), bar(1, 100.0, 100.0, 100.0, 100.0, -1), bar(2, 100.0, 100.0, 100.0, 100.0, None)])[1]["reason"] == "REVERSAL"


def test_funding_is_settled_at_every_time_of_a_long_bar():
    """Three days on daily bars make nine payments, two and a half on bars of five hours seven."""
    daily = [{**bar(24 * i, 100.0, 100.0, 100.0, 100.0, 1 if i < 1 else None), "signal": 1 if i == 0 else None} for i in range(4)]
    paid = kinds(daily, simulate.Rules(bar_seconds=86_400), "funding")
    assert len(paid) == 9 and all(p["amount"] == pytest.approx(p["quantity"] * 100 * 0.0001) for p in paid)
    five = [{**bar(5 * i, 100.0, 100.0, 100.0, 100.0, None), "signal": 1 if i == 0 else None} for i in range(12)]
    assert [p["ts"].hour for p in kinds(five, simulate.Rules(bar_seconds=18_000), "funding")] == [8, 16, 0, 8, 16, 0, 8]


def test_funding_beyond_the_margin_liquidates():
    at = T0 + dt.timedelta(hours=8)
    rows = [bar(6, 100.0, 100.0, 100.0, 100.0, 1), bar(7, 100.0, 100.0, 100.0, 100.0, None, rates=[{"at": at, "rate": 0.9}]), bar(8, 100.0, 100.0, 100.0, 100.0, None)]
    rules = simulate.Rules(leverage=2)
    (paid,) = kinds(rows, rules, "funding")
    gone = kinds(rows, rules)[1]
    assert paid["amount"] == kinds(rows, rules)[0]["margin"] < paid["theoretical"] and paid["reason"] == "measured"
    assert gone["reason"] == "LIQUIDATION" and gone["ts"] == at + dt.timedelta(milliseconds=1)
    mild = [bar(6, 100.0, 100.0, 100.0, 100.0, 1), bar(7, 100.0, 100.0, 100.0, 100.0, None, rates=[{"at": at, "rate": 0.1}]), bar(8, 100.0, 100.0, 100.0, 100.0, None), bar(9, 100.0, 100.0, 70.0, 100.0, None)]
    # margin of half the price less a tenth of it: the price may fall by 0.4 less maintenance, not by 0.5
    assert kinds(mild, simulate.Rules(leverage=2, distance=0.9))[1]["reason"] == "END_OF_DATA"
    mild[3]["l"] = 60.2
    assert kinds(mild, simulate.Rules(leverage=2, distance=0.9))[1]["reason"] == "LIQUIDATION"


@pytest.mark.parametrize("leverage,cash", [(1, 1000.0), (3, 1234.56789), (7, 0.5)])
def test_the_largest_quantity_that_cash_covers(leverage, cash):
    book = simulate.Book(simulate.Rules(capital=cash, leverage=leverage), "r", "s")
    price, unit = simulate.money("123.45678901"), simulate.money("0.00000001")
    q = book.affordable(price, simulate.money(10_000))
    assert book.needed(price, q) <= book.cash < book.needed(price, q + unit)
    assert book.affordable(price, q / 2) <= q / 2


def test_slippage_that_grows_with_the_quantity():
    rules = simulate.Rules(capital=1000, spread=0.001, impact=0.5, liquidity=100.0, distance=0.001)
    entry = kinds([bar(0, 100.0, 100.0, 100.0, 100.0, 1), bar(1, 100.0, 100.0, 100.0, 100.0, None)], rules)[0]
    rate = 0.0005 + 0.5 * entry["quantity"] / 100
    assert entry["truncated"] and entry["price"] == pytest.approx(100 * (1 + rate), abs=1e-7) and entry["cash"] >= 0


def test_runs_share_the_bars(spark, sf):
    from tallow import queries

    bars = queries._signals(spark, sf)
    runs = {f"r{i}": simulate.Rules(distance=0.01 + i / 200) for i in range(5)}
    by = {n: sorted(map(tuple, simulate.journal(bars, runs, runs_a_task=n).collect()), key=str) for n in (2, 16)}
    assert by[2] == by[16]
    plain = [simulate.journal_of([r.asDict() for r in bars.filter("sym = 'view'").orderBy("ts").collect()], runs["r3"], "r3", "view")]
    assert sorted((tuple(r.values()) for r in plain[0]), key=str) == [r for r in by[2] if r[0] == "r3" and r[1] == "view"]


def test_net_is_gross_less_costs(spark, sf):
    from tallow.queries import QUERIES

    rows = QUERIES["sim_19"](spark, sf).collect()
    assert rows
    for t in rows:
        assert t["net"] == pytest.approx(t["gross"] - t["fees"] - t["slippage"] - t["funding"], abs=0.03)


def test_metrics_of_known_trades(spark):
    nets = [200.0, -100.0, 150.0, -50.0, 300.0, -120.0, 80.0, 250.0, -70.0, 180.0]
    m = metrics.of_trades(spark.createDataFrame([(x, 100.0) for x in nets], "net double, r0 double")).first()
    assert m.trade_count == 10 and m.win_rate == pytest.approx(0.6) and m.pf == pytest.approx(3.4118, abs=5e-5)
    assert m.payoff == pytest.approx(2.2745, abs=5e-5) and m.kelly == pytest.approx(0.4241, abs=5e-5) and m.expectancy_r == pytest.approx(0.82) and m.sqn is None
    none = metrics.of_trades(spark.createDataFrame([(5.0, 0.0)], "net double, r0 double")).first()
    assert math.isinf(none.pf) and none.expectancy_r is None


def test_drawdown_over_months(spark):
    e = [(T0 + dt.timedelta(days=20 * i), v) for i, v in enumerate([100.0, 110.0, 99.0, 105.0, 120.0, 60.0])]
    d = metrics.of_drawdowns(spark.createDataFrame(e, "ts timestamp, equity double")).first()
    assert d.mdd == pytest.approx(-0.5)


def test_normal_distribution(spark):
    row = spark.range(1).select(metrics.normal_cdf(F.lit(1.96)).alias("a"), metrics.normal_cdf(F.lit(-1.96)).alias("b")).first()
    assert row.a == pytest.approx(0.9750021, abs=1e-6) and row.b == pytest.approx(0.0249979, abs=1e-6)


def test_a_gate_fails_on_what_is_undefined(spark):
    rows = spark.createDataFrame([(40, 2.0, 2.0, 2.0, None, -0.1, 0.0, 0.5)], "trade_count int, pf double, sortino double, calmar double, sqn double, mdd double, ror double, expectancy_r double")
    g = metrics.gate(rows).first()
    assert g.failed == ["sqn"] and not g.passed


def test_confirmed_resampling_drops_incomplete_buckets(spark):
    rows = [("a", T0 + dt.timedelta(minutes=i), 100.0 + i, 101.0 + i, 99.0 - i, 100.0 + i, 1.0, None if i == 3 else 1) for i in range(9) if i != 7]
    df = spark.createDataFrame(rows, "sym string, ts timestamp, o double, h double, l double, c double, v double, q int")
    got = resample.confirmed(df, "1m", "5m", optional=("q",)).collect()
    assert len(got) == 1 and (got[0].o, got[0].h, got[0].l, got[0].c, got[0].v, got[0].q) == (100.0, 105.0, 95.0, 104.0, 5.0, None)
    with pytest.raises(Exception, match="duplicate"):
        resample.confirmed(df.union(df.limit(1)), "1m", "5m").collect()
    assert resample.rolled_up(df, "5m").count() == 2
    with pytest.raises(ValueError):
        resample.timeframe_seconds("0m")


def test_episodes(spark):
    e = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([10, 10, 8, 9, 10, 12, 11])], "sym string, seq int, equity double")
    got = [tuple(r)[1:] for r in audit.episodes(e).orderBy("first").collect()]
    assert got == [(0, 2, 2, 3, 4, 0.2), (5, 6, 6, 6, None, pytest.approx(1 / 12))]


def test_keyed_writes(spark):
    t, n = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in catalog.upserted(t, n, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in catalog.inserted_if_absent(t, n, ["k"]).collect()} == {(3, "d")}
    with pytest.raises(Exception, match="no such row"):
        catalog.compared(t, "k", [1, 9]).collect()


def test_ranges_of_absent_hours(spark):
    rows = [("a", T0 + dt.timedelta(hours=i)) for i in (0, 1, 5, 6, 9)]
    b = spark.createDataFrame(rows, "sym string, ts timestamp_ntz")
    assert sorted(r.steps for r in gaps.ranges(gaps.absent(b, 3600), 3600).collect()) == [2, 3]


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(minutes=7 * i), i, 100.0 + (i * 37) % 11, 1.0) for i in range(300)]
    schema = "sym string, ts timestamp, seq int, price double, size double"
    df = spark.createDataFrame(rows, schema)
    df.filter("seq < 150").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.filter("seq >= 150").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "bars")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.streamed_bars(s).writeStream.foreachBatch(streaming.append_once(out, ["sym", "ts"], "ts")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.ts: (r.o, r.h, r.l, r.c, r.v) for r in streaming.kept_once(spark, out).collect()}
    want = {r.ts: (r.o, r.h, r.l, r.c, r.v) for r in resample.bars_from_ticks(df, "1 hour").collect()}
    assert len(got) >= len(want) - 2 and all(want[k] == v for k, v in got.items())

    b = resample.bars_from_ticks(df, "1 hour")
    b.filter("ts < timestamp '2024-01-01 12:00:00'").coalesce(1).write.parquet(str(tmp_path / "b"))
    b.filter("ts >= timestamp '2024-01-01 12:00:00'").coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    bars = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b"))
    ship(spark)
    with streaming.keyed_state(spark):
        q = streaming.streamed_average(bars, 5).writeStream.format("memory").queryName("averages").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        q.awaitTermination()
    from tallow.plans.layers import run_average

    close = b.orderBy("ts").toPandas()["c"].to_numpy()
    streamed = spark.sql("select value from averages order by ts").toPandas()["value"].to_numpy()
    batch = run_average(close, 5, 2 / 6)
    assert streamed == pytest.approx(batch[~(batch != batch)])
