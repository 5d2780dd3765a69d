"""Queries over whole tables, by brute force on the smallest ones."""

import datetime as dt
import random

import numpy as np
import pytest

from tallow.operators import resampling
from tallow.queries import QUERIES
from tallow.streaming import bars as streaming


def test_joins_cover_every_row(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate").collect()
    firsts = sorted({o.o_orderdate for o in orders if o.o_orderdate.day == 1})
    day = dt.timedelta(days=1)
    want = sorted((o.o_orderkey, i) for o in orders for i, d in enumerate(firsts, 1) if o.o_orderdate <= d + 10 * day and o.o_orderdate + 2 * day >= d)
    assert sorted((r.o_orderkey, r.episode) for r in QUERIES["joi_10"](spark, sf).collect()) == want

    events = spark.read.parquet(f"{sf}/events.parquet").collect()
    by: dict[str, list] = {}
    for e in sorted(events, key=lambda e: (e.ts, e.event_id)):
        by.setdefault(e.event_type, []).append(e)
    candles = {}
    for e in events:
        after = [t.value for t in by[e.event_type] if e.ts < t.ts <= e.ts + dt.timedelta(hours=1)]
        if after:
            candles[e.event_id] = (after[0], max(after), min(after), after[-1], len(after))
    assert {r.event_id: (r.o, r.h, r.l, r.c, r.n) for r in QUERIES["joi_14"](spark, sf).collect()} == candles

    opens: dict[tuple, float] = {}
    for kind, rows in by.items():
        for e in rows:
            opens.setdefault((kind, e.ts.replace(minute=0, second=0, microsecond=0)), e.value)
    nexts = {e.event_id: min(((ts, o) for (kind, ts), o in opens.items() if kind == e.event_type and ts > e.ts), default=(None, None)) for e in events}
    assert {r.event_id: (r.next_ts, r.next_o) for r in QUERIES["joi_13"](spark, sf).collect()} == nexts


def test_no_query_stops_at_an_id(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect()
    epoch = dt.datetime(1970, 1, 1)
    eighths = lambda t: (t - epoch) // dt.timedelta(hours=8)
    want = sorted((e.event_id, b * 28800.0) for e in events for b in range(eighths(e.ts) + 1, eighths(e.ts + dt.timedelta(hours=20)) + 1))
    assert sorted((r.event_id, r.at) for r in QUERIES["sim_18"](spark, sf).collect()) == want
    assert sorted(r.event_id for r in QUERIES["joi_15"](spark, sf).collect()) == [e.event_id for e in events]


def test_wallets_consume_every_event(spark, sf):
    wallets: dict[str, tuple[float, float]] = {}
    want = []
    for e in spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect():
        w, side, price = f"w{e.event_id % 5}", e.event_id % 3 - 1, e.value + 1
        cash, position = wallets.get(w, (100_000.0, 0.0))
        if e.event_type not in ("view", "click", "signup", "purchase"):
            want.append((w, e.event_id, side, "symbol_not_allowed", cash, position))
            continue
        if position and side * position <= 0:
            at = price * (0.9995 if position > 0 else 1.0005)
            cash, position = cash + position * at - abs(position) * at * 0.0005, 0.0
            want.append((w, e.event_id, 0, "closed", cash, position))
        if side and not position:
            at = price * (1 + 0.0005 * side)
            quantity = max(0.0, cash) * 0.2 / at
            position = side * quantity
            cash -= position * at + quantity * at * 0.0005
            want.append((w, e.event_id, side, "opened", cash, position))
        wallets[w] = cash, position
    got = sorted((r.wallet, r.signal_id, r.reason, r.side, r.cash, r.position) for r in QUERIES["sim_29"](spark, sf).collect())
    assert [g[:4] for g in got] == [(w, i, reason, side) for w, i, side, reason, _, _ in sorted(want, key=lambda x: (x[0], x[1], x[3]))]
    assert [g[4:] for g in got] == [pytest.approx(x[4:], rel=1e-9) for x in sorted(want, key=lambda x: (x[0], x[1], x[3]))]


def walked(rs: np.ndarray, draws: np.ndarray) -> tuple[list[float], list[bool]]:
    """Ends of given draws (a row a path), by the whole history of each path at once."""
    history = np.cumprod(1 + rs[draws] / 100, axis=1)
    highs = np.maximum.accumulate(np.column_stack([np.ones(len(draws)), history]), axis=1)[:, 1:]
    return rs[draws].sum(axis=1).tolist(), (history / highs <= 0.4).any(axis=1).tolist()


@pytest.mark.parametrize("n", [1, 50, 1000])
def test_paths_in_blocks_are_those_of_their_draws(n):
    rs = np.array([random.Random(n + i).uniform(-6, 7) for i in range(n)])
    total, ruined = resampling.resampled_paths(rs, 40, np.random.default_rng(7), step=n)
    want = walked(rs, np.random.default_rng(7).integers(0, n, (40, n)))
    assert total.tolist() == pytest.approx(want[0]) and ruined.tolist() == want[1]
    rng = np.random.default_rng(7)
    draws = np.concatenate([rng.integers(0, n, (40, min(7, n - i))) for i in range(0, n, 7)], axis=1)
    total, ruined = resampling.resampled_paths(rs, 40, np.random.default_rng(7), step=7)
    assert total.tolist() == pytest.approx(walked(rs, draws)[0]) and ruined.tolist() == walked(rs, draws)[1]


def test_monte_carlo_takes_all_multiples_and_paths(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").orderBy("o_orderkey").collect()
    rs: dict[str, list[float]] = {}
    for o in orders:
        rs.setdefault(str(o.o_orderdate.year), []).append((o.o_totalprice - 250000) / 10000)
    got = {r.run_id: r for r in QUERIES["val_03"](spark, sf).collect()}
    assert set(got) == set(rs) and {r.run_id: r for r in QUERIES["val_03"](spark, sf).collect()} == got
    for year, values in rs.items():
        values = np.array(values)
        blocks = [np.random.default_rng([0, k, *year.encode()]).integers(0, len(values), (250, len(values))) for k in range(40)]
        ends = [walked(values, b) for b in blocks]
        totals, ruined = np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])
        assert (got[year].p05, got[year].p95) == pytest.approx(tuple(np.quantile(totals, [0.05, 0.95]))) and got[year].ruin == pytest.approx(ruined.mean())
        # and as the theory has it: a sum of n draws is about normal
        spread = 1.645 * values.std() * len(values) ** 0.5
        assert got[year].p95 - got[year].p05 == pytest.approx(2 * spread, rel=0.06)
    none = resampling.monte_carlo(spark.createDataFrame([("a", 1, None)], "run_id string, trade_id bigint, r double"), paths=600).first()
    assert tuple(none) == ("a", 0.0, 0.0, 0.0)


@pytest.mark.parametrize("kind", ["touched", "update"])
def test_late_ticks_correct_stored_bars(spark, tmp_path, kind):
    schema = "sym string, ts timestamp, seq bigint, price double, size double"
    t0 = dt.datetime(2024, 1, 1)
    minute = dt.timedelta(minutes=1)
    first = [("a", t0 + 10 * i * minute, i, 100.0 + i, 1.0) for i in range(30)]
    late = [("a", t0 + 5 * minute, 100, 500.0, 2.0), ("a", t0 + 61 * minute, 101, 1.0, 1.0), ("b", t0, 102, 7.0, 1.0)]
    for i, rows in enumerate((first, late)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    ticks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    raw, out = str(tmp_path / "raw"), str(tmp_path / "bars")
    writer = ticks.writeStream.foreachBatch(streaming.refreshed(raw, out)) if kind == "touched" else streaming.rolling_bars(ticks).writeStream.outputMode("update").foreachBatch(streaming.put(out))
    writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want: dict[tuple, list] = {}
    for sym, ts, seq, price, size in sorted([*first, *late], key=lambda x: (x[1], x[2])):
        want.setdefault((sym, ts.replace(minute=0)), []).append((price, size))
    got = {(r.sym, r.ts): (r.o, r.h, r.l, r.c, r.v) for r in streaming.stored_bars(spark, out).collect()}
    assert got == {k: (v[0][0], max(p for p, _ in v), min(p for p, _ in v), v[-1][0], sum(s for _, s in v)) for k, v in want.items()}
    if kind == "touched":  # a replay changes nothing, a corrected tick its bar
        batch = spark.createDataFrame([("a", t0, 0, 900.0, 1.0)], schema)
        for _ in range(2):
            streaming.refreshed(raw, out)(batch, 7)
        again = {(r.sym, r.ts): (r.o, r.h, r.v) for r in streaming.stored_bars(spark, out).collect()}
        assert again[("a", t0)] == (900.0, 900.0, got[("a", t0)][4]) and len(again) == len(got)


def test_the_overfit_bundle_has_its_monte_carlo(spark, sf):
    got, alone = QUERIES["val_06"](spark, sf).collect(), QUERIES["met_10"](spark, sf).first()
    assert len(got) == 1 and got[0].folds and got[0].psr is not None and got[0].ruin == alone.ruin and got[0].p05 < got[0].p95


def test_bars_aggregate_without_a_sort(spark):
    """First and last prices by (ts, seq) are hash aggregates, whatever the numbers; null numbers come first."""
    from tallow.operators.resample import bars_from_ticks

    big = 2**63 - 1
    rows = [("a", "2024-01-01 00:00:01", big, 1.0), ("a", "2024-01-01 00:00:01", -big, 2.0), ("a", "2024-01-01 00:00:02", -big, 3.0), ("a", "2024-01-01 00:00:02", None, 4.0), ("b", "1969-01-01 00:00:02", 1, 5.0), ("b", "1969-01-01 00:00:01.000001", 9, 6.0)]
    ticks = spark.createDataFrame(rows, "sym string, at string, seq bigint, price double").selectExpr("sym", "cast(at as timestamp) as ts", "seq", "price", "1d as size")
    bars = bars_from_ticks(ticks, "1 hour")
    assert {(r.sym, r.o, r.c, r.v) for r in bars.collect()} == {("a", 2.0, 3.0, 4.0), ("b", 6.0, 5.0, 2.0)}
    assert "SortAggregate" not in bars._jdf.queryExecution().executedPlan().toString()


def test_a_group_of_most_rows_meets_its_depth_where_it_lies(spark):
    from tallow.operators import hashtree

    rows = spark.range(3000).selectExpr("id as k", "concat('x', id % 2) as g")
    tree = hashtree.leaves(rows, ["k"], "g", hashtree.depths(rows, ["k"], "g", 64))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in hashtree.leaves(rows, ["k"], "g", hashtree.depths(rows, ["k"], "g", 64))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tree.agg({"rows": "sum"}).first()[0] == 3000


def _table(spark, tmp_path, **tables):
    for name, text in tables.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_logarithms_of_nothing_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from tallow.queries import ORACLES, QUERIES

    sf = _table(spark, tmp_path, events="select id as event_id, cast(id - 1 as double) as value from range(3)")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["fun_math"].replace("/ 1000)", "/ 1000)")).fetchall())
    assert sorted(map(repr, map(tuple, QUERIES["fun_math"](spark, sf).collect()))) == sorted(map(repr, want))


def test_names_of_long_numbers_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from tallow.queries import ORACLES, QUERIES

    sf = _table(spark, tmp_path, orders="select 9000001L as o_orderkey", customer="select id as c_custkey, 3 as c_nationkey from range(30)")
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    got = QUERIES["snk_05"](spark, sf).select("c_custkey", "run_seq", "run_id", "status")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLES["snk_05"]).fetchall())


def test_orders_meet_their_bar_within_a_day(spark):
    """No window holds all orders of a series, nor looks at all bars behind each of them."""
    from tallow.operators import simulate

    orders = spark.sql("select id as order_id, 'a' as sym, timestamp_ntz '2024-01-01 00:30:00' + make_dt_interval(id) as ts, 'market' as kind, 1 as side, 1d as level, 1 as quantity from range(9)")
    bars = spark.sql("select 'a' as sym, ts, 2d as o, 3d as h, 1d as l from values (timestamp_ntz '2024-01-01 00:30:00'), (timestamp_ntz '2024-01-05 00:00:00') t(ts)")
    met = simulate.matched(orders, bars)
    assert {str(r.bar_ts) for r in met.filter("order_id < 4").collect()} == {"2024-01-05 00:00:00"} and met.filter("bar_ts is null").count() == 5
    assert "unboundedfollowing" not in met._jdf.queryExecution().optimizedPlan().toString().lower().split("__near")[0]
