"""Texts, money, catalog and registry functions on small cases."""

import datetime as dt
import json
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallow.functions import texts
from tallow.operators import catalog, hashtree, money, patterns, resample, simulate
from tallow.plans import registry
from tallow.session import shared_dir

T0 = dt.datetime(2024, 1, 1)


def test_canonical_json():
    assert texts.canonical({"b": [1.0, 2.5, 1e-7, 1e21, -0.0], "a": {"z": None, "y": True, "x": "é\n"}}) == '{"a":{"x":"é\\n","y":true,"z":null},"b":[1,2.5,0.0000001,1000000000000000000000,-0.0]}'
    with pytest.raises(ValueError):
        texts.canonical(float("nan"))


def test_names_and_cut_decimals(spark):
    df = spark.createDataFrame([("x",), ("",), ("é|2024",)], "s string")
    for r in df.select("s", texts.uuid5(F.col("s")).alias("u")).collect():
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.s))
    d = spark.createDataFrame([(Decimal("1.2399"),), (Decimal("-1.2399"),)], "x decimal(10,4)")
    assert [float(r[0]) for r in d.select(texts.round_down(F.col("x"), 2)).collect()] == [1.23, -1.23]
    j = spark.createDataFrame([(1, '{"a": {"b": 1, "c": "t"}, "d": [2, 1]}'), (2, '{"a": {"b": 2, "c": "t"}}'), (3, None)], "run long, j string")
    assert {tuple(r) for r in catalog.differing(catalog.settings(j, "run", "j")).collect()} == {("a.b", "1,2")}


def test_sizes_and_limits(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(money.risk_size(F.lit(0.01), F.lit(1000.0), F.lit(2.0))) == 5.0 and value(money.risk_size(F.lit(0.011), F.lit(1000.0), F.lit(2.0))) is None
    assert value(money.capped(money.kelly(F.lit(0.6), F.lit(2.0)))) == pytest.approx(0.2) and value(money.capped(money.kelly(F.lit(0.2), F.lit(1.0)))) == 0
    assert value(money.within(F.lit(0.1) + 0.2, F.lit(0.3))) and not value(money.within(F.lit(0.3001), F.lit(0.3)))
    for bad in (lambda: money.capped(F.lit(1.0), 0.6), lambda: money.wallet_share(F.lit(1.0), 1.2)):
        with pytest.raises(ValueError):
            bad()
    plan = lambda p, side, price, n, cash: one.select(p.plan(F.lit(side), F.lit(price), F.lit(n), F.lit(100_000.0), F.lit(cash)).alias("p")).first().p
    t = plan(money.Turtle(), 1, 100.0, 2.0, 10_000.0)
    assert (t.stop, t.target, t.quantity, t.leverage, t.refusal) == (96.0, None, 250.0, 3, None)
    assert plan(money.Turtle(), 1, 100.0, 2.0, 1_000.0).refusal == "leverage" and plan(money.Turtle(cap=100), 1, 100.0, 2.0, 1_000.0).refusal == "liquidation_before_stop"
    assert plan(money.Turtle(), 1, 100.0, 60.0, 10_000.0).refusal == "price_not_positive" and plan(money.Manual(), -1, 100.0, None, 1.0).refusal == "no_distance"


def test_guard(spark):
    row = {"sym": "A", "mode": "paper", "spot": False, "side": 1, "quantity": 1.0, "price": 100.0, "stop": 99.0, "equity": 1000.0, "market_risk": 0.0, "total_risk": 0.0, "direction_risk": 0.0}
    cases = {None: {}, "paper_only": {"mode": "live"}, "symbol_not_canonical": {"sym": "a"}, "symbol_not_allowed": {"sym": "B"}, "spot_short_not_supported": {"spot": True, "side": -1}, "max_order_quantity": {"quantity": 99.0}, "max_order_notional": {"price": 9_999.0}, "protective_stop_required": {"stop": None}, "one_r_limit": {"stop": 80.0}, "direction_required": {"side": 0}, "exposure_limit": {"total_risk": 0.02}}
    schema = "sym string, mode string, spot boolean, side int, quantity double, price double, stop double, equity double, market_risk double, total_risk double, direction_risk double"
    guard = simulate.Guard(("A",), 10, 5000)
    got = [r.reason for r in guard.judged(spark.createDataFrame([tuple({**row, **c}.values()) for c in cases.values()], schema)).collect()]
    assert got == list(cases)
    assert {r.reason for r in simulate.Guard(("A",), 10, 5000, killed=True).judged(spark.createDataFrame([tuple(row.values())], schema)).collect()} == {"kill_switch"}


def test_a_bar_off_the_grid_makes_its_bucket_incomplete(spark):
    rows = [("a", T0 + dt.timedelta(minutes=5 * i + (1 if i == 4 else 0)), 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(6)]
    bars = spark.createDataFrame(rows, "sym string, ts timestamp, o double, h double, l double, c double, v double")
    assert resample.confirmed(bars, "5m", "15m").count() == 1
    assert tuple(resample.dropped(bars, "5m", "15m").first()) == ("a", 1, 1)


def test_catalog_writes(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, v string, x double")
    got = {tuple(r) for r in catalog.patched(t, spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, x double"), ["k"]).collect()}
    assert got == {(1, "a", 1.0), (2, "b", 5.0), (3, None, 6.0)}
    d = catalog.soft_deleted(t.withColumn("deleted_at", F.lit(None).cast("date")), t.filter("k = 1"), "k", F.lit(T0.date()))
    again = catalog.soft_deleted(d, t, "k", F.lit(dt.date(2030, 1, 1)))
    assert {(r.k, str(r.deleted_at)) for r in again.collect()} == {(1, "2024-01-01"), (2, "2030-01-01")}
    new = catalog.registered(spark.createDataFrame([(7,)], "run_seq long"), spark.createDataFrame([("z",), ("y",)], "name string"), ["name"])
    assert {(r.name, r.run_id) for r in new.collect()} == {("y", "run-000008"), ("z", "run-000009")}


def test_group_hashes_do_not_depend_on_the_rows_order(spark):
    df = spark.range(3000).selectExpr("id % 3 as g", "id as a", "cast(id * 7 as string) as b")
    one = {r.g: r.content_hash for r in hashtree.content_hash(df, ["a", "b"], "g", 4).collect()}
    assert one == {r.g: r.content_hash for r in hashtree.content_hash(df.orderBy(F.desc("id")).repartition(5), ["a", "b"], "g", 4).collect()} and len(set(one.values())) == 3
    assert one != {r.g: r.content_hash for r in hashtree.content_hash(df.filter("id <> 9"), ["a", "b"], "g", 4).collect()}


def test_series_of_timeframes():
    assert registry.resolved_series("explicit", [], ["EMA:n=9@strategy", "ema:n=9", "macd@4h"], "1h") == {"ema:n=9@1h": ("ema", {"n": 9}, "1h"), "macd:fast=12,signal=9,slow=26@4h": ("macd", {"fast": 12, "slow": 26, "signal": 9}, "4h")}
    for bad in ("ema@30m", "nothing@4h", "ema:q=1"):
        with pytest.raises(ValueError):
            registry.resolved_series("explicit", [], [bad], "1h")
    with pytest.raises(ValueError):
        patterns.pattern("doji", 1, "0")


def test_the_shared_folder_is_the_session_s(spark):
    assert shared_dir(spark).startswith("file:") and json.dumps(shared_dir(spark)) and shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_functions_of_numbers_of_any_size_are_those_of_the_sql(spark, tmp_path):
    """Exponentials and rounding to the last digit, and signs of zeros, of small, large, negative and absent values."""
    duckdb = pytest.importorskip("duckdb")
    from tallow.queries import ORACLES, QUERIES

    values = [None, 0.0, -1.5, 0.25, 29.27, 56428.62916861274, 0.0015196427413980455, 851.371609622, 1e-9, 72339.94362880627, 8e5, 1e9] + [i * 13.37 for i in range(4000)] + [-i * 1.01 for i in range(200)]
    events = spark.createDataFrame(list(enumerate(values)), "event_id bigint, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.execute(ORACLES["fun_math"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["fun_math"](spark, str(tmp_path)).collect())
    text = lambda rows: [[str(c).replace("-nan", "nan") for c in row] for row in rows]
    assert [r for r in zip(text(got), text(want)) if r[0] != r[1]] == []
