import datetime as dt

import pytest

from tallow.operators import plugins
from tallow.sources import paged
from tallow.streaming.wallet import wallet_fills
from tallow.session import ship
from tallow.streaming.bars import keyed_state


def test_parameters():
    s = plugins.Schema({"n": plugins.Parameter(int, 5, 1, 9), "x": plugins.Parameter(float, 0.5), "m": plugins.Parameter(str, "a", choices=("a", "b"))})
    assert s.resolved({"n": 3}) == {"n": 3, "x": 0.5, "m": "a"}
    for bad in ({"q": 1}, {"n": 0}, {"m": "c"}):
        with pytest.raises(ValueError):
            s.resolved(bad)
    with pytest.raises(TypeError):
        s.resolved({"n": True})


def test_discovery_and_decisions(spark):
    found = plugins.discovered("tallow.operators.plugins")
    assert list(found) == ["ema_regime"] and isinstance(found["ema_regime"], plugins.Strategy)
    t0 = dt.datetime(2024, 1, 1)
    lines = [(None, 1.0), (2.0, 1.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (3.0, 2.0)]
    df = spark.createDataFrame([("a", t0 + dt.timedelta(hours=i), f, s) for i, (f, s) in enumerate(lines)], "sym string, ts timestamp_ntz, fast double, slow double")
    got = [r.action for r in plugins.decided(df, found["ema_regime"]).orderBy("ts").collect()]
    assert got == ["HOLD", "ENTER_LONG", "HOLD", "EXIT", "ENTER_SHORT", "EXIT"]


def test_pages_advance():
    rows = list(paged.pages(paged.arithmetic, "aa", 0, 60 * 300, 50))
    assert [r[0] for r in rows] == [m * 60 for m in range(300) if m % 97]
    with pytest.raises(ValueError):
        list(paged.pages(lambda s, a, b, n: [(0, 1)] * n, "aa", 0, 100, 2))


def test_wallets_count_each_signal_once(spark, tmp_path):
    schema = "wallet string, signal_id bigint, sym string, side int, open double"
    first = [("w", 1, "a", 1, 100.0), ("w", 2, "a", 1, 101.0), ("w", 3, "b", 1, 5.0)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([*first, ("w", 4, "a", -1, 110.0), ("w", 5, "a", 0, 100.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ship(spark)
    with keyed_state(spark):
        q = wallet_fills(s, fee=0.0, slip=0.0, allowed=("a",)).writeStream.format("memory").queryName("fills").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.sql("select signal_id, side, reason, cash, position from fills").collect()
    assert sorted((r.signal_id, r.side, r.reason) for r in got) == [(1, 1, "opened"), (3, 1, "symbol_not_allowed"), (4, -1, "opened"), (4, 0, "closed"), (5, 0, "closed")]
    assert {r.position for r in got if r.signal_id == 5} == {0.0} and [r.cash for r in got if r.signal_id == 5][0] == pytest.approx(102_000 + 0.2 * 102_000 / 11)
