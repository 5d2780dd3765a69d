import datetime as dt
import math

import pytest

from tallow.plans import registry
from tallow.service import Workspace
from tallow.sources import bars as sources
from tallow.sources import evidence


def test_workspace(spark, sf, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}", sources.hourly(spark, sf))
    assert w.runs.count() == 0 and w.validate({"symbol": "view"}) == []
    assert len(w.validate({"strategy": "x", "timeframe": "7q", "parameters": {"fast": 30}})) == 4
    a = w.trigger_run({"symbol": "view"})
    s = w.trigger_sweep({"symbol": "click", "rules": {"distance": 0.05}}, {"fast": [5, 9]})
    assert a == "run-000001" and w.sweep(s).count() == 2 and w.list_runs().first().total == 3
    assert [j["events"][-1] for j in w.jobs.values()] == ["COMPLETED"] * 3
    assert [r.run_id for r in w.compare_runs(["run-000003", a]).collect()] == ["run-000003", a]
    with pytest.raises(KeyError):
        w.compare_runs(["run-000009"])
    w.add_tag(a, "kind", "base"), w.add_tag(a, "kind", "base"), w.add_tag("run-000002", "kind", "sweep")
    assert w.tag_facets().count() == 2 and w.list_runs(tag=("kind", "base")).first().run_id == a
    w.soft_delete("run-000002")
    assert w.list_runs().count() == 2 and w.list_runs(deleted="only").count() == 1
    with pytest.raises(ValueError):
        w.purge(a)
    w.purge("run-000002")
    assert w.runs.count() == 2 and w.tag_facets().count() == 1
    w.soft_delete(a), w.restore(a)
    trades = w.page(a, "trade").collect()
    assert len(trades) == w.get_run(a).first().trades and len(w.page(a, "trade", after=trades[0].trade_id).collect()) == len(trades) - 1
    assert all(t.net_pnl == t.gross_pnl - t.total_fee - t.slippage - t.funding_cost for t in trades)
    assert w.page(a, "execution").count() == 2 * len(trades) and {r.passed for r in w.page(a, "integrity_check").collect()} == {1}
    assert w.page(a, "trade_feature").count() == min(201, 4 * len(trades))
    for entity in evidence.ENTITIES:
        w.page(a, entity).collect()
    with pytest.raises(ValueError):
        w.page("../x", "trade")
    assert w.candles("view", "4h", "2024-01-01", "2024-02-01").count() >= 0 and w.health()["runs"] == 2


def dense(spark, hours=600):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), *(100 + 10 * math.sin(i / 9) + x for x in (0.0, 1.0, -1.0, 0.5)), 1.0) for i in range(hours)]
    return spark.createDataFrame(rows, "sym string, ts timestamp_ntz, o double, h double, l double, c double, v double")


def test_a_run_is_of_its_timeframe(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}", dense(spark))
    hour, four = w.trigger_run({"symbol": "a"}), w.trigger_run({"symbol": "a", "timeframe": "4h"})
    assert w.validate({"symbol": "a", "timeframe": "30m"}) == ["the timeframe is not made of the bars'"] and len(w.validate({"symbol": "a", "rules": {"nothing": 1}})) == 1
    marks = {r: w.page(r, "portfolio_pnl", limit=200).collect() for r in (hour, four)}
    steps = {r: {(b.ts - a.ts).total_seconds() for a, b in zip(m, m[1:]) if (b.ts - a.ts).total_seconds() > 1} for r, m in marks.items()}
    assert steps == {hour: {3600.0}, four: {14400.0}}
    assert all(t.entry_time.hour % 4 == 0 for t in w.page(four, "trade").collect())
    assert {r.config_hash for r in w.runs.collect()} == {w.get_run(hour).first().config_hash, w.get_run(four).first().config_hash} and w.runs.count() == 2
    sweep = w.trigger_sweep({"symbol": "a"}, {"distance": [0.01, 0.03], "fast": [5, 9]})
    assert w.sweep(sweep).count() == 4 and len({(r.net, r.trades) for r in w.sweep(sweep).collect()}) == 4


def test_numbers_are_claimed_once(spark, tmp_path):
    w, other = (Workspace(spark, f"file://{tmp_path}", dense(spark, 60)) for _ in range(2))
    assert [w._number(), other._number(), w._number()] == [1, 2, 3]


def test_preregistration_and_data_jobs(spark, tmp_path):
    bars = dense(spark)
    w = Workspace(spark, f"file://{tmp_path}", bars.filter("ts < timestamp_ntz '2024-01-10 00:00:00'"))
    run = w.trigger_run({"symbol": "a"})
    declared = {"hypothesis": "h", "primary_metric": "pf", "success_threshold": 1.3, "failure_threshold": 1.0, "edge_distinguishable": True, "higher_is_better": True, "declared_by": "me"}
    with pytest.raises(ValueError):
        w.register(run, {"hypothesis": "h"})
    w.register(run, declared)
    assert w.prereg(run).first().primary_metric == "pf"
    with pytest.raises(ValueError):
        w.register(run, declared)
    job = w.trigger_data_job("a", "2024-01-09 00:00:00", "2024-01-12 00:00:00", lambda s, a, b: bars)
    bad = w.trigger_data_job("a", "2024-01-09 00:00:00", "2024-01-12 00:00:00", lambda s, a, b: 1 / 0)
    got = {r.job_id: (r.status, r.rows) for r in w.data_jobs().collect()}
    assert got == {job: ("COMPLETED", 72), bad: ("FAILED", None)} and w.bars.count() == 11 * 24
    assert [r.event for r in w.data_job_events(job, 1).collect()] == ["RUNNING", "COMPLETED"] and w.data_jobs("FAILED").count() == 1
    w.soft_delete(run), w.purge(run)
    assert w.prereg(run).isEmpty() and w.runs.isEmpty()


def test_registry():
    assert registry.found("MACD", {"fast": 5})[1] == {"fast": 5, "slow": 26, "signal": 9}
    assert registry.series_key("ema", {"n": 9}, "1h") == "ema:n=9@1h"
    assert registry.resolved("auto", ["RSI", "rsi"]) == ["rsi"] and len(registry.resolved("all")) > 150
    for bad in (("nothing", {}), ("rsi", {"m": 1}), ("pat_doji", {"n": 1})):
        with pytest.raises(ValueError):
            registry.found(*bad)


def test_one_plan_for_many(spark, sf):
    bars = sources.hourly(spark, sf)
    both = registry.compute(bars, {"a": ("dema", {"n": 5}), "b": ("macd", {}), "p": ("pat_doji", {})})
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") <= 4
    one = registry.compute(bars, {"a": ("dema", {"n": 5})})
    assert sorted(map(tuple, both.select("sym", "ts", "a__value").collect()), key=str) == sorted(map(tuple, one.collect()), key=str)


def test_bars_are_made_once(spark, tmp_path):
    """Whatever runs and routes do, the frame that the bars came from is read once."""
    from tallow.service import Workspace

    source = f"file://{tmp_path}/source"
    spark.sql("select 'a' as sym, timestamp_ntz '2024-01-01 00:00:00' as ts, 1d as o, 1d as h, 1d as l, 1d as c, 1d as v").write.parquet(source)
    w = Workspace(spark, f"file://{tmp_path}/space", spark.read.parquet(source))
    w.trigger_data_job("a", "2024-01-01 00:00:00", "2024-01-02 00:00:00", lambda s, a, b: w.bars)
    assert all("/space/" in f for f in w.bars.inputFiles()) and w.bars.count() == 1
