"""Queries of the workspace's routes: two runs, a sweep, tags and data jobs over the hourly bars, read back through the routes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import replay
from .operators import simulate
from .plans.layers import as_sql
from .queries import _BARE, _EMAS, _FOUR, BARS, ORACLES, _ntz, query
from .service import Workspace
from .session import shared_dir
from .sources import bars as sources

A, B, C, D = (f"run-{i:06d}" for i in (1, 2, 3, 4))
_RULES = {A: simulate.Rules(), B: simulate.Rules(distance=0.05), C: simulate.Rules(distance=0.01), D: simulate.Rules(distance=0.03)}
_SYMBOL = {A: "view", B: "click", C: "view", D: "view"}
_spaces: dict[tuple[str, str], Workspace] = {}


def _space(spark: SparkSession, sf_dir: str) -> Workspace:
    """A workspace of this session with its four runs, made once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _spaces:
        w = Workspace(spark, f"{shared_dir(spark)}/workspace-{uuid.uuid4().hex[:12]}", sources.hourly(spark, sf_dir))
        bars = w.bars
        w.trigger_run({"symbol": "view"})
        w.trigger_run({"symbol": "click", "rules": {"distance": 0.05}})
        w.the_sweep = w.trigger_sweep({"symbol": "view"}, {"distance": [0.01, 0.03]})
        for run_id, kind, value in ((A, "kind", "base"), (B, "kind", "base"), (B, "mood", "wild"), (C, "kind", "sweep"), (C, "kind", "sweep"), (D, "kind", "gone")):
            w.add_tag(run_id, kind, value)
        w.remove_tag(D, "kind", "gone")
        w.register(A, {"hypothesis": "regimes last", "primary_metric": "pf", "success_threshold": 1.3, "failure_threshold": 1.0, "edge_distinguishable": True, "higher_is_better": True, "declared_by": "the author"})
        w.add_finding(A, "stops are near", "high")
        w.the_job = w.trigger_data_job("view", "2024-01-05 00:00:00", "2024-01-06 00:00:00", lambda s, a, b: bars.filter(F.col("sym") == s))
        w.bars = bars
        _spaces[key] = w
    return _spaces[key]


def _fixed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The few rows of df as they are now, whatever changes later."""
    return spark.createDataFrame(df.collect(), df.schema)


_OF_RUNS = " or ".join(f"(run_id = '{r}' and sym = '{s}')" for r, s in _SYMBOL.items())
_WITH = f"{replay.steps(_BARE, _RULES)}, mine as (select * from trade where {_OF_RUNS}), summary as (select run_id, sym as symbol, count(*) as trades, round(sum(net), 2) as net from mine group by all)"
_OF_A = f"run_id = '{A}' and sym = 'view'"


def _at(column: str, name: str) -> str:
    return f"make_timestamp((round({column}, 3) * 1000000)::bigint) as {name}"


def _rows(*rows: tuple, columns: str) -> str:
    shown = ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"select * from (values {shown}) t({columns})"


def _of_runs(df: DataFrame) -> DataFrame:
    return df.select("run_id", "symbol", "trades", F.round("net", 2).alias("net"))


# ---- runs


@query("api_validate", _rows((1, "unknown key: x"), (1, "symbol is missing"), (2, "fast must be shorter than slow"), (3, "unknown rule: speed"), columns="k, message"))
def api_validate(spark, sf_dir):
    w = _space(spark, sf_dir)
    asked = {1: {"x": 1}, 2: {"symbol": "view", "parameters": {"fast": 30}}, 3: {"symbol": "view", "rules": {"speed": 1}}, 4: {"symbol": "view", "timeframe": "4h"}}
    return spark.createDataFrame([(k, m) for k, c in asked.items() for m in w.validate(c)], "k int, message string")


@query("api_runs_post", f"{_WITH} select *, 'COMPLETED' as status from summary where run_id in ('{A}', '{B}')")
def api_runs_post(spark, sf_dir):
    return _of_runs_with(_space(spark, sf_dir).runs.filter(F.col("run_id").isin(A, B)), "status")


def _of_runs_with(df: DataFrame, *more: str) -> DataFrame:
    return df.select("run_id", "symbol", "trades", F.round("net", 2).alias("net"), *more)


@query("api_sweeps_post", f"{_WITH} select run_id, symbol, trades, net, 'COMPLETED' as status from summary where run_id in ('{C}', '{D}')")
def api_sweeps_post(spark, sf_dir):
    w = _space(spark, sf_dir)
    return _of_runs_with(w.runs.filter(F.col("sweep_id") == w.the_sweep), "status")


@query("api_sweep", f"{_WITH} select run_id, symbol, trades, net from summary where run_id in ('{C}', '{D}')")
def api_sweep(spark, sf_dir):
    w = _space(spark, sf_dir)
    return _of_runs(w.sweep(w.the_sweep))


@query("api_jobs_status", _rows(*((r, "COMPLETED") for r in (A, B, C, D)), columns="run_id, status"))
def api_jobs_status(spark, sf_dir):
    w = _space(spark, sf_dir)
    return spark.createDataFrame([(w.job(j)["run_id"], w.job(j)["events"][-1]) for j in w.jobs], "run_id string, status string")


@query("api_jobs_events", _rows(*((r, i, e) for r in (A, B, C, D) for i, e in enumerate(("QUEUED", "RUNNING", "COMPLETED"))), columns="run_id, k, event"))
def api_jobs_events(spark, sf_dir):
    w = _space(spark, sf_dir)
    return spark.createDataFrame([(j["run_id"], i, e) for j in w.jobs.values() for i, e in enumerate(j["events"])], "run_id string, k int, event string")


@query("api_runs_list", f"{_WITH} select *, 3 as total from summary where symbol = 'view' order by net desc, run_id desc limit 2 offset 1")
def api_runs_list(spark, sf_dir):
    rows = _space(spark, sf_dir).list_runs(symbol="view", sort="net", limit=2, offset=1)
    return _of_runs_with(rows, "total")


@query("api_compare", f"{_WITH} select *, case run_id when '{C}' then 0 else 1 end as position from summary where run_id in ('{A}', '{C}')")
def api_compare(spark, sf_dir):
    return _of_runs_with(_space(spark, sf_dir).compare_runs([C, A]), "position")


@query("api_run", f"{_WITH} select run_id, symbol, trades, net, '1h' as timeframe, 'COMPLETED' as status from summary where run_id = '{B}'")
def api_run(spark, sf_dir):
    return _of_runs_with(_space(spark, sf_dir).get_run(B), "timeframe", "status")


@query("api_summary", f"{_WITH} select run_id, round(sum(net) filter (net > 0) / sum(-net) filter (net < 0), 4) as pf from mine group by 1")
def api_summary(spark, sf_dir):
    return _space(spark, sf_dir).runs.select("run_id", F.round("pf", 4).alias("pf"))


@query("api_prereg", f"select '{A}' as run_id, 'regimes last' as hypothesis, 'pf' as primary_metric, 1.3e0 as success_threshold, true as higher_is_better")
def api_prereg(spark, sf_dir):
    return _space(spark, sf_dir).prereg(A).select("run_id", "hypothesis", "primary_metric", "success_threshold", "higher_is_better")


@query("api_delete", f"select '{D}' as run_id, 'only' as seen union all select r, 'none' from (values ('{A}'), ('{B}'), ('{C}')) t(r)")
def api_delete(spark, sf_dir):
    w = _space(spark, sf_dir)
    w.soft_delete(D)
    views = [w.list_runs(deleted=d).select("run_id", F.lit(d).alias("seen")) for d in ("only", "none")]
    out = _fixed(spark, views[0].unionByName(views[1]))
    w.restore(D)
    return out


@query("api_restore", _rows(*((r,) for r in (A, B, C, D)), columns="run_id"))
def api_restore(spark, sf_dir):
    w = _space(spark, sf_dir)
    w.soft_delete(C)
    w.restore(C)
    return _fixed(spark, w.list_runs().select("run_id"))


@query("api_purge", _rows((A, "kept"), ("run-000005", "purged"), columns="run_id, outcome"))
def api_purge(spark, sf_dir):
    """Only a deleted run goes for good; its number is not given again."""
    w = Workspace(spark, f"{shared_dir(spark)}/workspace-{uuid.uuid4().hex[:12]}", _space(spark, sf_dir).bars)
    for i in (1, 5):
        w._put("runs", spark.createDataFrame([{"run_id": f"run-{i:06d}", "run_seq": i, "status": "COMPLETED", "symbol": "view"}], w.runs.schema))
    w.soft_delete("run-000005")
    w.purge("run-000005")
    try:
        w.purge(A)
    except ValueError:
        pass
    left = {r.run_id for r in w.runs.collect()}
    return spark.createDataFrame([(r, "kept" if r in left else "purged") for r in (A, "run-000005")], "run_id string, outcome string")


# ---- data, tags, strategies


@query("api_data_jobs_post", f"select 'COMPLETED' as status, count(*) as \"rows\" from ({BARS}) where sym = 'view' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-06'")
def api_data_jobs_post(spark, sf_dir):
    w = _space(spark, sf_dir)
    return w.data_job(w.the_job).select("status", "rows")


@query("api_data_jobs", "select 'backfill' as kind, 'view' as symbol, 1 as total")
def api_data_jobs(spark, sf_dir):
    return _space(spark, sf_dir).data_jobs(status="COMPLETED").select("kind", "symbol", "total")


@query("api_data_job", "select 'view' as symbol, timestamp '2024-01-05' as since, timestamp '2024-01-06' as until")
def api_data_job(spark, sf_dir):
    w = _space(spark, sf_dir)
    return w.data_job(w.the_job).select("symbol", "since", "until")


@query("api_data_job_events", _rows((2, "RUNNING"), (3, "COMPLETED"), columns="seq, event"))
def api_data_job_events(spark, sf_dir):
    w = _space(spark, sf_dir)
    return w.data_job_events(w.the_job, after=1)


@query("api_strategies", "select 'ema_regime' as name")
def api_strategies(spark, sf_dir):
    return _space(spark, sf_dir).strategies().select("name")


@query("api_tag_facets", _rows(("kind", "base", 2), ("kind", "sweep", 1), ("mood", "wild", 1), columns="tag_type, tag_value, n"))
def api_tag_facets(spark, sf_dir):
    return _space(spark, sf_dir).tag_facets()


@query("api_tags", _rows(("kind", "base"), ("mood", "wild"), columns="tag_type, tag_value"))
def api_tags(spark, sf_dir):
    return _space(spark, sf_dir).run_tags(B).select("tag_type", "tag_value")


@query("api_tags_post", _rows((C, "kind", "sweep"), columns="run_id, tag_type, tag_value"))
def api_tags_post(spark, sf_dir):
    """A tag put twice is there once."""
    return _space(spark, sf_dir).run_tags(C).select("run_id", "tag_type", "tag_value")


@query("api_tags_delete", "select 0 as n")
def api_tags_delete(spark, sf_dir):
    return _space(spark, sf_dir).run_tags(D).agg(F.count("*").alias("n"))


@query("api_coverage", ORACLES["gap_05"])
def api_coverage(spark, sf_dir):
    return _space(spark, sf_dir).coverage()


@query("api_inventory", ORACLES["gap_06"])
def api_inventory(spark, sf_dir):
    return _space(spark, sf_dir).inventory()


@query("api_candles", f"select sym, ts, o, h, l, c, v from ({_FOUR}) where n = 4 and sym = 'view' and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-20' order by ts limit 10")
def api_candles(spark, sf_dir):
    return _ntz(_space(spark, sf_dir).candles("view", "4h", "2024-01-03 00:00:00", "2024-01-20 00:00:00", limit=10))


@query("api_health", "select 4 as runs, true as series")
def api_health(spark, sf_dir):
    h = _space(spark, sf_dir).health()
    return spark.createDataFrame([(h["runs"], h["series"] > 90)], "runs bigint, series boolean")


# ---- evidence


def _page(name: str, entity: str, sql: str, *columns: str) -> None:
    """A page of the base run's evidence, compared in some of its columns."""

    @query(f"api_{name}", f"{_WITH} {sql}")
    def page(spark, sf_dir):
        return _ntz(_space(spark, sf_dir).page(A, entity).selectExpr(*columns))


_page("trades", "trade", f"select trade_id, side, {_at('entry_t', 'entry_time')}, exit_reason, round(net, 2) as net from mine where {_OF_A} order by trade_id limit 201", "trade_id", "side", "entry_time", "exit_reason", "round(cast(net_pnl as double), 2) as net")
_JUDGED = f"(select t + 3600 as dt, act, why from st where act is not null and {_OF_A} union all select t + 0.001, 'skip', 'available_margin' from st where refused and {_OF_A})"
_page("executions", "execution", f"select trade_id, {_at('t', 'execution_ts')}, round(price, 4) as price, why as exit_reason from (select trade_id, entry_t as t, entry_price as price, null as why, 1 as k from entry where {_OF_A} union all select trade_id, \"at\", price, why, 2 from gone where {_OF_A}) order by t, k desc limit 201", "trade_id", "execution_ts", "round(cast(price as double), 4) as price", "exit_reason")
_page("funding_settlements", "funding_settlement", f"select trade_id, {_at('\"at\"', 'settled_at')}, round(-paid, 4) + 0 as payment from paid where {_OF_A} order by \"at\" limit 201", "trade_id", "settled_at", "round(cast(payment_amount as double), 4) + 0D as payment")
_page("equity", "portfolio_pnl", f"select {_at('t + 3600', 'ts')}, round(equity, 2) as equity from st where i > 0 and {_OF_A} order by t limit 201", "ts", "round(cast(total_equity as double), 2) as equity")
_page("chart_summaries", "chart_summary", f"select 2 * i - k as summary_seq, series_name, round(value, 2) + 0 as value from (select i, unnest([1, 0]) as k, unnest(['equity', 'drawdown']) as series_name, unnest([equity, equity / peak - 1]) as value from (select *, max(equity) over (order by i) as peak from st where i > 0 and {_OF_A})) order by 1 limit 201", "summary_seq", "series_name", "round(value, 2) + 0D as value")
_page("positions", "position", f"select {_at('t + 3600', 'ts')}, case when x2side > 0 then 'LONG' else 'SHORT' end as side, round(upl, 2) + 0 as unrealized from st where x2side <> 0 and {_OF_A} order by t limit 201", "ts", "side", "round(cast(unrealized_pnl as double), 2) + 0D as unrealized")
_page("integrity_checks", "integrity_check", _rows(("accounting_identity", 1), ("cost_once", 1), ("net_of_cost", 1), ("timestamp_order", 1), columns="check_name, passed"), "check_name", "passed")
_page("outcome_buckets", "outcome_bucket", f"select trade_id as subject_id, case when gross > 0 and net <= 0 then 'cost_churn' when net / r0 >= 2 then 'top_winner' when net > 0 then 'normal_winner' when net / r0 <= -1 then 'tail_loser' else 'small_loser' end as bucket from mine where {_OF_A} order by 1 limit 201", "subject_id", "bucket_value as bucket")
_page("signals", "signal", f"select {_at('dt', 'decision_ts')}, act as intent from {_JUDGED} order by dt limit 201", "decision_ts", "intent")
_page("decisions", "decision", f"select {_at('dt', 'decision_ts')}, act as action, why as skip_reason from {_JUDGED} order by dt limit 201", "decision_ts", "action", "skip_reason")
_page("candidate_events", "candidate_event", f"select {_at('dt', 'ts')}, why as blocked_by, (why is null)::int as realized from {_JUDGED} where act in ('enter', 'reverse') or (act = 'skip' and why <> 'no_position') order by dt limit 201", "ts", "blocked_by", "realized")
_page("missed_opportunities", "missed_opportunity", f"select {_at('dt', 'ts')}, why as missing_reason from {_JUDGED} where why in ('available_margin', 'next_candle_gap', 'end_of_data', 'exposure_limit') order by dt limit 201", "ts", "missing_reason")
_page("conditional_expectancy", "conditional_expectancy", f"select 'side=' || side as signature, count(*) as n, round(avg((net > 0)::int), 6) as win_rate, round(avg(net / r0), 4) as expectancy from mine where {_OF_A} group by side", "signature_key as signature", "sample_count as n", "round(win_rate, 6) as win_rate", "round(expectancy_r, 4) as expectancy")
_page("findings", "finding", "select 'stops are near' as claim, 'high' as confidence", "claim", "confidence")
_page("indicator_definitions", "indicator_definition", _rows(("ema:n=21@1h", 21), ("ema:n=9@1h", 9), columns="indicator_key, min_history"), "indicator_key", "min_history")


@query("api_drawdown_episodes", f"{_WITH} select count(distinct peak) filter (equity < peak) > 0 as fell, round(min(equity / peak - 1), 6) as deepest from (select *, max(equity) over (order by i, late rows unbounded preceding) as peak from (select i, 0 as late, equity from st where i > 0 and {_OF_A} union all select i, 1, cash from st where x3on and x3why = 'END_OF_DATA' and {_OF_A}))")
def api_drawdown_episodes(spark, sf_dir):
    """The deepest episode is the largest drawdown."""
    e = _space(spark, sf_dir).page(A, "drawdown_episode").filter("kind = 'drawdown'")
    return e.agg((F.count("*") > 0).alias("fell"), F.round(-F.max("depth_pct"), 6).alias("deepest"))


@query("api_trade_features", f"{_WITH} select phase, count(*) as n from (select unnest(['entry', 'exit', 'mae', 'mfe']) as phase from (select * from mine where {_OF_A} order by trade_id limit 50)) group by phase")
def api_trade_features(spark, sf_dir):
    f = _space(spark, sf_dir).page(A, "trade_feature", limit=199)
    return f.filter("trade_id <= 50").groupBy("phase").agg(F.count("*").alias("n"))


@query("api_indicator_snapshots", f"select k as indicator_key, ts as feature_ts, v as value from (select ts, unnest(['ema:n=21@1h', 'ema:n=9@1h']) as k, unnest([s, f]) as v from ({as_sql(_EMAS, BARS)}) where sym = 'view') order by ts, k limit 201")
def api_indicator_snapshots(spark, sf_dir):
    return _ntz(_space(spark, sf_dir).page(A, "indicator_snapshot").selectExpr("indicator_key", "feature_ts", "round(value, 6) as value"))
