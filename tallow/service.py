"""The application surface: runs, sweeps, catalog, tags, candles and evidence pages, as calls that return frames.

A workspace keeps its catalog (one row a run) and tags as small tables in a folder, the evidence of each run
beside them. Jobs run on the driver in the order they come.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, catalog, gaps, resample, simulate
from .operators.indicators import REGISTRY
from .plans.layers import Plan, ema, on_spark
from .plans.registry import series_key
from .sources import evidence

_RUNS = "run_id string, run_seq bigint, sweep_id string, symbol string, timeframe string, params_json string, config_hash string, status string, deleted_at timestamp, trades bigint, net double, pf double"
_TAGS = "run_id string, tag_type string, tag_value string"
_DATA_JOBS = "job_id string, kind string, symbol string, since timestamp_ntz, until timestamp_ntz, status string, rows bigint, events string"
_PREREG = "run_id string, hypothesis string, primary_metric string, success_threshold double, failure_threshold double, edge_distinguishable boolean, higher_is_better boolean, declared_by string"
_KEYS = {"runs": ["run_id"], "tags": ["run_id", "tag_type", "tag_value"], "data_jobs": ["job_id"], "prereg": ["run_id"]}
STRATEGIES = {"ema_regime": {"parameters": {"fast": 9, "slow": 21}, "money": ["manual"]}}


class Workspace:
    """root: a folder of whatever store Spark knows. bars: of source_timeframe, made once and kept in it, so that what runs and routes
    cost does not grow with what the bars are made of. Changes of the catalog are appended, a small
    file each, and the last one of a key counts, so that no change rewrites or collects the catalog."""

    def __init__(self, spark: SparkSession, root: str, bars: DataFrame, source_timeframe: str = "1h"):
        self.spark, self.root, self.source_timeframe = spark, root.rstrip("/"), source_timeframe
        self.bars = self._kept(bars)
        self.jobs: dict[str, dict] = {}

    def _kept(self, bars: DataFrame) -> DataFrame:
        at = f"{self.root}/series/{uuid.uuid4().hex}"
        bars.write.parquet(at)
        return self.spark.read.schema(bars.schema).parquet(at)

    # ---- tables of changes

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _table(self, name: str, ddl: str) -> DataFrame:
        """The last change of each key, without what was removed."""
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return self.spark.createDataFrame([], ddl)
        changes = self.spark.read.schema(f"{ddl}, changed bigint, gone boolean").parquet(f"{self.root}/{name}")
        return catalog.latest(changes, _KEYS[name], [F.col("changed").desc()]).filter("not gone").drop("changed", "gone")

    def _put(self, name: str, df: DataFrame, gone: bool = False) -> None:
        df.withColumn("changed", F.lit(time.time_ns())).withColumn("gone", F.lit(gone)).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def _number(self) -> int:
        """The next run's number, claimed by a file that only one can make."""
        n = (self.runs.agg(F.max("run_seq")).first()[0] or 0) + 1
        while True:
            fs, p = self._fs(f"{self.root}/numbers/{n:06d}")
            fs.mkdirs(p.getParent())
            if fs.createNewFile(p):
                return n
            n += 1

    @property
    def runs(self) -> DataFrame:
        return self._table("runs", _RUNS)

    @property
    def tags(self) -> DataFrame:
        return self._table("tags", _TAGS)

    # ---- runs, sweeps, jobs

    def validate(self, config: Mapping[str, object]) -> list[str]:
        """What is wrong with a run configuration."""
        wrong = [f"unknown key: {k}" for k in config if k not in ("symbol", "timeframe", "strategy", "parameters", "rules", "sweep_id")]
        wrong += [f"unknown rule: {k}" for k in dict(config.get("rules", {})) if k not in simulate.Rules.__dataclass_fields__ or k == "bar_seconds"]
        if config.get("strategy", "ema_regime") not in STRATEGIES:
            wrong.append("no such strategy")
        if not config.get("symbol"):
            wrong.append("symbol is missing")
        try:
            wide = resample.timeframe_seconds(str(config.get("timeframe", self.source_timeframe)))
            if wide % resample.timeframe_seconds(self.source_timeframe):
                wrong.append("the timeframe is not made of the bars'")
        except ValueError as e:
            wrong.append(str(e))
        p = {**STRATEGIES["ema_regime"]["parameters"], **dict(config.get("parameters", {}))}
        if not 0 < int(p["fast"]) < int(p["slow"]):
            wrong.append("fast must be shorter than slow")
        return wrong

    def trigger_run(self, config: Mapping[str, object]) -> str:
        """Runs a configuration, keeps its evidence and catalog row, and returns its id."""
        if wrong := self.validate(config):
            raise ValueError("; ".join(wrong))
        (run_id,) = self._run_all({"only": config})
        return run_id

    def _series(self, symbol: str, timeframe: str) -> DataFrame:
        """Bars of the timeframe: whole ones of the source's, or the source's own."""
        bars = self.bars.filter(F.col("sym") == symbol)
        if timeframe == self.source_timeframe:
            return bars
        wide = resample.confirmed(bars, self.source_timeframe, timeframe)
        return wide.withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    def _run_all(self, configs: Mapping[str, Mapping[str, object]]) -> list[str]:
        """Runs of one symbol and timeframe: bars are read once a set of parameters, all its rules pass over them together."""
        made, groups = [], {}
        for name, config in configs.items():
            p = {**STRATEGIES["ema_regime"]["parameters"], **dict(config.get("parameters", {}))}
            run_id, job = f"run-{(seq := self._number()):06d}", uuid.uuid4().hex
            self.jobs[job] = {"job_id": job, "run_id": run_id, "events": ["QUEUED", "RUNNING"]}
            timeframe = str(config.get("timeframe", self.source_timeframe))
            rules = replace(simulate.Rules(**dict(config.get("rules", {}))), bar_seconds=resample.timeframe_seconds(timeframe))
            params = json.dumps({"parameters": p, "rules": dict(config.get("rules", {}))}, sort_keys=True)
            digest = hashlib.sha256("\x1f".join([str(config["symbol"]), timeframe, params]).encode()).hexdigest()
            row = {"run_id": run_id, "run_seq": seq, "sweep_id": config.get("sweep_id"), "symbol": config["symbol"], "timeframe": timeframe, "params_json": params, "config_hash": digest, "status": "RUNNING"}
            self._put("runs", self.spark.createDataFrame([row], _RUNS))
            made.append(run_id)
            groups.setdefault((config["symbol"], timeframe, int(p["fast"]), int(p["slow"])), []).append((config, row, rules, job))
        for (symbol, timeframe, fast, slow), members in groups.items():
            bars = self._series(symbol, timeframe)
            lines = on_spark(Plan(["f", "s"]).scan(ema("f", "c", fast), ema("s", "c", slow)), bars)
            signals = bars.join(lines, ["sym", "ts"]).selectExpr("sym", "ts", "o", "h", "l", "c", "case when s is null then null when f > s then 1 when f < s then -1 else 0 end as signal")
            base = f"{self.root}/journals/{uuid.uuid4().hex}"
            simulate.journal(signals, {row["run_id"]: rules for _, row, rules, _ in members}).write.partitionBy("run_id").parquet(base)
            journal = self.spark.read.schema(simulate.JOURNAL_DDL).parquet(base)
            for config, row, rules, job in members:
                try:
                    self._finish(row, rules, bars, lines, journal.filter(F.col("run_id") == row["run_id"]), (fast, slow))
                    self.jobs[job]["events"].append("COMPLETED")
                except Exception:
                    self._put("runs", self.spark.createDataFrame([row | {"status": "FAILED"}], _RUNS))
                    self.jobs[job]["events"].append("FAILED")
                    raise
            fs, p = self._fs(base)
            fs.delete(p, True)
        return made

    def _finish(self, row: dict, rules: simulate.Rules, bars: DataFrame, lines: DataFrame, journal: DataFrame, spans: tuple[int, int]) -> None:
        self._record(row, rules, bars, lines, journal, spans)
        kept = evidence.opened(self.spark, self.root, row["run_id"], "trade")
        net = F.col("net_pnl").cast("double")
        m = kept.agg(F.count("*").alias("n"), F.sum(net).alias("net"), (F.sum(F.when(net > 0, net)) / F.sum(F.when(net < 0, -net))).alias("pf")).first()
        self._put("runs", self.spark.createDataFrame([row | {"status": "COMPLETED", "trades": m.n, "net": m.net, "pf": m.pf}], _RUNS))

    def _record(self, row: dict, rules: simulate.Rules, bars: DataFrame, lines: DataFrame, journal: DataFrame, spans: tuple[int, int]) -> None:
        run_id, symbol, timeframe = row["run_id"], row["symbol"], row["timeframe"]
        put = lambda df, entity: evidence.record(df, self.root, run_id, entity)
        of = lambda kind: journal.filter(F.col("kind") == kind)
        span = bars.agg(F.min("ts").alias("period_start"), F.max("ts").alias("period_end"))
        put(span.select(F.lit(run_id).alias("run_id"), F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), "period_start", "period_end", F.lit(rules.capital).alias("initial_capital"), F.lit(row["config_hash"]).alias("config_hash"), F.lit(row["params_json"]).alias("params_json")), "run")
        trades = simulate.trades(journal)
        put(trades.selectExpr("trade_id", "sym as symbol", "side", "entry_ts as entry_time", "entry_price", "quantity", "exit_ts as exit_time", "exit_price", "exit_reason", "gross as gross_pnl", "fees as total_fee", "slippage", "funding as funding_cost", "net as net_pnl", "r0", "r_multiple"), "trade")
        done = evidence.opened(self.spark, self.root, run_id, "trade")
        put(of("fill").selectExpr("seq as execution_id", "trade_id", "ts as execution_ts", "sym as symbol", "case when (side > 0) = (action = 'entry') then 'BUY' else 'SELL' end as side", "price", "quantity", "fee", "slippage", "reason as exit_reason"), "execution")
        put(of("decision").selectExpr("seq as decision_id", "seq as signal_id", "ts as decision_ts", "action", "reason as skip_reason"), "decision")
        put(of("decision").selectExpr("seq as signal_id", "ts as decision_ts", "sym as symbol", "action as intent"), "signal")
        blocked = of("decision").filter("action in ('enter', 'reverse') or reason not in ('no_position')")
        put(blocked.selectExpr("seq as candidate_id", "ts", "sym as symbol", "'ema_regime' as trigger_rule", "reason as blocked_by", "int(reason is null) as realized"), "candidate_event")
        put(of("funding").selectExpr("seq as settlement_id", "trade_id", "ts as settled_at", "rate", "-amount as payment_amount"), "funding_settlement")
        put(of("equity").filter("side <> 0").selectExpr("seq as position_seq", "trade_id", "ts", "sym as symbol", "case when side > 0 then 'LONG' else 'SHORT' end as side", "quantity", "unrealized as unrealized_pnl"), "position")
        grid = simulate.equity_curve(journal)
        put(grid.selectExpr("seq as equity_seq", "ts", "equity as total_equity", "peak as peak_equity", "drawdown as drawdown_pct"), "portfolio_pnl")
        points = grid.selectExpr("row_number() over (order by seq) as seq", "ts", "equity", "drawdown")
        put(audit.chart_rows(points).selectExpr("seq as summary_seq", "series_name", "ts as bucket_ts", "value"), "chart_summary")
        put(done.select(F.col("trade_id").alias("bucket_id"), F.col("trade_id").alias("subject_id"), audit.outcome(F.col("gross_pnl"), F.col("net_pnl"), F.col("r_multiple")).alias("bucket_value"), "r_multiple"), "outcome_bucket")
        both = None
        for kind in ("drawdown", "runup"):
            e = audit.episodes(points.withColumn("sym", F.lit("all")), kind).withColumn("kind", F.lit(kind))
            both = e if both is None else both.unionByName(e)
        put(both.selectExpr("row_number() over (order by kind, first) as episode_id", "kind", "first as start_seq", "last as end_seq", "recovery as recovery_seq", "depth as depth_pct"), "drawdown_episode")
        lost = of("decision").filter("reason in ('available_margin', 'next_candle_gap', 'end_of_data', 'exposure_limit')")
        put(lost.selectExpr("seq as miss_id", "ts", "sym as symbol", "'ema_regime' as source_rule", "reason as missing_reason"), "missed_opportunity")
        won = F.avg((F.col("net_pnl") > 0).cast("int"))
        by = done.groupBy("side").agg(F.count("*").alias("n"), won.alias("w"), F.avg("r_multiple").alias("e"))
        put(by.selectExpr("row_number() over (order by side) as ce_id", "concat('side=', side) as signature_key", "n as sample_count", "w as win_rate", "e as expectancy_r", "int(n >= 30) as is_significant"), "conditional_expectancy")
        phases = audit.phases(trades, simulate.excursions(trades, bars, rules.bar_seconds))
        put(phases.selectExpr("row_number() over (order by trade_id, phase) as tfs_id", "trade_id", "phase", "ts", "to_json(struct(r)) as features_json"), "trade_feature")
        faults = audit.checks(journal, trades, rules.bar_seconds)
        put(faults.selectExpr("row_number() over (order by check_name) as check_id", "check_name", "int(passed) as passed", "sample_ref"), "integrity_check")
        keys = [series_key("ema", {"n": n}, timeframe) for n in spans]
        put(self.spark.createDataFrame([(k, "ema", json.dumps({"n": n}), n) for k, n in zip(keys, spans)], "indicator_key string, name string, params_json string, min_history bigint"), "indicator_definition")
        values = lines.select("ts", F.explode(F.array(F.struct(F.lit(keys[0]).alias("k"), F.col("f").alias("v")), F.struct(F.lit(keys[1]).alias("k"), F.col("s").alias("v")))).alias("x"))
        put(values.selectExpr("row_number() over (order by ts, x.k) as snapshot_seq", "x.k as indicator_key", "ts as feature_ts", "x.v as value", "cast(x.v is null as int) as is_warmup"), "indicator_snapshot")

    def trigger_sweep(self, base: Mapping[str, object], axes: Mapping[str, Sequence]) -> str:
        """A run for each cell of the grid of parameters and rules (100 at most); cells that differ in rules only share a pass."""
        sweep_id = f"sweep-{uuid.uuid4().hex[:8]}"
        cells = simulate.grid_of(**{k: list(v) for k, v in axes.items()})
        fields = set(simulate.Rules.__dataclass_fields__)
        configs = {}
        for i, cell in enumerate(cells):
            rules = {k: v for k, v in cell.items() if k in fields}
            own = {k: v for k, v in cell.items() if k not in fields}
            configs[str(i)] = {**base, "parameters": {**dict(base.get("parameters", {})), **own}, "rules": {**dict(base.get("rules", {})), **rules}, "sweep_id": sweep_id}
        if wrong := [w for c in configs.values() for w in self.validate(c)]:
            raise ValueError("; ".join(sorted(set(wrong))))
        self._run_all(configs)
        return sweep_id

    def job(self, job_id: str) -> dict:
        return self.jobs[job_id]

    def sweep(self, sweep_id: str) -> DataFrame:
        return self.runs.filter(F.col("sweep_id") == sweep_id).orderBy("run_seq")

    def list_runs(self, *, symbol: str | None = None, sweep_id: str | None = None, tag: tuple[str, str] | None = None, deleted: str = "none", sort: str = "run_seq", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
        if sort not in ("run_seq", "net", "pf", "trades", "symbol"):
            raise ValueError(f"not a sort column: {sort}")
        rows = catalog.matching(self.runs, {"symbol": symbol, "sweep_id": sweep_id}, deleted=deleted)
        if tag:
            rows = rows.join(self.tags.filter((F.col("tag_type") == tag[0]) & (F.col("tag_value") == tag[1])), "run_id", "left_semi")
        c = F.col(sort)
        return catalog.offset_page(rows, [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("run_seq").desc()], limit, offset)

    def get_run(self, run_id: str) -> DataFrame:
        return self.runs.filter(F.col("run_id") == run_id)

    def compare_runs(self, run_ids: Sequence[str]) -> DataFrame:
        asked = self.spark.createDataFrame(list(enumerate(run_ids)), "position bigint, run_id string")
        known = {r.run_id for r in self.runs.join(asked, "run_id", "left_semi").select("run_id").collect()}
        if missing := [r for r in run_ids if r not in known]:
            raise KeyError(missing)
        return asked.join(self.runs, "run_id").orderBy("position")

    def _mark(self, run_id: str, deleted: bool) -> None:
        row = self.get_run(run_id)
        if row.isEmpty():
            raise KeyError(run_id)
        self._put("runs", row.withColumn("deleted_at", F.current_timestamp() if deleted else F.lit(None).cast("timestamp")))

    def soft_delete(self, run_id: str) -> None:
        self._mark(run_id, True)

    def restore(self, run_id: str) -> None:
        self._mark(run_id, False)

    def purge(self, run_id: str) -> None:
        """Removes a soft-deleted run for good."""
        if self.get_run(run_id).filter("deleted_at is not null").isEmpty():
            raise ValueError("only a deleted run can be purged")
        self._put("tags", self.run_tags(run_id), gone=True)
        self._put("prereg", self.prereg(run_id), gone=True)
        self._put("runs", self.get_run(run_id), gone=True)
        fs, p = self._fs(f"{self.root}/evidence/{run_id}")
        fs.delete(p, True)

    # ---- preregistration

    def register(self, run_id: str, declaration: Mapping[str, object]) -> None:
        """What a run is to show, said once before it is judged."""
        names = [f.split()[0] for f in _PREREG.split(", ")][1:]
        if missing := [n for n in names if n not in declaration]:
            raise ValueError(f"missing: {missing}")
        if not self.prereg(run_id).isEmpty():
            raise ValueError("a run is registered once")
        self._put("prereg", self.spark.createDataFrame([{"run_id": run_id, **{n: declaration[n] for n in names}}], _PREREG))

    def prereg(self, run_id: str) -> DataFrame:
        return self._table("prereg", _PREREG).filter(F.col("run_id") == run_id)

    # ---- data jobs

    def trigger_data_job(self, symbol: str, since: str, until: str, fetch, kind: str = "backfill") -> str:
        """Fetches bars of [since, until) with fetch(symbol, since, until) -> DataFrame, keeps them beside the workspace and
        lets runs see them; bars that are there already are replaced."""
        job_id = f"data-{uuid.uuid4().hex[:12]}"
        row = {"job_id": job_id, "kind": kind, "symbol": symbol, "since": datetime.fromisoformat(since), "until": datetime.fromisoformat(until), "rows": None, "events": "QUEUED,RUNNING"}
        self._put("data_jobs", self.spark.createDataFrame([row | {"status": "RUNNING"}], _DATA_JOBS))
        try:
            at = f"{self.root}/bars/{job_id}"
            fetch(symbol, since, until).filter(F.col("ts").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz"))).write.parquet(at)
            new = self.spark.read.parquet(at)
            n = new.count()
            self.bars = self._kept(catalog.upserted(self.bars, new.select(*self.bars.columns), ["sym", "ts"]))
            done = row | {"status": "COMPLETED", "rows": n, "events": "QUEUED,RUNNING,COMPLETED"}
        except Exception as e:
            done = row | {"status": "FAILED", "events": f"QUEUED,RUNNING,FAILED:{type(e).__name__}"}
        self._put("data_jobs", self.spark.createDataFrame([done], _DATA_JOBS))
        return job_id

    def data_jobs(self, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return catalog.offset_page(catalog.matching(self._table("data_jobs", _DATA_JOBS), {"status": status}), [F.col("job_id").asc()], limit, offset)

    def data_job(self, job_id: str) -> DataFrame:
        return self._table("data_jobs", _DATA_JOBS).filter(F.col("job_id") == job_id)

    def data_job_events(self, job_id: str, after: int = 0) -> DataFrame:
        """seq, event, those after a number."""
        return self.data_job(job_id).select(F.posexplode(F.split("events", ",")).alias("seq", "event")).select((F.col("seq") + 1).alias("seq"), "event").filter(F.col("seq") > after)

    # ---- tags, strategies, data

    def _tag(self, run_id: str, tag_type: str, tag_value: str, gone: bool) -> None:
        self._put("tags", self.spark.createDataFrame([(run_id, tag_type, tag_value)], _TAGS), gone)

    def add_tag(self, run_id: str, tag_type: str, tag_value: str) -> None:
        self._tag(run_id, tag_type, tag_value, False)

    def remove_tag(self, run_id: str, tag_type: str, tag_value: str) -> None:
        self._tag(run_id, tag_type, tag_value, True)

    def run_tags(self, run_id: str) -> DataFrame:
        return self.tags.filter(F.col("run_id") == run_id)

    def tag_facets(self) -> DataFrame:
        return self.tags.groupBy("tag_type", "tag_value").agg(F.count("*").alias("n")).orderBy("tag_type", F.desc("n"), "tag_value")

    def add_finding(self, run_id: str, claim: str, confidence: str = "low") -> None:
        """Adds a claim to the findings of a run; one process writes those of a run."""
        if confidence not in ("low", "medium", "high"):
            raise ValueError(f"not a confidence: {confidence}")
        held = evidence.opened(self.spark, self.root, run_id, "finding").collect()  # a person's notes on a run
        row = {"finding_id": len(held) + 1, "claim": claim, "confidence": confidence, "created_at": datetime.now()}
        rows = self.spark.createDataFrame([*(r.asDict() for r in held), row], "finding_id bigint, claim string, confidence string, created_at timestamp")
        evidence.record(rows, self.root, run_id, "finding")

    def strategies(self) -> DataFrame:
        return self.spark.createDataFrame([(k, json.dumps(v)) for k, v in STRATEGIES.items()], "name string, declaration string")

    def coverage(self, step: int = 3600) -> DataFrame:
        return gaps.coverage(self.bars, step)

    def inventory(self) -> DataFrame:
        return gaps.inventory(self.bars)

    def candles(self, symbol: str, timeframe: str, start: str, end: str, limit: int = 5000) -> DataFrame:
        part = self.bars.filter((F.col("sym") == symbol) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        return (part if timeframe == self.source_timeframe else resample.confirmed(part, self.source_timeframe, timeframe)).orderBy("ts").limit(limit)

    def health(self) -> dict:
        return {"runs": self.runs.count(), "series": len(REGISTRY)}

    # ---- evidence pages

    def page(self, run_id: str, entity: str, after: object | None = None, limit: int = 200, **equal: object) -> DataFrame:
        """The next rows of an entity by its cursor (one more than asked for), of those that match."""
        rows = catalog.matching(evidence.opened(self.spark, self.root, run_id, entity), equal)
        return catalog.keyset_page(rows, evidence.ENTITIES[entity][0], after, min(limit, 200))
