"""The evidence of runs: a Parquet folder an entity and run, money as whole numbers of 1e-8, times in milliseconds.

Entities have fixed columns (checked on writing); reading restores money to decimals and times to timestamps.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Per entity its cursor and columns (I whole number, M money, R real, T text, S time).
ENTITIES = {
    "run": ("run_id", "run_id:T symbol:T timeframe:T period_start:S period_end:S initial_capital:M config_hash:T params_json:T"),
    "trade": ("trade_id", "trade_id:I symbol:T side:T entry_time:S entry_price:M quantity:M exit_time:S exit_price:M exit_reason:T gross_pnl:M total_fee:M slippage:M funding_cost:M net_pnl:M r0:M r_multiple:R"),
    "execution": ("execution_id", "execution_id:I trade_id:I execution_ts:S symbol:T side:T price:M quantity:M fee:M slippage:M exit_reason:T"),
    "portfolio_pnl": ("equity_seq", "equity_seq:I ts:S total_equity:M peak_equity:M drawdown_pct:R"),
    "signal": ("signal_id", "signal_id:I decision_ts:S symbol:T price:R intent:T"),
    "decision": ("decision_id", "decision_id:I signal_id:I decision_ts:S action:T skip_reason:T"),
    "funding_settlement": ("settlement_id", "settlement_id:I trade_id:I settled_at:S rate:R payment_amount:M"),
    "position": ("position_seq", "position_seq:I trade_id:I ts:S symbol:T side:T quantity:M unrealized_pnl:M"),
    "indicator_definition": ("indicator_key", "indicator_key:T name:T params_json:T min_history:I"),
    "indicator_snapshot": ("snapshot_seq", "snapshot_seq:I indicator_key:T feature_ts:S value:R is_warmup:I"),
    "outcome_bucket": ("bucket_id", "bucket_id:I subject_id:I bucket_value:T r_multiple:R"),
    "integrity_check": ("check_id", "check_id:I check_name:T passed:I sample_ref:T"),
    "chart_summary": ("summary_seq", "summary_seq:I series_name:T bucket_ts:S value:R"),
    "drawdown_episode": ("episode_id", "episode_id:I kind:T start_seq:I end_seq:I recovery_seq:I depth_pct:R"),
    "trade_feature": ("tfs_id", "tfs_id:I trade_id:I phase:T ts:S features_json:T"),
    "candidate_event": ("candidate_id", "candidate_id:I ts:S symbol:T trigger_rule:T blocked_by:T realized:I"),
    "missed_opportunity": ("miss_id", "miss_id:I ts:S symbol:T source_rule:T missing_reason:T"),
    "conditional_expectancy": ("ce_id", "ce_id:I signature_key:T sample_count:I win_rate:R expectancy_r:R is_significant:I"),
    "finding": ("finding_id", "finding_id:I claim:T confidence:T created_at:S"),
}
_STORED = {"I": "bigint", "M": "bigint", "R": "double", "T": "string", "S": "bigint"}


def columns(entity: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in ENTITIES[entity][1].split()]


def path(root: str, run_id: str, entity: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id) or run_id in (".", ".."):
        raise ValueError(f"not a run id: {run_id!r}")
    if entity not in ENTITIES:
        raise ValueError(f"no such entity: {entity}")
    return f"{root}/evidence/{run_id}/{entity}"


def encoded(df: DataFrame, entity: str) -> DataFrame:
    """df in the stored form. Columns that df lacks are null; unknown ones raise."""
    known = dict(columns(entity))
    if extra := set(df.columns) - set(known):
        raise ValueError(f"{entity} has no column {sorted(extra)}")
    out = []
    for name, kind in columns(entity):
        c = F.col(name) if name in df.columns else F.lit(None)
        if kind == "M":
            c = F.bround(c.cast("double") * 1e8, 0)
        elif kind == "S":
            c = F.unix_millis(c.cast("timestamp"))
        out.append(c.cast(_STORED[kind]).alias(name))
    return df.select(*out)


def restored(df: DataFrame, entity: str) -> DataFrame:
    """Money as decimals of 8 places, times as timestamps."""
    out = []
    for name, kind in columns(entity):
        c = F.col(name)
        if kind == "M":
            c = (c.cast("decimal(20,0)") / F.lit(100_000_000).cast("decimal(9,0)")).cast("decimal(28,8)")
        elif kind == "S":
            c = F.timestamp_millis(c)
        out.append(c.alias(name))
    return df.select(*out)


def record(df: DataFrame, root: str, run_id: str, entity: str) -> None:
    encoded(df, entity).write.mode("overwrite").parquet(path(root, run_id, entity))


def opened(spark: SparkSession, root: str, run_id: str, entity: str) -> DataFrame:
    """The entity's rows as restored, none where the run has not recorded it."""
    where = path(root, run_id, entity)
    ddl = ", ".join(f"{n} {_STORED[k]}" for n, k in columns(entity))
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(where)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return restored(spark.read.schema(ddl).parquet(where) if there else spark.createDataFrame([], ddl), entity)
