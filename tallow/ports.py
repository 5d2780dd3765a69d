"""What a run needs from outside, as protocols over DataFrames, and the forms that tables give."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import resample, simulate


@runtime_checkable
class DataFeed(Protocol):
    def bars(self, symbols: list[str], timeframe: str, until: datetime) -> DataFrame: ...

    def rates(self, symbols: list[str], until: datetime) -> DataFrame: ...


@runtime_checkable
class Clock(Protocol):
    def now(self) -> datetime: ...


@runtime_checkable
class CostModel(Protocol):
    def rules(self, **own: object) -> simulate.Rules: ...


@runtime_checkable
class Broker(Protocol):
    def fills(self, orders: DataFrame, bars: DataFrame) -> DataFrame: ...


@runtime_checkable
class EvidenceSink(Protocol):
    def record(self, rows: DataFrame, run_id: str, entity: str) -> None: ...


@runtime_checkable
class CatalogStore(Protocol):
    def trigger_run(self, config: dict) -> str: ...

    def get_run(self, run_id: str) -> DataFrame: ...


@dataclass
class TableFeed:
    """Bars of one timeframe and rates from tables; nothing that closes after `until` is seen."""

    source: DataFrame
    timeframe: str
    funding: DataFrame | None = None

    def bars(self, symbols: list[str], timeframe: str, until: datetime) -> DataFrame:
        own = self.source.filter(F.col("sym").isin(symbols))
        if timeframe != self.timeframe:
            own = resample.confirmed(own, self.timeframe, timeframe).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        return own.filter(F.col("ts") + F.make_dt_interval(secs=F.lit(resample.timeframe_seconds(timeframe))) <= F.lit(until).cast("timestamp_ntz"))

    def rates(self, symbols: list[str], until: datetime) -> DataFrame:
        return self.funding.filter(F.col("sym").isin(symbols) & (F.col("at") <= F.lit(until).cast("timestamp_ntz")))


@dataclass
class FixedClock:
    at: datetime

    def now(self) -> datetime:
        return self.at


@dataclass
class Costs:
    """The default costs with a venue's own."""

    own: dict

    def rules(self, **more: object) -> simulate.Rules:
        return simulate.Rules(**{**self.own, **more})


@dataclass
class PaperBroker:
    fee: float = 0.0005
    slip: float = 0.0005

    def fills(self, orders: DataFrame, bars: DataFrame) -> DataFrame:
        return simulate.matched(orders, bars, self.fee, self.slip)


def journal(feed: DataFeed, clock: Clock, costs: CostModel, symbols: list[str], timeframe: str, signal: Column, runs: dict[str, dict]) -> DataFrame:
    """The journal of runs over whatever ports give; signal: of the columns of bars."""
    bars = feed.bars(symbols, timeframe, clock.now()).withColumn("signal", signal)
    seconds = resample.timeframe_seconds(timeframe)
    return simulate.journal(bars, {k: costs.rules(bar_seconds=seconds, **v) for k, v in runs.items()})
