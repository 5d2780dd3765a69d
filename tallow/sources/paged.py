"""Bars from paged providers: a Spark data source that reads ranges of time in parallel, page by page.

A provider is a function "module:name" (symbol, since, until, limit) -> list of (ts seconds, o, h, l, c, v), ascending
and at most `limit` long; ts in [since, until). Each partition reads its own range with a cursor that must advance.
"""

from __future__ import annotations

import datetime as dt
import importlib
import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 1000


def pages(fetch: Callable, symbol: str, since: int, until: int, limit: int = PAGE) -> Iterator[tuple]:
    """All rows of [since, until), page after page; rows out of order or a page that does not advance raise."""
    cursor = since
    while cursor < until:
        rows = fetch(symbol, cursor, until, limit)
        if not rows:
            return
        for row in rows:
            if row[0] < cursor or row[0] >= until:
                raise ValueError(f"row at {row[0]} outside of [{cursor}, {until})")
            cursor = row[0] + 1
            yield row
        if len(rows) < limit:
            return


class _Range(InputPartition):
    def __init__(self, symbol: str, since: int, until: int):
        self.symbol, self.since, self.until = symbol, since, until


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        o = self.options
        since, until, n = int(o["since"]), int(o["until"]), int(o.get("parts", "4"))
        width = max(1, math.ceil((until - since) / n))
        return [_Range(s, a, min(a + width, until)) for s in o["symbols"].split(",") for a in range(since, until, width)]

    def read(self, partition):
        module, _, name = self.options["provider"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for ts, *prices in pages(fetch, partition.symbol, partition.since, partition.until, int(self.options.get("page", PAGE))):
            yield (partition.symbol, dt.datetime.fromtimestamp(ts, dt.UTC).replace(tzinfo=None), *map(float, prices))


class PagedBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return "sym string, ts timestamp_ntz, o double, h double, l double, c double, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def paged_bars(spark: SparkSession, provider: str, symbols: list[str], since: int, until: int, parts: int = 4, page: int = PAGE) -> DataFrame:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(PagedBars)
    options = {"provider": provider, "symbols": ",".join(symbols), "since": str(since), "until": str(until), "parts": str(parts), "page": str(page)}
    return spark.read.format("paged_bars").options(**options).load()


class _RateReader(_Reader):
    def read(self, partition):
        module, _, name = self.options["provider"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for ts, rate, mark in pages(fetch, partition.symbol, partition.since, partition.until, int(self.options.get("page", PAGE))):
            yield (partition.symbol, dt.datetime.fromtimestamp(ts, dt.UTC).replace(tzinfo=None), rate, mark)


class PagedRates(DataSource):
    """Funding rates; rate and mark price stay the decimal texts that the provider gave."""

    @classmethod
    def name(cls) -> str:
        return "paged_rates"

    def schema(self) -> str:
        return "sym string, at timestamp_ntz, rate string, mark string"

    def reader(self, schema) -> DataSourceReader:
        return _RateReader(dict(self.options))


def paged_rates(spark: SparkSession, provider: str, symbols: list[str], since: int, until: int, parts: int = 4, page: int = PAGE) -> DataFrame:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(PagedRates)
    options = {"provider": provider, "symbols": ",".join(symbols), "since": str(since), "until": str(until), "parts": str(parts), "page": str(page)}
    return spark.read.format("paged_rates").options(**options).load()


def eighths(symbol: str, since: int, until: int, limit: int) -> list[tuple]:
    """A provider for tests: rates at every eighth hour but each seventh, whose texts end in zeros; every third has no mark."""
    step, out = 8 * 3600, []
    for k in range(-(-since // step), -(-until // step)):
        if k % 7:
            out.append((k * step, f"0.000{k % 9}0{len(symbol)}00", None if k % 3 == 0 else f"{100 + k % 40}.50000000"))
        if len(out) == limit:
            break
    return out


def arithmetic(symbol: str, since: int, until: int, limit: int) -> list[tuple]:
    """A provider for tests: minute bars whose prices follow from the minute alone; every 97th minute is missing."""
    first, out = -(-since // 60), []
    for m in range(first, -(-until // 60)):
        if m % 97:
            base = 100 + (m * 31 + len(symbol) * 7) % 50
            out.append((m * 60, base, base + 2, base - 2, base + 1, 1 + m % 5))
        if len(out) == limit:
            break
    return out
