"""Streams that meet in time, fall silent, or come from a source with offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def next_candles(signals: DataFrame, bars: DataFrame, seconds: int = 3600, lateness: str = "1 minute", how: str = "leftOuter") -> DataFrame:
    """A stream of signals (sym, ts, ...) with the bar that begins in (ts, ts + seconds] of a stream of bars that wide: a join by interval.

    Both sides carry a watermark: a row later than it is dropped, a signal without a bar comes out with nulls once the
    watermark has passed its interval, and what no row can meet any more leaves the state, which so holds no more than
    lateness and interval span. bars: sym, ts, o, h, l, c, v, which come as bar_ts, o, h, l, c, v.

    Both meet by blocks of that many seconds: a bar begins in a signal's own block or in the next one, so that it is there for both.
    A signal is held against two bars, not against all of its series, and a series is the work of as many tasks as it has blocks.
    """
    block = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    s = signals.withWatermark("ts", lateness).withColumn("__block", block("ts"))
    b = bars.select(F.col("sym").alias("bar_sym"), F.col("ts").alias("bar_ts"), "o", "h", "l", "c", "v").withWatermark("bar_ts", lateness)
    b = b.withColumn("__of", F.explode(F.array(block("bar_ts"), block("bar_ts") - 1)))
    meets = (F.col("sym") == F.col("bar_sym")) & (F.col("__block") == F.col("__of")) & (F.col("bar_ts") > F.col("ts")) & F.expr(f"bar_ts <= ts + interval {seconds} seconds")
    return s.join(b, meets, how).drop("bar_sym", "__block", "__of")


class _Silence(StatefulProcessor):
    """Reports the end of each stretch of rows once. State: the last row's time, and a timer for the silence behind it."""

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros bigint")

    def _told(self, key, since: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"sym": [key[0]] * len(since), "since": pd.to_datetime(since, unit="us")}).astype({"sym": object})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted({int(t) for part in rows for t in part["ts"].to_numpy("datetime64[us]").astype("int64").tolist()})
        last = self.last.get()[0] if self.last.exists() else None
        silent = []
        for t in times:
            if last is not None and t - last > self.wait * 1000:
                silent.append(last)
            last = t if last is None else max(last, t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last,))
        self.handle.registerTimer(last // 1000 + self.wait + 1)
        if silent:
            yield self._told(key, silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()  # a series that speaks again begins anew
        yield self._told(key, [last])

    def close(self) -> None:
        pass


def silences(rows: DataFrame, seconds: float, lateness: str = "1 minute") -> DataFrame:
    """sym, since: the last row before each silence of more than `seconds` of a stream (sym, ts, ...), told once: by the row
    that ends it, or by a timer when the watermark has passed it, so that a series that stops for good is told without a further
    row. Start the query within `keyed_state`."""
    marked = rows.select("sym", "ts").withWatermark("ts", lateness)
    return marked.groupBy("sym").transformWithStateInPandas(_Silence(seconds), "sym string, since timestamp", "Append", "EventTime")


class _Range(InputPartition):
    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


class _Events(DataSourceStreamReader):
    """Rows in the order of their ids. An offset is the last id read; a batch is the ids behind one offset up to another, so that the
    same batch gives the same rows however often it is asked for."""

    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.path, self.key = options["path"], options.get("key", "event_id")
        self.upto = int(options["upto"]) if "upto" in options else None
        self.ids = int(options.get("ids_a_partition", 1 << 20))

    def _dataset(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.path.removeprefix("file://") if self.path.startswith("file://") else self.path)

    def initialOffset(self) -> dict:
        return {"id": -1}

    def latestOffset(self) -> dict:
        """The largest id, by the files' statistics (one row group after another, without reading it)."""
        largest = -1
        for fragment in self._dataset().get_fragments():
            for group in fragment.row_groups:
                largest = max(largest, group.statistics[self.key]["max"])
        return {"id": largest if self.upto is None else min(largest, self.upto)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(a, min(end["id"], a + self.ids)) for a in range(start["id"], end["id"], self.ids)]

    def read(self, partition: _Range):
        import pyarrow.dataset as ds

        near = (ds.field(self.key) > partition.after) & (ds.field(self.key) <= partition.upto)
        yield from self._dataset().to_batches(columns=self.names, filter=near)

    def commit(self, end: dict) -> None:
        """Nothing to release: the rows stay where they are."""


class EventSource(DataSource):
    """A streaming source over a Parquet table with ascending whole ids: spark.readStream.format("tallow_events").option("path", ...).
    Options: key (the id's column), upto (no id above it), ids_a_partition. The schema has to be given."""

    @classmethod
    def name(cls) -> str:
        return "tallow_events"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Events(schema, self.options)
