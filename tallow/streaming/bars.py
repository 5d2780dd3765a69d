"""The streaming twin: event-time bars, incremental averages with state, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.align import as_of
from ..operators.catalog import inserted_if_absent, latest
from ..operators.resample import bars_from_ticks, bucket, confirmed, place, timeframe_seconds
from ..plans.layers import Average, scanned


def streamed_bars(ticks: DataFrame, width: str = "1 hour", lateness: str = "1 minute") -> DataFrame:
    """Bars of a stream of (sym, ts, seq, price, size): a bar appears once the watermark has passed its end."""
    at = place(ticks)
    g = ticks.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "sym")
    bars = g.agg(F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.sum("size").alias("v"))
    return bars.select("sym", F.col("w.start").alias("ts"), "o", "h", "l", "c", "v")


STATE = "seen bigint, value double, total double, last bigint"


class _Averages(StatefulProcessor):
    """The SMA-seeded recursive average of c; state: bars seen, value, sum while warming up, time of the last bar."""

    def __init__(self, n: int, alpha: float, step_seconds: int | None):
        self.n, self.alpha, self.step = n, alpha, step_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("average", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.state.update((int(row["seen"]), float(row["value"]), float(row["total"]), int(row["last"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, value, total, last = self.state.get() if self.state.exists() else (0, 0.0, 0.0, -1)
        bars = pd.concat(list(rows)).sort_values("ts")
        at, close = bars["ts"].to_numpy("datetime64[us]").astype("int64"), bars["c"].to_numpy(float)
        out = []
        for now, c in zip(at.tolist(), close.tolist()):
            if now <= last:
                continue
            if self.step and last >= 0 and now - last > self.step * 1_000_000:
                seen, total = 0, 0.0
            seen, last = seen + 1, now
            if seen <= self.n:
                total += c
                value = total / self.n
            else:
                value += self.alpha * (c - value)
            if seen >= self.n:
                out.append((now, value))
        self.state.update((seen, value, total, last))
        if out:
            yield pd.DataFrame({"sym": [key[0]] * len(out), "ts": pd.to_datetime([t for t, _ in out], unit="us"), "value": [v for _, v in out]}).astype({"sym": object, "value": float})

    def close(self) -> None:
        pass


def streamed_average(bars: DataFrame, n: int, alpha: float | None = None, step_seconds: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """sym, ts, value: the SMA-seeded recursive average of c, its state carried from batch to batch.

    With step_seconds, a gap in the series starts the warm-up anew; bars at or before the last seen one are dropped. seeds
    (as `seeded` makes them of the history) warm the series up. Start the query within `keyed_state`.
    """
    processor = _Averages(n, 2 / (n + 1) if alpha is None else alpha, step_seconds)
    initial = None if seeds is None else seeds.groupBy("sym")
    return bars.groupBy("sym").transformWithStateInPandas(processor, "sym string, ts timestamp, value double", "Append", "None", initialState=initial)


def seeded(history: DataFrame, n: int, alpha: float | None = None) -> DataFrame:
    """sym and the state (as STATE) after the bars of the history."""
    numbered = history.select("sym", "ts", "c", F.row_number().over(Window.partitionBy("sym").orderBy("ts")).alias("rn"))
    both = scanned(numbered, [Average("value", "c", n, 2 / (n + 1) if alpha is None else alpha)])
    last = F.unix_micros(F.col("ts").cast("timestamp"))
    return both.groupBy("sym").agg(F.count("*").alias("seen"), F.coalesce(F.max_by("value", "ts"), F.sum("c") / n).alias("value"), F.sum("c").alias("total"), F.max(last).alias("last"))


class _Consumed(StatefulProcessor):
    """Passes on each id once; state: the last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else -1
        parts = [np.unique(ids[ids > last]) for ids in (part["signal_id"].to_numpy(np.int64) for part in rows)]
        new = np.unique(np.concatenate(parts)) if parts else np.array([], np.int64)  # 8 bytes an id
        if len(new):
            self.last.update((int(new[-1]),))
        for at in range(0, len(new), 1 << 16):
            ids = new[at : at + (1 << 16)]
            yield pd.DataFrame({"wallet": [key[0]] * len(ids), "signal_id": ids}).astype({"wallet": object})

    def close(self) -> None:
        pass


def receipts(signals: DataFrame) -> DataFrame:
    """wallet, signal_id: a receipt for each signal that a wallet consumes; replays and ids at or below the last have none."""
    return signals.select("wallet", "signal_id").groupBy("wallet").transformWithStateInPandas(_Consumed(), "wallet string, signal_id bigint", "Append", "None")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep keyed state in a store on disk; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def next_poll(now: Column, every_seconds: int = 60, buffer_seconds: int = 2) -> Column:
    """The next time to look, after now: a buffer past a boundary of the wall clock."""
    micros = F.unix_micros(now.cast("timestamp")) - buffer_seconds * 1_000_000
    k = F.floor(micros / (every_seconds * 1_000_000)) + 1
    return F.timestamp_seconds(k * every_seconds + buffer_seconds)


def append_once(path: str, keys: list[str], days: str | None = None):
    """A foreachBatch function that stores only rows whose keys the table lacks, so that replays do no harm.

    Each batch has a folder, which a replay of it writes again. days: a time column; then only the stored days that the
    batch touches are read for its keys, so that a batch costs what it touches, not what is stored.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        new = batch.dropDuplicates(keys)
        held = _stored(spark, path)
        if days is not None:
            new = new.withColumn("day", F.to_date(days))
            if held is not None:
                touched = sorted(r["day"] for r in new.select("day").distinct().collect())  # a batch spans few days
                held = held.filter(F.col("day").isin(touched)) if touched else None
        if held is not None:
            new = inserted_if_absent(held.filter(F.col("batch") < batch_id), new, keys)
        writer = new.write.mode("overwrite")
        (writer.partitionBy("day") if days is not None else writer).parquet(f"{path}/batch={batch_id}")

    return write


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A folder of batches, if there is one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return _batches(spark, path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def kept_once(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """What append_once has stored; nothing, of the given schema, where no batch had rows."""
    if schema is not None and _stored(spark, path) is None:
        return spark.createDataFrame([], schema)
    out = _batches(spark, path)
    return out.drop(*({"batch", "day"} & set(out.columns)))


def ingested(root: str, symbols: tuple[str, ...], step_seconds: int):
    """A foreachBatch function over bars: those of other symbols are refused, those not later than the last stored one of
    their series are old; the rest are stored, with a log of the steps missing before each. Folders by batch: bars, gaps,
    refused, last (a row a series)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        put(batch.filter(~F.col("sym").isin(*symbols)), "refused")
        held = _stored(spark, f"{root}/last")
        known = batch.filter(F.col("sym").isin(*symbols)).dropDuplicates(["sym", "ts"])
        last = latest(held.filter(F.col("batch") < batch_id), ["sym"], [F.col("batch").desc()]).select("sym", "last") if held is not None else known.selectExpr("sym", "cast(null as timestamp_ntz) as last").limit(0)
        fresh = known.join(F.broadcast(last), "sym", "left").filter(F.col("last").isNull() | (F.col("ts") > F.col("last")))  # a row a series
        w = Window.partitionBy("sym").orderBy("ts")
        seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
        gapped = fresh.withColumn("before", F.coalesce(F.lag("ts").over(w), "last")).withColumn("missing", ((seconds("ts") - seconds("before")) / step_seconds - 1).cast("bigint"))
        put(gapped.filter("missing > 0").select("sym", "ts", "missing"), "gaps")
        put(fresh.drop("last"), "bars")
        newest = fresh.groupBy("sym").agg(F.max("ts").alias("last"))
        put(last.join(newest.withColumnRenamed("last", "new"), "sym", "full").select("sym", F.coalesce("new", "last").alias("last")), "last")

    return write


def advanced(root: str, source: str, wide: str):
    """A foreachBatch function over bars of the source timeframe, in order of time: first the wide bars that they complete,
    then each bar with the close of the last wide bar complete by its start. Folders by batch: fine, wide, out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        put(batch, "fine")
        span = timeframe_seconds(wide)
        bars = _batches(spark, f"{root}/fine").filter(F.col("batch") <= batch_id)
        touched = batch.select("sym", bucket("ts", span).alias("b")).distinct()
        own = bars.drop("batch").withColumn("b", bucket("ts", span)).join(touched, ["sym", "b"], "left_semi").drop("b")
        put(confirmed(own, source, wide).withColumn("ts", F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(span))).select("sym", "ts", F.col("c").alias("wide")), "wide")
        whole = latest(_batches(spark, f"{root}/wide").filter(F.col("batch") <= batch_id), ["sym", "ts"], [F.col("batch").desc()])
        put(as_of(batch.select("sym", "ts", "c"), whole.select("sym", "ts", "wide"), "wide"), "out")

    return write


def rolling_bars(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Bars for update mode, however late a tick comes: one row of state a bucket, as many as there are bars."""
    return bars_from_ticks(ticks, width)


def put(path: str):
    """A foreachBatch function that stores a batch's bars under its number; a replay writes the same place."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def refreshed(raw: str, path: str, width: str = "1 hour"):
    """A foreachBatch function over ticks: stores them, then makes the bars of every bucket that they touch anew.

    The last tick stored under a key (sym, ts, seq) counts, so that a corrected tick corrects its bar.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.select("sym", "ts", "seq", "price", "size").write.mode("overwrite").parquet(f"{raw}/batch={batch_id}")
        held = _batches(spark, raw).filter(F.col("batch") <= batch_id)
        bucket = F.window("ts", width)["start"].alias("bucket")
        touched = held.filter(F.col("batch") == batch_id).select("sym", bucket).distinct()
        ticks = held.select("*", bucket).join(touched, ["sym", "bucket"], "left_semi").drop("bucket")
        put(path)(bars_from_ticks(latest(ticks, ["sym", "ts", "seq"], [F.col("batch").desc()]), width), batch_id)

    return write


def stored_bars(spark: SparkSession, path: str) -> DataFrame:
    """The bars of a store, each as its last batch left it."""
    return latest(_batches(spark, path), ["sym", "ts"], [F.col("batch").desc()]).drop("batch")


def _batches(spark: SparkSession, path: str) -> DataFrame:
    """A folder of batches with their numbers."""
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("bigint"))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return _batches(spark, path).drop("batch")
