"""Stored aggregates by day: a batch reads and writes only the days that it touches.

Ticks lie in folders by day and batch, bars in folders by day. A batch stores its ticks (a replay writes the same folders),
reads the ticks of the days that it touches, and only those (a filter on the partition column, which the scan prunes by), and puts
these days' bars in the place of the old ones by dynamic partition overwrite. So a late tick corrects its bar, and
the cost of a batch does not grow with what is stored.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import latest
from ..operators.resample import bars_from_ticks, bucket, timeframe_seconds

_TICKS = "sym string, ts timestamp, seq bigint, price double, size double, day date, batch bigint"
_BARS = "sym string, ts timestamp, o double, h double, l double, c double, v double, day date"

#: Files at most of a day and batch of ticks.
_PIECES = 16


class DayStore:
    """root/ticks/day=/batch=, root/bars/day=, root/<timeframe>/day= of the first day of a bucket."""

    def __init__(self, spark: SparkSession, root: str, width: str = "1 hour"):
        self.spark, self.root, self.width = spark, root, width

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._fs().exists(self._path(f"{self.root}/{name}")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _put(self, df: DataFrame, name: str) -> None:
        """df's days in the place of those of a table. The days are dealt over tasks whole, so that a day is few files."""
        df.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.root}/{name}")

    def ticks(self, days: list[dt.date] | None = None) -> DataFrame:
        """The last tick stored under each key (sym, ts, seq)."""
        held = self._read("ticks", _TICKS)
        if days is not None:
            held = held.filter(F.col("day").isin(days))
        return latest(held, ["sym", "ts", "seq"], [F.col("batch").desc()])

    def bars(self, days: list[dt.date] | None = None, name: str = "bars") -> DataFrame:
        held = self._read(name, _BARS)
        return held if days is None else held.filter(F.col("day").isin(days))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """A foreachBatch function over ticks (sym, ts, seq, price, size)."""
        day = F.to_date("ts").alias("day")
        new = batch.select("sym", "ts", "seq", "price", "size", day, F.lit(batch_id).cast("bigint").alias("batch"))
        # in pieces of days, so that no task sorts a whole batch for its folders
        piece = F.pmod(F.xxhash64("sym", "ts", "seq"), F.lit(_PIECES))
        new.repartition("day", piece).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.root}/ticks")
        days = sorted(r["day"] for r in batch.select(day).distinct().collect())  # a batch spans few days
        if days:
            self._put(self.made(days), "bars")

    def made(self, days: list[dt.date]) -> DataFrame:
        """The bars of these days from their ticks."""
        return bars_from_ticks(self.ticks(days).drop("day", "batch"), self.width).withColumn("day", F.to_date("ts"))

    def refresh(self, timeframe: str, until: dt.date, days: int) -> None:
        """Buckets of the timeframe that begin in the last `days` days before `until` (that day included), made anew from the bars. Buckets begin
        at multiples since the epoch, so the first and last may reach over: the days that they need are read, no more."""
        span = timeframe_seconds(timeframe)
        reach = -(-span // 86_400)
        first = until - dt.timedelta(days=days - 1)
        wanted = [first + dt.timedelta(days=i) for i in range(-reach, days + reach)]
        b = self.bars(wanted).drop("day").withColumn("bucket", bucket("ts", span))
        wide = b.groupBy("sym", "bucket").agg(F.min_by("o", "ts").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "ts").alias("c"), F.sum("v").alias("v"))
        wide = wide.withColumnRenamed("bucket", "ts").withColumn("day", F.to_date("ts")).filter(F.col("day").between(first, until))
        self._put(wide, timeframe)

    def compact(self, days: list[dt.date]) -> None:
        """The batches of each day's ticks as one, under the newest batch's number: written aside, then exchanged."""
        fs = self._fs()
        for day in days:
            folder = f"{self.root}/ticks/day={day}"
            batches = sorted(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("batch="))
            if len(batches) < 2:
                continue
            aside = f"{self.root}/aside-{uuid.uuid4().hex[:12]}"
            self.ticks([day]).drop("day", "batch").write.parquet(aside)
            # the newest batch goes last: until then the older ones are still there for any key that it lacks
            old = f"{folder}/batch={batches[-1]}"
            fs.rename(self._path(old), self._path(f"{aside}-old"))
            fs.rename(self._path(aside), self._path(old))
            for b in batches[:-1]:
                fs.delete(self._path(f"{folder}/batch={b}"), True)
            fs.delete(self._path(f"{aside}-old"), True)
