"""The inventory of stored series (first and last row, number of rows) kept up to date from inserts and deletes.

Changes (sym, ts, op: insert or delete) come in batches in any order, a delete even before its insert. Series lie in folders by a
hash; a batch reads and writes the folders of the series that it touches. Where a series has inserts only, its first and last row and count merge;
where rows go, or a delete still waits for its insert, they are made anew from the stored changes of that folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHANGES = "sym string, ts timestamp, sign int, part int, batch bigint"
_KNOWN = "sym string, available_from timestamp, available_to timestamp, row_count bigint, waiting bigint, upto bigint, part int"


class Inventory:
    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        self.spark, self.root, self.n = spark, root, parts

    def _read(self, name: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return self.spark.createDataFrame([], schema)
        held = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return held if parts is None else held.filter(F.col("part").isin(parts))

    def _put(self, df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.root}/{name}")

    @staticmethod
    def _made(changes: DataFrame) -> DataFrame:
        """Inventory rows from all changes of their series."""
        net = changes.groupBy("sym", "part", "ts").agg(F.sum("sign").alias("net"), F.max("batch").alias("batch"))
        there = F.when(F.col("net") > 0, F.col("ts"))
        known = net.groupBy("sym", "part").agg(F.min(there).alias("available_from"), F.max(there).alias("available_to"), F.sum(F.greatest("net", F.lit(0))).alias("row_count"), F.sum((F.col("net") < 0).cast("bigint")).alias("waiting"), F.max("batch").alias("upto"))
        return known.select("sym", "available_from", "available_to", "row_count", "waiting", "upto", "part")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """A foreachBatch function over changes. A replay of a batch writes the same folders; an inventory that has it already is made anew."""
        part = F.pmod(F.xxhash64("sym"), F.lit(self.n)).cast("int").alias("part")
        sign = F.when(F.col("op") == "delete", -1).otherwise(1).alias("sign")
        new = batch.select("sym", F.col("ts").cast("timestamp").alias("ts"), sign, part, F.lit(batch_id).cast("bigint").alias("batch"))
        self._put(new, "changes", "part", "batch")
        parts = sorted(r["part"] for r in new.select("part").distinct().collect())  # at most self.n
        if not parts:
            return
        fresh = self._read("changes", _CHANGES, parts).filter(F.col("batch") == batch_id)
        known = self._read("inventory", _KNOWN, parts)
        touched = fresh.groupBy("sym").agg(F.min("sign").alias("least"))
        state = touched.join(known.select("sym", "waiting", "upto"), "sym", "left")
        anew = state.filter((F.col("least") < 0) | (F.col("waiting") > 0) | (F.col("upto") >= batch_id)).select("sym")
        rebuilt = self._made(self._read("changes", _CHANGES, parts).filter(F.col("batch") <= batch_id).join(anew, "sym", "left_semi"))
        added = self._made(fresh.join(anew, "sym", "left_anti"))
        kept = known.join(anew, "sym", "left_anti").unionByName(added)
        merged = kept.groupBy("sym", "part").agg(F.min("available_from").alias("available_from"), F.max("available_to").alias("available_to"), F.sum("row_count").alias("row_count"), F.sum("waiting").alias("waiting"), F.max("upto").alias("upto"))
        aside = f"{self.root}/aside/{batch_id}"
        merged.select(*rebuilt.columns).unionByName(rebuilt).write.mode("overwrite").parquet(aside)  # it reads what it is to replace
        self._put(self.spark.read.parquet(aside), "inventory", "part")

    def rows(self) -> DataFrame:
        """sym, available_from, available_to, row_count of the series that have rows."""
        return self._read("inventory", _KNOWN).filter("row_count > 0").select("sym", "available_from", "available_to", "row_count")
