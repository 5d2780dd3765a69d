"""Catalog-style querying: filters, projections, facets, pages, comparison, keyed writes on frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import leaves


def matching(df: DataFrame, equal: Mapping[str, object] = {}, at_least: Mapping[str, object] = {}, at_most: Mapping[str, object] = {}, deleted: str = "any", deleted_column: str = "deleted_at") -> DataFrame:
    """Rows that meet all given predicates; a None value does not restrict. deleted: any, only or none."""
    tests = [F.col(k) == v for k, v in equal.items() if v is not None]
    tests += [F.col(k) >= v for k, v in at_least.items() if v is not None]
    tests += [F.col(k) <= v for k, v in at_most.items() if v is not None]
    if deleted != "any":
        tests.append(F.col(deleted_column).isNotNull() if deleted == "only" else F.col(deleted_column).isNull())
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def offset_page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows and the total number of rows beside each."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def keyset_page(df: DataFrame, cursor: str, after: int | None, limit: int) -> DataFrame:
    """The next rows by a unique cursor, one more than asked for, which tells whether there are more."""
    rows = df if after is None else df.filter(F.col(cursor) > after)
    return rows.orderBy(cursor).limit(limit + 1)


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """kind, value, n: how often each value of each column occurs; one pass."""
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(kinds.alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upserted(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with the rows inserted, or in the place of those with their keys."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    return latest(both, keys, [F.col("__new").desc()]).drop("__new")


def inserted_if_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys the table does not have, one a key."""
    return rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")


def compared(df: DataFrame, key: str, wanted: Sequence[int]) -> DataFrame:
    """The rows of the wanted keys in that order (position from 0); raises if one is missing."""
    asked = df.sparkSession.range(len(wanted)).select(F.col("id").alias("position"), F.element_at(F.array(*map(F.lit, wanted)), (F.col("id") + 1).cast("int")).alias(key))
    out = asked.join(df, key, "left")
    known = next(c for c in df.columns if c != key)
    return out.withColumn("position", F.when(F.col(known).isNotNull(), F.col("position")).otherwise(F.raise_error(F.lit("no such row")).cast("bigint")))


def varied(df: DataFrame, key: str, json: str) -> DataFrame:
    """name, values: parameters (of a flat JSON object) with more than one value across rows."""
    pairs = df.select(F.explode(F.from_json(json, "map<string,string>")).alias("name", "value"))
    return pairs.groupBy("name").agg(F.count_distinct("value").alias("values")).filter("values > 1")


def patched(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with those columns replaced that rows (one a key) have and where they are not null; new keys are added."""
    own = [c for c in rows.columns if c not in keys]
    both = table.join(rows.select(*keys, *(F.col(c).alias(f"__{c}") for c in own)), list(keys), "full")
    return both.select(*(F.coalesce(f"__{c}", c).alias(c) if c in own else F.col(c) for c in table.columns))


def soft_deleted(table: DataFrame, gone: DataFrame, key: str, at: Column, column: str = "deleted_at") -> DataFrame:
    """The table with `column` set to `at` for the keys of gone that are not deleted yet."""
    marks = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    return table.join(marks, key, "left").withColumn(column, F.coalesce(column, F.when(F.col("__gone"), at))).drop("__gone")


def retained(table: DataFrame, ts: str, now: Column, drop_days: int, compress_days: int) -> DataFrame:
    """Rows younger than drop_days, with storage: compressed from compress_days on. Both are of whole days, so that a table in
    partitions of days loses or rewrites whole partitions."""
    age = F.date_diff(now, F.to_date(ts))
    return table.filter(age < drop_days).withColumn("storage", F.when(age >= compress_days, "compressed").otherwise("plain"))


def registered(catalog: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """new rows as runs that begin: run_seq after the catalog's last one, in the given order, run_id from it, status RUNNING.
    One request registers few rows, which are numbered in one task."""
    last = catalog.agg(F.coalesce(F.max("run_seq"), F.lit(0)).alias("last"))
    numbered = new.withColumn("k", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(last))
    seq = (F.col("last") + F.col("k")).cast("bigint")
    return numbered.withColumn("run_seq", seq).withColumn("run_id", F.format_string("run-%06d", "run_seq")).withColumn("status", F.lit("RUNNING")).drop("k", "last")


def probes(**asked: tuple[DataFrame, str]) -> DataFrame:
    """name, n, there of each probe (a frame and a condition): a count, and whether there is a row at all."""
    one = lambda name, df, test: df.filter(test).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") > 0).alias("there"))
    return reduce(DataFrame.unionByName, (one(name, df, test) for name, (df, test) in asked.items()))


def settings(runs: DataFrame, key: str, json: str) -> DataFrame:
    """key, name, value of every leaf of nested JSON settings, names joined by dots."""
    return runs.select(key, F.explode(leaves(F.col(json))).alias("x")).select(key, "x.name", "x.value")


def differing(rows: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """name, values (all of them, sorted) of the settings that are not the same in all rows."""
    g = rows.groupBy(name).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias("values"), F.count_distinct(value).alias("n"))
    return g.filter("n > 1").select(name, "values")
