"""Content hashes of groups as hash trees: equal under any partitioning, and two trees tell in which ranges they differ.

Rows have SHA-256 hashes; a group's leaves are the ranges of hashes that begin alike, with as many leading digits as
leave some rows_a_leaf rows in each (equal rows count as one, with their number). Each further level hashes sixteen nodes into one,
up to the group's root. No list holds more than a leaf or sixteen hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_A_LEAF = 1024
_DIGITS = 12
#: Most groups whose depths are held, a row each, and sent to all tasks.
_GROUPS = 10_000


def row_hash(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def depths(df: DataFrame, columns: list[str], group: str, rows_a_leaf: int = ROWS_A_LEAF) -> DataFrame:
    """group and depth: the digits that its leaves share. Rows meet the depths of few groups where they lie, so that a large group
    is not one task's; more groups than that are joined."""
    n = df.select(group, row_hash(columns).alias("h")).distinct().groupBy(group).agg(F.count("*").alias("n"))
    deeper = sum((F.col("n") > rows_a_leaf * 16**k).cast("int") for k in range(_DIGITS))
    found = n.select(group, deeper.alias("depth"))
    held = found.limit(_GROUPS + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(held, found.schema)) if len(held) <= _GROUPS else found


def leaves(df: DataFrame, columns: list[str], group: str, deep: DataFrame) -> DataFrame:
    """group, depth, prefix, own (the hash of the rows in it), rows."""
    counted = df.select(group, row_hash(columns).alias("h")).groupBy(group, "h").agg(F.count("*").alias("n"))
    same = counted[group].eqNullSafe(deep[group])
    placed = counted.join(deep, same).select(counted[group], "depth", F.expr("substring(h, 1, depth)").alias("prefix"), "h", "n")
    listed = F.array_sort(F.collect_list(F.concat("h", F.lit(":"), F.col("n").cast("string"))))
    return placed.groupBy(group, "depth", "prefix").agg(F.sha2(F.concat_ws("\x1e", listed), 256).alias("own"), F.sum("n").alias("rows"))


def root(tree: DataFrame, group: str) -> DataFrame:
    """group and content_hash of leaves."""
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    nodes = tree.filter(F.col("depth") == deepest).select(group, "prefix", "own")
    for level in range(deepest - 1, -1, -1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "own"))), lambda x: x["own"])
        up = nodes.groupBy(group, F.substring("prefix", 1, level).alias("above")).agg(F.sha2(F.concat_ws("\x1e", children), 256).alias("own")).withColumnRenamed("above", "prefix")
        nodes = up.unionByName(tree.filter(F.col("depth") == level).select(group, "prefix", "own"))
    return nodes.select(group, F.col("own").alias("content_hash"))


def content_hash(df: DataFrame, columns: list[str], group: str, rows_a_leaf: int = ROWS_A_LEAF) -> DataFrame:
    """group and content_hash: of its rows, whatever their order."""
    return root(leaves(df, columns, group, depths(df, columns, group, rows_a_leaf)), group)


def ranges_at_odds(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """group, prefix of the leaves that differ between two trees of the same depths."""
    left, right = a.select(group, "prefix", F.col("own").alias("own_a")), b.select(F.col(group).alias("group_b"), F.col("prefix").alias("prefix_b"), F.col("own").alias("own_b"))
    met = left.join(right, left[group].eqNullSafe(right["group_b"]) & (F.col("prefix") == F.col("prefix_b")), "full")
    at_odds = met.filter(~F.col("own_a").eqNullSafe(F.col("own_b")))
    return at_odds.select(F.when(F.col("own_a").isNotNull(), F.col(group)).otherwise(F.col("group_b")).alias(group), F.coalesce("prefix", "prefix_b").alias("prefix"))


def difference(a: DataFrame, b: DataFrame, columns: list[str], group: str, rows_a_leaf: int = ROWS_A_LEAF) -> DataFrame:
    """The columns, group and surplus (copies that a has more than b) of rows in which two tables differ: their trees say in which ranges, and
    the rows of those ranges alone are compared."""
    kept = list(dict.fromkeys([group, *columns]))
    deep = depths(a.select(*kept).unionByName(b.select(*kept)), columns, group, rows_a_leaf)
    odd = ranges_at_odds(leaves(a, columns, group, deep), leaves(b, columns, group, deep), group).join(deep.withColumnRenamed(group, "of"), F.col(group).eqNullSafe(F.col("of"))).drop("of")
    odd = odd.select(F.col(group).alias("odd_group"), "prefix")
    lengths = deep.select(F.col(group).alias("deep_group"), "depth")

    def near(df: DataFrame, sign: int) -> DataFrame:
        rows = df.select(*kept, row_hash(columns).alias("h")).join(lengths, F.col(group).eqNullSafe(F.col("deep_group")))
        met = rows.join(odd, F.col(group).eqNullSafe(F.col("odd_group")) & (F.expr("substring(h, 1, depth)") == F.col("prefix")), "left_semi")
        return met.select(*kept, F.lit(sign).alias("sign"))

    both = near(a, 1).unionByName(near(b, -1))
    return both.groupBy(*kept).agg(F.sum("sign").alias("surplus")).filter("surplus <> 0")


def as_sql(table: str, row: str, group: str, rows_a_leaf: int = ROWS_A_LEAF, most: int = 5) -> str:
    """content_hash() as DuckDB SQL, to a depth of `most`; row: the text that is hashed."""
    deeper = " + ".join(f"(count(*) > {rows_a_leaf * 16**k})::int" for k in range(_DIGITS))
    levels = [f"l{most} as (select g, prefix, own from leaf where depth = {most})"]
    for k in range(most - 1, -1, -1):
        levels.append(f"l{k} as (select g, prefix, own from leaf where depth = {k} union all select g, prefix[1:{k}], sha256(string_agg(own, chr(30) order by prefix)) from l{k + 1} group by 1, 2)")
    return (
        f"with h as (select {group} as g, sha256({row}) as h, count(*) as n from {table} group by 1, 2), c as (select g, {deeper} as depth from h group by g), "
        f"leaf as (select g, depth, h[1:depth] as prefix, sha256(string_agg(h || ':' || n, chr(30) order by h)) as own from h join c using (g) group by 1, 2, 3), {', '.join(levels)} "
        f"select g as {group}, own as content_hash from l0"
    )
