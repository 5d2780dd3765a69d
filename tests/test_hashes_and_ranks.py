"""Hash trees, exact quantiles and the inventory under deletes against plain forms."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.operators import hashtree, quantiles
from tallow.streaming.inventory import Inventory


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaab") if i % 50 else None, i // 3, rng.choice(["x", "y", None])) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, a long, b string")


def test_a_tree_does_not_depend_on_partitions_and_splits_with_its_rows(spark, table):
    one = {r.g: r.content_hash for r in hashtree.content_hash(table, ["a", "b"], "g", 4).collect()}
    assert one == {r.g: r.content_hash for r in hashtree.content_hash(table.repartition(9), ["a", "b"], "g", 4).collect()} and len(set(one.values())) == 3
    leaves = hashtree.leaves(table, ["a", "b"], "g", hashtree.depths(table, ["a", "b"], "g", 4))
    most = leaves.groupBy("g").agg(F.count("*").alias("n"), F.max("rows").alias("rows"), F.first("depth").alias("depth")).collect()
    assert {r.g: r.depth for r in most}["a"] == 3 and max(r.rows for r in most) < 60


def test_one_changed_row_is_one_range(spark, table):
    table = table.withColumn("id", F.monotonically_increasing_id())
    table = table.persist()
    changed = table.withColumn("b", F.when(F.col("id") == 7, F.lit("z")).otherwise(F.col("b")))
    columns = ["a", "b", "id"]
    deep = hashtree.depths(table, columns, "g", 8)
    assert 1 <= hashtree.ranges_at_odds(hashtree.leaves(table, columns, "g", deep), hashtree.leaves(changed, columns, "g", deep), "g").count() <= 2
    got = sorted((r.b or "", r.surplus) for r in hashtree.difference(table, changed, columns, "g", 8).collect())
    was = table.filter("id = 7").first().b or ""
    assert got == sorted([(was, 1), ("z", -1)])
    assert hashtree.difference(table, table.repartition(3), columns, "g", 8).count() == 0
    twice = hashtree.difference(table.unionByName(table.filter("id = 7")), table, columns, "g", 8).collect()
    assert [r.surplus for r in twice] == [1]


@pytest.mark.parametrize("few", [1, 20, 10**6])
def test_quantiles_are_exact_for_any_spread(spark, few):
    rng = np.random.default_rng(few)
    groups = {"even": rng.random(500), "wild": np.append(rng.normal(0, 1, 300) * 10.0 ** rng.integers(-9, 9, 300), [1e300, -1e300]), "one": np.full(40, 3.0), "hot": np.append(np.full(400, 5.0), rng.random(100) * 10), "single": np.array([2.5])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("even", None), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = quantiles.exact_quantiles(df, "g", "x", {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p99": 0.99, "p1": 1.0}, few=few, buckets=16).collect()
    assert {r.g for r in got} == set(groups)
    for r in got:
        np.testing.assert_allclose([r.p0, r.p05, r.p50, r.p99, r.p1], np.quantile(groups[r.g], [0, 0.05, 0.5, 0.99, 1]), rtol=1e-12)


@pytest.mark.parametrize("seed", [0, 1])
def test_inserts_and_deletes_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    keys = [(s, t0 + dt.timedelta(hours=h)) for s in "abc" for h in range(12)]
    gone = rng.sample(keys, 14) + [k for k in keys if k[0] == "c"]
    changes = [(*k, "insert") for k in keys] + [(*k, "delete") for k in set(gone)]
    rng.shuffle(changes)
    held = Inventory(spark, f"file://{tmp_path}/held", parts=3)
    cuts = [0, 11, 30, 31, len(changes)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2 if i == 2 else 1):  # a replay
            held.write(spark.createDataFrame(changes[a:b], "sym string, ts timestamp, op string"), i)
    left = sorted(set(keys) - set(gone))
    want = {s: (min(t for x, t in left if x == s), max(t for x, t in left if x == s), sum(x == s for x, _ in left)) for s in {s for s, _ in left}}
    assert {r.sym: tuple(r)[1:] for r in held.rows().collect()} == want
