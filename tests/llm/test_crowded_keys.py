"""Keys of many members in different components, by all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallow.llm import jaccard_join
from test_texts import slow_classes, variants


def bare(percent, block):
    join = jaccard_join.Join.__new__(jaccard_join.Join)
    join.percent, join.block = percent, block
    return join


@pytest.mark.parametrize("percent,block", [(85, 4), (80, 7), (100, 5), (85, 512)])
def test_cells_give_the_pairs_of_a_key(spark, percent, block):
    rng = random.Random(block)
    rows = [(key, rep, rng.randint(20, 48), rng.randint(0, 3), 0, rng.choice([rep, 1, 2])) for key, m in ((1, 150), (2, 3), (3, 60)) for rep in rng.sample(range(1000), m)]
    # sizes at the very edge of what may be partners
    rows += [(4, rep, n, 0, 0, rep) for rep, n in enumerate([17, 20, 34, 40, 85, 100, 68, 80, 51, 60] * 4)]
    frame = spark.createDataFrame(rows, "key bigint, rep bigint, n bigint, place int, weight bigint, component bigint").repartition(3)
    pairs, crowded = bare(percent, block)._across(frame)
    got = sorted((r.a, r.b, r.na, r.nb) for r in pairs.collect())

    def fits(x, y):
        enough = (x[2] + y[2]) * percent
        return all((r[2] - r[3]) * (100 + percent) >= enough for r in (x, y)) and min(x[2], y[2]) * (100 + percent) >= enough

    want = sorted((x[1], y[1], x[2], y[2]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[5] != y[5] and fits(x, y))
    assert got == want and want and (crowded.count() > 0) == (block < 512)


def test_a_crowded_key_is_many_groups(spark):
    """4000 members of one key and size: no cell has more than a few blocks' rows."""
    rows = spark.range(4000).select(F.lit(1).cast("bigint").alias("key"), F.col("id").alias("rep"), F.lit(30).cast("bigint").alias("n"), F.lit(0).alias("place"), F.lit(0).alias("weight"), F.col("id").alias("component"))
    join, seen = bare(85, 128), []
    whole = jaccard_join.Join._by_cells

    def watched(self, rows):
        seen.append(rows)
        return whole(self, rows)

    join._by_cells = watched.__get__(join)
    pairs, _ = join._across(rows)
    assert pairs.count() == 4000 * 3999 // 2
    blocks = seen[0].withColumn("at", F.pmod(F.xxhash64("rep"), F.col("blocks")[F.col("band")])).groupBy("at").count().agg(F.max("count"), F.count("*")).first()
    assert blocks[0] < 2 * 128 and blocks[1] == 32


@pytest.mark.parametrize("block", [2, 5])
def test_joins_with_cells_agree_with_all_pairs(spark, block):
    rng = random.Random(block)
    draw = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    line = draw(6)
    texts = [None, "", "one"] + [f"{line} {draw(3)}" for _ in range(60)] + [t for n, m in ((60, 4), (150, 8)) for t in variants(rng, draw(n), 20, m)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for stars in (0, 1):
        join = jaccard_join.Join(docs, block=block, star_rounds=stars)
        assert sorted(tuple(r) for r in join.classes().collect()) == slow_classes(rows, 4, 85)
