"""Bootstrap paths over runs of several chunks, against plain numpy over the same draws."""

import random

import numpy as np
import pytest

from tallow.operators import resampling

SCHEMA = "run_id string, trade_id bigint, r double, block string"


def made(name, n):
    rng = random.Random(f"{name}{n}")
    return [(name, i, round(rng.uniform(-5, 6.5), 3), "x") for i in range(n)]


def plain(spark, rows, paths, block, chunk, steps, name):
    """Ends of all paths: the whole history of each at once, from the draws of its chunks."""
    n = len(rows)
    chunks = -(-2 * n // chunk)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("trade_id", "r", f"pmod(xxhash64(trade_id, r), {chunks}) as c")
    by = {}
    for t, r, c in sorted(map(tuple, frame.collect())):
        by.setdefault(c, []).append(r)
    values = [np.array(by[c]) for c in sorted(by)]
    sizes = np.array([len(v) for v in values])
    totals, ruined = [], []
    for k in range(-(-paths // block)):
        many, drawn = min(block, paths - k * block), []
        for p, at in enumerate(range(0, n, steps)):
            key = [0, k, 256 + p, *name.encode()]
            counts = np.random.default_rng(key).multinomial(min(steps, n - at), sizes / sizes.sum(), size=many)
            rows_of = [[] for _ in range(many)]
            for c, v in enumerate(values):
                picked = iter(v[np.random.default_rng([*key, 256 + c]).integers(0, len(v), int(counts[:, c].sum()))])
                for path in range(many):
                    rows_of[path] += [next(picked) for _ in range(counts[path, c])]
            drawn.append(np.random.default_rng([*key, 2**32 - 1]).permuted(np.array(rows_of), axis=1))
        drawn = np.hstack(drawn)
        history = np.cumprod(1 + drawn / 100, axis=1)
        highs = np.maximum.accumulate(np.hstack([np.ones((many, 1)), history]), axis=1)[:, 1:]
        totals += drawn.sum(axis=1).tolist()
        ruined += (history <= 0.4 * highs).any(axis=1).tolist()
    return np.array(totals), np.array(ruined)


@pytest.mark.parametrize("partitions", [1, 7])
def test_runs_of_several_chunks_are_those_of_their_draws(spark, partitions):
    rows, short = made("long", 700), made("short", 40)
    frame = spark.createDataFrame(rows + short + [("none", 1, None, "x")], SCHEMA).repartition(partitions)
    got = {r.run_id: r for r in resampling.monte_carlo(frame, paths=130, block=50, chunk=100, steps=64).collect()}
    totals, ruined = plain(spark, rows, 130, 50, 100, 64, "long")
    assert (got["long"].p05, got["long"].p95) == pytest.approx(tuple(np.quantile(totals, [0.05, 0.95]))) and got["long"].ruin == pytest.approx(ruined.mean())
    assert tuple(got["none"]) == ("none", 0.0, 0.0, 0.0)
    # a short run beside a long one is the short run alone
    alone = resampling.monte_carlo(spark.createDataFrame(short, SCHEMA), paths=130, block=50, steps=64).first()
    assert got["short"] == alone and set(got) == {"long", "short", "none"}


def test_chunks_draw_as_one_chunk_does(spark):
    rows = [(None, i, r, x) for _, i, r, x in made("any", 900)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = resampling.monte_carlo(frame, paths=3000).first()
    cut = resampling.monte_carlo(frame, paths=3000, chunk=150, steps=128).first()
    assert whole.run_id is None and cut.run_id is None
    rs = np.array([r for _, _, r, _ in rows])
    spread = rs.std() * len(rs) ** 0.5
    for got in (whole, cut):
        assert got.p05 == pytest.approx(rs.sum() - 1.645 * spread, abs=0.12 * spread) and got.p95 == pytest.approx(rs.sum() + 1.645 * spread, abs=0.12 * spread)
    assert cut.ruin == pytest.approx(whole.ruin, abs=0.05)


def test_a_fall_over_parts_is_a_fall():
    """Parts compose: a path that no part ruins by itself."""
    drawn = np.full((1, 100), -1.0)
    assert not resampling.summary(drawn[:, :60], 0.01, 0.6)[4][0]
    rs = np.full(100, -1.0)
    for step in (100, 60, 7, 1):
        total, ruined = resampling.resampled_paths(rs, 3, np.random.default_rng(1), step=step)
        assert ruined.all() and total.tolist() == [-100.0] * 3
    assert not resampling.resampled_paths(rs[:90], 3, np.random.default_rng(1), step=7)[1].any()


def test_an_empty_table_has_no_runs(spark):
    assert resampling.monte_carlo(spark.createDataFrame([], SCHEMA), paths=60).collect() == []


def test_a_long_run_of_few_values_draws_in_place(spark, monkeypatch):
    """Copies of a table are one run of few values: no draw leaves its task, and paths end as those drawn one by one do."""
    rng = random.Random(5)
    rs = [round(rng.uniform(-25, 26), 2) for _ in range(300)]
    rows = [("many", i, rs[i % 300], "x") for i in range(6000)]
    whole = resampling.monte_carlo(spark.createDataFrame(rows, SCHEMA), paths=2000).first()
    monkeypatch.setattr(resampling, "_spread", None)
    frame = spark.createDataFrame(rows + [("none", 1, None, "x")], SCHEMA)
    got = {r.run_id: r for r in resampling.monte_carlo(frame, paths=2000, chunk=100).collect()}
    sd = np.std(rs) * 6000**0.5
    assert set(got) == {"many", "none"} and got["many"].ruin == pytest.approx(whole.ruin, abs=0.03)
    for q in ("p05", "p95"):
        assert got["many"][q] == pytest.approx(whole[q], abs=0.15 * sd)
    assert {r.run_id: r for r in resampling.monte_carlo(frame.repartition(5), paths=2000, chunk=100).collect()} == got


@pytest.mark.parametrize("counts", [[6, 6, 6, 12], [7, 1, 900, 92]])
def test_tables_draw_by_their_counts(counts):
    """Mean, spread and ruin of paths from a table are those of its rows, whether the table is one of copies or not."""
    values, counts = np.array([-30.0, 5.0, 8.0, 20.0]), np.array(counts)
    plain = resampling.resampled_paths(np.repeat(values, counts), 8000, np.random.default_rng(1))
    total, ruined = resampling.tabled_paths(values, counts, 8000, np.random.default_rng(2), step=16)
    assert total.mean() == pytest.approx(plain[0].mean(), abs=0.06 * plain[0].std()) and total.std() == pytest.approx(plain[0].std(), rel=0.05)
    assert ruined.mean() == pytest.approx(plain[1].mean(), abs=0.03)


def test_a_path_that_no_ruin_ends_is_walked_to_its_end():
    total, ruined = resampling.tabled_paths(np.array([1.0]), np.array([1000]), 3, np.random.default_rng(1), step=64)
    assert total.tolist() == [1000.0] * 3 and not ruined.any()
    total, ruined = resampling.tabled_paths(np.array([-1.0]), np.array([1000]), 3, np.random.default_rng(1), step=64)
    assert total.tolist() == [-1000.0] * 3 and ruined.all()


def written(spark):
    """Bytes of shuffle that the session wrote so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_steps_behind_a_ruin_are_not_shuffled(spark):
    """A long run of different multiples: the draws of the steps that are walked travel, of the others sums alone."""
    rows = "cast(null as string) as run_id, id as trade_id, (id * 7919 % 60000) / 1200D - 25 as r"
    frame, before = spark.range(60_000).selectExpr(*rows.split(", ")), written(spark)
    got = resampling.monte_carlo(frame, paths=200, chunk=10_000).first()
    assert written(spark) - before < 20_000_000  # of 96 MB of draws
    rs = np.arange(60_000) / 1200 - 25
    spread = rs.std() * len(rs) ** 0.5
    assert got.p05 == pytest.approx(rs.sum() - 1.645 * spread, abs=0.35 * spread) and got.p95 == pytest.approx(rs.sum() + 1.645 * spread, abs=0.35 * spread)
    assert got.run_id is None and got.ruin == 1.0


def test_paths_ruined_in_any_part_end_as_those_drawn_one_by_one(spark):
    rng = random.Random(3)
    rows = [("some", i, round(rng.uniform(-7, 8), 3), "x") for i in range(2000)] + [("all", i, round(rng.uniform(-25, 24), 3), "x") for i in range(700)] + [("none", i, 1 + i / 1000, "x") for i in range(500)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.run_id: r for r in resampling.monte_carlo(frame, paths=2000, chunk=150, steps=32).collect()}
    for run, low, high in (("some", 0.3, 0.95), ("all", 1, 1), ("none", 0, 0)):
        rs = np.array([r for of, _, r, _ in rows if of == run])
        total, ruined = resampling.resampled_paths(rs, 4000, np.random.default_rng(8))
        assert low <= ruined.mean() <= high and got[run].ruin == pytest.approx(ruined.mean(), abs=0.05)
        for q, of in ((0.05, got[run].p05), (0.95, got[run].p95)):
            assert of == pytest.approx(np.quantile(total, q), abs=0.15 * total.std())
    again = frame.repartition(5)
    assert {r.run_id: r for r in resampling.monte_carlo(again, paths=2000, chunk=150, steps=32).collect()} == got
    assert {r.run_id: r.ruin for r in resampling.risk_of_ruin(again, paths=2000, chunk=150, steps=32).collect()} == {k: r.ruin for k, r in got.items()}


@pytest.mark.parametrize("n", [1, 3, 256, 700])
def test_sums_are_of_as_many_draws(n):
    counts = [np.array([0, 1, 2, 3, 1001]), np.zeros(4, int)]
    rngs = lambda: [np.random.default_rng(k) for k in range(2)]
    assert [x.tolist() for x in resampling.own_sums(np.ones(n), counts, rngs())] == [x.tolist() for x in counts]
    values = np.random.default_rng(n).uniform(-1, 9, n)
    many = np.full(4000, 333)
    got = resampling.own_sums(values, [many], rngs())[0]
    assert got.mean() == pytest.approx(333 * values.mean(), abs=0.08 * 333**0.5 * values.std() + 1e-9) and got.std() == pytest.approx(333**0.5 * values.std(), rel=0.05, abs=1e-9)


def test_a_run_of_one_chunk_does_not_travel_with_every_block(spark):
    frame, before = spark.range(60_000).selectExpr("'a' as run_id", "id as trade_id", "(id * 7919 % 60000) / 1200D - 25 as r"), written(spark)
    got = resampling.monte_carlo(frame, paths=400, block=10).first()
    assert written(spark) - before < 8_000_000 and got.ruin == 1.0  # 40 blocks, 480 KB of multiples
