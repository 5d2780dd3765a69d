"""Lookups along time and episodes, in parts of any length, against plain loops."""

import datetime as dt
import random

import pytest

from tallow.operators import align, audit

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(0, 40_000))
    left = [(i, rng.choice("aaaab"), at()) for i in range(300)]
    right = sorted({(rng.choice("aaaac"), at()) for _ in range(150)})
    return left, [(s, t, None if rng.random() < 0.2 else rng.random()) for s, t in right]


@pytest.mark.parametrize("seconds", [500, 7_000, 10**7])
def test_as_of_and_next_in_parts(spark, rows, seconds):
    left, right = rows
    a = spark.createDataFrame(left, "id long, sym string, ts timestamp_ntz")
    b = spark.createDataFrame(right, "sym string, ts timestamp_ntz, v double")
    known = lambda s: [(t, v) for sym, t, v in right if sym == s and v is not None]
    got = {r.id: r.v for r in align.as_of(a, b, "v", seconds=seconds).collect()}
    assert got == {i: next((v for t, v in reversed(known(s)) if t <= at), None) for i, s, at in left}
    got = {r.id: (r.next_ts, r.next_v) for r in align.next_bar(a, b, columns=("v",), seconds=seconds).collect()}
    assert got == {i: next(((t, v) for sym, t, v in right if sym == s and t > at), (None, None)) for i, s, at in left}


def test_first_value_within_a_span(spark, rows):
    points = sorted({t for *_, t in rows[0]})[::9] + [rows[1][0][1]]
    p = spark.createDataFrame([(t,) for t in dict.fromkeys(points)], "ts timestamp_ntz")
    values = {}
    for _, t, v in rows[1]:
        if v is not None:
            values.setdefault(t, set()).add(v)
    for r in align.first_within(p, spark.createDataFrame(rows[1], "sym string, ts timestamp_ntz, v double"), 300, "v", -1.0).collect():
        soon = [t for t in values if r.ts <= t < r.ts + dt.timedelta(seconds=300)]
        assert (r.source == "measured" and r.v in values[min(soon)]) if soon else (r.source, r.v) == ("fallback", -1.0)


@pytest.mark.parametrize("seconds", [60, 900, 50_000])
def test_candles_of_what_follows(spark, seconds):
    rng = random.Random(2)
    data = [(i, rng.choice("aab"), T0 + dt.timedelta(seconds=rng.randrange(0, 3_000)), rng.random()) for i in range(500)]
    e = spark.createDataFrame(data, "id long, sym string, ts timestamp_ntz, x double")
    got = {tuple(r) for r in align.following(e.select("id", "sym", "ts"), e, seconds, "x", "id").select("id", "o", "h", "l", "c", "n").collect()}
    want = set()
    for i, s, at, _ in data:
        span = sorted((t, k, x) for k, sym, t, x in data if sym == s and at < t <= at + dt.timedelta(seconds=seconds))
        if span:
            x = [v for *_, v in span]
            want.add((i, x[0], max(x), min(x), x[-1], len(x)))
    assert got == want


@pytest.mark.parametrize("kind", ["drawdown", "runup"])
def test_episodes_do_not_depend_on_parts(spark, kind):
    rng = random.Random(6)
    data = []
    for sym, n in (("a", 400), ("b", 3), ("c", 60)):
        v = 100
        for i in range(n):
            v += rng.choice([-1, -1, 0, 1, 1])
            data.append((sym, i * rng.choice([1]) + 7, float(v)))
    e = spark.createDataFrame(data, "sym string, seq long, equity double").repartition(3)
    want = sorted(map(str, audit.episodes(e, kind, rows_a_part=10**6).collect()))
    for rows in (1, 13, 100):
        assert sorted(map(str, audit.episodes(e, kind, rows_a_part=rows).collect())) == want
