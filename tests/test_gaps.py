"""Gaps over parts of series, by plain loops."""

import datetime as dt
import random

import pytest

from tallow.operators import gaps

HOUR, T0 = dt.timedelta(hours=1), dt.datetime(2024, 1, 1, 3)


@pytest.fixture(scope="module")
def hours():
    rng = random.Random(3)
    out = {}
    for sym, n, share in (("a", 600, 0.4), ("b", 90, 0.97), ("c", 1, 1.0), (None, 50, 0.5)):
        out[sym] = sorted({0, n - 1} | {i for i in range(n) if rng.random() < share})
    return out


@pytest.fixture(scope="module")
def bars(spark, hours):
    return spark.createDataFrame([(s, T0 + i * HOUR, "x") for s, at in hours.items() for i in at], "sym string, ts timestamp_ntz, part string").repartition(5)


@pytest.mark.parametrize("seconds", [3600, 7 * 3600, 10**9])
def test_ranges_over_parts_of_any_length(bars, hours, seconds):
    want = sorted((str(s), T0 + (a + 1) * HOUR, T0 + (b - 1) * HOUR, b - a - 1) for s, at in hours.items() for a, b in zip(at, at[1:]) if b - a > 1)
    got = sorted((str(r.sym), r.first_ts, r.last_ts, r.steps) for r in gaps.missing_ranges(bars, 3600, seconds).collect())
    assert got == want
    steps = sorted((str(r.sym), r.ts, r.missing) for r in gaps.steps_missing(bars, 3600, seconds).collect())
    assert steps == sorted((s, last + HOUR, n) for s, _, last, n in want)


def test_ranges_are_those_of_the_grid(bars):
    known = bars.filter("sym is not null")
    key = lambda r: (r.sym, r.first_ts, r.last_ts, r.steps)
    assert sorted(map(key, gaps.missing_ranges(known, 3600).collect())) == sorted(map(key, gaps.ranges(gaps.absent(known, 3600), 3600).collect()))


def test_funding_times_that_no_bar_tells(bars, hours):
    got = {r.sym: r for r in gaps.coverage(bars, 3600).collect()}
    assert set(got) == set(hours)
    for sym, at in hours.items():
        # hour i opens at 3 + i o'clock; a funding time is the close of one bar and the opening of the next
        boundaries = [i for i in range(at[0], at[-1] + 1) if (3 + i + 1) % 8 == 0]
        missing = [i for i in boundaries if i not in at]
        unseen = [i for i in missing if i + 1 not in at and i + 1 <= at[-1]]
        r = got[sym]
        assert (r.funding_boundaries, r.funding_missing, r.funding_unobservable) == (len(boundaries), len(missing), len(unseen)), sym
        assert r.longest_gap == 3600 * max((b - a - 1 for a, b in zip(at, at[1:])), default=0) and r.missing == at[-1] - at[0] + 1 - len(at)
    assert got["a"].funding_unobservable and got["a"].funding_unobservable < got["a"].funding_missing


@pytest.mark.parametrize("rows_a_part", [1, 10, 1 << 16])
def test_order_faults_over_parts(spark, rows_a_part):
    rng = random.Random(5)
    rows = [(s, T0 + rng.randint(0, 30) * HOUR if rng.random() < 0.9 else None, i) for s in "ab" for i in rng.sample(range(500), 200)]
    want = {}
    for s in "ab":
        ts = [t for _, t, _ in sorted((r for r in rows if r[0] == s), key=lambda r: r[2])]
        pairs = [(a, b) for a, b in zip(ts, ts[1:]) if a and b]
        want[s] = (sum(a == b for a, b in pairs), sum(b < a for a, b in pairs))
    got = gaps.order_faults(spark.createDataFrame(rows, "sym string, ts timestamp_ntz, seq bigint").repartition(4), "seq", rows_a_part)
    assert {r.sym: (r.duplicates, r.regressions) for r in got.collect()} == want


def test_no_window_by_series_alone(bars):
    """Windows of rows are by series and part; those by series have a row a part."""
    plan = gaps.missing_ranges(bars, 3600)._jdf.queryExecution().optimizedPlan().toString()
    by_rows = [line for line in plan.splitlines() if "lag(" in line and "Window" in line]
    assert by_rows and all("part" in line.split("],", 1)[1] for line in by_rows)
