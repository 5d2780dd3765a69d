"""Indicators, patterns and cycle kernels on small series, against plain loops and known cases."""

import datetime as dt
import math

import numpy as np
import pytest

from tallow.operators import cycle, indicators, patterns
from tallow.plans.layers import on_spark, run_average


def frame(spark, close, spread=1.0, volume=10.0, sym="a"):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(sym, t0 + dt.timedelta(hours=i), float(c) - 0.25 * spread * (-1) ** i, c + spread, c - spread, float(c), float(volume + i % 3)) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "sym string, ts timestamp_ntz, o double, h double, l double, c double, v double")


def values(spark, name, close, *args, **kw):
    rows = on_spark(indicators.REGISTRY[name](*args), frame(spark, close, **kw)).orderBy("ts").collect()
    return [r[2] for r in rows]


WAVE = [100 + 0.1 * i + 5 * math.sin(i / 7) for i in range(140)]


def test_average_is_seeded_by_the_mean_and_recursive(spark):
    got = values(spark, "ema_", WAVE, 9)
    v, want = None, []
    for i, x in enumerate(WAVE):
        v = None if i < 8 else sum(WAVE[:9]) / 9 if i == 8 else v + 0.2 * (x - v)
        want.append(v)
    assert [None if w is None else pytest.approx(w, abs=1e-6) for w in want] == got


@pytest.mark.parametrize("name,first", [("dema", 41), ("tema", 61), ("macd", 26), ("tsi", 38), ("t3", 121), ("connors_rsi", 102), ("ulcer_index", 27), ("schaff_trend_cycle", 68), ("pretty_good_oscillator", 89)])
def test_warm_up(spark, name, first):
    got = values(spark, name, WAVE)
    assert all(x is None for x in got[: first - 1]) and all(x is not None for x in got[first - 1 :])


def test_flat_prices_take_the_named_substitutes(spark):
    flat = [100.0] * 60
    for name, want in {"rsi": 100.0, "cci": 0.0, "williams_pr": -50.0, "stochastic": 50.0, "demarker": 0.5, "imi": 50.0, "choppiness_index": 100.0, "cmo": 0.0, "money_flow_index": 100.0}.items():
        kw = {"spread": 0.0}
        assert values(spark, name, flat, **kw)[-1] == pytest.approx(want), name


def test_falling_prices(spark):
    assert values(spark, "rsi", [600.0 - i for i in range(60)])[-1] == 0.0


def test_linear_prices(spark):
    line = [10.0 + i for i in range(60)]
    assert values(spark, "prm_sma", line, 5)[-1] == pytest.approx(67.0)
    assert values(spark, "prm_linreg", line, 14)[-1] == pytest.approx(69.0)
    assert values(spark, "prm_wma", line, 3)[-1] == pytest.approx((69 * 3 + 68 * 2 + 67) / 6, abs=1e-6)


def test_parabolic_sar_follows_a_rise_from_below(spark):
    got = values(spark, "parabolic_sar", [100.0 + i for i in range(40)])
    assert got[0] is None and all(s < 100 + i - 1 for i, s in enumerate(got) if s is not None and i > 1)


def test_a_row_never_depends_on_later_rows():
    close = np.array(WAVE)
    for f in (cycle.period, cycle.phase, cycle.phasor, cycle.sine, cycle.trendline, cycle.trendmode, cycle.mama):
        for whole, part in zip(f(close), f(close[:100])):
            np.testing.assert_allclose(whole[:100], part)


def test_cycle_finds_the_period_of_a_sine():
    close = 100 + 5 * np.sin(2 * np.pi * np.arange(300) / 20)
    period = cycle.period(close)[0]
    assert np.isnan(period[:32]).all() and abs(period[-1] - 20) < 2
    assert set(np.unique(cycle.trendmode(close)[0][63:])) <= {0.0, 1.0}


def test_average_keeps_its_state_over_missing_values():
    x = np.array([1.0, 2.0, 3.0, np.nan, 5.0])
    np.testing.assert_allclose(run_average(x, 3, 0.5), [np.nan, np.nan, 2.0, np.nan, 3.5])


def test_engulfing_and_its_boundary(spark):
    t0 = dt.datetime(2024, 1, 1)
    bars = [(10, 10.5, 9.5, 10.1), (10, 10.5, 9.5, 10.1), (10.5, 11, 9, 10.0), (9.9, 11.5, 9, 11.0), (10.5, 11, 9, 10.0), (10.0, 11.5, 9, 11.0)]
    rows = [("a", t0 + dt.timedelta(hours=i), *map(float, b), 1.0) for i, b in enumerate(bars)]
    df = spark.createDataFrame(rows, "sym string, ts timestamp_ntz, o double, h double, l double, c double, v double")
    got = [r.pat_engulfing for r in on_spark(patterns.plan(("engulfing",)), df).orderBy("ts").collect()]
    assert got[:2] == [None, None] and got[3] == 100 and got[5] == 80


def test_hikkake_is_confirmed_once(spark):
    t0 = dt.datetime(2024, 1, 1)
    hl = [(12, 8)] * 4 + [(12, 6), (11, 7), (10, 6.5), (10.5, 6.6), (12.5, 7), (13, 8)]
    rows = [("a", t0 + dt.timedelta(hours=i), 9.0, float(h), float(low), float(h) - 0.1, 1.0) for i, (h, low) in enumerate(hl)]
    df = spark.createDataFrame(rows, "sym string, ts timestamp_ntz, o double, h double, l double, c double, v double")
    got = [r.pat_hikkake for r in on_spark(patterns.plan(("hikkake",)), df).orderBy("ts").collect()]
    assert got[6] == 100 and got[8] == 200 and got[9] == 0


def test_pattern_outputs(spark):
    df = spark.createDataFrame([(v,) for v in (None, 0, 100, -80, 200, -200)], "v int")
    got = [r[0] for r in df.select(patterns.described(df.v)).collect()]
    assert got[0] is None and tuple(got[1]) == (0, 0, 0, 0) and tuple(got[2]) == (1, 1, 1, 0) and tuple(got[3]) == (1, -1, 0.5, 0) and tuple(got[4]) == (0, 1, 0, 1) and tuple(got[5]) == (0, -1, 0, 1)
