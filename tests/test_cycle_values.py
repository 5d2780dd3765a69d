"""The cycle indicators against published values of an outside implementation, on the series that these are of."""

import datetime as dt

import numpy as np
import pytest

from tallow.operators import indicators
from tallow.plans.layers import on_spark

#: Fixed values: (plan, output) -> value at rows of the series.
VALUES = {
    ("ht_dcperiod", "value"): {100: 34.32072027977639, 200: 36.78736433058124, 299: 28.96116981732977},
    ("ht_dcphase", "value"): {100: 290.82905103424196, 200: 24.42106318098179, 299: 152.279549719366},
    ("ht_phasor", "inphase"): {100: -7.556408195779168, 200: 17.909495585544327, 299: 13.186006337717208},
    ("ht_phasor", "quadrature"): {100: 16.960837960208693, 200: 14.334888953139199, 299: -9.277155452967948},
    ("ht_sine", "sine"): {100: -0.9346455041542449, 200: 0.41343918912274585, 299: 0.4651580349894065},
    ("ht_sine", "leadsine"): {100: -0.409460503252314, 200: 0.9361888171646754, 299: -0.29703407740235044},
    ("ht_trendline", "value"): {100: 123.35561621477714, 200: 107.90803080758697, 299: 121.7226077549036},
    ("ht_trendmode", "value"): {68: 0.0, 100: 1.0, 200: 1.0, 299: 1.0},
    ("mama", "mama"): {100: 114.90356352702632, 200: 98.87237136545686, 299: 139.2345001447337},
    ("mama", "fama"): {100: 119.0674410237951, 200: 102.24004988142946, 299: 124.22440676741788},
}


@pytest.fixture(scope="module")
def series(spark):
    # fixed values: the coefficients of the series
    i = np.arange(300)
    c = 100 + np.cumsum(3 * np.sin(i / 5) + 1.5 * np.cos(i / 11) + 0.25 * (i % 7) - 0.75)
    o = np.concatenate([[100], c[:-1]])
    h, low = np.maximum(o, c) + 1.25 + 0.4 * (i % 3), np.minimum(o, c) - 1.25 - 0.3 * (i % 5)
    rows = [("a", dt.datetime(2025, 1, 1) + dt.timedelta(hours=int(k)), *map(float, (o[k], h[k], low[k], c[k], 100 + 5 * (k % 13)))) for k in i]
    return spark.createDataFrame(rows, "sym string, ts timestamp_ntz, o double, h double, l double, c double, v double").cache()


@pytest.mark.parametrize("name", sorted({n for n, _ in VALUES}))
def test_values(series, name):
    got = on_spark(indicators.REGISTRY[name](), series).orderBy("ts").collect()
    for (plan, output), points in VALUES.items():
        if plan == name:
            for at, value in points.items():
                assert got[at][output] == pytest.approx(value, abs=1e-6), (output, at)
