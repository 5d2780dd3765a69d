"""Plans over parts of series against the same plans over whole series."""

import numpy as np
import pytest

from tallow.operators import indicators
from tallow.plans import layers, parts

PARTED = [n for n, make in indicators.REGISTRY.items() if n not in indicators.PAIRED and parts.partable(make())]


def whole(plan, bars):
    """The plan over whole series, one after another."""
    df = bars.selectExpr("*", "row_number() over (partition by sym order by ts) as rn")
    for step in plan.steps:
        df = df.selectExpr("*", *(f"{e} as {c}" for c, e in step.items())) if isinstance(step, dict) else layers.scanned(df, step)
    return df.selectExpr("sym", "ts", *plan.shown())


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(4)
    rows = []
    for sym, n in (("a", 700), ("b", 5), ("c", 257), ("d", 1)):
        c = 100 + np.cumsum(rng.normal(0, 1, n))
        for i in range(n):
            rows.append((sym, i, float(c[i] + rng.normal()), float(c[i] + 3), float(c[i] - 3), float(c[i]), float(rng.integers(0, 9))))
    df = spark.createDataFrame(rows, "sym string, i long, o double, h double, l double, c double, v double").repartition(3)
    return df.selectExpr("sym", "timestamp_ntz '2020-01-01' + make_dt_interval(0, i * 7, 0, 0) as ts", "o", "h", "l", "c", "v").cache()


def test_reach_of_windows():
    assert parts.reach("c - lag(c, 7) over (partition by sym order by ts)") == 7
    assert parts.reach("avg(c) over (partition by sym order by ts rows between 19 preceding and current row)") == 19
    assert parts.reach("c + 1") == 0
    for text in ("sum(c) over (partition by sym order by ts rows between unbounded preceding and current row)", "lead(c, 1) over (partition by sym order by ts)", "row_number() over (partition by sym, island order by ts)"):
        assert parts.reach(text) is None
    assert {"ema_", "rsi", "macd", "atr", "t3", "kama", "connors_rsi"} - set(PARTED) <= {"connors_rsi"}


def held_to(plan, bars, rows):
    a = parts.on_parts(plan, bars, rows).orderBy("sym", "ts").toPandas()
    b = whole(plan, bars).orderBy("sym", "ts").toPandas()
    assert len(a) == len(b) == 963 and list(a.columns) == list(b.columns)
    for c in a.columns[2:]:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-6, equal_nan=True)


@pytest.mark.parametrize("name", ["rsi", "macd", "t3", "kama", "bollinger_bands"])
def test_parts_give_the_rows_of_whole_series(bars, name):
    held_to(indicators.REGISTRY[name](), bars, 90)


def test_seeds_over_several_short_parts_and_values_that_begin_late(spark, bars):
    late = bars.selectExpr("sym", "ts", "o", "h", "l", "case when v > 1 then c end as c", "v")
    held_to(layers.Plan(["value", "m"]).scan(layers.ema("value", "c", 50), layers.ema("m", "value", 9)), late, 7)


def test_one_series_is_several_parts(bars):
    cut = parts.numbered(bars).selectExpr("sym", "(rn - 1) div 90 as part").groupBy("sym", "part").count().collect()
    assert sorted((r.sym, r["count"]) for r in cut) == sorted([("a", 90)] * 7 + [("a", 70), ("b", 5), ("c", 90), ("c", 90), ("c", 77), ("d", 1)])
