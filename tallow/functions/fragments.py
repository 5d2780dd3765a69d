"""SQL fragments over series: columns sym (series), ts (order), rn (place from 1) and whatever a layer adds.

Every fragment reads the same in Spark SQL and in DuckDB; `§` stands for "ignore nulls" (see plans.layers).
Warm-up is NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

ORDER = "partition by sym order by ts"


def num(x: float) -> str:
    """A double literal of both dialects."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def frame(f: str, x: str, n: int) -> str:
    """f(x) over the last n rows."""
    return f"{f}({x}) over ({ORDER} rows between {n - 1} preceding and current row)"


def whole(f: str, x: str, n: int) -> str:
    """frame(), null until the frame holds n values."""
    return f"case when {frame('count', x, n)} = {n} then {frame(f, x, n)} end"


def sma(x: str, n: int) -> str:
    return whole("avg", x, n)


def rolling_sum(x: str, n: int) -> str:
    return whole("sum", x, n)


def stdev(x: str, n: int) -> str:
    return whole("stddev_pop", x, n)


def highest(x: str, n: int) -> str:
    return whole("max", x, n)


def lowest(x: str, n: int) -> str:
    return whole("min", x, n)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) over ({ORDER})" if k else f"({x})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) over ({ORDER})"


def running(f: str, x: str) -> str:
    return f"{f}({x}) over ({ORDER} rows between unbounded preceding and current row)"


def held(x: str, start: float) -> str:
    """x where it is not null, else its last value before, else start."""
    return f"coalesce(last_value({x} §) over ({ORDER} rows between unbounded preceding and current row), {num(start)})"


def weighted(x: str, weights: Sequence[float]) -> str:
    """Sum of weights[i] times x i rows before; null until all are there."""
    return "(" + " + ".join(f"{num(w)} * {lag(x, i)}" for i, w in enumerate(weights)) + ")"


def wma(x: str, n: int) -> str:
    """Weights n for the newest down to 1."""
    total = n * (n + 1) / 2
    return weighted(x, [(n - i) / total for i in range(n)])


def linreg(x: str, n: int) -> str:
    """End point of the least-squares line through the last n values."""
    return weighted(x, [(2 * (2 * n - 1) - 6 * i) / (n * (n + 1)) for i in range(n)])


def ratio(a: str, b: str, on_zero: str | float) -> str:
    """a / b with a named substitute for a zero denominator; nulls pass through."""
    z = on_zero if isinstance(on_zero, str) else num(on_zero)
    return f"(case when ({b}) = 0 then case when ({a}) is not null then {z} end else ({a}) / ({b}) end)"


TP, HL2, HLCC4, OHLC4 = "((h + l + c) / 3)", "((h + l) / 2)", "((h + l + 2 * c) / 4)", "((o + h + l + c) / 4)"


def true_range() -> str:
    """First row: high - low."""
    return f"greatest(h - l, coalesce(abs(h - {lag('c')}), h - l), coalesce(abs(l - {lag('c')}), h - l))"
