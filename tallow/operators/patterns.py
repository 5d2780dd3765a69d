"""The 61 candlestick patterns as layered plans: name -> integer in {0, +-80, +-100, +-200}, null in warm-up.

Conditions name values by kind and rows back, as in c1 (close one row back): o h l c prices, b real body, t and m
its top and bottom, u and w upper and lower shadow, s colour (1 for close >= open, else -1); averages over
the rows before the named row: bl bs bd long, short and doji body, ss sv short and very short shadow, nr fr eq
near, far and equal distance. A shadow is long beyond the body, very long beyond twice the body.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fragments import lag, num
from ..plans.layers import Machine, Plan

#: Name -> (measure, rows, factor). Shadows count half.
AVERAGES = {
    "bl": ("b", 10, 1.0),
    "bs": ("b", 10, 1.0),
    "bd": ("(h - l)", 10, 0.1),
    "ss": ("(u + w)", 10, 0.5),
    "sv": ("(h - l)", 10, 0.1),
    "nr": ("(h - l)", 5, 0.2),
    "fr": ("(h - l)", 5, 0.6),
    "eq": ("(h - l)", 5, 0.05),
}
_DOJI = "b0 <= bd0"
_GAP_UP = lambda a, b: f"m{a} > t{b}"
_GAP_DOWN = lambda a, b: f"t{a} < m{b}"
_INSIDE = "case when t0 < t1 and m0 > m1 then -100 * s1 when t0 <= t1 and m0 >= m1 then -80 * s1 else 0 end"
_SHORT_AFTER = "s1 = -1 and b1 > bl1 and s0 = 1 and o0 < l1"
_MARUBOZU = lambda k: f"b{k} > bl{k} and u{k} < sv{k} and w{k} < sv{k}"
_KICK = f"s1 = -s0 and {_MARUBOZU(1)} and {_MARUBOZU(0)} and (s1 = -1 and l0 > h1 or s1 = 1 and h0 < l1)"
_NEAR_IN = lambda a, b: f"o{a} >= m{b} - nr{b} and o{a} <= t{b} + nr{b}"


def _rising(far: str) -> str:
    """Three rising white rows, each opening in or near the body before."""
    return f"s2 = 1 and s1 = 1 and s0 = 1 and c0 > c1 and c1 > c2 and o1 > o2 and o1 <= c2 + nr2 and o0 > o1 and o0 <= c1 + nr1 and {far}"


def _when(condition: str, value: str = "100") -> str:
    return f"case when {condition} then {value} else 0 end"


#: name -> (rows before the first result, value).
CONDITIONS: dict[str, tuple[int, str]] = {
    # one row
    "doji": (10, _when(_DOJI)),
    "long_legged_doji": (10, _when(f"{_DOJI} and (w0 > b0 or u0 > b0)")),
    "rickshaw_man": (10, _when(f"{_DOJI} and w0 > b0 and u0 > b0 and m0 <= l0 + (h0 - l0) / 2 + nr0 and t0 >= l0 + (h0 - l0) / 2 - nr0")),
    "dragonfly_doji": (10, _when(f"{_DOJI} and u0 < sv0 and w0 > sv0")),
    "gravestone_doji": (10, _when(f"{_DOJI} and w0 < sv0 and u0 > sv0")),
    "takuri": (10, _when(f"{_DOJI} and u0 < sv0 and w0 > 2 * b0")),
    "hammer": (11, _when("b0 < bs0 and w0 > b0 and u0 < sv0 and m0 <= l1 + nr1")),
    "hanging_man": (11, _when("b0 < bs0 and w0 > b0 and u0 < sv0 and m0 >= h1 - nr1", "-100")),
    "inverted_hammer": (11, _when(f"{_GAP_DOWN(0, 1)} and b0 < bs0 and u0 > b0 and w0 < sv0")),
    "shooting_star": (11, _when(f"{_GAP_UP(0, 1)} and b0 < bs0 and u0 > b0 and w0 < sv0", "-100")),
    "spinning_top": (10, _when("u0 > b0 and w0 > b0 and b0 < bs0", "100 * s0")),
    "high_wave": (10, _when("b0 < bs0 and u0 > 2 * b0 and w0 > 2 * b0", "100 * s0")),
    "marubozu": (10, _when(_MARUBOZU(0), "100 * s0")),
    "closing_marubozu": (10, _when("b0 > bl0 and (s0 = 1 and u0 < sv0 or s0 = -1 and w0 < sv0)", "100 * s0")),
    "belt_hold": (10, _when("b0 > bl0 and (s0 = 1 and w0 < sv0 or s0 = -1 and u0 < sv0)", "100 * s0")),
    "long_line": (10, _when("b0 > bl0 and u0 < ss0 and w0 < ss0", "100 * s0")),
    "short_line": (10, _when("b0 < bs0 and u0 < ss0 and w0 < ss0", "100 * s0")),
    # two rows
    "engulfing": (2, _when("s0 = -s1 and (t0 >= t1 and m0 < m1 or t0 > t1 and m0 <= m1)", "s0 * case when o0 <> c1 and c0 <> o1 then 100 else 80 end")),
    "harami": (11, _when("b1 > bl1 and b0 <= bs0", _INSIDE)),
    "harami_cross": (11, _when("b1 > bl1 and b0 <= bd0", _INSIDE)),
    "doji_star": (11, _when(f"b1 > bl1 and {_DOJI} and (s1 = 1 and {_GAP_UP(0, 1)} or s1 = -1 and {_GAP_DOWN(0, 1)})", "-100 * s1")),
    "piercing": (11, _when("s1 = -1 and b1 > bl1 and s0 = 1 and b0 > bl0 and o0 < l1 and c0 < o1 and c0 > c1 + b1 * 0.5e0")),
    "dark_cloud_cover": (11, _when("s1 = 1 and b1 > bl1 and s0 = -1 and o0 > h1 and c0 > o1 and c0 < c1 - b1 * 0.5e0", "-100")),
    "counterattack": (11, _when("s1 = -s0 and b1 > bl1 and b0 > bl0 and c0 <= c1 + eq1 and c0 >= c1 - eq1", "100 * s0")),
    "separating_lines": (11, _when("s1 = -s0 and o0 <= o1 + eq1 and o0 >= o1 - eq1 and b0 > bl0 and (s0 = 1 and w0 < sv0 or s0 = -1 and u0 < sv0)", "100 * s0")),
    "kicking": (11, _when(_KICK, "100 * s0")),
    "kicking_by_length": (11, _when(_KICK, "100 * case when b0 > b1 then s0 else s1 end")),
    "homing_pigeon": (11, _when("s1 = -1 and s0 = -1 and b1 > bl1 and b0 <= bs0 and o0 < o1 and c0 > c1")),
    "matching_low": (6, _when("s1 = -1 and s0 = -1 and c0 <= c1 + eq1 and c0 >= c1 - eq1")),
    "in_neck": (11, _when(f"{_SHORT_AFTER} and c0 <= c1 + eq1 and c0 >= c1", "-100")),
    "on_neck": (11, _when(f"{_SHORT_AFTER} and c0 <= l1 + eq1 and c0 >= l1 - eq1", "-100")),
    "thrusting": (11, _when(f"{_SHORT_AFTER} and c0 > c1 + eq1 and c0 <= c1 + b1 * 0.5e0", "-100")),
    # three rows
    "two_crows": (12, _when(f"s2 = 1 and b2 > bl2 and s1 = -1 and {_GAP_UP(1, 2)} and s0 = -1 and o0 < o1 and o0 > c1 and c0 > o2 and c0 < c2", "-100")),
    "three_black_crows": (13, _when("s3 = 1 and s2 = -1 and s1 = -1 and s0 = -1 and o1 < o2 and o1 > c2 and o0 < o1 and o0 > c1 and h3 > c2 and c2 > c1 and c1 > c0 and w2 < sv2 and w1 < sv1 and w0 < sv0", "-100")),
    "three_inside": (12, _when("t1 < t2 and m1 > m2 and b2 > bl2 and b1 <= bs1 and s0 = -s2 and (s2 = 1 and c0 < o2 or s2 = -1 and c0 > o2)", "-100 * s2")),
    "three_outside": (3, _when("s2 = -s1 and t1 > t2 and m1 < m2 and (s1 = 1 and c0 > c1 or s1 = -1 and c0 < c1)", "100 * s1")),
    "three_stars_in_the_south": (12, _when("s2 = -1 and s1 = -1 and s0 = -1 and b2 > bl2 and w2 > b2 and b1 < b2 and o1 > c2 and o1 <= h2 and l1 < c2 and l1 >= l2 and w1 > sv1 and b0 < bs0 and w0 < sv0 and u0 < sv0 and l0 > l1 and h0 < h1")),
    "three_white_soldiers": (12, _when(_rising("u2 < sv2 and u1 < sv1 and u0 < sv0 and b1 > b2 - fr2 and b0 > b1 - fr1 and b0 > bs0"))),
    "abandoned_baby": (12, _when("b2 > bl2 and b1 <= bd1 and b0 > bs0 and s2 = -s0 and (s2 = 1 and c0 < c2 - b2 * 0.3e0 and l1 > h2 and h0 < l1 or s2 = -1 and c0 > c2 + b2 * 0.3e0 and h1 < l2 and l0 > h1)", "100 * s0")),
    "advance_block": (12, _when(_rising("b2 > bl2 and u2 < ss2 and (b1 < b2 - fr2 and b0 < b1 + nr1 or b0 < b1 - fr1 or b0 < b1 and b1 < b2 and (u0 > ss0 or u1 > ss1) or b0 < b1 and u0 > b0)"), "-100")),
    "evening_doji_star": (12, _when(f"s2 = 1 and b2 > bl2 and b1 <= bd1 and {_GAP_UP(1, 2)} and b0 > bs0 and s0 = -1 and c0 < c2 - b2 * 0.3e0", "-100")),
    "evening_star": (12, _when(f"s2 = 1 and b2 > bl2 and b1 <= bs1 and {_GAP_UP(1, 2)} and b0 > bs0 and s0 = -1 and c0 < c2 - b2 * 0.3e0", "-100")),
    "identical_three_crows": (12, _when("s2 = -1 and s1 = -1 and s0 = -1 and w2 < sv2 and w1 < sv1 and w0 < sv0 and c2 > c1 and c1 > c0 and o1 <= c2 + eq2 and o1 >= c2 - eq2 and o0 <= c1 + eq1 and o0 >= c1 - eq1", "-100")),
    "morning_doji_star": (12, _when(f"s2 = -1 and b2 > bl2 and b1 <= bd1 and {_GAP_DOWN(1, 2)} and b0 > bs0 and s0 = 1 and c0 > c2 + b2 * 0.3e0")),
    "morning_star": (12, _when(f"s2 = -1 and b2 > bl2 and b1 <= bs1 and {_GAP_DOWN(1, 2)} and b0 > bs0 and s0 = 1 and c0 > c2 + b2 * 0.3e0")),
    "stalled_pattern": (12, _when("s2 = 1 and s1 = 1 and s0 = 1 and c0 > c1 and c1 > c2 and b2 > bl2 and b1 > bl1 and u1 < sv1 and o1 > o2 and o1 <= c2 + nr2 and b0 < bs0 and o0 >= c1 - b0 - nr1", "-100")),
    "tri_star": (12, f"case when b2 <= bd2 and b1 <= bd2 and b0 <= bd2 then case when {_GAP_DOWN(1, 2)} and m0 > m1 then 100 when {_GAP_UP(1, 2)} and t0 < t1 then -100 else 0 end else 0 end"),
    "unique_three_river": (12, _when("s2 = -1 and s1 = -1 and s0 = 1 and b2 > bl2 and b0 < bs0 and c1 > c2 and o1 <= o2 and l1 < l2 and o0 > l1")),
    "upside_gap_two_crows": (12, _when(f"s2 = 1 and b2 > bl2 and s1 = -1 and b1 <= bs1 and {_GAP_UP(1, 2)} and s0 = -1 and o0 > o1 and c0 < c1 and c0 > c2", "-100")),
    # more rows
    "three_line_strike": (8, _when(f"s3 = s2 and s2 = s1 and s0 = -s1 and {_NEAR_IN(2, 3)} and {_NEAR_IN(1, 2)} and (s1 = 1 and c1 > c2 and c2 > c3 and o0 > c1 and c0 < o3 or s1 = -1 and c1 < c2 and c2 < c3 and o0 < c1 and c0 > o3)", "100 * s1")),
    "breakaway": (14, _when(f"b4 > bl4 and s4 = s3 and s3 = s1 and s0 = -s1 and (s4 = -1 and {_GAP_DOWN(3, 4)} and h2 < h3 and l2 < l3 and h1 < h2 and l1 < l2 and c0 > o3 and c0 < c4 or s4 = 1 and {_GAP_UP(3, 4)} and h2 > h3 and l2 > l3 and h1 > h2 and l1 > l2 and c0 < o3 and c0 > c4)", "100 * s0")),
    "concealing_baby_swallow": (13, _when(f"s3 = -1 and s2 = -1 and s1 = -1 and s0 = -1 and w3 < sv3 and u3 < sv3 and w2 < sv2 and u2 < sv2 and {_GAP_DOWN(1, 2)} and u1 > sv1 and h1 > c2 and h0 > h1 and l0 < l1")),
    "gap_side_by_side_white": (7, _when("s1 = 1 and s0 = 1 and b0 >= b1 - nr1 and b0 <= b1 + nr1 and o0 >= o1 - eq1 and o0 <= o1 + eq1", "case when m1 > t2 and m0 > t2 then 100 when t1 < m2 and t0 < m2 then -100 else 0 end")),
    "ladder_bottom": (14, _when("s4 = -1 and s3 = -1 and s2 = -1 and s1 = -1 and s0 = 1 and o4 > o3 and o3 > o2 and c4 > c3 and c3 > c2 and u1 > sv1 and o0 > o1 and c0 > h1")),
    "mat_hold": (14, _when(f"b4 > bl4 and b3 < bs3 and b2 < bs2 and b1 < bs1 and s4 = 1 and s3 = -1 and s0 = 1 and {_GAP_UP(3, 4)} and m2 < c4 and m1 < c4 and m2 > c4 - b4 * 0.5e0 and m1 > c4 - b4 * 0.5e0 and t2 < o3 and t1 < t2 and o0 > c1 and c0 > greatest(h3, h2, h1)")),
    "rise_fall_three_methods": (14, _when("b4 > bl4 and b3 < bs3 and b2 < bs2 and b1 < bs1 and b0 > bl0 and s4 = -s3 and s3 = s2 and s2 = s1 and s1 = -s0 and m3 < h4 and t3 > l4 and m2 < h4 and t2 > l4 and m1 < h4 and t1 > l4 and c2 * s4 < c3 * s4 and c1 * s4 < c2 * s4 and o0 * s4 > c1 * s4 and c0 * s4 > c4 * s4", "100 * s4")),
    "stick_sandwich": (7, _when("s2 = -1 and s1 = 1 and s0 = -1 and l1 > c2 and c0 <= c2 + eq2 and c0 >= c2 - eq2")),
    "tasuki_gap": (7, _when(f"s0 = -s1 and abs(b1 - b0) < nr1 and o0 < t1 and o0 > m1 and (s1 = 1 and {_GAP_UP(1, 2)} and c0 < o1 and c0 > t2 or s1 = -1 and {_GAP_DOWN(1, 2)} and c0 > o1 and c0 < m2)", "100 * s1")),
    "gap_three_methods": (2, _when(f"s2 = s1 and s1 = -s0 and o0 < t1 and o0 > m1 and c0 < t2 and c0 > m2 and (s2 = 1 and {_GAP_UP(1, 2)} or s2 = -1 and {_GAP_DOWN(1, 2)})", "100 * s2")),
}
#: Patterns with a state: name -> (rows before the first result, first row that can match, match as signed number).
_HIKKAKE = {
    "hikkake": (5, 2, _when("h1 < h2 and l1 > l2 and (h0 < h1 and l0 < l1 or h0 > h1 and l0 > l1)", "case when h0 < h1 then 100 else -100 end")),
    "hikkake_modified": (10, 7, _when("h2 < h3 and l2 > l3 and h1 < h2 and l1 > l2 and (h0 < h1 and l0 < l1 and c2 <= l2 + nr2 or h0 > h1 and l0 > l1 and c2 >= h2 - nr2)", "case when h0 < h1 then 100 else -100 end")),
}
NAMES = (*CONDITIONS, *_HIKKAKE)


def pattern(name: str, before: int, value: str) -> Plan:
    """Adds a pattern of one's own: rows before its first result, and its value as SQL over the names that the built-in ones use."""
    if name in NAMES:
        raise ValueError(f"there is a pattern {name}")
    CONDITIONS[name] = (before, value)
    return plan((name,))



def _values(conditions: list[str]) -> list[dict[str, str]]:
    """Layers that make the values which the conditions name."""
    used = sorted({(k, int(n)) for c in conditions for k, n in re.findall(r"\b([a-z]{1,2})([0-4])\b", c)})
    averaged = sorted({k for k, _ in used if k in AVERAGES})
    layers = [{"b": "abs(c - o)", "t": "greatest(o, c)", "m": "least(o, c)", "u": "h - greatest(o, c)", "w": "least(o, c) - l", "s": "case when c >= o then 1 else -1 end"}]
    if averaged:
        before = "sum({0}) over (partition by sym order by ts rows between {1} preceding and 1 preceding)"
        layers.append({k: f"case when rn > {n} then {num(f)} * {before.format(x, n)} / {n} end" for k, (x, n, f) in AVERAGES.items() if k in averaged})
    layers.append({f"{k}{n}": lag(k, n) for k, n in used})
    return layers


def _confirmed(name: str, first: int) -> Machine:
    """A match at a row, then its confirmation: a close beyond the row before the match within three rows, once.

    States: the value, the last match's sign and row, and the high and low of the row before it.
    """

    def kernel(hit, h, l, c):  # noqa: E741
        out, at, sign, top, bottom = np.full((5, len(c)), np.nan), -9, 0, 0.0, 0.0
        for i in range(first, len(c)):
            value = 0
            if hit[i]:
                value, sign, at, top, bottom = hit[i], np.sign(hit[i]), i + 1, h[i - 1], l[i - 1]
            elif sign and i + 1 <= at + 3 and (c[i] > top if sign > 0 else c[i] < bottom):
                value, at = 200 * sign, -9
            out[:, i] = value, sign, at, top, bottom
        return list(out)

    v, g, a, p, q = (f"{x}_{name}" for x in ("value", "sign", "row", "top", "bottom"))
    hit = f"coalesce(s.hit_{name}, 0)"
    confirmed = f"(r.{g} <> 0 and s.rn <= r.{a} + 3 and case when r.{g} > 0 then s.c > r.{p} else s.c < r.{q} end)"
    step = [
        f"case when {hit} <> 0 then {hit} when {confirmed} then 200 * r.{g} else 0 end",
        f"case when {hit} <> 0 then sign({hit}) else r.{g} end",
        f"case when {hit} <> 0 then s.rn when {confirmed} then -9 else r.{a} end",
        f"case when {hit} <> 0 then s.h1 else r.{p} end",
        f"case when {hit} <> 0 then s.l1 else r.{q} end",
    ]
    start = [hit, f"sign({hit})", f"case when {hit} <> 0 then s.rn else -9 end", f"case when {hit} <> 0 then s.h1 else 0 end", f"case when {hit} <> 0 then s.l1 else 0 end"]
    return Machine([v, g, a, p, q], [f"hit_{name}", "h", "l", "c"], f"s.rn = {first + 1}", start, step, kernel, also=("h1", "l1"))


def plan(names: tuple[str, ...] = NAMES) -> Plan:
    """One plan for any patterns: one shuffle, one sort."""
    stateless = [n for n in names if n in CONDITIONS]
    stateful = [n for n in names if n in _HIKKAKE]
    p = Plan([f"pat_{n}" for n in names])
    for layer in _values([CONDITIONS[n][1] for n in stateless] + [_HIKKAKE[n][2] for n in stateful]):
        p.add(**layer)
    p.add(**{f"pat_{n}": f"case when rn > {CONDITIONS[n][0]} then {CONDITIONS[n][1]} end" for n in stateless}, **{f"hit_{n}": f"cast({_HIKKAKE[n][2]} as double)" for n in stateful})
    if stateful:
        p.scan(*(_confirmed(n, _HIKKAKE[n][1]) for n in stateful))
        p.add(**{f"pat_{n}": f"case when rn > {_HIKKAKE[n][0]} then value_{n} end" for n in stateful})
    return p


def described(value: Column) -> Column:
    """match, direction, strength and confirm of a pattern's integer; null in warm-up."""
    size, lit = F.abs(value), lambda x: F.lit(float(x))
    return F.when(
        value.isNotNull(),
        F.struct(
            F.when(size.isin(80, 100), lit(1)).otherwise(lit(0)).alias("match"),
            F.signum(value).cast("double").alias("direction"),
            F.when(size == 100, lit(1)).when(size == 80, lit(0.5)).otherwise(lit(0)).alias("strength"),
            F.when(size == 200, lit(1)).otherwise(lit(0)).alias("confirm"),
        ),
    )
