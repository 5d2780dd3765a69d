"""Technical indicators as layered plans: name -> function of parameters -> Plan.

Columns of a series: sym, ts, o, h, l, c, v; warm-up is NULL. Each zero denominator has its own named
substitute. State machines that are no recurrences are in kernels.py.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log10, sqrt

import numpy as np

from ..functions.fragments import HL2, TP, frame, held, highest, lag, linreg, lowest, num, ratio, rolling_sum, running, sma, stdev, true_range, weighted, wma
from ..plans.layers import Affine, Difference, Machine, Plan, ema, rma
from . import cycle

REGISTRY: dict[str, Callable[..., Plan]] = {}


def indicator(f: Callable[..., Plan]) -> Callable[..., Plan]:
    REGISTRY[f.__name__] = f
    return f


def one(expression: str, **before: str) -> Plan:
    """A plan of one or two window layers with the output `value`."""
    p = Plan(["value"])
    return (p.add(**before) if before else p).add(value=expression)


# ---- trend


@indicator
def ema_(n: int = 21) -> Plan:
    return Plan(["value"]).scan(ema("value", "c", n))


@indicator
def dema(n: int = 21) -> Plan:
    return Plan(["value"]).scan(ema("e1", "c", n), ema("e2", "e1", n)).add(value="2 * e1 - e2")


@indicator
def tema(n: int = 21) -> Plan:
    return Plan(["value"]).scan(ema("e1", "c", n), ema("e2", "e1", n), ema("e3", "e2", n)).add(value="3 * e1 - 3 * e2 + e3")


@indicator
def kama(n: int = 10, fast: int = 2, slow: int = 30) -> Plan:
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    p = Plan(["value"]).add(d=f"abs(c - {lag('c')})", before=lag("c"), change=f"abs(c - {lag('c', n)})")
    p.add(er=ratio("change", frame("sum", "d", n), 0))
    p.add(k=f"power(er * {num(f - s)} + {num(s)}, 2)")
    p.add(a="1 - k", b="k * c", start=f"case when rn = {n + 1} then before + k * (c - before) end")
    return p.scan(Affine("value", "a", "b", "start"))


@indicator
def t3(n: int = 21, factor: float = 0.7) -> Plan:
    v = factor
    names = [f"e{i}" for i in range(1, 7)]
    p = Plan(["value"]).scan(*(ema(x, y, n) for x, y in zip(names, ["c", *names])))
    c1, c2, c3, c4 = -(v**3), 3 * v * v + 3 * v**3, -6 * v * v - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v * v
    return p.add(value=f"{num(c1)} * e6 + {num(c2)} * e5 + {num(c3)} * e4 + {num(c4)} * e3")


@indicator
def hma(n: int = 9) -> Plan:
    return Plan(["value"]).add(x=f"2 * {wma('c', n // 2)} - {wma('c', n)}").add(value=wma("x", round(sqrt(n))))


@indicator
def zlema(n: int = 21) -> Plan:
    return Plan(["value"]).add(x=f"c + (c - {lag('c', (n - 1) // 2)})").scan(ema("value", "x", n))


@indicator
def alma(n: int = 9, offset: float = 0.85, sigma: float = 6.0) -> Plan:
    m, s = offset * (n - 1), n / sigma
    w = [exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)]
    return one(weighted("c", [x / sum(w) for x in reversed(w)]))


def _cmo(n: int) -> str:
    up, down = rolling_sum("up", n), rolling_sum("dn", n)
    return f"100 * {ratio(f'({up}) - ({down})', f'({up}) + ({down})', 0)}"


def _moves(p: Plan, x: str = "c") -> Plan:
    return p.add(d=f"{x} - {lag(x)}").add(up="case when d is not null then greatest(d, 0) end", dn="case when d is not null then greatest(-d, 0) end")


@indicator
def vidya(n: int = 21, m: int = 9) -> Plan:
    first = max(n, m + 1)
    p = _moves(Plan(["value"])).add(k=f"{num(2 / (n + 1))} * abs({_cmo(m)}) / 100", mean=sma("c", n))
    p.add(a="1 - k", b="k * c", start=f"case when rn = {first} then mean end")
    return p.scan(Affine("value", "a", "b", "start"))


@indicator
def guppy_gmma() -> Plan:
    spans = (3, 5, 8, 10, 12, 15, 30, 35, 40, 45, 50, 60)
    return Plan([f"ema_{n}" for n in spans]).scan(*(ema(f"ema_{n}", "c", n) for n in spans))


@indicator
def trima(n: int = 21) -> Plan:
    a, b = ((n + 1) // 2, (n + 1) // 2) if n % 2 else (n // 2, n // 2 + 1)
    return one(sma("x", b), x=sma("c", a))


@indicator
def mcginley_dynamic(n: int = 21) -> Plan:
    p = Plan(["value"]).add(mean=sma("c", n)).add(start=f"case when rn = {n} then mean end")

    def kernel(c, start):
        out, v = np.full(len(c), np.nan), None
        for i in range(len(c)):
            if v is None:
                v = None if np.isnan(start[i]) else start[i]
            else:
                den = n * (c[i] / v) ** 4 if v else 0.0
                v = v + (c[i] - v) / den if den else v
            out[i] = np.nan if v is None else v
        return [out]

    den = f"{n} * power(s.c / nullif(r.value, 0), 4)"
    return p.scan(Machine(["value"], ["c", "start"], "s.start is not null and s.rn = %d" % n, ["s.start"], [f"case when coalesce({den}, 0) = 0 then r.value else r.value + (s.c - r.value) / ({den}) end"], kernel))


# ---- momentum


@indicator
def fisher_transform(n: int = 9) -> Plan:
    p = Plan(["fisher", "signal"]).add(m=HL2).add(hi=highest("m", n), lo=lowest("m", n)).add(raw=f"2 * {ratio('m - lo', 'hi - lo', 0.5)} - 1")

    def kernel(raw):
        x, f, xs, fs = 0.0, 0.0, np.full(len(raw), np.nan), np.full(len(raw), np.nan)
        for i in np.flatnonzero(~np.isnan(raw)):
            x = max(-0.999, min(0.999, 0.33 * raw[i] + 0.67 * x))
            f = 0.5 * np.log((1 + x) / (1 - x)) + 0.5 * f
            xs[i], fs[i] = x, f
        return [xs, fs]

    clamp = lambda e: f"greatest(-0.999e0, least(0.999e0, {e}))"
    curve = lambda x, f: f"0.5e0 * ln((1 + {x}) / (1 - {x})) + 0.5e0 * {f}"
    x0, x1 = clamp("0.33e0 * s.raw"), clamp("0.33e0 * s.raw + 0.67e0 * r.x")
    p.scan(Machine(["x", "fisher"], ["raw"], f"s.rn = {n}", [x0, curve(x0, "0e0")], [x1, curve(x1, "r.fisher")], kernel))
    return p.add(signal=lag("fisher"))


@indicator
def laguerre_rsi(gamma: float = 0.5) -> Plan:
    g = gamma
    names = ["z0", "z1", "z2", "z3"]

    def kernel(c):
        z, out = None, np.full((4, len(c)), np.nan)
        for i, price in enumerate(c):
            if z is None:
                z = [price] * 4
            else:
                new = [(1 - g) * price + g * z[0]]
                for k in range(3):
                    new.append(-g * new[k] + z[k] + g * z[k + 1])
                z = new
            out[:, i] = z
        return list(out)

    new = [f"{num(1 - g)} * s.c + {num(g)} * r.z0"]
    for k in range(3):
        new.append(f"-{num(g)} * ({new[k]}) + r.z{k} + {num(g)} * r.z{k + 1}")
    p = Plan(["value"]).scan(Machine(names, ["c"], "s.rn = 1", ["s.c"] * 4, new, kernel))
    p.add(cu=" + ".join(f"greatest(z{k} - z{k + 1}, 0)" for k in range(3)), cd=" + ".join(f"greatest(z{k + 1} - z{k}, 0)" for k in range(3)))
    return p.add(value=f"case when rn > 1 then {ratio('cu', 'cu + cd', 0)} end")


def _rsi(g: str, d: str) -> str:
    return f"case when {d} = 0 then 100e0 when {g} = 0 then 0e0 else 100 - 100 / (1 + {g} / {d}) end"


@indicator
def rsi(n: int = 14) -> Plan:
    return _moves(Plan(["value"])).scan(rma("g", "up", n), rma("f", "dn", n)).add(value=_rsi("g", "f"))


def _fast_k(p: Plan, n: int) -> Plan:
    p.add(hi=highest("h", n), lo=lowest("l", n))
    p.add(raw="case when hi <> lo then 100 * (c - lo) / (hi - lo) end")
    return p.add(k=f"case when hi is not null then {held('raw', 50)} end")


@indicator
def stochastic(n: int = 14, m: int = 3) -> Plan:
    return _fast_k(Plan(["k", "d"]), n).add(d=sma("k", m))


@indicator
def stochastic_slow(n: int = 14, m: int = 3) -> Plan:
    return _fast_k(Plan(["slow_k", "slow_d"]), n).add(slow_k=sma("k", m)).add(slow_d=sma("slow_k", m))


@indicator
def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Plan:
    p = Plan(["macd", "signal", "histogram"]).scan(ema("f", "c", fast), ema("s", "c", slow), Difference("macd", "f", "s"), ema("signal", "macd", signal))
    return p.add(histogram="macd - signal")


@indicator
def tsi(long: int = 25, short: int = 13) -> Plan:
    p = Plan(["value"]).add(d=f"c - {lag('c')}", m=f"abs(c - {lag('c')})")
    p.scan(ema("d1", "d", long), ema("d2", "d1", short), ema("m1", "m", long), ema("m2", "m1", short))
    return p.add(value=f"100 * {ratio('d2', 'm2', 0)}")


def _cci(n: int, mean: str) -> str:
    spread = " + ".join(f"abs({lag('tp', i)} - {mean})" for i in range(n))
    return ratio(f"tp - {mean}", f"0.015e0 * ({spread}) / {n}", 0)


@indicator
def cci(n: int = 20) -> Plan:
    return Plan(["value"]).add(tp=TP).add(m=sma("tp", n)).add(value=_cci(n, "m"))


@indicator
def awesome_oscillator(fast: int = 5, slow: int = 34) -> Plan:
    return one(f"({sma(HL2, fast)}) - ({sma(HL2, slow)})")


@indicator
def ppo(fast: int = 12, slow: int = 26, signal: int = 9) -> Plan:
    p = Plan(["ppo", "signal", "histogram"]).scan(ema("f", "c", fast), ema("s", "c", slow)).add(ppo=f"100 * {ratio('f - s', 's', 0)}")
    return p.scan(ema("signal", "ppo", signal)).add(histogram="ppo - signal")


@indicator
def smi(n: int = 13, long: int = 25, short: int = 13, signal: int = 3) -> Plan:
    p = Plan(["smi", "signal"]).add(hi=highest("h", n), lo=lowest("l", n)).add(x="c - (hi + lo) / 2", r="(hi - lo) / 2")
    p.scan(ema("x1", "x", long), ema("x2", "x1", short), ema("r1", "r", long), ema("r2", "r1", short))
    return p.add(smi=f"100 * {ratio('x2', 'r2', 0)}").scan(ema("signal", "smi", signal))


@indicator
def accelerator_oscillator(fast: int = 5, slow: int = 34, smooth: int = 5) -> Plan:
    return Plan(["value"]).add(ao=f"({sma(HL2, fast)}) - ({sma(HL2, slow)})").add(value=f"ao - ({sma('ao', smooth)})")


@indicator
def stochastic_rsi(n: int = 14, m: int = 14, k: int = 3, d: int = 3) -> Plan:
    p = _moves(Plan(["k", "d2"])).scan(rma("g", "up", n), rma("f", "dn", n)).add(r=_rsi("g", "f"))
    p.add(hi=highest("r", m), lo=lowest("r", m)).add(x=f"100 * {ratio('r - lo', 'hi - lo', 0.5)}").add(k=sma("x", k))
    return p.add(d2=sma("k", d))


@indicator
def trix(n: int = 15) -> Plan:
    p = Plan(["value"]).scan(ema("e1", "c", n), ema("e2", "e1", n), ema("e3", "e2", n))
    return p.add(was=lag("e3")).add(value=f"100 * {ratio('e3 - was', 'was', 0)}")


@indicator
def cmo(n: int = 14) -> Plan:
    return _moves(Plan(["value"])).add(value=_cmo(n))


@indicator
def williams_pr(n: int = 14) -> Plan:
    return Plan(["value"]).add(hi=highest("h", n), lo=lowest("l", n)).add(value=f"-100 * {ratio('hi - c', 'hi - lo', 0.5)}")


@indicator
def ultimate_oscillator(a: int = 7, b: int = 14, d: int = 28) -> Plan:
    p = Plan(["value"]).add(was=lag("c")).add(low=f"case when was is not null then least(l, was) end", top="case when was is not null then greatest(h, was) end")
    p.add(bp="c - low", tr="top - low")
    r = lambda n: ratio(rolling_sum("bp", n), rolling_sum("tr", n), 0.5)
    return p.add(value=f"100 * (4 * {r(a)} + 2 * {r(b)} + {r(d)}) / 7")


@indicator
def kst() -> Plan:
    p = Plan(["kst", "signal"])
    for i, n in enumerate((10, 15, 20, 30), 1):
        p.add(**{f"r{i}": f"100 * {ratio(f'c - {lag(chr(99), n)}', lag('c', n), 'null')}"})
    p.add(kst=" + ".join(f"{i} * ({sma(f'r{i}', m)})" for i, m in ((1, 10), (2, 10), (3, 10), (4, 15))))
    return p.add(signal=sma("kst", 9))


@indicator
def coppock_curve(long: int = 14, short: int = 11, smooth: int = 10) -> Plan:
    r = lambda n: f"100 * {ratio(f'c - {lag(chr(99), n)}', lag('c', n), 'null')}"
    return one(wma("x", smooth), x=f"{r(long)} + {r(short)}")


@indicator
def connors_rsi(n: int = 3, m: int = 2, k: int = 100) -> Plan:
    p = Plan(["value"]).add(s=f"coalesce(sign(c - {lag('c')}), 0)")
    p.add(new=f"case when s <> coalesce({lag('s')}, 0) or s = 0 then 1 else 0 end")
    p.add(streak=f"s * (rn + 1 - {running('max', 'case when new = 1 then rn end')})")
    p.add(d=f"c - {lag('c')}", e=f"streak - {lag('streak')}", roc=f"100 * {ratio(f'c - {lag(chr(99))}', lag('c'), 'null')}")
    pos = lambda x: f"case when {x} is not null then greatest({x}, 0) end"
    p.add(u1=pos("d"), w1=pos("-d"), u2=pos("e"), w2=pos("-e"))
    below = " + ".join(f"case when {lag('roc', i)} < roc then 1 when {lag('roc', i)} is not null and roc is not null then 0 end" for i in range(1, k + 1))
    p.add(rank=f"100e0 * ({below}) / {k}")
    p.scan(rma("g1", "u1", n), rma("f1", "w1", n), rma("g2", "u2", m), rma("f2", "w2", m))
    return p.add(value=f"(({_rsi('g1', 'f1')}) + ({_rsi('g2', 'f2')}) + rank) / 3")


@indicator
def qstick(n: int = 8) -> Plan:
    return one(sma("x", n), x="c - o")


@indicator
def chande_forecast_oscillator(n: int = 14) -> Plan:
    return one(f"100 * {ratio('c - x', 'c', 0)}", x=linreg("c", n))


@indicator
def demarker(n: int = 14) -> Plan:
    p = Plan(["value"]).add(up=f"greatest(h - {lag('h')}, 0)", dn=f"greatest({lag('l')} - l, 0)")
    p.add(ups=f"case when rn > {n} then {frame('avg', 'case when rn > 1 then up end', n)} end", dns=f"case when rn > {n} then {frame('avg', 'case when rn > 1 then dn end', n)} end")
    p.add(raw="case when ups + dns <> 0 then ups / (ups + dns) end")
    return p.add(value=f"case when ups is not null then {held('raw', 0.5)} end")


@indicator
def dpo(n: int = 20) -> Plan:
    return one(f"{lag('c', n // 2 + 1)} - ({sma('c', n)})")


def _schaff(p: Plan, x: str, n: int, tag: str) -> None:
    p.add(**{f"hi{tag}": highest(x, n), f"lo{tag}": lowest(x, n)})
    p.add(**{f"raw{tag}": f"case when hi{tag} <> lo{tag} then 100 * ({x} - lo{tag}) / (hi{tag} - lo{tag}) end"})
    p.add(**{f"k{tag}": f"case when hi{tag} is not null then {held(f'raw{tag}', 50)} end"})
    p.add(**{f"nth{tag}": running("count", f"k{tag}")})
    p.add(**{f"a{tag}": "0.5e0", f"b{tag}": f"0.5e0 * k{tag}", f"s{tag}": f"case when nth{tag} = 1 then k{tag} end"})
    p.scan(Affine(f"out{tag}", f"a{tag}", f"b{tag}", f"s{tag}"))


@indicator
def schaff_trend_cycle(fast: int = 23, slow: int = 50, n: int = 10) -> Plan:
    p = Plan(["out2"]).scan(ema("f", "c", fast), ema("s", "c", slow)).add(m="f - s")
    _schaff(p, "m", n, "1")
    _schaff(p, "out1", n, "2")
    return p


@indicator
def relative_vigor_index(n: int = 10) -> Plan:
    w = [1 / 6, 2 / 6, 2 / 6, 1 / 6]
    p = Plan(["rvi", "signal"]).add(x=weighted("(c - o)", w), y=weighted("(h - l)", w))
    p.add(rvi=ratio(sma("x", n), sma("y", n), 0))
    return p.add(signal=weighted("rvi", w))


@indicator
def pretty_good_oscillator(n: int = 89) -> Plan:
    return Plan(["value"]).add(tr=true_range(), m=sma("c", n)).scan(rma("atr", "tr", n)).add(value=ratio("c - m", "atr", 0))


@indicator
def center_of_gravity(n: int = 10) -> Plan:
    x, y = weighted("c", [i + 1 for i in range(n)]), weighted("c", [1] * n)
    return one(f"case when y = 0 then 0e0 else -x / y + {num((n + 1) / 2)} end", x=x, y=y)


@indicator
def apo(fast: int = 12, slow: int = 26, average: str = "sma") -> Plan:
    if average == "sma":
        return one(f"({sma('c', fast)}) - ({sma('c', slow)})")
    kind = {"ema": ema, "rma": rma}[average]
    return Plan(["value"]).scan(kind("f", "c", fast), kind("s", "c", slow)).add(value="f - s")


@indicator
def bop(n: int = 14) -> Plan:
    return one(sma("x", n), x=ratio("c - o", "h - l", 0))


@indicator
def imi(n: int = 14) -> Plan:
    p = Plan(["value"]).add(up="greatest(c - o, 0)", dn="greatest(o - c, 0)").add(u=rolling_sum("up", n), w=rolling_sum("dn", n))
    return p.add(value=f"100 * {ratio('u', 'u + w', 0.5)}")


# ---- volatility


@indicator
def atr(n: int = 14) -> Plan:
    return Plan(["value"]).add(tr=true_range()).scan(rma("value", "tr", n))


@indicator
def bollinger_bands(n: int = 20, k: float = 2.0) -> Plan:
    p = Plan(["middle", "upper", "lower", "percent_b", "bandwidth"]).add(middle=sma("c", n), sd=stdev("c", n))
    p.add(upper=f"middle + {num(k)} * sd", lower=f"middle - {num(k)} * sd")
    return p.add(percent_b="case when upper <> lower then (c - lower) / (upper - lower) end", bandwidth=ratio("upper - lower", "middle", 0))


@indicator
def keltner_channel(n: int = 20, m: int = 10, k: float = 2.0) -> Plan:
    p = Plan(["middle", "upper", "lower"]).add(tr=true_range()).scan(ema("middle", "c", n), rma("a", "tr", m))
    return p.add(upper=f"middle + {num(k)} * a", lower=f"middle - {num(k)} * a")


@indicator
def donchian_channel(n: int = 20) -> Plan:
    return Plan(["upper", "lower", "middle"]).add(upper=highest("h", n), lower=lowest("l", n)).add(middle="(upper + lower) / 2")


@indicator
def supertrend(n: int = 10, k: float = 3.0) -> Plan:
    p = Plan(["supertrend", "direction", "upper", "lower"]).add(tr=true_range(), was=lag("c")).scan(rma("a", "tr", n))
    p.add(bu=f"{HL2} + {num(k)} * a", bl=f"{HL2} - {num(k)} * a")

    def kernel(c, was, bu, bl):
        up, lo, d = np.full(len(c), np.nan), np.full(len(c), np.nan), np.full(len(c), np.nan)
        for i in np.flatnonzero(~np.isnan(bu)):
            started = i > 0 and not np.isnan(d[i - 1])
            up[i] = bu[i] if not started or bu[i] < up[i - 1] or was[i] > up[i - 1] else up[i - 1]
            lo[i] = bl[i] if not started or bl[i] > lo[i - 1] or was[i] < lo[i - 1] else lo[i - 1]
            rising = started and d[i - 1] == 1
            d[i] = (-1 if c[i] < lo[i] else 1) if rising else (1 if c[i] > up[i] else -1)
        return [up, lo, d]

    u = "(case when s.bu < r.upper or s.was > r.upper then s.bu else r.upper end)"
    w = "(case when s.bl > r.lower or s.was < r.lower then s.bl else r.lower end)"
    turn = f"case when r.direction = 1 then case when s.c < {w} then -1e0 else 1e0 end else case when s.c > {u} then 1e0 else -1e0 end end"
    p.scan(Machine(["upper", "lower", "direction"], ["c", "was", "bu", "bl"], f"s.rn = {n}", ["s.bu", "s.bl", "case when s.c > s.bu then 1e0 else -1e0 end"], [u, w, turn], kernel))
    return p.add(supertrend="case when direction = 1 then lower else upper end")


@indicator
def chandelier_exit(n: int = 22, k: float = 3.0) -> Plan:
    p = Plan(["long_exit", "short_exit"]).add(tr=true_range(), hi=highest("h", n), lo=lowest("l", n)).scan(rma("a", "tr", n))
    return p.add(long_exit=f"hi - {num(k)} * a", short_exit=f"lo + {num(k)} * a")


@indicator
def ulcer_index(n: int = 14) -> Plan:
    p = Plan(["value"]).add(hi=highest("c", n)).add(d=f"power({ratio('100 * (c - hi)', 'hi', 0)}, 2)")
    return p.add(m=sma("d", n)).add(value="sqrt(m)")


@indicator
def relative_volatility_index(n: int = 14, m: int = 10) -> Plan:
    p = Plan(["value"]).add(sd=stdev("c", m), was=lag("c"))
    p.add(up="case when sd is not null and was is not null then case when c > was then sd else 0 end end", dn="case when sd is not null and was is not null then case when c < was then sd else 0 end end")
    return p.scan(rma("u", "up", n), rma("w", "dn", n)).add(value=f"100 * {ratio('u', 'u + w', 0.5)}")


@indicator
def chaikin_volatility(n: int = 10) -> Plan:
    p = Plan(["value"]).add(r="h - l").scan(ema("e", "r", n)).add(was=lag("e", n))
    return p.add(value=f"100 * {ratio('e - was', 'was', 0)}")


@indicator
def mass_index(n: int = 9, m: int = 25) -> Plan:
    p = Plan(["value"]).add(r="h - l").scan(ema("e1", "r", n), ema("e2", "e1", n)).add(x=ratio("e1", "e2", 1))
    return p.add(value=rolling_sum("x", m))


@indicator
def natr(n: int = 14) -> Plan:
    return Plan(["value"]).add(tr=true_range()).scan(rma("a", "tr", n)).add(value=f"100 * {ratio('a', 'c', 0)}")


@indicator
def acceleration_bands(n: int = 20) -> Plan:
    p = Plan(["upper", "middle", "lower"]).add(r=ratio("h - l", "h + l", 0)).add(x="h * (1 + 4 * r)", y="l * (1 - 4 * r)")
    return p.add(upper=sma("x", n), middle=sma("c", n), lower=sma("y", n))


# ---- volume

_MULTIPLIER = ratio("(c - l) - (h - c)", "h - l", 0)


@indicator
def a_d_line() -> Plan:
    return one(running("sum", "x"), x=f"{_MULTIPLIER} * v")


@indicator
def chaikin_oscillator(fast: int = 3, slow: int = 10) -> Plan:
    p = Plan(["value"]).add(x=f"{_MULTIPLIER} * v").add(ad=running("sum", "x")).scan(ema("f", "ad", fast), ema("s", "ad", slow))
    return p.add(value="f - s")


@indicator
def cmf(n: int = 20) -> Plan:
    return one(ratio(rolling_sum("x", n), rolling_sum("v", n), 0), x=f"{_MULTIPLIER} * v")


@indicator
def obv() -> Plan:
    return one(running("sum", "x"), x=f"coalesce(sign(c - {lag('c')}), 0) * v")


@indicator
def force_index(n: int = 13) -> Plan:
    return Plan(["value"]).add(x=f"(c - {lag('c')}) * v").scan(ema("value", "x", n))


@indicator
def money_flow_index(n: int = 14) -> Plan:
    p = Plan(["value"]).add(tp=TP).add(was=lag("tp"))
    p.add(up="case when was is not null then case when tp > was then tp * v else 0 end end", dn="case when was is not null then case when tp < was then tp * v else 0 end end")
    return p.add(u=rolling_sum("up", n), w=rolling_sum("dn", n)).add(value=_rsi("u", "w"))


@indicator
def ease_of_movement(n: int = 14, scale: float = 1e8) -> Plan:
    p = Plan(["value"], wide=True).add(m=HL2).add(x=ratio(f"(m - {lag('m')}) * (h - l) * {num(scale)}", "v", 0))
    return p.add(value=sma("x", n))


@indicator
def klinger_volume_oscillator(a: int = 34, b: int = 55, signal: int = 13) -> Plan:
    p = Plan(["kvo", "signal"]).add(s="h + l + c", span="h - l").add(was=lag("s"), span0=lag("span"))
    p.add(trend="case when was is not null then case when s > was then 1 else -1 end end")
    p.add(new=f"case when trend is not null and trend is distinct from {lag('trend')} then 1 else 0 end").add(island=running("sum", "new"))
    p.add(cm="sum(span) over (partition by sym, island order by ts rows between unbounded preceding and current row) + first_value(span0) over (partition by sym, island order by ts rows between unbounded preceding and current row)")
    p.add(vf="case when trend is not null then case when cm = 0 then 0e0 else v * abs(2 * (span / cm) - 1) * trend * 100 end end")
    p.scan(ema("f", "vf", a), ema("g", "vf", b)).add(kvo="f - g")
    return p.scan(ema("signal", "kvo", signal))


def _volume_index(sign: str) -> Plan:
    p = Plan(["value"], wide=True).add(was=lag("c"), vol=lag("v"))
    p.add(a=f"case when v {sign} vol then 1 + {ratio('c - was', 'was', 0)} else 1e0 end", b="0e0", start="case when rn = 1 then 1000e0 end")
    return p.scan(Affine("value", "a", "b", "start"))


@indicator
def negative_volume_index() -> Plan:
    return _volume_index("<")


@indicator
def positive_volume_index() -> Plan:
    return _volume_index(">")


@indicator
def volume_sma(n: int = 20) -> Plan:
    return one(sma("v", n))


# ---- strength


@indicator
def dmi(n: int = 14) -> Plan:
    p = Plan(["plus_di", "minus_di", "adx", "adxr"]).add(up=f"h - {lag('h')}", dn=f"{lag('l')} - l", t=true_range())
    p.add(pd="case when up is not null then case when up > dn and up > 0 then up else 0 end end", md="case when up is not null then case when dn > up and dn > 0 then dn else 0 end end", tr="case when rn > 1 then t end")
    p.scan(rma("p1", "pd", n), rma("m1", "md", n), rma("a", "tr", n)).add(plus_di=f"100 * {ratio('p1', 'a', 0)}", minus_di=f"100 * {ratio('m1', 'a', 0)}")
    p.add(dx=f"100 * {ratio('abs(plus_di - minus_di)', 'plus_di + minus_di', 0)}").scan(rma("adx", "dx", n))
    return p.add(adxr=f"(adx + {lag('adx', n)}) / 2")


@indicator
def aroon(n: int = 25) -> Plan:
    p = Plan(["up", "down", "oscillator"]).add(hi=highest("h", n + 1), lo=lowest("l", n + 1))
    ago = lambda x, top: "case " + " ".join(f"when {lag(x, k)} = {top} then {k}" for k in range(n, -1, -1)) + " end"
    p.add(up=f"100e0 * ({n} - {ago('h', 'hi')}) / {n}", down=f"100e0 * ({n} - {ago('l', 'lo')}) / {n}")
    return p.add(oscillator="up - down")


@indicator
def vortex_indicator(n: int = 14) -> Plan:
    p = Plan(["plus_vi", "minus_vi"]).add(x=f"abs(h - {lag('l')})", y=f"abs(l - {lag('h')})", t=true_range()).add(tr="case when rn > 1 then t end")
    return p.add(plus_vi=ratio(rolling_sum("x", n), rolling_sum("tr", n), 0), minus_vi=ratio(rolling_sum("y", n), rolling_sum("tr", n), 0))


@indicator
def choppiness_index(n: int = 14) -> Plan:
    p = Plan(["value"]).add(tr=true_range(), hi=highest("h", n), lo=lowest("l", n)).add(s=rolling_sum("tr", n))
    return p.add(value=f"case when hi = lo or s = 0 then 100e0 else 100 * log10(s / (hi - lo)) / {num(log10(n))} end")


@indicator
def random_walk_index(n: int = 14) -> Plan:
    p = Plan(["high_rwi", "low_rwi"]).add(tr=true_range(), x=f"h - {lag('l', n)}", y=f"{lag('h', n)} - l").scan(rma("a", "tr", n))
    return p.add(high_rwi=ratio("x", f"a * {num(sqrt(n))}", 0), low_rwi=ratio("y", f"a * {num(sqrt(n))}", 0))


# ---- systems


@indicator
def elder_ray(n: int = 13) -> Plan:
    return Plan(["bull", "bear"]).scan(ema("e", "c", n)).add(bull="h - e", bear="l - e")


@indicator
def parabolic_sar(step: float = 0.02, maximum: float = 0.2) -> Plan:
    p = Plan(["stop"]).add(c1=lag("c"), l1=lag("l"), l2=lag("l", 2), h1=lag("h"), h2=lag("h", 2))

    def kernel(h, l, c, c1, l1, l2, h1, h2):  # noqa: E741
        n = len(h)
        out = np.full((4, n), np.nan)
        for i in range(1, n):
            if i == 1:
                up = c[1] >= c1[1]
                stop, far, pace = (l1[1], h1[1], step) if up else (h1[1], l1[1], step)
            stop += pace * (far - stop)
            near = [x for x in ((l1[i], l2[i]) if up else (h1[i], h2[i])) if not np.isnan(x)]
            stop = min(stop, *near) if up else max(stop, *near)
            if (l[i] < stop) if up else (h[i] > stop):
                stop, up, pace = far, not up, step
                far = h[i] if up else l[i]
            elif (h[i] > far) if up else (l[i] < far):
                far, pace = (h[i] if up else l[i]), min(pace + step, maximum)
            out[:, i] = stop, far, pace, up
        return list(out)

    def states(stop: str, far: str, pace: str, up: str) -> list[str]:
        s = f"({stop} + {pace} * ({far} - {stop}))"
        s = f"(case when {up} = 1 then least({s}, s.l1, s.l2) else greatest({s}, s.h1, s.h2) end)"
        turn = f"(case when {up} = 1 then s.l < {s} else s.h > {s} end)"
        grows = f"(case when {up} = 1 then s.h > {far} else s.l < {far} end)"
        far2 = f"case when {turn} then case when {up} = 1 then s.l else s.h end when {grows} then case when {up} = 1 then s.h else s.l end else {far} end"
        pace2 = f"case when {turn} then {num(step)} when {grows} then least({pace} + {num(step)}, {num(maximum)}) else {pace} end"
        return [f"case when {turn} then {far} else {s} end", far2, pace2, f"case when {turn} then 1 - {up} else {up} end"]

    rising = "(case when s.c >= s.c1 then 1e0 else 0e0 end)"
    pick = lambda a, b: f"(case when s.c >= s.c1 then s.{a} else s.{b} end)"
    first = states(pick("l1", "h1"), pick("h1", "l1"), num(step), rising)
    return p.scan(Machine(["stop", "far", "pace", "rising"], ["h", "l", "c", "c1", "l1", "l2", "h1", "h2"], "s.rn = 2", first, states("r.stop", "r.far", "r.pace", "r.rising"), kernel))


@indicator
def ichimoku_kinko_hyo(a: int = 9, b: int = 26, d: int = 52, shift: int = 26) -> Plan:
    mid = lambda n: f"(({highest('h', n)}) + ({lowest('l', n)})) / 2"
    p = Plan(["conversion", "base", "span_a", "span_b"]).add(conversion=mid(a), base=mid(b), wide=mid(d)).add(lead_a="(conversion + base) / 2")
    return p.add(span_a=lag("lead_a", shift), span_b=lag("wide", shift))


def _alligator(outputs: list[str]) -> Plan:
    p = Plan(outputs).add(m=HL2).scan(rma("j", "m", 13), rma("t", "m", 8), rma("q", "m", 5))
    return p.add(jaw=lag("j", 8), teeth=lag("t", 5), lips=lag("q", 3))


@indicator
def alligator() -> Plan:
    return _alligator(["jaw", "teeth", "lips"])


@indicator
def gator_oscillator() -> Plan:
    return _alligator(["upper", "lower"]).add(upper="abs(jaw - teeth)", lower="-abs(teeth - lips)")


@indicator
def fractals(n: int = 5) -> Plan:
    m = n // 2
    pivot = lambda x, s: " and ".join(f"{lag(x, m)} {s} {lag(x, i)}" for i in range(n) if i != m)
    flag = lambda x, s: f"case when rn >= {n} then case when {pivot(x, s)} then 1e0 else 0e0 end end"
    return Plan(["up", "down"]).add(up=flag("h", ">"), down=flag("l", "<"))


@indicator
def market_facilitation_index() -> Plan:
    return one(ratio("h - l", "v", 0))


@indicator
def elder_impulse_system(n: int = 13, fast: int = 12, slow: int = 26, signal: int = 9) -> Plan:
    p = Plan(["value"]).scan(ema("e", "c", n), ema("f", "c", fast), ema("s", "c", slow)).add(m="f - s").scan(ema("g", "m", signal))
    p.add(x="m - g").add(de=f"e - {lag('e')}", dx=f"x - {lag('x')}")
    return p.add(value="case when de is not null and dx is not null then case when de > 0 and dx > 0 then 1e0 when de < 0 and dx < 0 then -1e0 else 0e0 end end")


@indicator
def td_sequential(n: int = 4) -> Plan:
    p = Plan(["value"]).add(s=f"sign(c - {lag('c', n)})").add(new=f"case when s is distinct from {lag('s')} or s = 0 then 1 else 0 end").add(island=running("sum", "new"))
    return p.add(value="case when s is not null then s * row_number() over (partition by sym, island order by ts) end")


@indicator
def woodies_cci(n: int = 14, turbo: int = 6) -> Plan:
    p = Plan(["cci", "turbo", "zone"]).add(tp=TP).add(m=sma("tp", n), q=sma("tp", turbo)).add(cci=_cci(n, "m"), turbo=_cci(turbo, "q"))
    return p.add(zone="case when cci is null then null when cci > 200 then 2e0 when cci > 100 then 1e0 when cci < -200 then -2e0 when cci < -100 then -1e0 else 0e0 end")


# ---- cycle (no SQL: atan of ratios of products, over variable windows)


def _cycle(outputs: list[str], kernel: Callable, **parameters: float) -> Plan:
    return Plan(outputs).scan(Machine(outputs, ["c"], None, None, None, lambda c: kernel(c, **parameters)))


@indicator
def ht_dcperiod() -> Plan:
    return _cycle(["value"], cycle.period)


@indicator
def ht_dcphase() -> Plan:
    return _cycle(["value"], cycle.phase)


@indicator
def ht_phasor() -> Plan:
    return _cycle(["inphase", "quadrature"], cycle.phasor)


@indicator
def ht_sine() -> Plan:
    return _cycle(["sine", "leadsine"], cycle.sine)


@indicator
def ht_trendline() -> Plan:
    return _cycle(["value"], cycle.trendline)


@indicator
def ht_trendmode() -> Plan:
    return _cycle(["value"], cycle.trendmode)


@indicator
def mama(fastlimit: float = 0.5, slowlimit: float = 0.05) -> Plan:
    return _cycle(["mama", "fama"], cycle.mama, fast=fastlimit, slow=slowlimit)


# ---- paired series: columns c and c2 (the reference's close) on the same ts


@indicator
def beta(n: int = 5) -> Plan:
    p = Plan(["value"]).add(y=ratio(f"c - {lag('c')}", lag("c"), 0), x=ratio(f"c2 - {lag('c2')}", lag("c2"), 0)).add(xx="x * x", xy="x * y")
    p.add(sx=rolling_sum("x", n), sy=rolling_sum("y", n), sxx=rolling_sum("xx", n), sxy=rolling_sum("xy", n)).add(den=f"{n} * sxx - sx * sx")
    return p.add(value=f"case when abs(den) < 1e-14 then 0e0 else ({n} * sxy - sx * sy) / den end")


@indicator
def correl(n: int = 30) -> Plan:
    p = Plan(["value"]).add(xx="c2 * c2", yy="c * c", xy="c * c2")
    p.add(sx=rolling_sum("c2", n), sy=rolling_sum("c", n), sxx=rolling_sum("xx", n), syy=rolling_sum("yy", n), sxy=rolling_sum("xy", n))
    p.add(vx=f"sxx - sx * sx / {n}", vy=f"syy - sy * sy / {n}")
    return p.add(value=f"case when vx * vy < 1e-14 then 0e0 else (sxy - sx * sy / {n}) / sqrt(vx * vy) end")


PAIRED = ("beta", "correl")


# ---- shared primitives, on the close


@indicator
def prm_wma(n: int = 9) -> Plan:
    return one(wma("c", n))


@indicator
def prm_tr() -> Plan:
    return one(true_range())


@indicator
def prm_roc(n: int = 10) -> Plan:
    return one(f"100 * {ratio(f'c - {lag(chr(99), n)}', lag('c', n), 'null')}")


@indicator
def prm_mom(n: int = 10) -> Plan:
    return one(f"c - {lag('c', n)}")


@indicator
def prm_linreg(n: int = 14) -> Plan:
    return one(linreg("c", n))


@indicator
def prm_stdev(n: int = 20) -> Plan:
    return one(stdev("c", n))


@indicator
def prm_sma(n: int = 20) -> Plan:
    return one(sma("c", n))


@indicator
def prm_rma(n: int = 14) -> Plan:
    return Plan(["value"]).scan(rma("value", "c", n))


@indicator
def prm_hh_ll(n: int = 20) -> Plan:
    return Plan(["hh", "ll"]).add(hh=highest("c", n), ll=lowest("c", n))


@indicator
def prm_cumulative() -> Plan:
    return one(running("sum", "c"))


@indicator
def prm_prices() -> Plan:
    return Plan(["tp", "hl2", "hlcc4", "ohlc4"]).add(tp=TP, hl2=HL2, hlcc4="(h + l + 2 * c) / 4", ohlc4="(o + h + l + c) / 4")


@indicator
def prm_publish_after(k: int = 5) -> Plan:
    return one(lag("c", k))


@indicator
def prm_streak() -> Plan:
    p = Plan(["value"]).add(s=f"coalesce(sign(c - {lag('c')}), 0)").add(new=f"case when s <> coalesce({lag('s')}, 0) or s = 0 then 1 else 0 end").add(island=running("sum", "new"))
    return p.add(value="s * row_number() over (partition by sym, island order by ts)")


@indicator
def prm_percent_rank(k: int = 20) -> Plan:
    below = " + ".join(f"case when {lag('c', i)} < c then 1 when {lag('c', i)} is not null then 0 end" for i in range(1, k + 1))
    return one(f"100e0 * ({below}) / {k}")


def warm_up(name: str) -> int | None:
    """Rows until all outputs of a registered indicator with its own parameters can be there, where that is fixed."""
    return {"dema": 41, "tema": 61, "t3": 121, "macd": 34, "tsi": 38, "connors_rsi": 102, "dmi": 42, "ichimoku_kinko_hyo": 78}.get(name)


