"""Dominant-cycle indicators by the discrete Hilbert transform: kernels from an array of closes to arrays.

The transform of a series x is the filter 0.0962 x[t] + 0.5769 x[t-2] - 0.5769 x[t-4] - 0.0962 x[t-6], scaled
by 0.075 times the last period plus 0.54; what lies before the first step counts as zero.
"""

from __future__ import annotations

from math import atan, cos, degrees, pi, radians, sin

import numpy as np

#: Steps that only warm the price average, and rows without a result, of the two families.
SHORT, LONG = (9, 32), (34, 63)
_PERIODS = (6.0, 50.0)


class Analytic:
    """In-phase and quadrature parts and the cycle period of a price series, row by row."""

    def __init__(self, close: np.ndarray, skip: int):
        n = len(close)
        self.start = min(n, 3 + skip)
        self.smooth, self.inphase, self.quadrature, self.period = (np.full(n, np.nan) for _ in range(4))
        if n > 3:
            self.smooth[3:] = (4 * close[3:] + 3 * close[2:-1] + 2 * close[1:-2] + close[:-3]) / 10
        price, detrended, q1, i1 = ([0.0] * n for _ in range(4))
        i2 = q2 = re = im = period = 0.0

        def transform(x: list[float], t: int, scale: float) -> float:
            back = lambda k: x[t - k] if t - k >= self.start else 0.0
            return (0.0962 * (x[t] - back(6)) + 0.5769 * (back(2) - back(4))) * scale

        for t in range(self.start, n):
            scale = 0.075 * period + 0.54
            price[t] = self.smooth[t]
            detrended[t] = transform(price, t, scale)
            q1[t] = transform(detrended, t, scale)
            i1[t] = detrended[t - 3] if t - 3 >= self.start else 0.0
            was_i, was_q = i2, q2
            i2 = 0.2 * (i1[t] - transform(q1, t, scale)) + 0.8 * was_i
            q2 = 0.2 * (q1[t] + transform(i1, t, scale)) + 0.8 * was_q
            re = 0.2 * (i2 * was_i + q2 * was_q) + 0.8 * re
            im = 0.2 * (i2 * was_q - q2 * was_i) + 0.8 * im
            raw = 360.0 / degrees(atan(im / re)) if im != 0.0 and re != 0.0 else period
            raw = max(min(raw, 1.5 * period), 0.67 * period)
            period = 0.2 * min(max(raw, _PERIODS[0]), _PERIODS[1]) + 0.8 * period
            self.inphase[t], self.quadrature[t], self.period[t] = i1[t], q1[t], period

    def smoothed(self) -> np.ndarray:
        out, v = np.full(len(self.period), np.nan), 0.0
        for t in range(self.start, len(out)):
            v = out[t] = 0.33 * self.period[t] + 0.67 * v
        return out


def _from(values: np.ndarray, first: int) -> np.ndarray:
    out = values.copy()
    out[:first] = np.nan
    return out


def _phases(a: Analytic, span: np.ndarray) -> np.ndarray:
    out, phase = np.full(len(span), np.nan), 0.0
    price = np.where(np.arange(len(span)) >= a.start, a.smooth, 0.0)
    for t in range(a.start, len(span)):
        n = int(span[t] + 0.5)
        real = sum(sin(2 * pi * k / n) * (price[t - k] if t - k >= 0 else 0.0) for k in range(n))
        imaginary = sum(cos(2 * pi * k / n) * (price[t - k] if t - k >= 0 else 0.0) for k in range(n))
        if imaginary != 0.0:
            phase = degrees(atan(real / imaginary))
        elif real != 0.0:
            phase += 90.0 if real > 0.0 else -90.0
        phase += 90.0 + 360.0 / span[t] + (180.0 if imaginary < 0.0 else 0.0)
        if phase > 315.0:
            phase -= 360.0
        out[t] = phase
    return out


def _lines(close: np.ndarray, a: Analytic, span: np.ndarray) -> np.ndarray:
    """The mean close over the cycle, smoothed over four rows."""
    out, means = np.full(len(close), np.nan), [0.0] * 3
    for t in range(a.start, len(close)):
        n = int(span[t] + 0.5)
        means = [float(close[t - n + 1 : t + 1].mean()) if n else 0.0, *means[:3]]
        out[t] = (4 * means[0] + 3 * means[1] + 2 * means[2] + means[3]) / 10
    return out


def period(close: np.ndarray) -> list[np.ndarray]:
    return [_from(Analytic(close, SHORT[0]).smoothed(), SHORT[1])]


def phasor(close: np.ndarray) -> list[np.ndarray]:
    a = Analytic(close, SHORT[0])
    return [_from(a.inphase, SHORT[1]), _from(a.quadrature, SHORT[1])]


def phase(close: np.ndarray) -> list[np.ndarray]:
    a = Analytic(close, LONG[0])
    return [_from(_phases(a, a.smoothed()), LONG[1])]


def sine(close: np.ndarray) -> list[np.ndarray]:
    angle = phase(close)[0]
    return [np.sin(np.radians(angle)), np.sin(np.radians(angle + 45))]


def trendline(close: np.ndarray) -> list[np.ndarray]:
    a = Analytic(close, LONG[0])
    return [_from(_lines(close, a, a.smoothed()), LONG[1])]


def trendmode(close: np.ndarray) -> list[np.ndarray]:
    """1 in a trend, 0 in a cycle: after a crossing of sine and lead sine, for half a cycle, or while the phase
    moves on at about the cycle's pace; far from the trend line it is a trend whatever these say."""
    a = Analytic(close, LONG[0])
    span = a.smoothed()
    angles, lines = _phases(a, span), _lines(close, a, span)
    out = np.full(len(close), np.nan)
    was_angle = was_gap = 0.0
    days = 0
    for t in range(a.start, len(close)):
        gap = sin(radians(angles[t])) - sin(radians(angles[t] + 45))
        crossed = gap > 0 and was_gap <= 0 or gap < 0 and was_gap >= 0
        days = 1 if crossed else days + 1
        pace = (angles[t] - was_angle) * span[t] / 360.0
        cycling = crossed or days < 0.5 * span[t] or 0.67 < pace < 1.5
        far = lines[t] != 0.0 and abs((a.smooth[t] - lines[t]) / lines[t]) >= 0.015
        out[t] = 1.0 if far or not cycling else 0.0
        was_angle, was_gap = angles[t], gap
    return [_from(out, LONG[1])]


def mama(close: np.ndarray, fast: float = 0.5, slow: float = 0.05) -> list[np.ndarray]:
    """Averages that follow faster the less the phase moves, and at half that pace."""
    a = Analytic(close, SHORT[0])
    quick, late = np.full(len(close), np.nan), np.full(len(close), np.nan)
    m = f = was = 0.0
    for t in range(a.start, len(close)):
        angle = degrees(atan(a.quadrature[t] / a.inphase[t])) if a.inphase[t] != 0.0 else 0.0
        moved, was = max(1.0, was - angle), angle
        alpha = max(slow, fast / moved) if moved > 1.0 else fast
        m = alpha * close[t] + (1 - alpha) * m
        f = alpha / 2 * m + (1 - alpha / 2) * f
        quick[t], late[t] = m, f
    return [_from(quick, SHORT[1]), _from(late, SHORT[1])]
