"""Seasonal-trend decomposition by LOESS (Cleveland et al., 1990), non-robust, for one short series."""

from __future__ import annotations

import numpy as np


def loess(y: np.ndarray, width: int, at: np.ndarray, degree: int = 1) -> np.ndarray:
    """Local regression of y (at 0..n-1) with tricube weights over the `width` nearest points, at positions `at`."""
    n, x = len(y), np.arange(len(y), dtype=float)
    out = np.empty(len(at))
    q = min(width, n)
    for k, p in enumerate(at):
        first = int(np.clip(np.ceil(p - (q + 1) / 2 + 0.5), 0, n - q))
        while first > 0 and p - x[first - 1] < x[first + q - 1] - p:
            first -= 1
        while first + q < n and x[first + q] - p < p - x[first]:
            first += 1
        xs, ys = x[first : first + q], y[first : first + q]
        reach = max(abs(xs[0] - p), abs(xs[-1] - p)) + (max(0, width - n) // 2)
        d = np.abs(xs - p) / max(reach, 1e-12)
        w = np.where(d < 1, (1 - d**3) ** 3, 0.0)
        if not w.any():
            w = np.ones_like(xs)
        w /= w.sum()
        mean = (w * xs).sum()
        spread = (w * (xs - mean) ** 2).sum()
        if degree and spread > 1e-12 * n * n:
            w = w * (1 + (p - mean) * (xs - mean) / spread)
        out[k] = (w * ys).sum()
    return out


def _average(y: np.ndarray, width: int) -> np.ndarray:
    return np.convolve(y, np.ones(width) / width, "valid")


def stl(y: np.ndarray, period: int = 12, seasonal: int = 13, trend: int | None = None, low: int | None = None, rounds: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, residual). Needs at least two periods."""
    n = len(y)
    if n < 2 * period:
        raise ValueError("a series must cover two periods")
    odd = lambda v: int(v) | 1
    trend = trend or odd(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    low = low or odd(period if period % 2 else period + 1)
    at, level, season = np.arange(n, dtype=float), np.zeros(n), np.zeros(n)
    for _ in range(rounds):
        rest, cycle = y - level, np.empty(n + 2 * period)
        for k in range(period):
            part = rest[k::period]
            cycle[k::period] = loess(part, seasonal, np.arange(-1, len(part) + 1, dtype=float))
        passed = loess(_average(_average(_average(cycle, period), period), 3), low, at)
        season = cycle[period : period + n] - passed
        level = loess(y - season, trend, at)
    return level, season, y - level - season
