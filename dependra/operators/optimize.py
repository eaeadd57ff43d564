"""Small bounded optimisers for estimates inside grouped functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Optimum:
    x: np.ndarray
    value: float
    success: bool
    evaluations: int
    message: str


def golden(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-9, most: int = 200) -> Optimum:
    """Minimum of a unimodal function on an interval."""
    ratio = (np.sqrt(5) - 1) / 2
    a, b = lo, hi
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    n = 2
    while abs(b - a) > tol * (1 + abs(a) + abs(b)) and n < most:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
        n += 1
    x = (a + b) / 2
    return Optimum(np.array([x]), float(f(x)), n < most, n + 1, "converged" if n < most else "too many evaluations")


def projected_bfgs(f: Callable[[np.ndarray], float], x0, lo, hi, tol: float = 1e-5, most: int = 200, many: Callable[[np.ndarray], np.ndarray] | None = None) -> Optimum:
    """Quasi-Newton steps with central differences, on the variables that are not held by a bound.

    ``many`` evaluates the rows of a matrix at once, where that is cheaper than one by one.
    """
    lo, hi = np.asarray(lo, float), np.asarray(hi, float)
    x = np.clip(np.asarray(x0, float), lo, hi)
    count = 0

    def value(y):
        nonlocal count
        count += 1
        v = f(y)
        return float(v) if np.isfinite(v) else 1e10

    def slope(y):
        nonlocal count
        h = 1e-5 * (1 + np.abs(y))
        up, down = np.tile(y, (len(y), 1)), np.tile(y, (len(y), 1))
        np.fill_diagonal(up, np.minimum(y + h, hi))
        np.fill_diagonal(down, np.maximum(y - h, lo))
        if many is None:
            v = np.array([value(p) for p in np.concatenate([up, down])])
        else:
            v = many(np.concatenate([up, down]))
            v = np.where(np.isfinite(v), v, 1e10)
            count += len(v)
        return (v[: len(y)] - v[len(y) :]) / (np.diag(up) - np.diag(down))

    fx, g, inverse = value(x), slope(x), np.eye(len(x))
    for _ in range(most):
        free = ~(((x <= lo + 1e-12) & (g > 0)) | ((x >= hi - 1e-12) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < tol * (1 + abs(fx)):
            return Optimum(x, fx, True, count, "projected gradient is small")
        p = np.zeros(len(x))
        p[free] = -(inverse[np.ix_(free, free)] @ g[free])
        if p @ g >= 0:
            inverse, p = np.eye(len(x)), np.where(free, -g, 0.0)
        step, best = min(1.0, 2.0 / (np.abs(p).max() + 1e-12)), None
        for _ in range(30):
            y = np.clip(x + step * p, lo, hi)
            fy = value(y)
            if fy <= fx + 1e-4 * g @ (y - x):
                best = (y, fy)
                break
            step /= 2
        if best is None:
            return Optimum(x, fx, True, count, "no lower value along the search direction")
        y, fy = best
        gy = slope(y)
        s, d = y - x, gy - g
        if s @ d > 1e-12:
            rho = 1.0 / (s @ d)
            e = np.eye(len(x)) - rho * np.outer(s, d)
            inverse = e @ inverse @ e.T + rho * np.outer(s, s)
        if abs(fx - fy) < 1e-10 * (1 + abs(fx)):
            return Optimum(y, fy, True, count, "the value has settled")
        x, fx, g = y, fy, gy
    return Optimum(x, fx, False, count, "too many iterations")
