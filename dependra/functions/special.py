"""Special functions and quadrature rules in NumPy."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from . import scalars
from .backend import num

_lg = np.vectorize(math.lgamma, otypes=[float])


def lgamma(x):
    return _lg(np.asarray(x, float))


def norm_cdf(x):
    return scalars.norm_cdf(num, np.asarray(x, float))


def norm_ppf(p):
    return scalars.norm_ppf_refined(num, np.asarray(p, float))


def betainc(a, b, x):
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    y = np.clip(y, 0.0, 1.0)
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1.0 - (p + q) * y / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for k in range(1, 400):
        for e in (k * (q - k) * y / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * y / ((p + 2 * k) * (p + 2 * k + 1))):
            d = 1.0 + e * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + e / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(np.maximum(y, tiny)) + q * np.log1p(-np.minimum(y, 1 - 1e-16)) - np.log(p) - (lgamma(p) + lgamma(q) - lgamma(p + q)))
    out = np.clip(front * f, 0.0, 1.0)
    return np.where(swap, 1.0 - out, out)


TABLE_ROWS = 8192  #: from so many values on, a Student function of one number of degrees of freedom goes through its table
_CDF_REACH = 30.0  # of asinh(x) in the table of the distribution


def _one(df) -> float | None:
    """The number that all degrees of freedom equal, if there is one."""
    df = np.asarray(df, float)
    return float(df.flat[0]) if df.size and (df.ndim == 0 or df.min() == df.max()) else None


def _quintic(f, f1, f2, h: float) -> np.ndarray:
    """Coefficients, by cell, of the polynomials of degree five that meet values and two derivatives at both ends."""
    a, b, c = f[:-1], f1[:-1] * h, f2[:-1] * h * h / 2
    p, q, r = f[1:] - a - b - c, f1[1:] * h - b - 2 * c, f2[1:] * h * h - 2 * c
    return np.stack([a, b, c, 10 * p - 4 * q + r / 2, -15 * p + 7 * q - r, 6 * p - 3 * q + r / 2])


def _look_up(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at places counted in cells."""
    cell = np.minimum(at.astype(np.int64), table.shape[1] - 1)
    t = at - cell
    out = table[5][cell]
    for c in table[4::-1]:
        out = out * t + c[cell]
    return out


@lru_cache(maxsize=32)
def _cdf_table(df: float, cells: int = 8192) -> np.ndarray:
    """Logarithm of the upper tail over asinh(x) from 0."""
    s = np.linspace(0.0, _CDF_REACH, cells + 1)
    x, slope = np.sinh(s), np.cosh(s)
    log_tail = np.log(np.maximum(_t_tail(x, df), 1e-300))
    ratio = np.exp(t_logpdf(x, df) - log_tail)  # density over tail
    first = -ratio * slope
    second = -ratio * x - slope * slope * (ratio * ratio - ratio * (df + 1) * x / (df + x * x))
    return _quintic(log_tail, first, second, s[1])


@lru_cache(maxsize=32)
def _ppf_table(df: float, cells: int = 8192) -> np.ndarray:
    """Quantile over the normal score from 0 to that of 1e-12."""
    z = np.linspace(0.0, 7.1, cells + 1)
    x = -_t_newton(scalars.norm_cdf(num, -z), -z, df)
    first = np.exp(-0.5 * z * z - 0.5 * np.log(2 * np.pi) - t_logpdf(x, df))
    second = first * (-z + first * (df + 1) * x / (df + x * x))
    return _quintic(x, first, second, z[1])


def _t_tail(y, df):
    return 0.5 * betainc(np.asarray(df, float) / 2.0, 0.5, df / (df + y * y))


def t_cdf(x, df):
    """Student distribution; many values at one number of degrees of freedom take a table of quintic pieces."""
    x = np.asarray(x, float)
    y = np.abs(x)
    if x.size >= TABLE_ROWS and (one := _one(df)) is not None and one <= 300 and np.isfinite(y).all() and y.max() < np.sinh(_CDF_REACH):
        tail = np.exp(_look_up(_cdf_table(one), np.arcsinh(y) * (8192 / _CDF_REACH)))
    else:
        tail = _t_tail(y, df)
    return np.where(x < 0, tail, 1.0 - tail)


def t_logpdf(x, df):
    return lgamma((df + 1.0) / 2.0) - lgamma(df / 2.0) - 0.5 * np.log(df * np.pi) - (df + 1.0) / 2.0 * np.log1p(x * x / df)


def _t_newton(p, z, df):
    """Quantiles from normal scores: their first corrections, then safeguarded Newton steps."""
    x = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
    lo, hi = np.full(x.shape, -1e8), np.full(x.shape, 1e8)
    for _ in range(80):
        e = t_cdf(x, df) - p
        lo, hi = np.where(e < 0, x, lo), np.where(e < 0, hi, x)
        step = x - e / np.maximum(np.exp(t_logpdf(x, df)), 1e-300)
        new = np.where((step > lo) & (step < hi), step, (np.maximum(lo, -1e6) + np.minimum(hi, 1e6)) / 2)
        if np.all(np.abs(new - x) <= 1e-12 * (1 + np.abs(x))):
            x = new
            break
        x = new
    return x


def t_ppf(p, df):
    """Student quantile; many values at one number of degrees of freedom take a table of quintic pieces over normal scores."""
    p = np.clip(np.asarray(p, float), 1e-12, 1 - 1e-12)
    if p.size >= TABLE_ROWS and (one := _one(df)) is not None and one <= 300 and np.isfinite(p).all():
        # scores of the tail: norm_ppf clips at 1e-10, so the few beyond are found one by one
        z = norm_ppf(np.minimum(p, 1 - p))
        out = np.copysign(_look_up(_ppf_table(one), np.abs(z) * (8192 / 7.1)), p - 0.5)
        if len(far := np.flatnonzero(np.minimum(p, 1 - p) < 1e-9)):
            out.flat[far] = t_ppf(p.flat[far][: TABLE_ROWS - 1], one) if len(far) < TABLE_ROWS else np.concatenate([t_ppf(k, one) for k in np.array_split(p.flat[far], -(-len(far) // 4096))])
        return out
    p, df = np.broadcast_arrays(p, np.asarray(df, float))
    return _t_newton(p, norm_ppf(p), df)


def gammainc(a, x):
    """Regularised lower incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    x = np.maximum(x, 0.0)
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - lgamma(a))
    term = total = 1.0 / a
    for k in range(1, 1000):
        term = term * x / (a + k)
        total = total + term
        if np.all(np.abs(term) < 1e-17 * np.abs(total)):
            break
    series = front * total
    b = x + 1.0 - a
    c, d = np.full(x.shape, 1e300), 1.0 / np.where(b == 0, 1e-300, b)
    f = d.copy()
    for k in range(1, 400):
        an = -k * (k - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        f = f * d * c
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    out = np.where(x < a + 1.0, series, 1.0 - front * f)
    return np.clip(np.where(x == 0, 0.0, out), 0.0, 1.0)


def chi2_cdf(x, df):
    return gammainc(np.asarray(df, float) / 2.0, np.asarray(x, float) / 2.0)


def golub_welsch(diagonal: np.ndarray, off: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of a Gauss rule from its Jacobi matrix."""
    nodes, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    return nodes, mass * vectors[0] ** 2


@lru_cache(maxsize=64)
def gauss_hermite(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rule of the standard normal weight: weights sum to one."""
    return golub_welsch(np.zeros(n), np.sqrt(np.arange(1, n, dtype=float)), 1.0)


@lru_cache(maxsize=64)
def gauss_legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rule on (0, 1)."""
    k = np.arange(1, n, dtype=float)
    x, w = golub_welsch(np.zeros(n), k / np.sqrt(4 * k * k - 1), 1.0)
    return (x + 1) / 2, w


@lru_cache(maxsize=256)
def gauss_jacobi(n: int, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    """Rule of the Beta(a, b) law on (0, 1): weights sum to one."""
    al, be = b - 1.0, a - 1.0  # weights (1 - x)^al (1 + x)^be on (-1, 1)
    k = np.arange(n, dtype=float)
    s = 2 * k + al + be
    with np.errstate(divide="ignore", invalid="ignore"):
        diagonal = (be * be - al * al) / (s * (s + 2))
    diagonal[0] = (be - al) / (al + be + 2)
    diagonal = np.where(np.isfinite(diagonal), diagonal, 0.0)
    k = np.arange(1, n, dtype=float)
    s = 2 * k + al + be
    with np.errstate(divide="ignore", invalid="ignore"):
        off2 = 4 * k * (k + al) * (k + be) * (k + al + be) / (s * s * (s + 1) * (s - 1))
    if n > 1:
        off2[0] = 4 * (1 + al) * (1 + be) / ((2 + al + be) ** 2 * (3 + al + be))
    x, w = golub_welsch(diagonal, np.sqrt(np.maximum(off2, 0.0)), 1.0)
    return np.clip((x + 1) / 2, 1e-12, 1 - 1e-12), w
