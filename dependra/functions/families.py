"""Bivariate copula families, each formula written once for both evaluators.

``h(m, u, v, r)`` is the distribution of u given v; ``h_inv`` undoes it in u. Rotations act on the inputs:
90 reflects the first coordinate, 270 the second, 180 both.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

from . import scalars as s
from .backend import num

INVERSE_STEPS = 64


@dataclass(frozen=True)
class Family:
    """Static facts of a family; the formulas are methods of the subclasses."""

    name: str = ""
    lower: float = 0.0
    upper: float = math.inf
    rotations: tuple[int, ...] = (0, 90, 180, 270)
    offset: float = 0.0
    positive: bool = True  #: the unrotated family models positive dependence only

    def log_pdf(self, m, u, v, r):
        raise NotImplementedError

    def log_pdf_grid(self, u, v, r):
        """:meth:`log_pdf` of NumPy pairs at many parameters, which broadcast with them."""
        return self.log_pdf(num, u, v, r)

    def score(self, m, u, v, r):
        raise NotImplementedError

    def h(self, m, u, v, r):
        raise NotImplementedError

    def h_inv(self, m, q, v, r):
        return m.bisect(lambda u: self.h(m, u, v, r) - q, s.DRAW_EPS, 1 - s.DRAW_EPS, INVERSE_STEPS)

    def tau(self, m, r):
        raise NotImplementedError

    def from_tau(self, m, tau):
        raise NotImplementedError

    def link(self, name: str = "softplus") -> s.Link:
        return s.LINKS[name](self.offset)

    def clip_parameter(self, r: float) -> float:
        return float(min(max(r, self.lower), self.upper))


class Independence(Family):
    def log_pdf(self, m, u, v, r):
        return u * 0.0

    score = log_pdf

    def h(self, m, u, v, r):
        return u

    def h_inv(self, m, q, v, r):
        return q

    def tau(self, m, r):
        return r * 0.0

    def from_tau(self, m, tau):
        return tau * 0.0


class Clayton(Family):
    @staticmethod
    def _parts(m, u, v, r):
        """log u, log v, the larger exponent, both scaled powers and the logarithm of their sum less one."""
        lu, lv = m.log(u), m.log(v)
        top = m.greatest(-r * lu, -r * lv)
        pu, pv = m.exp(-r * lu - top), m.exp(-r * lv - top)
        rest = pu + pv - m.exp(-top)
        return lu, lv, pu, pv, rest, top + m.log(rest)

    def log_pdf(self, m, u, v, r):
        lu, lv, _, _, _, log_s = self._parts(m, u, v, r)
        return m.log1p(r) - (r + 1.0) * (lu + lv) - (2.0 + 1.0 / r) * log_s

    def log_pdf_grid(self, u, v, r):
        # of both scaled powers the larger is one, and large arrays are written in place
        lu, lv = np.log(u), np.log(v)
        low = np.minimum(lu, lv)
        top = r * low
        rest = r * (low - np.maximum(lu, lv))
        np.exp(rest, out=rest)
        rest += 1.0
        rest -= np.exp(top)
        np.log(rest, out=rest)
        rest -= top
        rest *= -(2.0 + 1.0 / r)
        rest += np.log1p(r)
        rest -= np.multiply(r + 1.0, lu + lv, out=top)
        return rest

    def score(self, m, u, v, r):
        lu, lv, pu, pv, rest, log_s = self._parts(m, u, v, r)
        return 1.0 / (1.0 + r) - (lu + lv) + log_s / (r * r) + (2.0 + 1.0 / r) * (pu * lu + pv * lv) / rest

    def h(self, m, u, v, r):
        _, lv, _, _, _, log_s = self._parts(m, u, v, r)
        return m.where(r < 1e-8, u, m.exp(-(r + 1.0) * lv - (1.0 + 1.0 / r) * log_s))

    def h_inv(self, m, q, v, r):
        lv = m.log(v)
        # log(x + 1 - v^-r), where log x = -r/(1+r) log(q v^(r+1)) >= -r log v
        log_x = -r / (1.0 + r) * (m.log(q) + (r + 1.0) * lv)
        log_sum = log_x + m.log(m.greatest(1.0 + m.exp(-log_x) - m.exp(-r * lv - log_x), 1e-300))
        return m.where(r < 1e-8, q, m.exp(-log_sum / r))

    def tau(self, m, r):
        return r / (r + 2.0)

    def from_tau(self, m, tau):
        return 2.0 * tau / (1.0 - tau)

    def psi(self, m, t, r):
        return m.exp(-m.log1p(r * t) / r)

    def frailty(self, rng, r, n):
        return rng.gamma(1.0 / r, r, n)


class Frank(Family):
    @staticmethod
    def _d(m, u, v, r):
        eu, ev = m.exp(-r * u), m.exp(-r * v)
        return -eu * m.expm1(-r * v) - ev * m.expm1(-r * (1.0 - v))

    def log_pdf(self, m, u, v, r):
        return m.log(r) + s.log1mexp(m, r) - r * (u + v) - 2.0 * m.log(self._d(m, u, v, r))

    def score(self, m, u, v, r):
        eu, ev = m.exp(-r * u), m.exp(-r * v)
        slope = u * eu * m.expm1(-r * v) + v * eu * ev + v * ev * m.expm1(-r * (1.0 - v)) + (1.0 - v) * m.exp(-r)
        return 1.0 / r - m.exp(-r) / m.expm1(-r) - (u + v) - 2.0 * slope / self._d(m, u, v, r)

    def h(self, m, u, v, r):
        return -m.exp(-r * v) * m.expm1(-r * u) / self._d(m, u, v, r)

    def h_inv(self, m, q, v, r):
        x = (1.0 - q) / q * m.exp(-r * v)
        small = -m.log((x + m.exp(-r)) / (x + 1.0)) / r
        # where e^(-rv) underflows: u = v + log of the odds of q over r
        far = v + (m.log(q) - m.log1p(-q)) / r
        return m.greatest(s.DRAW_EPS, m.least(m.where(r * v > 600.0, far, small), 1.0 - s.DRAW_EPS))

    def tau(self, m, r):
        return 1.0 - 4.0 / r * (1.0 - debye1(m, r))

    def from_tau(self, m, tau):
        return m.bisect(lambda r: self.tau(m, r) - tau, 1e-4, 200.0, 80)

    def psi(self, m, t, r):
        return -m.log1p(m.exp(-t) * m.expm1(-r)) / r

    def frailty(self, rng, r, n):
        return rng.logseries(1.0 - math.exp(-r), n).astype(float)


class Gumbel(Family):
    @staticmethod
    def _parts(m, u, v, r):
        a, b = -m.log(u), -m.log(v)
        la, lb = m.log(a), m.log(b)
        top = m.greatest(la, lb)
        pa, pb = m.exp(r * (la - top)), m.exp(r * (lb - top))
        log_s = r * top + m.log(pa + pb)
        return a, b, la, lb, pa, pb, log_s, m.exp(log_s / r)

    def log_pdf(self, m, u, v, r):
        a, b, la, lb, _, _, log_s, big = self._parts(m, u, v, r)
        return (r - 1.0) * (la + lb) + (1.0 / r - 2.0) * log_s + m.log(r - 1.0 + big) - big + a + b

    def score(self, m, u, v, r):
        a, b, la, lb, pa, pb, log_s, big = self._parts(m, u, v, r)
        ds = (pa * la + pb * lb) / (pa + pb)
        d_big = big * (ds / r - log_s / (r * r))
        return la + lb - log_s / (r * r) + (1.0 / r - 2.0) * ds + (1.0 + d_big) / (r - 1.0 + big) - d_big

    def h(self, m, u, v, r):
        _, b, _, lb, _, _, log_s, big = self._parts(m, u, v, r)
        return m.where(r < 1.0 + 1e-8, u, m.exp((r - 1.0) * lb + (1.0 / r - 1.0) * log_s - big + b))

    def tau(self, m, r):
        return 1.0 - 1.0 / r

    def from_tau(self, m, tau):
        return 1.0 / (1.0 - tau)

    def psi(self, m, t, r):
        return m.exp(-m.exp(m.log(t) / r))

    def frailty(self, rng, r, n):
        """Positive stable of index 1/r, by the Chambers-Mallows-Stuck form."""
        alpha = 1.0 / r
        if r <= 1.0 + 1e-12:
            return np.ones(n)
        angle, e = rng.uniform(0.0, math.pi, n), rng.exponential(1.0, n)
        return np.sin(alpha * angle) / np.sin(angle) ** r * (np.sin((1.0 - alpha) * angle) / e) ** (r - 1.0)


class Joe(Family):
    @staticmethod
    def _parts(m, u, v, r):
        lp, lq = m.log1p(-u), m.log1p(-v)
        pp, pq = m.exp(r * lp), m.exp(r * lq)
        big = pp + pq - pp * pq
        return lp, lq, pp, pq, big, m.log(big)

    def log_pdf(self, m, u, v, r):
        lp, lq, _, _, big, log_b = self._parts(m, u, v, r)
        return (r - 1.0) * (lp + lq) + m.log(big + r - 1.0) - (2.0 - 1.0 / r) * log_b

    def score(self, m, u, v, r):
        lp, lq, pp, pq, big, log_b = self._parts(m, u, v, r)
        slope = pp * lp + pq * lq - pp * pq * (lp + lq)
        return lp + lq + (slope + 1.0) / (big + r - 1.0) - log_b / (r * r) - (2.0 - 1.0 / r) * slope / big

    def h(self, m, u, v, r):
        _, lq, pp, _, _, log_b = self._parts(m, u, v, r)
        return (1.0 - pp) * m.exp((1.0 / r - 1.0) * log_b + (r - 1.0) * lq)

    def tau(self, m, r):
        a = 2.0 / r
        near = m.abs(a - 1.0) < 1e-6
        safe = m.where(near, a + 1e-4, a)
        f = (digamma(m, safe) + EULER) / (safe - 1.0) - (digamma(m, safe + 1.0) + EULER) / safe
        # at r = 2 the first quotient is the trigamma value pi^2/6
        return m.where(near, 1.0 - 4.0 / (r * r) * (math.pi**2 / 6.0 - 1.0), 1.0 - 4.0 / (r * r) * f)

    def from_tau(self, m, tau):
        return m.bisect(lambda r: self.tau(m, r) - tau, 1.0001, 200.0, 80)

    def psi(self, m, t, r):
        return 1.0 - m.exp(m.log(-m.expm1(-t)) / r)

    def frailty(self, rng, r, n):
        """Sibuya by inversion of its tail, P(V > k) = 1 / (k B(k, 1 - 1/r)), with the asymptote beyond it."""
        from .special import lgamma

        a = 1.0 / r
        p = rng.uniform(size=n)
        tail = lambda k: np.exp(lgamma(k + 1.0 - a) - lgamma(k + 1.0) - lgamma(np.array(1.0 - a)))
        v = np.floor(((1.0 - p) * math.gamma(1.0 - a)) ** (-r)) if r > 1 + 1e-9 else np.ones(n)
        v = np.maximum(v, 1.0)
        small = v < 1e6
        for _ in range(64):
            more = small & (tail(v) > 1.0 - p)
            if not more.any():
                break
            v = np.where(more, v + 1.0, v)
        for _ in range(64):
            less = small & (v > 1) & (tail(np.maximum(v - 1.0, 1.0)) <= 1.0 - p) & (a <= p)
            if not less.any():
                break
            v = np.where(less, v - 1.0, v)
        return np.where(p <= a, 1.0, v)


class Gaussian(Family):
    def log_pdf(self, m, u, v, r):
        return self.log_pdf_scores(m, s.norm_ppf(m, u), s.norm_ppf(m, v), r)

    @staticmethod
    def log_pdf_scores(m, x, y, r):
        """The same from normal scores."""
        k = 1.0 - r * r
        return -0.5 * m.log(k) - 0.5 * (r * r * (x * x + y * y) - 2.0 * r * x * y) / k

    def score(self, m, u, v, r):
        x, y = s.norm_ppf(m, u), s.norm_ppf(m, v)
        k = 1.0 - r * r
        q, p = x * x + y * y, x * y
        return r / k - (r * q - p) / k - r * (r * r * q - 2.0 * r * p) / (k * k)

    def h(self, m, u, v, r):
        return s.norm_cdf(m, (s.norm_ppf(m, u) - r * s.norm_ppf(m, v)) / m.sqrt(1.0 - r * r + m.of(0.0)))

    def h_inv(self, m, q, v, r):
        return s.norm_cdf(m, s.norm_ppf(m, q) * m.sqrt(1.0 - r * r + m.of(0.0)) + r * s.norm_ppf(m, v))

    def tau(self, m, r):
        return 2.0 / math.pi * m.asin(r)

    def from_tau(self, m, tau):
        return m.sin(math.pi / 2.0 * tau)

    def link(self, name: str = "softplus") -> s.Link:
        return s.gaussian_link(self.upper)


EULER = 0.5772156649015329


def digamma(m, x):
    """Recurrence to ten and an asymptotic series."""
    shift = x * 0.0
    for k in range(10):
        shift = shift - 1.0 / (x + float(k))
    y = x + 10.0
    w = 1.0 / (y * y)
    return shift + m.log(y) - 0.5 / y - w * (1 / 12.0 - w * (1 / 120.0 - w * (1 / 252.0 - w * (1 / 240.0 - w / 132.0))))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def debye1(m, r):
    """(1/r) times the integral of t/(e^t - 1) from 0 to r, by Gauss-Legendre on panels of a fixed rule."""
    total = r * 0.0
    for x, w in zip((_NODES + 1) / 2, _WEIGHTS / 2):
        t = r * float(x)
        total = total + float(w) * t / m.expm1(t)
    # beyond 30 the integral is pi^2/6 up to rounding
    return m.where(r > 30.0, math.pi**2 / 6.0 / r, total)


INDEPENDENCE = Independence("independence", 0.0, 0.0, (0,), positive=False)
FAMILIES: dict[str, Family] = {
    f.name: f
    for f in (
        INDEPENDENCE,
        Clayton("clayton", 1e-4, math.inf, offset=1e-4),
        Frank("frank", 1e-4, math.inf, (0,), offset=1e-4),
        Gumbel("gumbel", 1.0001, math.inf, offset=1.0001),
        Joe("joe", 1.0001, math.inf, offset=1.0001),
        Gaussian("gaussian", -0.9999, 0.9999, (0,), positive=False),
    )
}


@dataclass(frozen=True)
class Copula:
    """A family with a rotation and a link: what every operator takes. Never changed in place."""

    family: str
    rotation: int = 0
    link: str = "softplus"

    def __post_init__(self):
        if self.family not in FAMILIES:
            raise ValueError(f"unknown family {self.family!r}; known: {sorted(FAMILIES)}")
        if self.rotation not in self.base.rotations:
            raise ValueError(f"{self.family} cannot be rotated by {self.rotation}; allowed: {self.base.rotations}")
        if self.link not in s.LINKS:
            raise ValueError(f"unknown link {self.link!r}; known: {sorted(s.LINKS)}")

    @property
    def base(self) -> Family:
        return FAMILIES[self.family]

    def rotate(self, u, v):
        return (1.0 - u if self.rotation in (90, 180) else u), (1.0 - v if self.rotation in (180, 270) else v)

    @property
    def sign(self) -> int:
        return -1 if self.rotation in (90, 270) else 1

    def transposed(self) -> Copula:
        """The copula of (v, u)."""
        return replace(self, rotation={90: 270, 270: 90}.get(self.rotation, self.rotation))

    def log_pdf(self, m, u, v, r):
        u, v = self.rotate(s.clip(m, u), s.clip(m, v))
        return self.base.log_pdf(m, u, v, r)

    def log_pdf_grid(self, u, v, r):
        u, v = self.rotate(s.clip(num, u), s.clip(num, v))
        return self.base.log_pdf_grid(u, v, r)

    def pdf(self, m, u, v, r):
        return m.exp(self.log_pdf(m, u, v, r))

    def score(self, m, u, v, r):
        u, v = self.rotate(s.clip(m, u), s.clip(m, v))
        return self.base.score(m, u, v, r)

    def pdf_and_latent_slope(self, m, u, v, x):
        """Density and its derivative in the latent x, under the link."""
        link = self.base.link(self.link)
        r = link.forward(m, x)
        p = self.pdf(m, u, v, r)
        return p, p * self.score(m, u, v, r) * link.slope(m, x)

    def h(self, m, u, v, r):
        """The distribution of u given v."""
        a, b = self.rotate(s.clip(m, u), s.clip(m, v))
        x = self.base.h(m, a, b, r)
        return s.clip_h(m, 1.0 - x if self.rotation in (90, 180) else x)

    def h_pair(self, m, u, v, r):
        return self.h(m, u, v, r), self.transposed().h(m, v, u, r)

    def h_inv(self, m, q, v, r):
        flip = self.rotation in (90, 180)
        q, v = s.clip(m, q), s.clip(m, v)
        b = 1.0 - v if self.rotation in (180, 270) else v
        x = self.base.h_inv(m, 1.0 - q if flip else q, b, r)
        return s.clip_h(m, 1.0 - x if flip else x)

    def tau(self, m, r):
        return self.sign * self.base.tau(m, r)

    def from_tau(self, m, tau):
        return self.base.from_tau(m, self.sign * tau)

    def start(self, tau: float) -> float:
        """A parameter inside the bounds for an observed tau."""
        if self.family == "independence":
            return 0.0
        t = self.sign * tau
        if self.base.positive:
            t = min(max(t, 0.02), 0.95)
        return self.base.clip_parameter(float(self.base.from_tau(num, np.float64(t))))

    def starts(self, tau: np.ndarray) -> np.ndarray:
        """:meth:`start` of each tau."""
        if self.family == "independence":
            return np.zeros(len(tau))
        t = self.sign * tau
        if self.base.positive:
            t = np.clip(t, 0.02, 0.95)
        return np.clip(self.base.from_tau(num, t), self.base.lower, self.base.upper)
