"""Clips, stable logarithms, links and normal distribution functions, for either evaluator."""

from __future__ import annotations

import math

#: Clips of pseudo-observations and h values, of Rosenblatt outputs, of conditional draws.
UNIT_EPS, ROSENBLATT_EPS, DRAW_EPS = 1e-10, 1e-6, 1e-12


def clip(m, x, eps: float = UNIT_EPS):
    return m.greatest(m.of(eps), m.least(m.of(1.0 - eps), x))


def clip_h(m, x):
    return clip(m, x, UNIT_EPS)


def clip_rosenblatt(m, x):
    return clip(m, x, ROSENBLATT_EPS)


def clip_draw(m, x, given=None):
    """A free coordinate is clipped, a given one stays exact."""
    return clip(m, x, DRAW_EPS) if given is None else m.of(given)


def log1mexp(m, x):
    """log(1 - exp(-x)) for x > 0."""
    return m.where(x < math.log(2.0), m.log(-m.expm1(-x)), m.log1p(-m.exp(-x)))


def logsumexp(m, a, b):
    top = m.greatest(a, b)
    return top + m.log(m.exp(a - top) + m.exp(b - top))


def sigmoid(m, x):
    return m.where(x >= 0, 1.0 / (1.0 + m.exp(-m.abs(x))), m.exp(-m.abs(x)) / (1.0 + m.exp(-m.abs(x))))


def logit(m, p, eps: float = 1e-12):
    p = clip(m, p, eps)
    return m.log(p) - m.log1p(-p)


# links: latent x -> parameter r, with derivative and inverse
def softplus(m, x):
    return m.greatest(x, 0.0) + m.log1p(m.exp(-m.abs(x)))


class Link:
    """``forward``, ``slope`` and ``inverse`` take the evaluator first; ``offset`` is the family's lower bound."""

    def __init__(self, name, forward, slope, inverse):
        self.name, self.forward, self.slope, self.inverse = name, forward, slope, inverse


def softplus_link(offset: float) -> Link:
    return Link(
        "softplus",
        lambda m, x: softplus(m, x) + offset,
        lambda m, x: sigmoid(m, x),
        lambda m, r: m.where(r - offset > 20.0, r - offset, m.log(m.expm1(m.greatest(m.least(r - offset, 20.0), 1e-10)))),
    )


def xtanh_link(offset: float) -> Link:
    """x tanh x; its "inverse" is |r| + offset by definition and does not undo it."""
    return Link(
        "xtanh",
        lambda m, x: x * m.tanh(x) + offset,
        lambda m, x: m.tanh(x) + x * (1.0 - m.tanh(x) * m.tanh(x)),
        lambda m, r: m.abs(r) + offset,
    )


def exp_link(offset: float) -> Link:
    return Link("exp", lambda m, x: m.exp(x) + offset, lambda m, x: m.exp(x), lambda m, r: m.log(m.greatest(r - offset, 1e-10)))


def logistic_link(offset: float, width: float = 20.0) -> Link:
    return Link(
        "logistic",
        lambda m, x: offset + width * sigmoid(m, x / 2.0),
        lambda m, x: width / 2.0 * sigmoid(m, x / 2.0) * (1.0 - sigmoid(m, x / 2.0)),
        lambda m, r: 2.0 * logit(m, (r - offset) / width),
    )


def gaussian_link(bound: float = 0.9999) -> Link:
    return Link(
        "gaussian-tanh",
        lambda m, x: bound * m.tanh(x / 4.0),
        lambda m, x: bound / 4.0 * (1.0 - m.tanh(x / 4.0) * m.tanh(x / 4.0)),
        lambda m, r: 4.0 * m.atanh(m.greatest(m.least(r / bound, 1 - 1e-12), -1 + 1e-12)),
    )


def equicorr_link(d: int) -> Link:
    low = -1.0 / (d - 1)
    half = 0.5 * (1.0 - low)
    return Link(
        "equicorr",
        lambda m, x: low + half * (1.0 + m.tanh(x)),
        lambda m, x: half * (1.0 - m.tanh(x) * m.tanh(x)),
        lambda m, r: m.atanh(m.greatest(m.least((r - low) / half - 1.0, 1 - 1e-12), -1 + 1e-12)),
    )


def student_df_link() -> Link:
    return softplus_link(2.0 + 1e-6)


LINKS = {"softplus": softplus_link, "xtanh": xtanh_link, "exp": exp_link, "logistic": logistic_link}

# normal distribution
#: Acklam's rational approximation of the normal quantile (relative error 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
#: Cody's rational approximations of erf and erfc.
_ERF_P = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_ERF_Q = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_ERFC_P = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_ERFC_Q = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_TAIL_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_TAIL_Q = (2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _poly(x, c):
    y = x * 0.0 + c[0]
    for v in c[1:]:
        y = y * x + v
    return y


def norm_ppf(m, p):
    """Normal quantile by Acklam's form; the argument is clipped at 1e-10."""
    p = clip(m, p, UNIT_EPS)
    tail = m.least(p, 1.0 - p)
    q = m.sqrt(-2.0 * m.log(tail))
    low = _poly(q, _C) / (_poly(q, _D) * q + 1.0)
    c = p - 0.5
    s = c * c
    mid = c * _poly(s, _A) / (_poly(s, _B) * s + 1.0)
    return m.where(tail < 0.02425, m.where(p < 0.5, low, -low), mid)


def norm_ppf_refined(m, p):
    """One Newton step on top of Acklam's form."""
    q = clip(m, p, UNIT_EPS)
    return m.let(norm_ppf(m, p), lambda x: x - (norm_cdf(m, x) - q) / (m.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)))


def erfc(m, x):
    y = m.abs(x)
    z = y * y
    num, den = _ERF_P[4] * z, z
    for i in range(3):
        num, den = (num + _ERF_P[i]) * z, (den + _ERF_Q[i]) * z
    inner = 1.0 - y * (num + _ERF_P[3]) / (den + _ERF_Q[3])
    num, den = _ERFC_P[8] * y, y
    for i in range(7):
        num, den = (num + _ERFC_P[i]) * y, (den + _ERFC_Q[i]) * y
    middle = m.exp(-z) * (num + _ERFC_P[7]) / (den + _ERFC_Q[7])
    w = 1.0 / m.greatest(z, 1e-30)
    num, den = _TAIL_P[5] * w, w
    for i in range(4):
        num, den = (num + _TAIL_P[i]) * w, (den + _TAIL_Q[i]) * w
    r = w * (num + _TAIL_P[4]) / (den + _TAIL_Q[4])
    outer = m.exp(-z) * (1.0 / math.sqrt(math.pi) - r) / m.greatest(y, 1e-15)
    upper = m.where(y <= 0.46875, inner, m.where(y <= 4.0, middle, outer))
    return m.where(x < 0, 2.0 - upper, upper)


def norm_cdf(m, x):
    return m.let(-x / math.sqrt(2.0), lambda t: 0.5 * erfc(m, t))
