"""Likelihoods of latent diffusions for many series at once: the filter of :mod:`latent` with series and parameters as leading axes.

``u`` and ``v`` are padded series (series x places), ``n`` their lengths; a request is a series' index and a row of
parameters. No value depends on which requests come together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

from ..functions.backend import num
from ..functions.families import Copula
from . import latent

PLACES = 262_144  #: numbers in the largest array of one step
MOST = 400  #: nodes of an Ornstein-Uhlenbeck grid from which on steps are interpolated
ORDERS = (32, 64, 128, 256)  #: nodes of a Jacobi rule
FLOORED = 1e-7  #: mass floored at zero in one step, above which the next order is taken


def _filtered(start: np.ndarray, move: np.ndarray, log_e: np.ndarray, n: np.ndarray, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods and the largest mass floored in a step. ``log_e`` is places x series x requests x nodes, ``move`` series x nodes x nodes.

    The mass is the weights' sum, or their product with ``total`` where weights are held over its square root's.
    """
    signed = total is not None
    top = log_e.max(-1, keepdims=True)
    log_e -= top
    e = np.exp(log_e, out=log_e)
    mass, floored = np.ones(e.shape[:-1]), np.zeros(e.shape[1:-1])
    total = np.ones_like(start) if total is None else total
    column = total[:, :, None]
    w = start[:, None, :] * e[0] if len(e) else None
    for t in range(len(e)):
        if t:
            w = w @ move
            if signed and w.min() < 0.0:
                low = np.minimum(w, 0.0)
                floored = np.maximum(floored, np.where(t < n[:, None], -(low @ column)[..., 0], 0.0))
                w -= low
                w /= w @ column
            w *= e[t]
        m = w @ column
        mass[t] = m[..., 0]
        w /= m
    return np.where((np.arange(len(e))[:, None] < n)[:, :, None], np.log(mass) + top[..., 0], 0.0).sum(0), floored


def _emissions(copula: Copula, u, v, i, r) -> np.ndarray:
    return copula.log_pdf_grid(u[i].T[:, :, None, None], v[i].T[:, :, None, None], r)


def ou_nodes(kappa, nu, dt, reach: float = 5.0, fine: float = 4.0) -> np.ndarray:
    """Three nodes in two conditional deviations, whose sums are exact to some 1e-9 for smooth densities, and up to eight where they
    would be over 1 / ``fine`` of a latent unit apart; by steps of four, so that many grids are alike."""
    s = np.sqrt(np.maximum(1e-12, -np.expm1(-2 * kappa * dt)))
    k = np.maximum(33, np.ceil(2 * reach * np.clip(fine * nu * np.sqrt(dt), 1.5, 4.0) / s))
    return (np.ceil((k - 1) / 4) * 4 + 1).astype(int)


@lru_cache(maxsize=64)
def _line(k: int, reach: float = 5.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in stationary deviations, trapezoid weights, start weights."""
    z = np.linspace(-reach, reach, k)
    weight = np.full(k, z[1] - z[0])
    weight[[0, -1]] /= 2
    start = np.exp(-0.5 * z * z) * weight
    return z, weight, start / start.sum()


def _ou_moves(kappa: np.ndarray, dt: np.ndarray, k: int) -> np.ndarray:
    z, weight, _ = _line(k)
    rho = np.exp(-kappa * dt)[:, None, None]
    move = (z - rho * z[:, None]) / np.sqrt(1 - rho * rho)
    move *= move
    move *= -0.5
    np.exp(move, out=move)
    move *= weight
    move /= move.sum(-1, keepdims=True)
    return move


def ou_log_likelihoods(copula: Copula, u: np.ndarray, v: np.ndarray, n: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of series i at the rows (kappa, mu, nu) of p."""
    link = copula.base.link(copula.link)
    return ou_emitted(lambda j, most, x: _emissions(copula, u[:, :most], v[:, :most], j, link.forward(num, x)), n, i, p)


def ou_emitted(emit: Callable[[np.ndarray, int, np.ndarray], np.ndarray], n: np.ndarray, i: np.ndarray, p: np.ndarray, fine: float = 4.0) -> np.ndarray:
    """Of series i at the rows (kappa, mu, nu) of p: by the dense kernel, by interpolated steps where it would take over ``MOST`` nodes.

    ``emit(j, most, x)`` are the log-densities of series j at their first ``most`` places and at latent values x (series x requests x
    nodes), places first. Requests of one series and one kappa share their moves.
    """
    out, dt = np.empty(len(p)), 1.0 / np.maximum(1, n[i] - 1)
    k = ou_nodes(p[:, 0], p[:, 2], dt, fine=fine)
    local = k > MOST
    k[local] = 129
    order = np.lexsort((p[:, 0], i, k, local))
    key = np.stack([local[order], k[order], i[order], p[order, 0]])
    first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))) if len(p) else np.zeros(0, int)
    count = np.diff(np.append(first, len(p)))
    kinds = np.stack([local[order[first]], k[order[first]], count], 1) if len(p) else np.zeros((0, 3), int)
    for far, nodes, c in np.unique(kinds, axis=0):
        which = first[(kinds == (far, nodes, c)).all(1)]
        z, _, start = _line(int(nodes))
        size = int(max(1, PLACES // (nodes * max(nodes, c * n.max()))))
        for begin in range(0, len(which), size):
            at = order[which[begin : begin + size, None] + np.arange(c)]  # moves x requests
            kappa, step = p[at[:, 0], 0], dt[at[:, 0]]
            if far:
                move = np.stack([latent.ou_local(a, 0.0, 1.0, d).move for a, d in zip(kappa, step)])
            else:
                move = _ou_moves(kappa, step, int(nodes))
            x = p[at, 1][:, :, None] + (p[at, 2] / np.sqrt(2 * p[at, 0]))[:, :, None] * z
            j = i[at[:, 0]]
            log_e = emit(j, int(n[j].max(initial=0)), x)
            out[at] = _filtered(np.broadcast_to(start, (len(at), int(nodes))), move, log_e, n[j])[0]
    return out


def jacobi_log_likelihoods(copula: Copula, u: np.ndarray, v: np.ndarray, n: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of series i at the rows (kappa, m, xi) of p, by the process's eigenfunctions.

    Weights are held over the square roots of the law's own, in which a step is a symmetric matrix and keeps the law, its
    variance and its correlation; what falls below zero is floored, and an order that floors more than rounding is doubled.
    """
    out, left = np.empty(len(p)), np.arange(len(p))
    for k in ORDERS:
        again = []
        size = int(max(1, PLACES // (k * max(k, u.shape[1]))))
        for begin in range(0, len(left), size):
            at = left[begin : begin + size]
            j = i[at]
            diagonal, off, decay = latent._jacobi_rule(*p[at].T, 1.0 / np.maximum(1, n[j] - 1), k)
            a = np.zeros((len(at), k, k))
            each = np.arange(k)
            a[:, each, each], a[:, each[1:], each[:-1]] = diagonal, off  # the lower triangle is read
            nodes, vec = np.linalg.eigh(a)
            root = np.abs(vec[:, 0, :])
            vec *= np.where(vec[:, :1, :] < 0, -1.0, 1.0)
            move = (vec * decay[:, :, None]).transpose(0, 2, 1) @ vec
            most = int(n[j].max(initial=0))
            r = copula.starts(copula.sign * np.clip((nodes + 1) / 2, 1e-6, 1 - 1e-6))
            got, floored = _filtered(root, move, _emissions(copula, u[:, :most], v[:, :most], j, r[:, None, :]), n[j], root)
            out[at] = got[:, 0]
            again.append(at[floored[:, 0] > FLOORED])
        left = np.concatenate(again) if again else left[:0]
        if not len(left):
            break
    return out
