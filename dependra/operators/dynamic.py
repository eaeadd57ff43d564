"""Dynamic models beyond one pair: equicorrelation and Student copulas with a moving parameter, and vines whose edges move.

A model is a function from parameter values to row log-densities; the score-driven recursion takes its
derivative numerically, the latent one its values on a grid. Series are groups, many in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import scalars as s, special
from ..functions.backend import num
from ..functions.families import Copula
from . import batches, latent, latent_many
from .aggregates import kendall_tau, nearest_correlation, shrink_correlation
from .fit import fit_many, select_many
from .multivariate import DF_BOUNDS, equicorr_log_pdf, student_log_pdf
from .optimize import golden, projected_bfgs
from .recursions import SCORE_BOUND, STATE_BOUND, gas_path, gas_start
from .vine import Edge, Vine, c_vine, d_vine, next_candidates, spanning_tree


@dataclass(frozen=True)
class Emission:
    """``rows(r)``: log-density of every row at one parameter; ``one(t, r)``: of row t at an array of parameters."""

    n: int
    rows: Callable[[float], np.ndarray]
    one: Callable[[int, np.ndarray], np.ndarray]
    link: s.Link
    start: float  # a latent value to begin from


def _inside(d: int, r):
    """Far latent values round to a bound of the correlation, where there is no density."""
    low = -1.0 / (d - 1)
    return np.clip(r, low + 1e-9 * (1.0 - low), 1.0 - 1e-9)


def equicorr_emission(u: np.ndarray) -> Emission:
    z = special.norm_ppf(u)
    a, b, d = z.sum(1), (z * z).sum(1), u.shape[1]
    return Emission(len(u), lambda r: equicorr_log_pdf(d, _inside(d, r), a, b, num), lambda t, r: equicorr_log_pdf(d, _inside(d, r), a[t], b[t], num), s.equicorr_link(d), 0.0)


def student_emission(u: np.ndarray, corr: np.ndarray) -> Emission:
    """Degrees of freedom move, the correlation stands still."""
    return Emission(
        len(u), lambda r: student_log_pdf(u, corr, float(np.clip(r, *DF_BOUNDS))),
        lambda t, r: student_log_pdf(np.repeat(u[t : t + 1], np.size(r), 0), corr, np.clip(np.ravel(r), *DF_BOUNDS)), s.student_df_link(), 5.0,
    )


def static(e: Emission) -> dict:
    best = golden(lambda x: -float(np.sum(e.rows(float(e.link.forward(num, np.float64(x)))))), e.start - 8.0, e.start + 8.0, 1e-6)
    return {"method": "mle", "x": float(best.x[0]), "r": float(e.link.forward(num, best.x)[0]), "log_likelihood": -best.value}


def gas_filter(e: Emission, params) -> tuple[np.ndarray, float]:
    omega, gamma, beta = params
    g, total, out = gas_start(omega, beta), 0.0, np.empty(e.n)
    for t in range(e.n):
        out[t] = g
        low, mid, high = e.one(t, e.link.forward(num, np.array([g - 1e-4, g, g + 1e-4])))
        total += float(mid)
        g = float(np.clip(omega + beta * g + gamma * np.clip((high - low) / 2e-4, -SCORE_BOUND, SCORE_BOUND), -STATE_BOUND, STATE_BOUND))
    return out, total


def grid_emissions(e: Emission, grid: latent.Grid) -> np.ndarray:
    return np.column_stack([e.rows(float(r)) for r in e.link.forward(num, grid.x)])


def fit_emission(e: Emission, method: str = "scar-tm-ou", most: int = 20) -> dict:
    """Static, score-driven or latent Ornstein-Uhlenbeck fit of an emission."""
    base = static(e)
    if method == "mle":
        return base
    if method == "gas":
        best = projected_bfgs(lambda p: -gas_filter(e, p)[1], (base["x"] * 0.1, 0.05, 0.9), (-10.0, -5.0, -0.999), (10.0, 5.0, 0.999), tol=1e-4, most=most)
        return {"method": method, "log_likelihood": -best.value, **dict(zip(("omega", "gamma", "beta"), map(float, best.x)))}
    if method == "scar-tm-ou":
        f = lambda p: -latent.forward(g := latent.ou_grid(*p, e.n), grid_emissions(e, g)).log_likelihood
        best = projected_bfgs(f, (5.0, base["x"], 1.0), (1e-2, -10.0, 1e-2), (200.0, 20.0, 20.0), tol=1e-4, most=most)
        return {"method": method, "log_likelihood": -best.value, **dict(zip(("kappa", "mu", "nu"), map(float, best.x)))}
    raise ValueError(f"unknown method {method!r}")


def _equicorr_many(series: Sequence[np.ndarray], fit: Callable) -> list[dict]:
    """``fit(n, a, b, x)`` of padded series of similar length: their sums of normal scores and of squares, and latent values of the static fits."""
    d, link = series[0].shape[1], s.equicorr_link(series[0].shape[1])
    z = [special.norm_ppf(u) for u in series]
    out: list = [None] * len(series)
    for k in batches.alike([len(u) for u in series]):
        n = np.array([len(series[j]) for j in k])
        (a, real), (b, _) = batches.padded([z[j].sum(1) for j in k], 0.0), batches.padded([(z[j] * z[j]).sum(1) for j in k], 0.0)
        rows = lambda i, x: np.where(real[i], equicorr_log_pdf(d, _inside(d, link.forward(num, x))[:, None], a[i], b[i], num), 0.0).sum(1)
        base = batches.golden_many(lambda i, x: -rows(i, x), np.full(len(k), -8.0), np.full(len(k), 8.0), 1e-6)
        for j, got in zip(k, fit(n, a, b, np.array([o.x[0] for o in base]))):
            out[j] = got
    return out


def equicorr_gas_many(series: Sequence[np.ndarray], most: int = 20) -> list[dict]:
    """:func:`fit_emission` by score of the equicorrelation of each series, side by side."""
    d, link = series[0].shape[1], s.equicorr_link(series[0].shape[1])

    def fit(n, a, b, x):
        at, bt = a.T.copy(), b.T.copy()

        def value(i, p):
            omega, gamma, beta = p.T
            with np.errstate(all="ignore"):
                g = np.where(np.abs(beta) < 1.0 - 1e-8, omega / (1.0 - beta), omega)
                total, own = np.zeros(len(g)), n[i]
                for t in range(own.max(initial=0)):
                    low, mid, high = equicorr_log_pdf(d, _inside(d, link.forward(num, np.stack([g - 1e-4, g, g + 1e-4]))), at[t, i], bt[t, i], num)
                    total += np.where(t < own, mid, 0.0)
                    g = np.clip(omega + beta * g + gamma * np.clip((high - low) / 2e-4, -SCORE_BOUND, SCORE_BOUND), -STATE_BOUND, STATE_BOUND)
            return -total

        x0 = np.stack([x * 0.1, np.full(len(x), 0.05), np.full(len(x), 0.9)], 1)
        best = batches.bfgs_many(value, x0, (-10.0, -5.0, -0.999), (10.0, 5.0, 0.999), tol=1e-4, most=most)
        return [{"method": "gas", "log_likelihood": -o.value, **dict(zip(("omega", "gamma", "beta"), map(float, o.x)))} for o in best]

    return _equicorr_many(series, fit)


#: Nodes in a latent unit of the equicorrelation, whose density has twice the slope of a pair's.
FINE = 8.0


def equicorr_emit(d: int, a: np.ndarray, b: np.ndarray) -> Callable[[np.ndarray, int, np.ndarray], np.ndarray]:
    """Log-densities for :func:`latent_many.ou_emitted`: linear in each row's sum of squares and squared sum, with slopes of the node alone."""
    link, bt, a2t = s.equicorr_link(d), b.T.copy(), (a * a).T.copy()

    def emit(j, most, x):
        r = _inside(d, link.forward(num, x))
        rest, lead = 1.0 - r, 1.0 + (d - 1.0) * r
        slope = -0.5 * r / rest
        out = slope * bt[:most, j, None, None]
        slope /= -lead
        out += slope * a2t[:most, j, None, None]
        out -= 0.5 * ((d - 1.0) * np.log(rest) + np.log(lead))
        return out

    return emit


def equicorr_scar_many(series: Sequence[np.ndarray], most: int = 20) -> list[dict]:
    """Latent Ornstein-Uhlenbeck fits of the equicorrelation of each series, side by side."""
    d = series[0].shape[1]

    def fit(n, a, b, x):
        emit = equicorr_emit(d, a, b)

        def value(i, p):
            with np.errstate(all="ignore"):
                return -latent_many.ou_emitted(emit, n, i, p, FINE)

        x0 = np.stack([np.full(len(x), 5.0), x, np.ones(len(x))], 1)
        best = batches.bfgs_many(value, x0, (1e-2, -10.0, 1e-2), (200.0, 20.0, 20.0), tol=1e-4, most=most)
        return [{"method": "scar-tm-ou", "log_likelihood": -o.value, **dict(zip(("kappa", "mu", "nu"), map(float, o.x)))} for o in best]

    return _equicorr_many(series, fit)


def posterior_weights(e: Emission, params: dict) -> tuple[np.ndarray, np.ndarray]:
    """Parameter values and smoothed weights of each row under a latent fit."""
    g = latent.ou_grid(params["kappa"], params["mu"], params["nu"], e.n)
    return e.link.forward(num, g.x), latent.smooth(g, grid_emissions(e, g))


def tau_correlation(u: np.ndarray, shrink: float | None = None) -> np.ndarray:
    d = u.shape[1]
    m = np.eye(d)
    for i in range(d):
        for j in range(i):
            m[i, j] = m[j, i] = np.sin(np.pi / 2 * kendall_tau(u[:, i], u[:, j]))
    m = nearest_correlation(m)
    return m if shrink is None else shrink_correlation(m, shrink)


def fit_series(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str], model: str = "equicorr", method: str = "scar-tm-ou") -> DataFrame:
    """``by, method, log_likelihood, params`` of each series; ``model`` is equicorr or student (correlation from tau)."""
    if model not in ("equicorr", "student"):
        raise ValueError(f"unknown model {model!r}")

    def fits(series: list[np.ndarray]) -> list[dict]:
        if model == "equicorr" and method == "gas":
            return equicorr_gas_many(series)
        if model == "equicorr" and method == "scar-tm-ou":
            return equicorr_scar_many(series)
        return [fit_emission(equicorr_emission(u) if model == "equicorr" else student_emission(u, tau_correlation(u)), method) for u in series]

    def run(keys, series):
        return [[(method, got["log_likelihood"], {k: v for k, v in got.items() if k not in ("method", "log_likelihood")})] for got in fits(series)]

    return batches.map_series(df, columns, by, order, "method string, log_likelihood double, params map<string,double>", run)


# vines with moving edges
@dataclass(frozen=True)
class MovingEdge:
    edge: Edge
    method: str
    params: dict

    def path(self, u: np.ndarray, v: np.ndarray) -> tuple[latent.Grid | None, np.ndarray]:
        """The grid and predictive weights, or None and the parameter path."""
        c, p = self.edge.copula, self.params
        if self.method == "gas":
            g, _ = gas_path(c, u, v, (p["omega"], p["gamma"], p["beta"]))
            return None, c.base.link(c.link).forward(num, g)
        if self.method == "scar-tm-ou":
            grid = latent.ou_grid(p["kappa"], p["mu"], p["nu"], len(u))
        elif self.method == "scar-tm-jacobi":
            grid = latent.jacobi_grid(p["kappa"], p["m"], p["xi"], len(u))
        else:
            return None, np.full(len(u), p.get("r", 0.0))
        return grid, latent.forward(grid, latent.emissions(c, u, v, latent.parameters(c, grid))).predictive

    def h_pair(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """u given v and v given u at the predictive state of each row."""
        c = self.edge.copula
        grid, w = self.path(u, v)
        if grid is None:
            return c.h_pair(num, u, v, w)
        r = latent.parameters(c, grid)[None, :]
        a, b = c.h_pair(num, u[:, None], v[:, None], r)
        return (w * a).sum(1), (w * b).sum(1)


@dataclass
class _Partial:
    """A vine that has grown up to some tree."""

    values: dict
    below: list[Edge]
    edges: list[MovingEdge]
    leads: bool = True  # the given variables are a vine of their own in it, so they can come first

    @property
    def score(self) -> float:
        return sum(m.edge.log_likelihood for m in self.edges)


#: What an edge among given variables counts more than its |tau|: before all others, somewhat, not.
BONUSES = (2.0, 0.25, 0.0)


def _growth(
    u: np.ndarray, structure: str | Vine = "r", method: str = "mle", truncation: int | None = None, threshold: float = 0.0, min_log_likelihood: float | None = None,
    given: Sequence[int] = (), width: int = 4,
) -> list[MovingEdge]:
    """The growth of :func:`fit_vine`: yields lists of (left, right, tau) and is sent (copula, method, params, log-likelihood) of each."""
    d, want = u.shape[1], frozenset(given)
    shape = structure if isinstance(structure, Vine) else {"c": c_vine, "d": d_vine}.get(structure, lambda _: None)(d)
    fits: dict = {}

    def fitted(wanted: list[tuple[Edge, np.ndarray, np.ndarray, float]], level: int):
        """Edges and their conditional values, new ones fitted together."""
        new = {(e.key, id(a), id(b)): (e, a, b, tau) for e, a, b, tau in wanted if (e.key, id(a), id(b)) not in fits}
        ask = {k: v for k, v in new.items() if not (truncation is not None and level >= truncation) and abs(v[3]) >= threshold}
        got = dict(zip(ask, (yield [v[1:] for v in ask.values()]) if ask else ()))
        for k, (e, a, b, tau) in new.items():
            copula, how, params, ll = got.get(k, (Copula("independence"), "mle", {}, 0.0))
            if min_log_likelihood is not None and copula.family != "independence" and ll < min_log_likelihood:
                copula, how, params, ll = Copula("independence"), "mle", {}, 0.0
            edge = MovingEdge(Edge(e.a, e.b, e.cond, copula, params.get("r", 0.0), tau, ll), how, params)
            fits[k] = edge, edge.h_pair(a, b)
            held.extend((a, b))
        return [fits[(e.key, id(a), id(b))] for e, a, b, _ in wanted]

    held: list[np.ndarray] = []  # arrays whose identity is a key stay alive
    beam = [_Partial({(i, frozenset()): u[:, i] for i in range(d)}, [], [])]
    for i in range(d):
        held.append(beam[0].values[(i, frozenset())])
    for level in range(d - 1):
        grown: dict = {}
        for part in beam:
            pool = [(i, j, Edge(i, j)) for i in range(d) for j in range(i + 1, d)] if level == 0 else next_candidates(part.below)
            if shape is not None:
                wanted = {(frozenset((e.a, e.b)), e.cond) for e in shape.tree(level)}
                pool = [k for k in pool if (frozenset((k[2].a, k[2].b)), k[2].cond) in wanted]
            taus = {k[2]: kendall_tau(part.values[(k[2].a, k[2].cond)], part.values[(k[2].b, k[2].cond)]) for k in pool}
            for bonus in BONUSES if want and shape is None else (0.0,):
                weighted = [(abs(taus[e]) + bonus * (e.variables <= want), i, j, e) for i, j, e in pool]
                tree = spanning_tree(weighted, d if level == 0 else len(part.below), d - 1 - level)
                mark = frozenset(m.edge.key for m in part.edges) | {e.key for e in tree}
                if mark in grown:
                    continue
                new = _Partial(dict(part.values), [], list(part.edges), part.leads and sum(e.variables <= want for e in tree) == max(0, len(want) - 1 - level))
                edges = yield from fitted([(e, part.values[(e.a, e.cond)], part.values[(e.b, e.cond)], taus[e]) for e in tree], level)
                for e, (edge, (h_ab, h_ba)) in zip(tree, edges):
                    new.edges.append(edge)
                    new.below.append(edge.edge)
                    new.values[(e.a, e.cond | {e.b})], new.values[(e.b, e.cond | {e.a})] = h_ab, h_ba
                grown[mark] = new
        ranked = sorted(grown.values(), key=lambda p: -p.score)
        beam = ranked[:width]
        if not any(p.leads for p in beam):
            beam[-1:] = [p for p in ranked if p.leads][:1] or beam[-1:]
    return min(beam, key=lambda p: (not p.leads, -p.score)).edges


def _edges_many(asked: list[tuple[np.ndarray, np.ndarray, float]], method: str) -> list[tuple]:
    """Family by AIC and fit by ``method`` of each pair; each family's pairs are fitted side by side."""
    pairs = [(a, b) for a, b, _ in asked]
    top = select_many(pairs, [t for _, _, t in asked])
    out: list = [(Copula("independence"), "mle", {}, 0.0)] * len(pairs)
    alike: dict = {}
    for i, t in enumerate(top):
        if t["family"] != "independence":
            c = Copula(t["family"], t["rotation"])
            how = "mle" if method == "scar-tm-jacobi" and not c.base.positive else method
            if how == "mle":
                out[i] = c, how, t["params"], t["log_likelihood"]
            else:
                alike.setdefault((c, how), []).append(i)
    for (c, how), which in alike.items():
        for i, got in zip(which, fit_many(c, [pairs[i] for i in which], how)):
            out[i] = c, how, got["params"], got["log_likelihood"]
    return out


def fit_vine_many(series: Sequence[np.ndarray], structure: str | Vine = "r", method: str = "mle", *args, **kw) -> list[list[MovingEdge]]:
    """:func:`fit_vine` of each series: all vines grow together, so that pairs of many series are fitted side by side."""
    out: list = [None] * len(series)
    growing = {i: _growth(u, structure, method, *args, **kw) for i, u in enumerate(series)}
    answers: dict = dict.fromkeys(growing)
    while growing:
        asked = {}
        for i in list(growing):
            try:
                asked[i] = growing[i].send(answers[i])
            except StopIteration as stop:
                out[i] = stop.value
                del growing[i]
        flat = _edges_many([q for i in asked for q in asked[i]], method)
        answers, at = {}, 0
        for i, q in asked.items():
            answers[i] = flat[at : at + len(q)]
            at += len(q)
    return out


def fit_vine(
    u: np.ndarray, structure: str | Vine = "r", method: str = "mle", truncation: int | None = None, threshold: float = 0.0, min_log_likelihood: float | None = None,
    given: Sequence[int] = (), width: int = 4,
) -> list[MovingEdge]:
    """Tree by tree in one series: families by AIC, edges by ``method``; edges under the threshold, beyond the
    truncation or of too small a likelihood are independent.

    With ``given`` variables the structure is searched: each tree is grown with three preferences for edges among
    them, the ``width`` likeliest partial vines go on, one in which the given variables can come first among them,
    and the likeliest of those wins.
    """
    return fit_vine_many([u], structure, method, truncation, threshold, min_log_likelihood, given, width)[0]


def fit_vines(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str], structure: str = "r", method: str = "mle", truncation: int | None = None) -> DataFrame:
    """One row an edge and series: ``by, tree, a, b, cond, family, rotation, tau, log_likelihood, method, params``."""

    def run(keys, series):
        return [
            [(len(m.edge.cond), m.edge.a, m.edge.b, sorted(m.edge.cond), m.edge.copula.family, m.edge.copula.rotation, m.edge.tau, m.edge.log_likelihood, m.method, m.params) for m in edges]
            for edges in fit_vine_many(series, structure, method, truncation)
        ]

    return batches.map_series(df, columns, by, order, "tree int, a int, b int, cond array<int>, family string, rotation int, tau double, log_likelihood double, method string, params map<string,double>", run)
