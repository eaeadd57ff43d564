"""Draws and forecasts of vines and Student copulas whose parameters move.

Paths of a vine with score-driven edges are recursions over rows: many paths advance side by side as arrays, and
batches of paths are the unit of parallelism. Forecasts start from each edge's state after a series' history.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.backend import num
from . import batches, latent
from .dynamic import Emission, MovingEdge, fit_emission, fit_vine_many, gas_filter, grid_emissions, student_emission, tau_correlation
from .multivariate import DF_BOUNDS, sample_correlated, student_log_pdf
from .optimize import golden
from .recursions import SCORE_BOUND, STATE_BOUND, gas_path, gas_start, gas_update
from .sample import predictive_state
from .vine import Values, Vine, _sample, sample_arrays, sample_mcmc


def _vine(edges: Sequence[MovingEdge]) -> Vine:
    return Vine(1 + max(max(m.edge.a, m.edge.b) for m in edges), tuple(sorted((m.edge for m in edges), key=lambda e: len(e.cond))))


def _link(m: MovingEdge):
    return m.edge.copula.base.link(m.edge.copula.link)


def _gas(m: MovingEdge) -> tuple[float, float, float]:
    return m.params["omega"], m.params["gamma"], m.params["beta"]


def _own_path(m: MovingEdge, n: int, count: int, rng: np.random.Generator) -> np.ndarray:
    """Parameters of a latent edge, which do not depend on what is drawn: count x n."""
    c, p = m.edge.copula, m.params
    if m.method == "scar-tm-jacobi":
        return np.array([[c.start(c.sign * t) for t in latent.jacobi_euler(p["kappa"], p["m"], p["xi"], n, rng)] for _ in range(count)])
    return _link(m).forward(num, latent.ou_paths(p["kappa"], p["mu"], p["nu"], n, rng.standard_normal((count, n))))


def sample_paths(edges: Sequence[MovingEdge], n: int, count: int, rng: np.random.Generator, uniforms: np.ndarray | None = None) -> np.ndarray:
    """``count`` new paths of ``n`` rows (count x n x d), from ``uniforms`` of that shape or new ones.

    Score-driven edges start at their stationary state and are updated by the pair that each drawn row holds for
    them; latent edges follow paths of their own; all others stand still.
    """
    vine = _vine(edges).complete()
    w = rng.uniform(size=(count, n, vine.d)) if uniforms is None else uniforms
    moving = [m for m in edges if m.edge.copula.family != "independence" and m.method != "mle"]
    own = {m.edge.key: _own_path(m, n, count, rng) for m in moving if m.method != "gas"}
    driven = [m for m in moving if m.method == "gas"]
    if not driven:
        return sample_arrays(vine, w.reshape(count * n, -1), r={k: x.ravel() for k, x in own.items()}).reshape(count, n, -1)
    order, out = vine.order(), np.empty((count, n, vine.d))
    state = {m.edge.key: np.full(count, gas_start(m.params["omega"], m.params["beta"])) for m in driven}
    for t in range(n):
        r = {k: x[:, t] for k, x in own.items()}
        r |= {m.edge.key: _link(m).forward(num, state[m.edge.key]) for m in driven}
        values = Values(vine, num, {}, r)
        _sample(values, order, {i: w[:, t, i] for i in range(vine.d)}, {})
        for i in range(vine.d):
            out[:, t, i] = values.known[(i, frozenset())]
        for m in driven:
            e = m.edge
            state[e.key] = gas_update(num, e.copula, values.get(e.a, e.cond), values.get(e.b, e.cond), state[e.key], *_gas(m))
    return out


def sample_moving(spark: SparkSession, edges: Sequence[MovingEdge], n: int, count: int, seed: int = 0, batch: int = 512) -> DataFrame:
    """``path, t, x0 ..``: new paths. A path's draws depend on the seed and its batch, not on partitions or retries."""
    edges = list(edges)
    d = _vine(edges).d

    def draw(batches):
        for pdf in batches:
            for k in pdf.id:
                size = int(min(batch, count - k * batch))
                x = sample_paths(edges, n, size, np.random.default_rng(np.random.SeedSequence([seed, int(k)])))
                for j in range(size):
                    yield pd.DataFrame({"path": k * batch + j, "t": np.arange(n), **{f"x{i}": x[j, :, i] for i in range(d)}})

    return spark.range(-(-count // batch)).mapInPandas(draw, "path long, t long, " + ", ".join(f"x{i} double" for i in range(d)))


def _history(edges: Sequence[MovingEdge], u: np.ndarray) -> dict:
    """The pair of values that each edge has seen in every row."""
    values = {(i, frozenset()): u[:, i] for i in range(u.shape[1])}
    seen = {}
    for m in sorted(edges, key=lambda k: len(k.edge.cond)):
        e = m.edge
        seen[e.key] = a, b = values[(e.a, e.cond)], values[(e.b, e.cond)]
        values[(e.a, e.cond | {e.b})], values[(e.b, e.cond | {e.a})] = m.h_pair(a, b)
    return seen


def _pick(w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One column for each row of weights."""
    c = np.cumsum(w, 1)
    return np.minimum((rng.uniform(size=(len(w), 1)) * c[:, -1:] > c).sum(1), w.shape[1] - 1)


def predict(edges: Sequence[MovingEdge], u: np.ndarray, n: int, rng: np.random.Generator, horizon: str = "next", given: dict[int, float] | None = None) -> tuple[np.ndarray, list[dict]]:
    """n draws after the history ``u`` and what became of each moving edge inside the ``given`` variables.

    An edge whose variables are all given has seen its pair: tree by tree, the weights of a latent state are
    multiplied by the pair's density in every draw (Bayes); a score-driven state of horizon "current" makes one
    step, one of "next" has made its step already and stays. Draws are exact where the given variables can
    come first in an order of the vine, and by Metropolis steps otherwise.
    """
    if horizon not in ("current", "next"):
        raise ValueError(f"unknown horizon {horizon!r}")
    given = {k: float(v) for k, v in (given or {}).items()}
    vine, seen, want = _vine(edges), _history(edges, u), frozenset(given)
    r, records = {}, []
    known = Values(vine.complete(tuple(given)), num, {(i, frozenset()): np.full(n, v) for i, v in given.items()}, r)
    for m in sorted(edges, key=lambda k: len(k.edge.cond)):
        e = m.edge
        if e.copula.family == "independence" or m.method == "mle":
            continue
        at, w = predictive_state(e.copula, m.params, m.method, *seen[e.key], horizon)
        inside, updated = e.variables <= want, False
        if m.method == "gas":
            r[e.key] = np.full(n, at[0])
            if inside and horizon == "current":
                g = np.full(n, gas_path(e.copula, *seen[e.key], _gas(m))[0][-1])
                r[e.key] = _link(m).forward(num, gas_update(num, e.copula, known.get(e.a, e.cond), known.get(e.b, e.cond), g, *_gas(m)))
                updated = True
        else:
            weights = np.broadcast_to(w, (n, len(w)))
            if inside:
                weights = weights * e.copula.pdf(num, known.get(e.a, e.cond)[:, None], known.get(e.b, e.cond)[:, None], at[None, :])
                updated = True
            r[e.key] = at[_pick(weights, rng)]
        if inside:
            records.append({"a": e.a, "b": e.b, "cond": sorted(e.cond), "method": m.method, "updated": updated, "before": float(at @ w / w.sum()), "after": float(r[e.key].mean())})
    order = vine.order(tuple(given))
    if order is not None and set(order[: len(given)]) == set(given):
        return sample_arrays(vine, rng.uniform(size=(n, vine.d)), given, r), records
    return sample_mcmc(vine, n, given, rng, r=r)[0], records


def predict_vines(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str], n: int, structure: str = "r", method: str = "mle",
    horizon: str = "next", given: dict[int, float] | None = None, truncation: int | None = None, seed: int = 0,
) -> DataFrame:
    """``by, draw, x0 ..``: a vine is fitted to each series and drawn from n times after it."""

    def run(keys, series):
        out = []
        for key, u, edges in zip(keys, series, fit_vine_many(series, structure, method, truncation, given=tuple(given or ()))):
            x, _ = predict(edges, u, n, np.random.default_rng(np.random.SeedSequence([seed, *repr(key).encode()])), horizon, given)
            out.append([(j, *r) for j, r in enumerate(x.tolist())])
        return out

    return batches.map_series(df, columns, by, order, "draw long, " + ", ".join(f"x{i} double" for i in range(len(columns))), run)


# Student copulas with moving degrees of freedom
def student_path(corr: np.ndarray, params: dict, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A new path of a latent fit: its degrees of freedom and one row at each."""
    link = student_emission(np.full((1, len(corr)), 0.5), corr).link
    x = latent.ou_paths(params["kappa"], params["mu"], params["nu"], n, rng.standard_normal((1, n)))[0]
    dof = np.clip(link.forward(num, x), *DF_BOUNDS)
    return dof, sample_correlated(n, corr, rng, dof)


def _student_state(e: Emission, params: dict, method: str, horizon: str) -> tuple[np.ndarray, np.ndarray]:
    if method == "mle":
        return np.array([params["r"]]), np.ones(1)
    if method == "gas":
        omega, gamma, beta = (params[k] for k in ("omega", "gamma", "beta"))
        g = gas_filter(e, (omega, gamma, beta))[0][-1]
        if horizon == "next":
            low, high = e.one(e.n - 1, e.link.forward(num, np.array([g - 1e-4, g + 1e-4])))
            g = np.clip(omega + beta * g + gamma * np.clip((high - low) / 2e-4, -SCORE_BOUND, SCORE_BOUND), -STATE_BOUND, STATE_BOUND)
        return np.array([float(e.link.forward(num, np.float64(g)))]), np.ones(1)
    grid = latent.ou_grid(params["kappa"], params["mu"], params["nu"], e.n)
    w = latent.forward(grid, grid_emissions(e, grid)).last
    return e.link.forward(num, grid.x), grid.push(w) if horizon == "next" else w


def student_predict(u: np.ndarray, corr: np.ndarray, params: dict, method: str, n: int, rng: np.random.Generator, horizon: str = "next", given: dict[int, float] | None = None) -> np.ndarray:
    """n rows after the history ``u``: degrees of freedom from the state's distribution, which two or more ``given`` values reweigh."""
    given = given or {}
    at, w = _student_state(student_emission(u, corr), params, method, horizon)
    at = np.clip(at, *DF_BOUNDS)
    if len(given) > 1:
        i = sorted(given)
        row = np.broadcast_to([given[k] for k in i], (len(at), len(i)))
        w = w * np.exp(student_log_pdf(row, np.asarray(corr)[np.ix_(i, i)], at))
    return sample_correlated(n, corr, rng, at[rng.choice(len(at), size=n, p=w / w.sum())], given)


def fit_student_shrunk(u: np.ndarray, method: str = "gas", tol: float = 0.02) -> dict:
    """Degrees of freedom (static or moving) together with the weight of the tau correlation against the identity, by profile likelihood."""
    base, eye = tau_correlation(u), np.eye(u.shape[1])
    best: dict = {}

    def loss(weight: float) -> float:
        nonlocal best
        corr = weight * base + (1.0 - weight) * eye
        got = fit_emission(student_emission(u, corr), method)
        if not best or got["log_likelihood"] > best["log_likelihood"]:
            best = {**got, "weight": float(weight), "correlation": corr}
        return -got["log_likelihood"]

    loss(1.0)
    golden(loss, 0.0, 1.0, tol)
    return best
