"""Portfolio losses, value at risk and expected shortfall."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.backend import num
from ..functions.families import Copula
from . import batches, marginals
from .fit import check_method, fit_many
from .sample import predictive_state

PLACES = 262_144  #: draws of windows that stand side by side


def portfolio_loss(returns: Sequence[str], weights: Sequence[float]) -> Column:
    """1 - sum of w_j exp(r_j)."""
    out = F.lit(1.0)
    for r, w in zip(returns, weights):
        out = out - float(w) * F.exp(F.col(r))
    return out


def cvar_objective(loss: str, q: float, gamma: float) -> Column:
    """Aggregate: q + E[(L - q)+] / (1 - gamma)."""
    return F.lit(float(q)) + F.avg(F.greatest(F.col(loss) - float(q), F.lit(0.0))) / (1.0 - gamma)


def var_cvar(df: DataFrame, loss: str, gamma: float, by: Sequence[str] = ()) -> DataFrame:
    """``var, cvar``: the left end of the minimisers of the objective is the discrete quantile; then one more aggregate."""
    q = df.groupBy(*by).agg(F.expr(f"percentile_disc({gamma}) WITHIN GROUP (ORDER BY `{loss}`)").alias("var"))
    met = df.join(q, list(by)) if by else df.crossJoin(F.broadcast(q))
    return met.groupBy(*by, "var").agg((F.max("var") + F.avg(F.greatest(F.col(loss) - F.col("var"), F.lit(0.0))) / (1.0 - gamma)).alias("cvar"))


def optimal_weights(returns: np.ndarray, gamma: float, rounds: int = 400) -> tuple[np.ndarray, float, float]:
    """Weights of least CVaR on the simplex by projected subgradients from equal weights; weights, VaR, CVaR."""
    n, d = returns.shape
    growth = np.exp(returns)
    w = np.full(d, 1.0 / d)
    best = (np.inf, w, 0.0)
    for k in range(rounds):
        loss = 1.0 - growth @ w
        q = np.sort(loss)[max(0, int(np.ceil(gamma * n)) - 1)]
        value = q + np.maximum(loss - q, 0).mean() / (1 - gamma)
        if value < best[0]:
            best = (value, w.copy(), q)
        tail = loss > q
        slope = -(growth[tail].sum(0) / n) / (1 - gamma) - (1 - tail.mean() / (1 - gamma)) * growth[np.argsort(loss)[max(0, int(np.ceil(gamma * n)) - 1)]]
        slope = slope - slope.mean()
        w = simplex(w - 0.5 / np.sqrt(k + 1.0) * slope / (np.linalg.norm(slope) + 1e-12))
    return best[1], float(best[2]), float(best[0])


def simplex(y: np.ndarray) -> np.ndarray:
    """The nearest point with non-negative entries that sum to one."""
    u = np.sort(y)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(y) + 1)
    k = np.nonzero(u > c)[0][-1]
    return np.maximum(y - c[k], 0.0)


def _generator(seed: int, key: tuple) -> np.random.Generator:
    """Of the root seed and a window's key; words as an array seed the same stream as a list of them, many times faster."""
    words = [seed, *repr(key).encode()]
    return np.random.default_rng(np.random.SeedSequence(np.array(words, np.uint32) if 0 <= seed < 2**32 else words))


def risk_metrics(
    windows: DataFrame, x: str, y: str, by: Sequence[str], order: Sequence[str], copula: Copula, marginal: str = "normal", method: str = "mle",
    gammas: Sequence[float] = (0.95,), draws: Sequence[int] = (1000,), weights: Sequence[float] | None = None, seed: int = 0,
) -> DataFrame:
    """``by, gamma, n_mc, var, cvar, w0, w1`` of each window (rows as of ``expand_windows``): marginals, ranks, fit, forecast, loss.

    Many windows stand side by side in a task, each with its own draws. ``weights`` None takes the weights of least CVaR.
    """
    marginals.resolve(marginal)
    check_method(method, copula)

    def side_by_side(keys, data: np.ndarray) -> list[list[tuple]]:
        """Windows of one length: windows x rows x 2."""
        n = data.shape[1]
        history = [np.ascontiguousarray(data[:, :, side]) for side in (0, 1)]
        fits = [marginals.fit_rows(marginal, d) for d in history]
        u, v = ((np.argsort(np.argsort(d, 1, kind="stable"), 1, kind="stable") + 1.0) / (n + 1.0) for d in history)
        got = fit_many(copula, list(zip(u, v)), method)
        states = [predictive_state(copula, f["params"], method, a, b) for f, a, b in zip(got, u, v)]
        rngs = [_generator(seed, tuple(k)) for k in keys]
        out: list = [[] for _ in keys]
        for m in draws:
            at, e = np.empty((len(keys), m)), np.empty((len(keys), 2, m))
            for j, (rng, (r, p)) in enumerate(zip(rngs, states)):
                if len(r) == 1:
                    rng.random(m)  # what the choice below takes from the stream
                    at[j] = r[0]
                else:
                    at[j] = r[rng.choice(len(r), size=m, p=p)]
                rng.random(out=e[j])
            a = copula.h_inv(num, e[:, 1], e[:, 0], at)
            ret = np.stack([marginals.ppf_rows(marginal, w, f, h) for w, f, h in zip((a, e[:, 0]), fits, history)], 2)
            if weights is not None:
                w = np.asarray(weights, float)
                loss = np.sort(1.0 - np.exp(ret) @ w, 1)
            for g in gammas:
                if weights is None:
                    for j, x in enumerate(ret):
                        own, q, c = optimal_weights(x, g)
                        out[j].append((float(g), int(m), q, c, float(own[0]), float(own[1])))
                    continue
                q = loss[:, max(0, int(np.ceil(g * m)) - 1)]
                c = q + np.maximum(loss - q[:, None], 0).mean(1) / (1 - g)
                for j, (x, y) in enumerate(zip(q.tolist(), c.tolist())):
                    out[j].append((float(g), int(m), x, y, float(w[0]), float(w[1])))
        return out

    def run(keys, series):
        out: list = [None] * len(series)
        size = max(1, PLACES // max(1, 2 * max(draws, default=1)))
        length = np.array([len(x) for x in series])
        for n in np.unique(length):
            k = np.flatnonzero(length == n)
            for begin in range(0, len(k), size):
                part = k[begin : begin + size]
                for j, got in zip(part, side_by_side([keys[j] for j in part], np.stack([series[j] for j in part]))):
                    out[j] = got
        return out

    return batches.map_series(windows, [x, y], by, order, "gamma double, n_mc long, var double, cvar double, w0 double, w1 double", run)
