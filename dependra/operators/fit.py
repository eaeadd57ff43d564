"""Estimation: static maximum likelihood, score-driven and latent models, family selection.

Groups are fitted side by side, one task a group (:func:`fit`). One large table is fitted by scans that
evaluate many parameters at once (:func:`fit_large`), so the number of passes is small and fixed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as s
from ..functions.backend import col, num
from ..functions.families import FAMILIES, Copula
from . import batches, latent, latent_many
from .aggregates import kendall_tau, log_pdf
from .optimize import golden, projected_bfgs
from .recursions import gas_likelihoods, gas_series

#: The row that every fit returns.
RESULT = (
    "method string, family string, rotation int, log_likelihood double, n_params int, n long, params map<string,double>, "
    "success boolean, nfev int, message string, aic double, bic double"
)
METHODS = ("mle", "gas", "scar-tm-ou", "scar-tm-jacobi", "scar-p-ou", "scar-m-ou")
TOP = {"clayton": 60.0, "frank": 80.0, "gumbel": 40.0, "joe": 40.0}
SCAR_BOUNDS = ((1e-2, -10.0, 1e-2), (200.0, 10.0, 20.0))


def check_method(method: str, copula: Copula) -> None:
    """Which methods fit which models; refused before any job runs."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {METHODS}")
    if copula.family == "independence" and method != "mle":
        raise ValueError("independence has no parameter to move")
    if method == "scar-tm-jacobi" and not copula.base.positive:
        raise ValueError("a Jacobi process moves tau in (0, 1); the family must model one sign of dependence")


def _result(method, copula, ll, params, n, success, nfev, message) -> dict:
    k = len(params)
    return dict(
        method=method, family=copula.family, rotation=copula.rotation, log_likelihood=float(ll), n_params=k, n=int(n), params={a: float(b) for a, b in params.items()},
        success=bool(success), nfev=int(nfev), message=message, aic=2 * k - 2 * ll, bic=k * float(np.log(max(n, 1))) - 2 * ll,
    )


def _bounds(copula: Copula) -> tuple[float, float]:
    f = copula.base
    return f.lower, min(f.upper, TOP.get(copula.family, f.upper))


def mle(copula: Copula, u, v) -> dict:
    if copula.family == "independence" or len(u) == 0:
        return _result("mle", copula, 0.0, {}, len(u), True, 0, "no parameter")
    lo, hi = _bounds(copula)
    f = lambda r: -float(np.sum(copula.log_pdf(num, u, v, r)))
    # the best of a coarse grid brackets the optimum
    grid = np.linspace(lo, hi, 25) if copula.family == "gaussian" else lo + np.geomspace(1e-3, hi - lo, 25)
    values = [f(r) for r in grid]
    i = int(np.argmin(values))
    best = golden(f, grid[i - 1] if i else lo, grid[min(24, i + 1)])
    return _result("mle", copula, -best.value, {"r": best.x[0]}, len(u), best.success, best.evaluations + 25, best.message)


def gas(copula: Copula, u, v, scaling: str = "unit") -> dict:
    start = copula.base.link(copula.link).inverse(num, np.float64(max(mle(copula, u, v)["params"]["r"], copula.base.lower + 1e-3)))
    many = lambda p: -gas_likelihoods(copula, u, v, p, scaling)
    grid = np.array([(float(start) * (1 - b), g, b) for b in (0.5, 0.8, 0.95) for g in (0.02, 0.1, 0.3)])
    first = grid[int(np.nanargmin(many(grid)))]
    best = projected_bfgs(lambda p: many(p[None, :])[0], first, (-10.0, -5.0, -0.999), (10.0, 5.0, 0.999), tol=1e-4, most=25, many=many)
    return _result("gas", copula, -best.value, dict(zip(("omega", "gamma", "beta"), best.x)), len(u), best.success, best.evaluations + 9, best.message)


def mle_many(copula: Copula, pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """:func:`mle` of each pair."""
    out: list = [None] * len(pairs)
    for k in batches.alike([len(u) for u, _ in pairs]):
        if copula.family == "independence" or not len(pairs[k[0]][0]):
            for j in k:
                out[j] = mle(copula, *pairs[j])
            continue
        (u, real), (v, _) = (batches.padded([pairs[j][side] for j in k]) for side in (0, 1))
        f = lambda i, r: -np.where(real[i], copula.log_pdf_grid(u[i], v[i], r[:, None]), 0.0).sum(1)
        lo, hi = _bounds(copula)
        grid = np.linspace(lo, hi, 25) if copula.family == "gaussian" else lo + np.geomspace(1e-3, hi - lo, 25)
        every = np.arange(len(k))
        at = np.argmin([f(every, np.full(len(k), r)) for r in grid], axis=0)
        best = batches.golden_many(f, np.where(at > 0, grid[at - 1], lo), grid[np.minimum(24, at + 1)])
        for j, b in zip(k, best):
            out[j] = _result("mle", copula, -b.value, {"r": b.x[0]}, len(pairs[j][0]), b.success, b.evaluations + 25, b.message)
    return out


def gas_many(copula: Copula, pairs: Sequence[tuple[np.ndarray, np.ndarray]], scaling: str = "unit") -> list[dict]:
    """:func:`gas` of each pair."""
    first = np.array([m["params"].get("r", copula.base.lower) for m in mle_many(copula, pairs)])
    start = np.asarray(copula.base.link(copula.link).inverse(num, np.maximum(first, copula.base.lower + 1e-3)), float)
    out: list = [None] * len(pairs)
    for k in batches.alike([len(u) for u, _ in pairs]):
        if not len(pairs[k[0]][0]):
            for j in k:
                out[j] = gas(copula, *pairs[j], scaling)
            continue
        n = np.array([len(pairs[j][0]) for j in k])
        u, v = (batches.padded([pairs[j][side] for j in k])[0].T.copy() for side in (0, 1))
        f = lambda i, p: -gas_series(copula, u, v, n, i, p, scaling)
        b, g = np.repeat((0.5, 0.8, 0.95), 3), np.tile((0.02, 0.1, 0.3), 3)
        grid = np.stack([start[k][:, None] * (1 - b), np.broadcast_to(g, (len(k), 9)), np.broadcast_to(b, (len(k), 9))], 2)
        value = f(np.repeat(np.arange(len(k)), 9), grid.reshape(-1, 3)).reshape(-1, 9)
        x0 = grid[np.arange(len(k)), np.argmin(np.where(np.isnan(value), np.inf, value), 1)]
        for j, best in zip(k, batches.bfgs_many(f, x0, (-10.0, -5.0, -0.999), (10.0, 5.0, 0.999), tol=1e-4, most=25)):
            out[j] = _result("gas", copula, -best.value, dict(zip(("omega", "gamma", "beta"), best.x)), len(pairs[j][0]), best.success, best.evaluations + 9, best.message)
    return out


def fit_many(copula: Copula, pairs: Sequence[tuple[np.ndarray, np.ndarray]], method: str = "scar-tm-ou", seeds: Sequence[int] | None = None) -> list[dict]:
    """:func:`fit_arrays` of each pair, side by side where the method allows it."""
    check_method(method, copula)
    if method == "mle":
        return mle_many(copula, pairs)
    if method == "gas":
        return gas_many(copula, pairs)
    if method == "scar-tm-ou":
        return scar_ou_many(copula, pairs)
    if method == "scar-tm-jacobi":
        return scar_jacobi_many(copula, pairs)
    return [fit_arrays(copula, u, v, method, 0 if seeds is None else seeds[i]) for i, (u, v) in enumerate(pairs)]


def scar_ou(copula: Copula, u, v, kind: str = "scar-p-ou", seed: int = 0, paths: int = 200) -> dict:
    """Ornstein-Uhlenbeck fits by simulated paths."""
    r = max(mle(copula, u, v)["params"]["r"], copula.base.lower + 1e-3)
    mu = float(copula.base.link(copula.link).inverse(num, np.float64(r)))
    draws = np.random.default_rng(seed).standard_normal((paths, len(u)))
    draws[1::2] = -draws[: 2 * (paths // 2) : 2]  # antithetic
    value = {
        "scar-p-ou": lambda p: latent.mc_log_likelihood(copula, u, v, p, draws),
        "scar-m-ou": lambda p: latent.eis_log_likelihood(copula, u, v, p, draws, 3),
    }[kind]
    best = projected_bfgs(lambda p: -value(p), (5.0, mu, 1.0), *SCAR_BOUNDS, most=40)
    return _result(kind, copula, -best.value, dict(zip(("kappa", "mu", "nu"), best.x)), len(u), best.success, best.evaluations, best.message)


def scar_ou_many(copula: Copula, pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """Latent Ornstein-Uhlenbeck fits of each pair."""
    r = np.array([max(m["params"].get("r", copula.base.lower), copula.base.lower + 1e-3) for m in mle_many(copula, pairs)])
    mu = np.asarray(copula.base.link(copula.link).inverse(num, r), float)
    start = np.stack([np.full(len(r), 5.0), mu, np.ones(len(r))], 1)
    return _latent_many("scar-tm-ou", latent_many.ou_log_likelihoods, copula, pairs, start, SCAR_BOUNDS, ("kappa", "mu", "nu"))


def scar_jacobi_many(copula: Copula, pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """Latent Jacobi fits of each pair."""
    m = np.array([min(0.95, max(0.05, copula.sign * kendall_tau(u, v))) for u, v in pairs])
    start = np.stack([np.full(len(m), 5.0), m, np.full(len(m), 0.5)], 1)
    return _latent_many("scar-tm-jacobi", latent_many.jacobi_log_likelihoods, copula, pairs, start, ((1e-3, 0.01, 1e-2), (100.0, 0.99, 5.0)), ("kappa", "m", "xi"))


def _latent_many(method: str, likelihoods, copula: Copula, pairs, start: np.ndarray, bounds, names) -> list[dict]:
    out: list = [None] * len(pairs)
    for k in batches.alike([len(u) for u, _ in pairs]):
        n = np.array([len(pairs[j][0]) for j in k])
        u, v = (batches.padded([pairs[j][side] for j in k])[0] for side in (0, 1))

        def value(i, p):
            with np.errstate(all="ignore"):
                return -likelihoods(copula, u, v, n, i, p)

        for j, best in zip(k, batches.bfgs_many(value, start[k], *bounds, most=40)):
            out[j] = _result(method, copula, -best.value, dict(zip(names, best.x)), len(pairs[j][0]), best.success, best.evaluations, best.message)
    return out


def fit_arrays(copula: Copula, u, v, method: str = "scar-tm-ou", seed: int = 0) -> dict:
    check_method(method, copula)
    u, v = np.asarray(u, float), np.asarray(v, float)
    if method == "mle":
        return mle(copula, u, v)
    if method == "gas":
        return gas(copula, u, v)
    if method == "scar-tm-ou":
        return scar_ou_many(copula, [(u, v)])[0]
    if method == "scar-tm-jacobi":
        return scar_jacobi_many(copula, [(u, v)])[0]
    return scar_ou(copula, u, v, method, seed)


def fit(df: DataFrame, copula: Copula, u: str, v: str, by: Sequence[str], order: Sequence[str], method: str = "scar-tm-ou", seed: int = 0) -> DataFrame:
    """One result row a group. Groups are series or windows of bounded length; many are one task's work.

    Random draws are seeded from the root seed and the group's key, never from a partition.
    """
    check_method(method, copula)
    names = [f.strip().rsplit(" ", 1)[0] for f in RESULT.split(", ")]

    def run(keys, series):
        seeds = [np.random.SeedSequence([seed, *repr(k).encode()]).generate_state(1)[0] for k in keys]
        return [[tuple(got[c] for c in names)] for got in fit_many(copula, [(x[:, 0], x[:, 1]) for x in series], method, seeds)]

    return batches.map_series(df, [u, v], by, order, RESULT, run)


def _search(copula: Copula, points: int, passes: int):
    """Yields parameters and is sent their log-likelihoods; returns the best, its log-likelihood, and whether it lies inside the bounds."""
    lo, hi = _bounds(copula)
    grid = np.linspace(lo, hi, points) if copula.family == "gaussian" else np.append(lo, lo + np.geomspace(1e-3, hi - lo, points - 1))
    ends = grid[0], grid[-1]
    values = yield grid
    for _ in range(passes - 1):
        i = int(np.argmax(values))
        grid = np.linspace(grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)], points)
        values = yield grid
    i = int(np.argmax(values))
    r, ll = float(grid[i]), float(values[i])
    if 0 < i < points - 1:
        left, mid, right = values[i - 1 : i + 2]
        bend = left - 2 * mid + right
        if bend < 0:
            top = r + 0.5 * (left - right) / bend * (grid[1] - grid[0])
            best = (yield [top])[0]
            if best >= ll:
                r, ll = float(top), float(best)
    return r, ll, ends[0] < r < ends[1]


def _found(copula: Copula, found: tuple[float, float, bool], n: int, passes: int) -> dict:
    r, ll, inside = found
    return _result("mle", copula, ll, {"r": r}, n, math.isfinite(ll), passes + 1, "bracket is small" if inside else "at a bound")


def fit_large(df: DataFrame, copula: Copula, u: str, v: str, points: int = 17, passes: int = 4) -> dict:
    """Maximum likelihood over a table of any size: each scan sums the likelihood at ``points`` parameters and narrows
    the bracket; the last is finished by the parabola through its best three points and one more scan.

    The pairs are kept for the scans, on disk where memory is short. The
    message says whether the best parameter lies at one of the family's bounds."""
    if copula.family == "independence":
        return _result("mle", copula, 0.0, {}, df.count(), True, 1, "no parameter")
    pair = df.select(F.col(u).alias("__u"), F.col(v).alias("__v"))
    value = lambda r: log_pdf(copula, "__u", "__v", float(r))
    if copula.family == "gaussian":  # the scores are columns of their own, not repeated in every candidate
        pair = pair.select(s.norm_ppf(col, F.col("__u")).alias("__u"), s.norm_ppf(col, F.col("__v")).alias("__v"))
        value = lambda r: copula.base.log_pdf_scores(col, F.col("__u"), F.col("__v"), F.lit(float(r)))
    pair = pair.persist()
    search = _search(copula, points, passes)
    grid, found, n = next(search), None, 0
    while found is None:
        row = pair.agg(*[F.sum(value(r)).alias(f"s{i}") for i, r in enumerate(grid)], F.count(F.lit(1)).alias("n")).first()
        n = row["n"]
        if n == 0:
            break
        try:
            grid = search.send([row[f"s{i}"] for i in range(len(grid))])
        except StopIteration as stop:
            found = stop.value
    pair.unpersist()
    return _found(copula, found, n, passes) if found else _result("mle", copula, 0.0, {}, 0, False, 1, "no rows")


SLICE = 2048  #: rows whose likelihoods at all parameters are evaluated together


def likelihoods(df: DataFrame, asked: Sequence[tuple[Copula, str, str, Sequence[float] | None]]) -> tuple[int, list[np.ndarray]]:
    """Rows, and the sums of the log-density of each (copula, u, v, parameters): one scan for all, in arrays.

    Without parameters, for a Gaussian copula, the sums that give any: rows, squares and products of the normal scores.
    Rows where a side is null do not count in sums.
    """
    columns = sorted({c for k in asked for c in k[1:3]})
    plan = [(c, columns.index(u), columns.index(v), None if r is None else np.asarray(r, float)) for c, u, v, r in asked]
    size = [3 if r is None else len(r) for *_, r in plan]

    def scan(batches):
        n, sums = 0, [np.zeros(k) for k in size]
        for b in batches:
            n += b.num_rows
            data = [b.column(i) for i in range(len(columns))]
            live = [c.is_valid().to_numpy(zero_copy_only=False) if c.null_count else None for c in data]
            data = [c.to_numpy(zero_copy_only=False) for c in data]
            for total, (c, i, j, r) in zip(sums, plan):
                u, v = data[i], data[j]
                if live[i] is not None or live[j] is not None:
                    keep = np.logical_and(*(np.ones(b.num_rows, bool) if live[k] is None else live[k] for k in (i, j)))
                    u, v = u[keep], v[keep]
                if r is None:
                    x, y = (s.norm_ppf(num, s.clip(num, k)) for k in (u, v))
                    total += (len(u), (x * x + y * y).sum(), (x * y).sum())
                    continue
                for k in range(0, len(u), SLICE):
                    with np.errstate(all="ignore"):
                        total += c.log_pdf_grid(u[k : k + SLICE, None], v[k : k + SLICE, None], r[None, :]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate(sums)], pa.list_(pa.float64()))], ["n", "sums"])

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(scan, "n long, sums array<double>").collect()
    total = np.array([r["sums"] for r in rows], float).reshape(len(rows), sum(size)).sum(0)
    return sum(r["n"] for r in rows), np.split(total, np.cumsum(size)[:-1])


def fit_large_many(df: DataFrame, asked: Sequence[tuple[Copula, str, str]], points: int = 17, passes: int = 4) -> list[dict]:
    """:func:`fit_large` of several copulas and pairs of columns together: each scan serves all of them. ``df`` should be kept.

    A Gaussian likelihood at any parameter follows from sums of the first scan.
    """
    out: list = [None] * len(asked)
    searches = {k: _search(c, points, passes) for k, (c, _, _) in enumerate(asked) if c.family != "independence"}
    grids = {k: next(g) for k, g in searches.items()}
    moments: dict = {}

    def gaussian(k: int, r) -> np.ndarray:
        m, squares, product = moments[k]
        r = np.asarray(r, float)
        return -0.5 * m * np.log(1.0 - r * r) - 0.5 * (r * r * squares - 2.0 * r * product) / (1.0 - r * r)

    n = None
    while grids or n is None:
        ask = [k for k in grids if k not in moments]
        if ask or n is None:
            normal = [asked[k][0].family == "gaussian" for k in ask]
            n, sums = likelihoods(df, [(*asked[k], None if g else grids[k]) for k, g in zip(ask, normal)]) if ask else (df.count(), [])
            moments |= {k: v for k, v, g in zip(ask, sums, normal) if g}
            got = {k: v for k, v, g in zip(ask, sums, normal) if not g}
        else:
            got = {}
        for k in list(grids):
            if n == 0:
                out[k] = _result("mle", asked[k][0], 0.0, {}, 0, False, 1, "no rows")
                del grids[k]
                continue
            try:
                grids[k] = searches[k].send(got[k] if k in got else gaussian(k, grids[k]))
            except StopIteration as stop:
                out[k] = _found(asked[k][0], stop.value, n, passes)
                del grids[k]
    return [_result("mle", c, 0.0, {}, n, True, 1, "no parameter") if o is None else o for o, (c, _, _) in zip(out, asked)]


def candidates(tau: float, families: Sequence[str] = tuple(FAMILIES)) -> list[Copula]:
    """Rotations that agree with the sign of tau, or all when it is weak."""
    out = [Copula(f, rot) for f in families for rot in FAMILIES[f].rotations]
    return [c for c in out if abs(tau) < 0.15 or not c.base.positive or c.sign == (1 if tau >= 0 else -1)]


def select_arrays(u, v, families: Sequence[str] = tuple(FAMILIES), keep: int = 3) -> dict:
    """Screen all candidates at their inverse-tau parameter, refine the best by maximum likelihood, compare AIC."""
    tau = kendall_tau(u, v)
    pool = candidates(tau, families)
    screened = sorted(pool, key=lambda c: -float(np.sum(c.log_pdf(num, u, v, c.start(tau)))))[:keep]
    fitted = [mle(c, u, v) for c in screened] + [mle(Copula("independence"), u, v)]
    return min(fitted, key=lambda r: r["aic"])


def select_many(pairs: Sequence[tuple[np.ndarray, np.ndarray]], taus: Sequence[float], families: Sequence[str] = tuple(FAMILIES), keep: int = 3) -> list[dict]:
    """:func:`select_arrays` of pairs whose taus are known: a family's pairs are refined side by side."""
    chosen: dict = {}
    for k in batches.alike([len(u) for u, _ in pairs]):
        (u, real), (v, _) = (batches.padded([pairs[j][side] for j in k]) for side in (0, 1))
        pools = [candidates(taus[j], families) for j in k]
        score: dict = {}
        for c in dict.fromkeys(c for p in pools for c in p):
            i = np.array([a for a, p in enumerate(pools) if c in p])
            r = c.starts(np.array([taus[k[a]] for a in i]))
            for a, x in zip(i, np.where(real[i], c.log_pdf(num, u[i], v[i], r[:, None]), 0.0).sum(1)):
                score[(a, c)] = float(x)
        for a, p in enumerate(pools):
            for c in sorted(p, key=lambda c: -score[(a, c)])[:keep]:
                chosen.setdefault(c, []).append(int(k[a]))
    fitted: list = [[] for _ in pairs]
    for c, which in chosen.items():
        for j, got in zip(which, mle_many(c, [pairs[j] for j in which])):
            fitted[j].append(got)
    return [min([*f, mle(Copula("independence"), *pairs[j])], key=lambda r: r["aic"]) for j, f in enumerate(fitted)]


def select_family(df: DataFrame, u: str, v: str, by: Sequence[str], families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    """The best family of each group, as a result row."""
    keys = [f for f in df.schema if f.name in by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{k.name: pdf[k.name].iloc[0] for k in keys}, **select_arrays(pdf[u].to_numpy(float), pdf[v].to_numpy(float), families)}])

    return df.groupBy(*by).applyInPandas(run, ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in keys) + ", " + RESULT)
