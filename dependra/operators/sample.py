"""Draws and forecasts of pair copulas.

Uniforms come from a hash of (seed, row key, coordinate), so a row's draw depends neither on partitions nor
on retries; frailty draws run in Arrow batches seeded the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as s
from ..functions.backend import col, num
from ..functions.families import FAMILIES, Copula
from ..functions.special import gauss_hermite
from . import latent
from .recursions import gas_path

SCALE = 1 << 53


def uniform(seed: int, *keys, coordinate: int = 0) -> Column:
    """A uniform in (0, 1) of a row's keys."""
    h = F.xxhash64(F.lit(seed), F.lit(coordinate), *keys)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(SCALE)


def uniforms(spark: SparkSession, n: int, d: int, seed: int = 0) -> DataFrame:
    """``id, w0 ..``: n rows of d uniforms."""
    return spark.range(n).select("id", *[uniform(seed, "id", coordinate=i).alias(f"w{i}") for i in range(d)])


def sample_inverse(df: DataFrame, copula: Copula, r, first: str, second: str, u: str = "u", v: str = "v") -> DataFrame:
    """Pairs from two columns of uniforms: v is the first, u = h^-1(second; v)."""
    r = r if isinstance(r, Column) else F.lit(float(r))
    return df.withColumn(v, s.clip(col, F.col(first))).withColumn(u, copula.h_inv(col, F.col(second), F.col(first), r))


def sample_given(df: DataFrame, copula: Copula, r: float, w: str, given: dict[int, float], u: str = "u", v: str = "v") -> DataFrame:
    """Pairs with one coordinate fixed exactly, the other from a column of uniforms."""
    if set(given) == {0}:
        return df.withColumn(u, F.lit(float(given[0]))).withColumn(v, copula.transposed().h_inv(col, F.col(w), F.col(u), F.lit(r)))
    if set(given) == {1}:
        return df.withColumn(v, F.lit(float(given[1]))).withColumn(u, copula.h_inv(col, F.col(w), F.col(v), F.lit(r)))
    raise ValueError("one of coordinates 0 and 1 is to be given")


def sample_frailty(spark: SparkSession, n: int, copula: Copula, r: float, seed: int = 0, batch: int = 65_536) -> DataFrame:
    """``id, u, v`` by a common frailty: psi(E / V), for the Archimedean families."""
    if copula.family not in ("clayton", "frank", "gumbel", "joe"):
        raise ValueError(f"{copula.family} has no frailty")
    base = FAMILIES[copula.family]

    def draw(batches):
        for pdf in batches:
            for k in pdf.id:
                size = int(min(batch, n - k * batch))
                rng = np.random.default_rng(np.random.SeedSequence([seed, int(k)]))
                e = rng.exponential(size=(2, size)) / base.frailty(rng, r, size)
                a, b = (np.clip(base.psi(num, x, r), s.DRAW_EPS, 1 - s.DRAW_EPS) for x in e)
                a, b = copula.rotate(a, b)
                yield pd.DataFrame({"id": k * batch + np.arange(size), "u": a, "v": b})

    return spark.range(-(-n // batch)).mapInPandas(draw, "id long, u double, v double")


def sample_model(copula: Copula, params: dict, method: str, n: int, seed) -> np.ndarray:
    """A new path of a fitted model: its own latent states, then one pair at each."""
    rng = np.random.default_rng(seed)
    w = rng.uniform(size=(n, 2))
    link = copula.base.link(copula.link)
    if method == "mle":
        r = np.full(n, params.get("r", 0.0))
    elif method == "gas":
        g, r, out = params["omega"] / (1 - params["beta"]), np.empty(n), np.empty((n, 2))
        for t in range(n):
            r[t] = link.forward(num, np.float64(g))
            u = copula.h_inv(num, w[t, 1], w[t, 0], r[t])
            out[t] = u, w[t, 0]
            score = copula.score(num, u, w[t, 0], r[t]) * link.slope(num, np.float64(g))
            g = float(np.clip(params["omega"] + params["beta"] * g + params["gamma"] * np.clip(score, -100, 100), -50, 50))
        return out
    elif method == "scar-tm-jacobi":
        tau = latent.jacobi_euler(params["kappa"], params["m"], params["xi"], n, rng)
        r = np.array([copula.start(copula.sign * t) for t in tau])
    else:
        x = latent.ou_paths(params["kappa"], params["mu"], params["nu"], n, rng.standard_normal((1, n)))[0]
        r = link.forward(num, x)
    return np.column_stack([copula.h_inv(num, w[:, 1], w[:, 0], r), w[:, 0]])


def predictive_state(copula: Copula, params: dict, method: str, u, v, horizon: str = "next") -> tuple[np.ndarray, np.ndarray]:
    """Parameter values and weights of the state that a forecast starts from."""
    link = copula.base.link(copula.link)
    if method == "mle":
        return np.array([params.get("r", 0.0)]), np.ones(1)
    if method == "gas":
        g, _ = gas_path(copula, u, v, (params["omega"], params["gamma"], params["beta"]))
        last = float(g[-1])
        if horizon == "next":
            from .recursions import gas_update

            last = float(gas_update(num, copula, u[-1], v[-1], last, params["omega"], params["gamma"], params["beta"]))
        return np.array([float(link.forward(num, np.float64(last)))]), np.ones(1)
    if method == "scar-tm-jacobi":
        grid = latent.jacobi_grid(params["kappa"], params["m"], params["xi"], len(u))
    else:
        grid = latent.ou_grid(params["kappa"], params["mu"], params["nu"], len(u))
    _, w = latent.terminal(copula, grid, u, v, horizon)
    return latent.parameters(copula, grid), w / w.sum()


def stationary_state(copula: Copula, kappa: float, mu: float, nu: float, order: int = 32) -> tuple[np.ndarray, np.ndarray]:
    x, w = gauss_hermite(order)
    return copula.base.link(copula.link).forward(num, mu + nu / np.sqrt(2 * kappa) * x), w


def predict(df: DataFrame, copula: Copula, u: str, v: str, by: list[str], order: list[str], params: dict, method: str, n: int, horizon: str = "next", given: dict[int, float] | None = None, seed: int = 0) -> DataFrame:
    """``by, draw, u, v``: n draws after each group's history. ``given`` fixes one coordinate."""
    keys = [f for f in df.schema if f.name in by]
    given = given or {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        r, w = predictive_state(copula, params, method, pdf[u].to_numpy(float), pdf[v].to_numpy(float), horizon)
        own = np.frombuffer(repr(tuple(pdf[k.name].iloc[0] for k in keys)).encode(), np.uint8).tolist()
        rng = np.random.default_rng(np.random.SeedSequence([seed, *own]))
        at = r[rng.choice(len(r), size=n, p=w / w.sum())]
        e = rng.uniform(size=(2, n))
        if 0 in given:
            a = np.full(n, given[0])
            b = copula.transposed().h_inv(num, e[1], a, at)
        else:
            b = np.full(n, given[1]) if 1 in given else e[0]
            a = copula.h_inv(num, e[1], b, at)
        return pd.DataFrame({**{k.name: pdf[k.name].iloc[0] for k in keys}, "draw": np.arange(n), "u": a, "v": b})

    return df.groupBy(*by).applyInPandas(run, ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in keys) + ", draw long, u double, v double")


def draw_from_grid(df: DataFrame, atoms: list[tuple[float, float]], w: str, out: str = "r") -> DataFrame:
    """A value for each row by inverting the cumulative weights of a small grid (value, weight) at a uniform column."""
    total, steps = sum(p for _, p in atoms), []
    acc = 0.0
    for x, p in atoms:
        acc += p / total
        steps.append((float(x), acc))
    expr = F.lit(steps[-1][0])
    for x, c in reversed(steps[:-1]):
        expr = F.when(F.col(w) <= c, F.lit(x)).otherwise(expr)
    return df.withColumn(out, expr)
