"""Score-driven, GARCH and Ornstein-Uhlenbeck recursions.

A recursion needs the rows of a series in order, so a series is one task's work and parallelism comes from
many series. The native form folds an ordered array of a series with ``aggregate``; the Arrow form
(:func:`filter_groups`) is for long series, where it takes compiled arrays a step at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.backend import col, num
from ..functions.families import Copula

#: Bounds of the latent state and of the score, least Fisher information.
STATE_BOUND, SCORE_BOUND, LEAST_FISHER = 50.0, 100.0, 1e-6


def gas_start(omega: float, beta: float) -> float:
    return omega / (1.0 - beta) if abs(beta) < 1.0 - 1e-8 else omega


def gas_score(m, copula: Copula, u, v, g):
    """Unit-scaled score: d log c / d r times the slope of the link."""
    link = copula.base.link(copula.link)
    x = copula.score(m, u, v, link.forward(m, g)) * link.slope(m, g)
    return m.greatest(-SCORE_BOUND, m.least(SCORE_BOUND, x))


def gas_score_fisher(m, copula: Copula, u, v, g, step: float = 1e-4):
    """Score over the (floored) negative second difference of log c in the latent state."""
    link = copula.base.link(copula.link)
    f = lambda x: copula.log_pdf(m, u, v, link.forward(m, x))
    fisher = m.greatest(LEAST_FISHER, -(f(g + step) - 2.0 * f(g) + f(g - step)) / (step * step))
    x = gas_score(m, copula, u, v, g) / fisher
    return m.greatest(-SCORE_BOUND, m.least(SCORE_BOUND, x))


def gas_update(m, copula: Copula, u, v, g, omega, gamma, beta, scaling: str = "unit"):
    """The state after one observation: the body of the batch fold and of the stream."""
    s = (gas_score_fisher if scaling == "fisher" else gas_score)(m, copula, u, v, g)
    return m.greatest(-STATE_BOUND, m.least(STATE_BOUND, omega + beta * g + gamma * s))


def series(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a series: ``obs``, its ordered rows as an array of structs."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in columns]))).alias("obs"))


def gas_filter(df: DataFrame, copula: Copula, u: str, v: str, params: tuple[float, float, float], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``by, log_likelihood, g_last, r_last, g_next`` of each series, natively."""
    omega, gamma, beta = params
    link = copula.base.link(copula.link)

    def step(acc, x):
        a, b = x[f"__{u}"], x[f"__{v}"]
        return F.struct(
            gas_update(col, copula, a, b, acc["next"], omega, gamma, beta).alias("next"), acc["next"].alias("g"),
            (acc["ll"] + copula.log_pdf(col, a, b, link.forward(col, acc["next"]))).alias("ll"),
        )

    start = F.struct(F.lit(gas_start(omega, beta)).alias("next"), F.lit(0.0).alias("g"), F.lit(0.0).alias("ll"))
    out = series(df, by, order, [u, v]).withColumn("x", F.aggregate("obs", start, step))
    return out.select(*by, F.col("x.ll").alias("log_likelihood"), F.col("x.g").alias("g_last"), link.forward(col, F.col("x.g")).alias("r_last"), F.col("x.next").alias("g_next"))


def gas_path(copula: Copula, u: np.ndarray, v: np.ndarray, params, scaling: str = "unit") -> tuple[np.ndarray, float]:
    """States before each observation and the log-likelihood of one series."""
    omega, gamma, beta = params
    link = copula.base.link(copula.link)
    g, out = gas_start(omega, beta), np.empty(len(u))
    for t in range(len(u)):
        out[t] = g
        g = float(gas_update(num, copula, u[t], v[t], g, omega, gamma, beta, scaling))
    return out, float(np.sum(copula.log_pdf(num, u, v, link.forward(num, out)))) if len(u) else 0.0


def gas_likelihoods(copula: Copula, u: np.ndarray, v: np.ndarray, params: np.ndarray, scaling: str = "unit") -> np.ndarray:
    """Log-likelihood of one series under each row (omega, gamma, beta) of a matrix, all in one pass."""
    omega, gamma, beta = np.asarray(params, float).T
    link = copula.base.link(copula.link)
    g = np.array([gas_start(o, b) for o, b in zip(omega, beta)])
    total = np.zeros(len(g))
    for t in range(len(u)):
        total += copula.log_pdf(num, u[t], v[t], link.forward(num, g))
        g = gas_update(num, copula, u[t], v[t], g, omega, gamma, beta, scaling)
    return total


def gas_series(copula: Copula, u: np.ndarray, v: np.ndarray, n: np.ndarray, i: np.ndarray, params: np.ndarray, scaling: str = "unit") -> np.ndarray:
    """The same of many series: ``u`` and ``v`` are places x series of lengths ``n``; each row of parameters goes with a series i."""
    omega, gamma, beta = np.asarray(params, float).T
    link = copula.base.link(copula.link)
    with np.errstate(all="ignore"):
        g = np.where(np.abs(beta) < 1.0 - 1e-8, omega / (1.0 - beta), omega)
        total, own, least = np.zeros(len(g)), n[i], n[i].min(initial=0)
        for t in range(own.max(initial=0)):
            a, b = u[t, i], v[t, i]
            x = copula.log_pdf(num, a, b, link.forward(num, g))
            total += x if t < least else np.where(t < own, x, 0.0)
            g = gas_update(num, copula, a, b, g, omega, gamma, beta, scaling)
    return total


def filter_groups(df: DataFrame, copula: Copula, u: str, v: str, params, by: Sequence[str], order: Sequence[str], scaling: str = "unit") -> DataFrame:
    """Every row with its state ``g``, parameter ``r`` and ``e2``, the distribution of v given u at it (Rosenblatt)."""
    if clash := {"g", "r", "e2"} & set(df.columns):
        raise ValueError(f"columns named {sorted(clash)} are there already; rename them first")
    link = copula.base.link(copula.link)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        g, _ = gas_path(copula, pdf[u].to_numpy(), pdf[v].to_numpy(), params, scaling)
        r = link.forward(num, g)
        return pdf.assign(g=g, r=r, e2=copula.transposed().h(num, pdf[v].to_numpy(), pdf[u].to_numpy(), r))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", g double, r double, e2 double"
    return df.groupBy(*by).applyInPandas(run, schema)


def garch_filter(df: DataFrame, e: str, params: tuple[float, float, float], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``by, s2_last, s2_next, log_likelihood``: s2_t = w + a e^2 + b s2, started at the larger of the long-run and the sample variance."""
    w, a, b = params
    long_run = w / (1.0 - a - b) if a + b < 1.0 else 0.0
    base = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(e).alias("__e")))).alias("obs"), F.var_samp(e).alias("var"))
    start = F.greatest(F.lit(long_run), F.coalesce("var", F.lit(0.0)), F.lit(1e-12))

    def step(acc, x):
        s2 = acc["next"]
        e2 = x["__e"] * x["__e"]
        return F.struct((w + a * e2 + b * s2).alias("next"), s2.alias("s2"), (acc["ll"] - 0.5 * (F.log(s2) + e2 / s2 + np.log(2 * np.pi))).alias("ll"))

    out = base.withColumn("x", F.aggregate("obs", F.struct(start.alias("next"), F.lit(0.0).alias("s2"), F.lit(0.0).alias("ll")), step))
    return out.select(*by, F.col("x.s2").alias("s2_last"), F.col("x.next").alias("s2_next"), F.col("x.ll").alias("log_likelihood"))


def ou_path(df: DataFrame, eps: str, kappa: float, mu: float, nu: float, dt: float, by: Sequence[str], order: Sequence[str], x0: float | None = None) -> DataFrame:
    """``by, path``: the exact recursion x' = mu + rho (x - mu) + sigma sqrt(1 - rho^2) eps with given innovations."""
    rho = float(np.exp(-kappa * dt))
    scale = float(nu / np.sqrt(2 * kappa) * np.sqrt(1 - rho * rho))
    start = F.struct(F.lit(mu if x0 is None else float(x0)).alias("x"), F.array().cast("array<double>").alias("path"))

    def step(acc, e):
        x = mu + rho * (acc["x"] - mu) + scale * e[f"__{eps}"]
        return F.struct(x.alias("x"), F.concat(acc["path"], F.array(x)).alias("path"))

    return series(df, by, order, [eps]).select(*by, F.aggregate("obs", start, step, lambda acc: acc["path"]).alias("path"))
