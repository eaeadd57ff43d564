"""Marginal distributions: fits as aggregates or grouped functions, evaluation as expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as s, special
from ..functions.backend import col
from .optimize import projected_bfgs

ALIASES = {"gaussian": "normal", "double-exponential": "laplace"}
MARGINALS = ("normal", "laplace", "logistic", "johnsonsu", "hyperbolic", "stable", "arma-garch")


def resolve(name: str) -> str:
    name = ALIASES.get(name.lower(), name.lower())
    if name not in MARGINALS:
        raise ValueError(f"unknown marginal {name!r}; known: {MARGINALS}")
    return name


def fit_closed(df: DataFrame, x: str, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """``loc, scale, n`` by aggregates: normal (mean, deviation), laplace (median, mean absolute deviation), logistic (moments)."""
    kind = resolve(kind)
    if kind == "normal":
        return df.groupBy(*by).agg(F.avg(x).alias("loc"), F.stddev_pop(x).alias("scale"), F.count(x).alias("n"))
    if kind == "logistic":
        return df.groupBy(*by).agg(F.avg(x).alias("loc"), (F.stddev_pop(x) * (math.sqrt(3) / math.pi)).alias("scale"), F.count(x).alias("n"))
    if kind == "laplace":
        mid = df.groupBy(*by).agg(F.percentile(x, F.lit(0.5)).alias("loc"))
        met = df.join(mid, list(by)) if by else df.crossJoin(F.broadcast(mid))
        return met.groupBy(*by, "loc").agg(F.avg(F.abs(F.col(x) - F.col("loc"))).alias("scale"), F.count(x).alias("n"))
    raise ValueError(f"{kind} has no closed-form fit; use fit_groups")


def cdf(kind: str, x: Column, loc: Column, scale: Column) -> Column:
    z = (x - loc) / scale
    kind = resolve(kind)
    if kind == "normal":
        return s.norm_cdf(col, z)
    if kind == "laplace":
        return F.when(z < 0, 0.5 * F.exp(z)).otherwise(1.0 - 0.5 * F.exp(-z))
    if kind == "logistic":
        return 1.0 / (1.0 + F.exp(-z))
    raise ValueError(f"{kind} has no closed-form distribution")


def ppf(kind: str, p: Column, loc: Column, scale: Column) -> Column:
    p = s.clip(col, p)
    kind = resolve(kind)
    if kind == "normal":
        return loc + scale * s.norm_ppf_refined(col, p)
    if kind == "laplace":
        return loc - scale * F.when(p < 0.5, -F.log(2.0 * p)).otherwise(F.log(2.0 * (1.0 - p)))
    if kind == "logistic":
        return loc + scale * (F.log(p) - F.log1p(-p))
    raise ValueError(f"{kind} has no closed-form quantile")


def _johnson_nll(p, x):
    g, d, loc, scale = p[0], np.exp(p[1]), p[2], np.exp(p[3])
    y = (x - loc) / scale
    z = g + d * np.arcsinh(y)
    return -np.sum(np.log(d) - np.log(scale) - 0.5 * np.log1p(y * y) - 0.5 * z * z - 0.5 * np.log(2 * np.pi))


def _garch_nll(p, e):
    w, a, b = np.exp(p[0]), p[1], p[2]
    if a + b >= 0.999:
        return 1e10
    s2 = max(w / (1 - a - b), float(np.var(e, ddof=1)) if len(e) > 1 else 0.0, 1e-12)
    total = 0.0
    for x in e:
        total += 0.5 * (math.log(s2) + x * x / s2 + math.log(2 * math.pi))
        s2 = w + a * x * x + b * s2
    return total


def garch_path(e: np.ndarray, w: float, a: float, b: float) -> np.ndarray:
    """Variances before each residual, and the next one."""
    s2 = np.empty(len(e) + 1)
    s2[0] = max(w / (1 - a - b) if a + b < 1 else 0.0, float(np.var(e, ddof=1)) if len(e) > 1 else 0.0, 1e-12)
    for t, x in enumerate(e):
        s2[t + 1] = w + a * x * x + b * s2[t]
    return s2


def fit_array(kind: str, x: np.ndarray, ar: int = 0, ma: int = 0) -> dict[str, float]:
    """Parameters by maximum likelihood; quantile-type kinds carry only location and scale."""
    kind = resolve(kind)
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 2:
        return {"loc": float(x[0]) if len(x) else 0.0, "scale": 1.0}
    m, sd = float(x.mean()), float(x.std()) or 1.0
    if kind == "normal":
        return {"loc": m, "scale": sd}
    if kind == "laplace":
        mid = float(np.median(x))
        return {"loc": mid, "scale": float(np.abs(x - mid).mean()) or 1e-12}
    if kind == "logistic":
        f = lambda p: np.sum((x - p[0]) / np.exp(p[1]) + p[1] + 2 * np.logaddexp(0.0, -(x - p[0]) / np.exp(p[1])))
        best = projected_bfgs(f, (m, math.log(sd * math.sqrt(3) / math.pi)), (m - 10 * sd, -30.0), (m + 10 * sd, 30.0))
        return {"loc": float(best.x[0]), "scale": float(np.exp(best.x[1]))}
    if kind == "johnsonsu":
        best = projected_bfgs(lambda p: _johnson_nll(p, x), (0.0, 0.5, m, math.log(sd)), (-20.0, -5.0, m - 20 * sd, math.log(sd) - 10), (20.0, 5.0, m + 20 * sd, math.log(sd) + 10))
        return {"gamma": float(best.x[0]), "delta": float(np.exp(best.x[1])), "loc": float(best.x[2]), "scale": float(np.exp(best.x[3]))}
    if kind == "arma-garch":
        if ma or ar not in (0, 1):
            raise ValueError("only AR(0) and AR(1) means without a moving average are supported")
        const, slope, e = m, 0.0, x - m
        if ar:
            slope = float(np.clip(np.polyfit(x[:-1], x[1:], 1)[0], -0.99, 0.99)) if np.ptp(x[:-1]) > 0 else 0.0
            const = float(x[1:].mean() - slope * x[:-1].mean())
            e = np.concatenate([[x[0] - m], x[1:] - const - slope * x[:-1]])
        v = max(float(np.var(e)), 1e-12)
        best = projected_bfgs(lambda p: _garch_nll(p, e), (math.log(0.1 * v), 0.08, 0.85), (-60.0, 0.0, 0.0), (60.0, 0.998, 0.998))
        return {"const": const, "ar1": slope, "omega": float(np.exp(best.x[0])), "alpha": float(best.x[1]), "beta": float(best.x[2]), "loc": m, "scale": math.sqrt(v)}
    return {"loc": float(np.median(x)), "scale": float(np.subtract(*np.percentile(x, [75, 25]))) / 1.349 or sd}


def standardized(kind_params: dict, x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Standardised residuals of an AR-GARCH fit, and mean and deviation of the next value."""
    p = kind_params
    e = x - p["loc"] if not p["ar1"] else np.concatenate([[x[0] - p["loc"]], x[1:] - p["const"] - p["ar1"] * x[:-1]])
    s2 = garch_path(e, p["omega"], p["alpha"], p["beta"])
    mean = p["const"] + p["ar1"] * x[-1] if p["ar1"] else p["loc"]
    return e / np.sqrt(s2[:-1]), float(mean), float(np.sqrt(s2[-1]))


def fit_rows(kind: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """:func:`fit_array` of each row of a matrix; parameters as columns."""
    kind = resolve(kind)
    if kind == "normal" and x.shape[1] > 1 and np.isfinite(x).all():
        sd = x.std(1, keepdims=True)
        return {"loc": x.mean(1, keepdims=True), "scale": np.where(sd == 0, 1.0, sd)}
    each = [fit_array(kind, row) for row in x]
    return {k: np.array([f[k] for f in each])[:, None] for k in each[0]}


def ppf_rows(kind: str, p: np.ndarray, params: dict[str, np.ndarray], history: np.ndarray) -> np.ndarray:
    """:func:`ppf_array` of each row by its own parameters and history."""
    kind = resolve(kind)
    if kind in ("normal", "laplace", "logistic", "johnsonsu"):
        return ppf_array(kind, p, params)
    return np.stack([ppf_array(kind, q, {k: c[j, 0] for k, c in params.items()}, history[j]) for j, q in enumerate(p)])


def ppf_array(kind: str, p: np.ndarray, params: dict, history: np.ndarray | None = None) -> np.ndarray:
    kind = resolve(kind)
    p = np.clip(p, 1e-10, 1 - 1e-10)
    if kind == "johnsonsu":
        return params["loc"] + params["scale"] * np.sinh((special.norm_ppf(p) - params["gamma"]) / params["delta"])
    if kind == "normal":
        return params["loc"] + params["scale"] * special.norm_ppf(p)
    if kind == "laplace":
        return params["loc"] - params["scale"] * np.where(p < 0.5, -np.log(2 * np.minimum(p, 0.5)), np.log(2 * np.minimum(1 - p, 0.5)))
    if kind == "logistic":
        return params["loc"] + params["scale"] * (np.log(p) - np.log1p(-p))
    if kind == "arma-garch":
        _, mean, sd = standardized(params, np.asarray(history, float))
        return mean + sd * special.norm_ppf(p)
    # heavy-tailed kinds: median-unbiased sample quantiles
    return np.quantile(np.asarray(history, float), p, method="median_unbiased")


def cdf_array(kind: str, x: np.ndarray, params: dict, history: np.ndarray | None = None) -> np.ndarray:
    kind = resolve(kind)
    z = (np.asarray(x, float) - params["loc"]) / params["scale"]
    if kind == "johnsonsu":
        return special.norm_cdf(params["gamma"] + params["delta"] * np.arcsinh(z))
    if kind in ("normal", "arma-garch"):
        return special.norm_cdf(z)
    if kind == "laplace":
        return np.where(z < 0, 0.5 * np.exp(np.minimum(z, 0)), 1 - 0.5 * np.exp(-np.maximum(z, 0)))
    if kind == "logistic":
        return 1 / (1 + np.exp(-z))
    h = np.sort(np.asarray(history, float))
    return (np.searchsorted(h, x, side="right") + 1 / 3) / (len(h) + 2 / 3)


def fit_groups(df: DataFrame, x: str, kind: str, by: Sequence[str], order: Sequence[str], ar: int = 0) -> DataFrame:
    """``by, params, n`` of each group by maximum likelihood, one task a group."""
    resolve(kind)
    keys = [f for f in df.schema if f.name in by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        return pd.DataFrame([{**{k.name: pdf[k.name].iloc[0] for k in keys}, "params": fit_array(kind, pdf[x].to_numpy(float), ar), "n": len(pdf)}])

    return df.groupBy(*by).applyInPandas(run, ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in keys) + ", params map<string,double>, n long")


def median_unbiased_quantile(df: DataFrame, x: str, p: float, by: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Type-8 sample quantile by interpolation between two ranks, natively."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    ranked = df.where(F.col(x).isNotNull()).withColumn("__i", F.row_number().over(w.orderBy(x, *ties))).withColumn("__n", F.count(F.lit(1)).over(w))
    at = (F.col("__n") + 1.0 / 3.0) * p + 1.0 / 3.0
    at = F.greatest(F.lit(1.0), F.least(F.col("__n").cast("double"), at))
    low = F.floor(at)
    weight = F.when(F.col("__i") == low, 1.0 - (at - low)).when(F.col("__i") == low + 1, at - low)
    return ranked.withColumn("__w", weight).where("__w is not null").groupBy(*by).agg(F.sum(F.col(x) * F.col("__w")).alias("quantile"))
