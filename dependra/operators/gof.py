"""Goodness of fit: Rosenblatt transforms, Cramer-von Mises statistic and p-value, parametric bootstrap."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalars as s, special
from ..functions.backend import col, num
from ..functions.families import Copula
from .fit import fit_arrays, mle


def rosenblatt_pair(df: DataFrame, copula: Copula, u: str, v: str, r: float, e1: str = "e1", e2: str = "e2") -> DataFrame:
    """e1 = u, e2 = distribution of v given u."""
    h = copula.transposed().h(col, F.col(v), F.col(u), F.lit(float(r)))
    return df.withColumn(e1, s.clip_rosenblatt(col, F.col(u))).withColumn(e2, s.clip_rosenblatt(col, h))


def rosenblatt_gaussian(df: DataFrame, columns: Sequence[str], corr: np.ndarray, prefix: str = "e") -> DataFrame:
    """Phi(L^-1 z) with literal coefficients."""
    inverse = np.linalg.inv(np.linalg.cholesky(np.asarray(corr, float)))
    z = df.withColumns({f"__z{i}": s.norm_ppf_refined(col, F.col(c)) for i, c in enumerate(columns)})
    y = {}
    for i in range(len(columns)):
        total = F.lit(0.0)
        for j in range(i + 1):
            total = total + float(inverse[i, j]) * F.col(f"__z{j}")
        y[f"__y{i}"] = total
    z = z.withColumns(y)
    out = {f"{prefix}{i}": s.clip_rosenblatt(col, s.norm_cdf(col, F.col(f"__y{i}"))) for i in range(len(columns))}
    return z.withColumns(out).drop(*[f"__z{i}" for i in range(len(columns))], *y)


def rosenblatt_student(df: DataFrame, columns: Sequence[str], corr: np.ndarray, dof: float) -> DataFrame:
    """``e`` (array): each coordinate's conditional Student distribution given the earlier ones."""
    corr = np.asarray(corr, float)

    names = [f"e{i}" for i in range(len(columns))]

    @F.pandas_udf(", ".join(f"{k} double" for k in names))
    def apply(u: pd.DataFrame) -> pd.DataFrame:
        x = special.t_ppf(u.to_numpy(float), dof)
        out = np.empty_like(x)
        for i in range(x.shape[1]):
            if i == 0:
                out[:, 0] = special.t_cdf(x[:, 0], dof)
                continue
            block = corr[:i, :i]
            a = np.linalg.solve(block, corr[:i, i])
            q = np.einsum("ti,ij,tj->t", x[:, :i], np.linalg.inv(block), x[:, :i])
            scale = np.sqrt((dof + q) / (dof + i) * (1 - corr[:i, i] @ a))
            out[:, i] = special.t_cdf((x[:, i] - x[:, :i] @ a) / scale, dof + i)
        return pd.DataFrame(np.clip(out, s.ROSENBLATT_EPS, 1 - s.ROSENBLATT_EPS), columns=names)

    return df.withColumn("e", apply(F.struct(*columns))).withColumn("e", F.array(*[F.col("e")[k] for k in names]))


def cvm_statistic(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """``statistic, n``: the chi-square distribution of the summed squared scores against uniformity.

    The ranks are over a group; without ``by`` use it on data of one task's size, or add a grouping.
    """
    q = None
    z = df.withColumns({f"__z{i}": s.norm_ppf_refined(col, F.col(c)) for i, c in enumerate(columns)})
    for i in range(len(columns)):
        t = F.col(f"__z{i}") * F.col(f"__z{i}")
        q = t if q is None else q + t
    z = z.withColumn("__q", q)
    d = len(columns)
    if d % 2 == 0:  # closed form: 1 - exp(-q/2) sum (q/2)^k / k!
        half, term, total = F.col("__q") / 2, F.lit(1.0), F.lit(1.0)
        for k in range(1, d // 2):
            term = term * half / float(k)
            total = total + term
        y = 1.0 - F.exp(-half) * total
    else:
        @F.pandas_udf("double")
        def chi2(x: pd.Series) -> pd.Series:
            return pd.Series(special.chi2_cdf(x.to_numpy(float), d))

        y = chi2("__q")
    z = z.withColumn("__y", y)
    w = Window.partitionBy(*by)
    ranked = z.withColumn("__i", F.row_number().over(w.orderBy("__y", *ties))).withColumn("__n", F.count(F.lit(1)).over(w))
    gap = (2.0 * F.col("__i") - 1.0) / (2.0 * F.col("__n")) - F.col("__y")
    return ranked.groupBy(*by).agg((1.0 / (12.0 * F.max("__n")) + F.sum(gap * gap)).alias("statistic"), F.max("__n").alias("n"))


def _bessel_quarter(z: float) -> float:
    """K_(1/4)(z) by the trapezoid rule on its integral."""
    t = np.linspace(0.0, 12.0, 4001)
    y = np.exp(-z * np.cosh(t)) * np.cosh(t / 4)
    return float((y.sum() - 0.5 * (y[0] + y[-1])) * (t[1] - t[0]))


def cvm_pvalue(statistic: float) -> float:
    """Upper tail of the limiting law."""
    if statistic <= 0:
        return 1.0
    total = 0.0
    for k in range(20):
        c = math.gamma(k + 0.5) / (math.gamma(0.5) * math.factorial(k))
        y = (4 * k + 1) ** 2 / (16 * statistic)
        if y > 700:
            break
        total += c * math.sqrt(4 * k + 1) * math.exp(-y) * _bessel_quarter(y)
    return float(min(1.0, max(0.0, 1.0 - total / (math.pi * math.sqrt(statistic)))))


def cvm_arrays(e: np.ndarray) -> float:
    y = np.sort(special.chi2_cdf((special.norm_ppf(e) ** 2).sum(1), e.shape[1]))
    n = len(y)
    return float(1 / (12 * n) + (((2 * np.arange(1, n + 1) - 1) / (2 * n) - y) ** 2).sum())


def _pair_statistic(copula: Copula, u, v) -> tuple[float, float]:
    r = mle(copula, u, v)["params"].get("r", 0.0)
    e = np.column_stack([u, copula.transposed().h(num, v, u, r)])
    return cvm_arrays(np.clip(e, s.ROSENBLATT_EPS, 1 - s.ROSENBLATT_EPS)), r


def bootstrap(spark, copula: Copula, u: np.ndarray, v: np.ndarray, replications: int, seed: int = 0) -> DataFrame:
    """``statistic, p_value``: each replication simulates, ranks, refits and tests; replications are rows of a range."""
    observed, r = _pair_statistic(copula, u, v)
    n = len(u)

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf.id:
                rng = np.random.default_rng(np.random.SeedSequence([seed, int(k)]))
                w = rng.uniform(size=(2, n))
                a = copula.h_inv(num, w[1], w[0], r)
                ranks = lambda x: (np.argsort(np.argsort(x)) + 1.0) / (n + 1.0)
                out.append(_pair_statistic(copula, ranks(a), ranks(w[0]))[0])
            yield pd.DataFrame({"boot": out})

    boots = spark.range(0, replications, 1, min(replications, 64)).mapInPandas(run, "boot double")
    return boots.agg(F.lit(observed).alias("statistic"), ((1.0 + F.count_if(F.col("boot") >= observed)) / (F.count(F.lit(1)) + 1.0)).alias("p_value"))


def bootstrap_groups(df: DataFrame, copula: Copula, u: str, v: str, by: Sequence[str], order: Sequence[str], replications: int, seed: int = 0) -> DataFrame:
    """``by, statistic, p_value, n`` of each group as :func:`bootstrap` gives them: a task fits one group, replications need its parameter and size alone."""
    keys = [f for f in df.schema if f.name in by]
    names = [f.name for f in keys]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)

    def observe(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        statistic, r = _pair_statistic(copula, pdf[u].to_numpy(float), pdf[v].to_numpy(float))
        return pdf[names].head(1).assign(statistic=float(statistic), r=float(r), n=len(pdf))

    def run(batches):
        for pdf in batches:
            boot = []
            for k, n, r in zip(pdf.k, pdf.n, pdf.r):
                rng = np.random.default_rng(np.random.SeedSequence([seed, int(k)]))
                w = rng.uniform(size=(2, n))
                a = copula.h_inv(num, w[1], w[0], r)
                ranks = lambda x: (np.argsort(np.argsort(x)) + 1.0) / (n + 1.0)
                boot.append(_pair_statistic(copula, ranks(a), ranks(w[0]))[0])
            yield pdf[[*names, "statistic", "n"]].assign(boot=boot)

    seen = df.select(*names, *order, u, v).groupBy(*names).applyInPandas(observe, f"{fields}, statistic double, r double, n long")
    each = seen.select("*", F.explode(F.sequence(F.lit(0), F.lit(replications - 1))).alias("k")).repartition(*names, "k")
    boots = each.mapInPandas(run, f"{fields}, statistic double, n long, boot double")
    p_value = (1.0 + F.count_if(F.col("boot") >= F.col("statistic"))) / (F.count(F.lit(1)) + 1.0)
    return boots.groupBy(*names, "statistic", "n").agg(p_value.alias("p_value")).select(*names, "statistic", "p_value", "n")


def gof_test(df: DataFrame, copula: Copula, u: str, v: str, by: Sequence[str], order: Sequence[str], method: str = "mle", to_pobs: bool = True) -> DataFrame:
    """``by, statistic, p_value, n`` of each group: fit, transform at the predictive state, test."""
    from . import latent
    from .recursions import gas_path

    keys = [f for f in df.schema if f.name in by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        a, b = pdf[u].to_numpy(float), pdf[v].to_numpy(float)
        n = len(a)
        if to_pobs:
            a, b = ((np.argsort(np.argsort(x, kind="stable"), kind="stable") + 1.0) / (n + 1.0) for x in (a, b))
        p = fit_arrays(copula, a, b, method)["params"]
        if method == "mle":
            e2 = copula.transposed().h(num, b, a, p.get("r", 0.0))
        elif method == "gas":
            g, _ = gas_path(copula, a, b, (p["omega"], p["gamma"], p["beta"]))
            e2 = copula.transposed().h(num, b, a, copula.base.link(copula.link).forward(num, g))
        elif method == "scar-tm-jacobi":
            e2 = latent.mixture_h(copula, latent.jacobi_grid(p["kappa"], p["m"], p["xi"], n), a, b)
        else:
            e2 = latent.mixture_h(copula, latent.ou_grid(p["kappa"], p["mu"], p["nu"], n), a, b)
        w = cvm_arrays(np.clip(np.column_stack([a, e2]), s.ROSENBLATT_EPS, 1 - s.ROSENBLATT_EPS))
        return pd.DataFrame([{**{k.name: pdf[k.name].iloc[0] for k in keys}, "statistic": w, "p_value": cvm_pvalue(w), "n": n}])

    return df.groupBy(*by).applyInPandas(run, ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in keys) + ", statistic double, p_value double, n long")
