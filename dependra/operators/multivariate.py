"""Gaussian, Student, equicorrelation, stochastic-df Student and factor copulas of any dimension."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as s, special
from ..functions.backend import col
from .aggregates import matrix_of, nearest_correlation, normal_scores, pack_cholesky, shrink_correlation, tau_matrix, unpack_cholesky
from .optimize import golden, projected_bfgs

DF_BOUNDS = (2.001, 1e4)


@dataclass(frozen=True)
class CorrelationPolicy:
    """How a correlation matrix is had: fixed, shrinkage, cholesky or factor (of a rank)."""

    mode: str = "fixed"
    rank: int = 1
    estimator: str = "normal-scores"

    def __post_init__(self):
        if self.mode not in ("fixed", "shrinkage", "cholesky", "factor"):
            raise ValueError(f"unknown correlation mode {self.mode!r}")

    def parameters(self, d: int) -> int:
        return {"fixed": 0, "shrinkage": 1, "cholesky": d * (d - 1) // 2, "factor": d * self.rank - self.rank * (self.rank - 1) // 2}[self.mode]


def gaussian_log_pdf(columns: Sequence[str], corr: np.ndarray) -> Column:
    """-log det R / 2 - z'(R^-1 - I) z / 2 with literal coefficients, over columns of normal scores."""
    r = np.asarray(corr, float)
    q = np.linalg.inv(r) - np.eye(len(r))
    out = F.lit(-0.5 * float(np.linalg.slogdet(r)[1]))
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            c = -0.5 * float(q[i, j]) * (1.0 if i == j else 2.0)
            out = out + c * F.col(a) * F.col(columns[j])
    return out


def gram(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """Rows and the matrix of sums of products: one scan, the sufficient statistic of every Gaussian fit."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((d, d))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return row["n"], out


def gaussian_log_likelihood(n: int, g: np.ndarray, corr: np.ndarray) -> float:
    return float(-0.5 * n * np.linalg.slogdet(corr)[1] - 0.5 * np.sum((np.linalg.inv(corr) - np.eye(len(corr))) * g))


def fit_gaussian(df: DataFrame, columns: Sequence[str], policy: CorrelationPolicy = CorrelationPolicy(), fixed: np.ndarray | None = None) -> dict:
    """Correlation, log-likelihood and parameters of a Gaussian copula over pseudo-observation columns."""
    n, g = gram(normal_scores(df, columns, "__z_"), [f"__z_{c}" for c in columns])
    d = len(columns)
    base = nearest_correlation(g / np.sqrt(np.outer(np.diag(g), np.diag(g)))) if fixed is None else nearest_correlation(fixed)
    corr = _apply(policy, base, lambda r: gaussian_log_likelihood(n, g, r))
    ll = gaussian_log_likelihood(n, g, corr)
    k = policy.parameters(d)
    return {"correlation": corr, "log_likelihood": ll, "n": n, "n_params": k, "aic": 2 * k - 2 * ll, "bic": k * math.log(max(1, n)) - 2 * ll}


def _apply(policy: CorrelationPolicy, base: np.ndarray, value) -> np.ndarray:
    d = len(base)
    if policy.mode == "shrinkage":
        best = golden(lambda a: -value(shrink_correlation(base, a)), -8.0, 8.0, 1e-7)
        return shrink_correlation(base, best.x[0])
    if policy.mode == "cholesky":
        start = pack_cholesky(base)
        best = projected_bfgs(lambda p: -value(unpack_cholesky(p, d)), start, start - 5.0, start + 5.0)
        return unpack_cholesky(best.x, d)
    if policy.mode == "factor":
        return FactorCorrelation.fit(base, policy.rank).dense()
    return base


def student_log_pdf(u: np.ndarray, corr: np.ndarray | FactorCorrelation, df) -> np.ndarray:
    """Rows of a Student copula density; ``df`` is a number or one for each row. Factors cost O(d k) a row and no dense matrix."""
    df = np.asarray(df, float)
    # one number for all rows stays one: its constants are computed once
    df = np.atleast_1d(df.flat[0]) if df.size and df.min() == df.max() else np.broadcast_to(df, (len(u),))
    x = special.t_ppf(u, df[:, None])
    d = u.shape[1]
    if isinstance(corr, FactorCorrelation):
        q, log_det = (x * corr.solve(x.T).T).sum(1), corr.logdet()
    else:
        q, log_det = np.einsum("ti,ij,tj->t", x, np.linalg.inv(corr), x), np.linalg.slogdet(corr)[1]
    joint = special.lgamma((df + d) / 2) - special.lgamma(df / 2) - d / 2 * np.log(df * np.pi) - 0.5 * log_det - (df + d) / 2 * np.log1p(q / df)
    return joint - special.t_logpdf(x, df[:, None]).sum(1)


def student_slope(u: np.ndarray, corr: np.ndarray | FactorCorrelation, df, step: float = 1e-4) -> np.ndarray:
    """Rows' derivative of the log-density in the degrees of freedom, by a central difference in their logarithm."""
    df = np.broadcast_to(np.asarray(df, float), (len(u),))
    high, low = df * np.exp(step), df * np.exp(-step)
    return (student_log_pdf(u, corr, high) - student_log_pdf(u, corr, low)) / (high - low)


def student_grid(u: np.ndarray, corr: np.ndarray | FactorCorrelation, grid: Sequence[float]) -> np.ndarray:
    """Log-densities of all rows (down) at several degrees of freedom (across)."""
    return np.column_stack([student_log_pdf(u, corr, float(g)) for g in grid])


def student_rows(df: DataFrame, columns: Sequence[str], corr: np.ndarray | FactorCorrelation, dof: float | str, name: str = "log_pdf") -> DataFrame:
    """``df`` with the Student log-density; ``dof`` is a number or a column of a row's degrees of freedom."""
    corr = corr if isinstance(corr, FactorCorrelation) else np.asarray(corr, float)

    @F.pandas_udf("double")
    def apply(u: pd.DataFrame) -> pd.Series:
        x = u.to_numpy(float)
        return pd.Series(student_log_pdf(x[:, :-1], corr, x[:, -1]))

    last = F.col(dof) if isinstance(dof, str) else F.lit(float(dof))
    return df.withColumn(name, apply(F.struct(*columns, last.alias("__df"))))


def fit_student(df: DataFrame, columns: Sequence[str], points: int = 9, passes: int = 4) -> dict:
    """Correlation from Kendall's tau, degrees of freedom by scans that evaluate several at once."""
    taus = tau_matrix(df, columns).collect()
    corr = nearest_correlation(matrix_of(taus, columns, "tau", lambda t: math.sin(math.pi * t / 2)))
    grid = np.geomspace(2.1, 200.0, points)
    best = (float("-inf"), 0.0)
    n = 0
    for _ in range(passes):
        lits = [float(g) for g in grid]

        def sums(batches, lits=lits):
            for pdf in batches:
                u = pdf[list(columns)].to_numpy(float)
                yield pd.DataFrame([{"n": len(u), **{f"s{i}": float(student_log_pdf(u, corr, g).sum()) for i, g in enumerate(lits)}}])

        schema = "n long, " + ", ".join(f"s{i} double" for i in range(len(lits)))
        row = df.select(*columns).mapInPandas(sums, schema).agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(lits))]).first()
        n = row["n"] or 0
        if not n:
            break
        values = [row[f"s{i}"] for i in range(len(lits))]
        i = int(np.argmax(values))
        best = max(best, (values[i], lits[i]))
        grid = np.geomspace(lits[max(0, i - 1)], lits[min(len(lits) - 1, i + 1)], points)
    ll, dof = best
    return {"correlation": corr, "df": dof, "log_likelihood": ll, "n": n, "n_params": 1, "aic": 2 - 2 * ll, "bic": math.log(max(1, n)) - 2 * ll}


# equicorrelation
def equicorr_log_pdf(d: int, rho, sum_z: str = "sum_z", sum_z2: str = "sum_z2", m=col) -> Column:
    a, b = (F.col(sum_z), F.col(sum_z2)) if m is col else (sum_z, sum_z2)
    rho = rho if isinstance(rho, Column) else m.of(rho)
    lead = 1.0 + (d - 1.0) * rho
    return -0.5 * ((d - 1.0) * m.log(1.0 - rho) + m.log(lead)) - 0.5 * (rho / (1.0 - rho) * b - rho / ((1.0 - rho) * lead) * a * a)


def equicorr_score(d: int, rho, sum_z: str = "sum_z", sum_z2: str = "sum_z2", m=col) -> Column:
    a, b = (F.col(sum_z), F.col(sum_z2)) if m is col else (sum_z, sum_z2)
    rho = rho if isinstance(rho, Column) else m.of(rho)
    lead, rest = 1.0 + (d - 1.0) * rho, 1.0 - rho
    # of rho / (rest * lead): the slope of the quotient
    slope = (rest * lead - rho * ((d - 1.0) * rest - lead)) / (rest * lead * rest * lead)
    return -0.5 * (-(d - 1.0) / rest + (d - 1.0) / lead) - 0.5 * (b / (rest * rest) - slope * a * a)


def fit_equicorr(stats: DataFrame, d: int, points: int = 33, passes: int = 7) -> dict:
    """Maximum likelihood over (sum_z, sum_z2) rows, some scans of many candidate correlations."""
    low = -1.0 / (d - 1)
    grid = np.linspace(low + 1e-3 * (1 - low), 1 - 1e-3, points)
    ll = rho = n = 0.0
    for _ in range(passes):
        row = stats.agg(F.count(F.lit(1)).alias("n"), *[F.sum(equicorr_log_pdf(d, float(r))).alias(f"s{i}") for i, r in enumerate(grid)]).first()
        values = [row[f"s{i}"] if row[f"s{i}"] is not None else 0.0 for i in range(points)]
        i = int(np.argmax(values))
        n, ll, rho = row["n"], float(values[i]), float(grid[i])
        grid = np.linspace(grid[max(0, i - 1)], grid[min(points - 1, i + 1)], points)
    return {"rho": rho, "log_likelihood": ll, "n": n, "n_params": 1}


# factor correlation R = D + B B'
@dataclass(frozen=True)
class FactorCorrelation:
    loadings: np.ndarray  # d x k

    @property
    def uniqueness(self) -> np.ndarray:
        return np.maximum(1.0 - (self.loadings**2).sum(1), 1e-6)

    @classmethod
    def fit(cls, corr: np.ndarray, rank: int, rounds: int = 200) -> FactorCorrelation:
        """Principal-axis iteration."""
        r = np.asarray(corr, float).copy()
        h = np.full(len(r), 0.5)
        b = np.zeros((len(r), rank))
        for _ in range(rounds):
            m = r.copy()
            np.fill_diagonal(m, h)
            w, q = np.linalg.eigh(m)
            b = q[:, -rank:] * np.sqrt(np.maximum(w[-rank:], 0.0))
            new = np.minimum((b**2).sum(1), 1 - 1e-6)
            if np.abs(new - h).max() < 1e-10:
                break
            h = new
        scale = np.sqrt(np.minimum(1.0, (1 - 1e-6) / np.maximum((b**2).sum(1), 1e-12)))
        return cls(b * scale[:, None])

    @classmethod
    def from_raw(cls, raw: np.ndarray, d: int, rank: int) -> FactorCorrelation:
        """Identified loadings: lower triangular with positive diagonal, rows inside the unit ball."""
        b = np.zeros((d, rank))
        b[np.tril_indices(d, 0, rank)] = raw
        b[np.arange(rank), np.arange(rank)] = np.exp(np.diag(b)[:rank])
        return cls(b / np.sqrt(1.0 + (b**2).sum(1, keepdims=True)))

    def matvec(self, x: np.ndarray) -> np.ndarray:
        return self.uniqueness * x + self.loadings @ (self.loadings.T @ x)

    def _core(self) -> np.ndarray:
        return np.eye(self.loadings.shape[1]) + self.loadings.T @ (self.loadings / self.uniqueness[:, None])

    def solve(self, x: np.ndarray) -> np.ndarray:
        """R^-1 x of a vector, or of every column of a matrix."""
        y = (x.T / self.uniqueness).T
        return y - (self.loadings / self.uniqueness[:, None]) @ np.linalg.solve(self._core(), self.loadings.T @ y)

    def logdet(self) -> float:
        return float(np.log(self.uniqueness).sum() + np.linalg.slogdet(self._core())[1])

    def dense(self, most: int = 20_000) -> np.ndarray:
        if len(self.loadings) > most:
            raise ValueError(f"a dense matrix of dimension {len(self.loadings)} is over the limit of {most}")
        out = self.loadings @ self.loadings.T
        np.fill_diagonal(out, 1.0)
        return out

    def quadratic(self, z: str) -> Column:
        """z' R^-1 z of an array column, natively: k weighted sums and a k x k literal matrix."""
        d, k = self.loadings.shape
        array = lambda v: F.array(*[F.lit(float(x)) for x in v])
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
        own = F.aggregate(F.zip_with(F.col(z), array(1 / self.uniqueness), lambda x, w: x * x * w), F.lit(0.0), lambda acc, x: acc + x)
        f = [dot(F.col(z), array(self.loadings[:, j] / self.uniqueness)) for j in range(k)]
        inner = np.linalg.inv(self._core())
        for i in range(k):
            for j in range(k):
                own = own - float(inner[i, j]) * f[i] * f[j]
        return own

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        d, k = self.loadings.shape
        return rng.standard_normal((n, k)) @ self.loadings.T + rng.standard_normal((n, d)) * np.sqrt(self.uniqueness)


def randomized_factors(df: DataFrame, array: str, d: int, rank: int, rounds: int = 3, seed: int = 0) -> FactorCorrelation:
    """Leading factors of the correlation of array rows by power iteration: each round is one scan that sums Z'(Z Q)."""
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, rank + 2)))[0]
    n = 0
    for _ in range(rounds):
        def part(batches, q=q):
            total, rows = np.zeros((d, q.shape[1])), 0
            for pdf in batches:
                if len(pdf):
                    z = np.stack(pdf[array].to_numpy()).astype(float)
                    total += z.T @ (z @ q)
                    rows += len(z)
            yield pd.DataFrame({"i": np.arange(d), "v": list(total), "n": rows})

        sums = df.select(array).mapInPandas(part, "i long, v array<double>, n long").select("i", "n", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
        y = np.zeros((d, q.shape[1]))
        for r in sums:
            y[r.i, r.j], n = r.x, r.n
        q, rr = np.linalg.qr(y)
    w, v = np.linalg.eigh((rr @ rr.T))
    top = np.sqrt(np.sqrt(np.maximum(w[-rank:], 0.0)) / max(1, n))
    b = q @ v[:, -rank:] * top
    scale = np.sqrt(np.minimum(1.0, (1 - 1e-6) / np.maximum((b**2).sum(1), 1e-12)))
    return FactorCorrelation(b * scale[:, None])


# sampling
def sample_correlated(n: int, corr: np.ndarray, rng: np.random.Generator, df: float | np.ndarray | None = None, given: dict[int, float] | None = None) -> np.ndarray:
    """Rows of a Gaussian (or with ``df`` Student) copula; ``given`` fixes coordinates in u-space exactly.

    ``df`` is a number or one for each row, as along a path of moving degrees of freedom.
    """
    corr = np.asarray(corr, float)
    d = len(corr)
    given = given or {}
    fixed, free = sorted(given), [i for i in range(d) if i not in given]
    out = np.empty((n, d))
    df = None if df is None else np.broadcast_to(np.asarray(df, float), (n,))
    mean, cov, scale = np.zeros(d), corr, np.ones(n)
    if fixed:
        g = np.broadcast_to([given[i] for i in fixed], (n, len(fixed)))
        z = special.norm_ppf(g) if df is None else special.t_ppf(g, df[:, None])
        inner = np.linalg.inv(corr[np.ix_(fixed, fixed)])
        a = inner @ corr[np.ix_(fixed, free)]
        mean, cov = z @ a, corr[np.ix_(free, free)] - a.T @ corr[np.ix_(fixed, free)]
        if df is not None:
            scale = (df + np.einsum("ti,ij,tj->t", z, inner, z)) / (df + len(fixed))
    if free:
        x = rng.standard_normal((n, len(free))) @ np.linalg.cholesky(nearest_psd(cov)).T
        if df is not None:
            k = df + len(fixed)
            x = x * np.sqrt(scale * k / rng.chisquare(k))[:, None]
        x = x + mean
        out[:, free] = np.clip(special.norm_cdf(x) if df is None else special.t_cdf(x, df[:, None]), s.DRAW_EPS, 1 - s.DRAW_EPS)
    for i in fixed:
        out[:, i] = given[i]
    return out


def nearest_psd(m: np.ndarray) -> np.ndarray:
    w, q = np.linalg.eigh((m + m.T) / 2)
    return (q * np.maximum(w, 1e-12)) @ q.T


def equicorr_sample(n: int, d: int, rho: float, rng: np.random.Generator) -> np.ndarray:
    """O(n d), negative correlations too: the mean of the rows gets its own scale."""
    e = rng.standard_normal((n, d))
    mean = e.mean(1, keepdims=True)
    z = np.sqrt(1 - rho) * (e - mean) + np.sqrt(max(0.0, 1 + (d - 1) * rho)) * mean
    return special.norm_cdf(z)
