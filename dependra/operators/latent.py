"""Copulas with a latent diffusion parameter: grids, filters, smoothers and samplers, in NumPy.

A latent process on a grid is (values, start weights, transition): the Ornstein-Uhlenbeck process by
quadrature of its kernel, by a banded or interpolated kernel, or by its eigenfunctions on Gauss-Hermite
nodes; the Jacobi process by its eigenfunctions on Gauss-Jacobi nodes. Time is scaled to [0, 1]: dt =
1 / (T - 1). One filter then serves all: predictive weights, likelihood, smoothing, mixtures, forecasts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.backend import num
from ..functions.families import Copula
from ..functions.special import gauss_hermite

AUTO_STEP = 1e-1  #: below this kappa * dt the eigenfunctions need too many terms


@dataclass(frozen=True)
class Grid:
    """``x`` latent nodes, ``start`` weights, ``move[i, j]`` the weight of going from i to j."""

    x: np.ndarray
    start: np.ndarray
    move: np.ndarray
    kind: str

    def push(self, w: np.ndarray) -> np.ndarray:
        return w @ self.move

    def pull(self, y: np.ndarray) -> np.ndarray:
        return self.move @ y


@dataclass(frozen=True)
class SparseGrid:
    """A grid whose few moves are kept as (row, column, value), by row and column."""

    x: np.ndarray
    start: np.ndarray
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    kind: str

    @classmethod
    def of(cls, x, start, row, column, value, kind: str) -> SparseGrid:
        """Values of one place are added, rows sum to one; rows without any value go to the start law."""
        k = len(x)
        key, at = np.unique(row * k + column, return_inverse=True)
        value = np.bincount(at, value)
        row, column = key // k, key % k
        total = np.bincount(row, value, k)
        if len(empty := np.flatnonzero(total <= 0)):
            kept = total[row] > 0
            return cls.of(x, start, np.append(row[kept], np.repeat(empty, k)), np.append(column[kept], np.tile(np.arange(k), len(empty))), np.append(value[kept], np.tile(start, len(empty))), kind)
        return cls(x, start, row, column, value / total[row], kind)

    def push(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * w[self.row], len(w))

    def pull(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * y[self.column], len(y))

    def dense(self) -> Grid:
        move = np.zeros((len(self.x), len(self.x)))
        move[self.row, self.column] = self.value
        return Grid(self.x, self.start, move, self.kind)


def _rows(m: np.ndarray) -> np.ndarray:
    m = np.maximum(m, 0.0)
    return m / m.sum(1, keepdims=True)


def ou_moments(kappa: float, nu: float, dt: float) -> tuple[float, float]:
    """Stationary deviation and one-step correlation."""
    return nu / np.sqrt(2 * kappa), float(np.exp(-kappa * dt))


def ou_nodes(kappa: float, nu: float, dt: float, points: int = 4, reach: float = 5.0, most: int = 400) -> int:
    """Nodes for at least ``points`` of them in one conditional deviation."""
    _, rho = ou_moments(kappa, nu, dt)
    return int(min(most, max(33, np.ceil(2 * reach * points / np.sqrt(max(1e-12, 1 - rho * rho)))))) | 1


def ou_dense(kappa, mu, nu, dt, k: int | None = None, reach: float = 5.0) -> Grid:
    """The Gaussian kernel times trapezoid weights."""
    sigma, rho = ou_moments(kappa, nu, dt)
    k = k or ou_nodes(kappa, nu, dt, reach=reach)
    z = np.linspace(-reach, reach, k)
    weight = np.full(k, z[1] - z[0])
    weight[[0, -1]] /= 2
    start = np.exp(-0.5 * z * z) * weight
    s = np.sqrt(1 - rho * rho)
    far = (z[None, :] - rho * z[:, None]) / s
    kernel = np.exp(-0.5 * far * far) * weight
    return Grid(mu + sigma * z, start / start.sum(), _rows(kernel), "dense")


def ou_banded(kappa, mu, nu, dt, k: int | None = None, reach: float = 5.0, band: float = 5.0, most: int = 4001) -> SparseGrid:
    """The same kernel at nodes within ``band`` conditional deviations alone, so short steps may take thousands of nodes."""
    sigma, rho = ou_moments(kappa, nu, dt)
    k = k or ou_nodes(kappa, nu, dt, reach=reach, most=most)
    z = np.linspace(-reach, reach, k)
    step, s = z[1] - z[0], np.sqrt(1 - rho * rho)
    weight = np.full(k, step)
    weight[[0, -1]] /= 2
    start = np.exp(-0.5 * z * z) * weight
    first = np.ceil((rho * z - band * s + reach) / step).astype(int)
    column = first[:, None] + np.arange(int(2 * band * s / step) + 1)
    row = np.broadcast_to(np.arange(k)[:, None], column.shape)
    inside = (column >= 0) & (column < k)
    row, column = row[inside], column[inside]
    far = (z[column] - rho * z[row]) / s
    value = np.where(np.abs(far) <= band, np.exp(-0.5 * far * far) * weight[column], 0.0)
    return SparseGrid.of(mu + sigma * z, start / start.sum(), row, column, value, "banded")


def ou_local(kappa, mu, nu, dt, k: int = 129, reach: float = 5.0, order: int = 9) -> Grid:
    """Gauss-Hermite steps from each node, interpolated linearly to the neighbouring nodes."""
    sigma, rho = ou_moments(kappa, nu, dt)
    z = np.linspace(-reach, reach, k)
    start = np.exp(-0.5 * z * z)
    e, w = gauss_hermite(order)
    target = np.clip(rho * z[:, None] + np.sqrt(1 - rho * rho) * e, -reach, reach)
    at = (target + reach) / (2 * reach) * (k - 1)
    low = np.minimum(at.astype(int), k - 2)
    part = at - low
    move = np.zeros((k, k))
    i = np.repeat(np.arange(k), order)
    np.add.at(move, (i, low.ravel()), (w * (1 - part)).ravel())
    np.add.at(move, (i, low.ravel() + 1), (w * part).ravel())
    return Grid(mu + sigma * z, start / start.sum(), _rows(move), "local")


def _eigen_move(diagonal, off, eigenvalues) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, weights and transition on a Gauss rule whose orthonormal polynomials are the eigenfunctions."""
    nodes, vec = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    root = np.abs(vec[0])
    move = (vec.T * eigenvalues) @ vec * root[None, :] / np.maximum(root[:, None], 1e-150)
    return nodes, root**2, move


def ou_spectral(kappa, mu, nu, dt, k: int = 48) -> Grid:
    """Hermite eigenfunctions: the n-th decays by rho^n."""
    sigma, rho = ou_moments(kappa, nu, dt)
    nodes, w, move = _eigen_move(np.zeros(k), np.sqrt(np.arange(1, k, dtype=float)), rho ** np.arange(k))
    return Grid(mu + sigma * nodes, w / w.sum(), _rows(move), "spectral")


def ou_grid(kappa, mu, nu, n: int, method: str = "auto") -> Grid:
    dt = 1.0 / max(1, n - 1)
    if method == "auto":
        method = "spectral" if kappa * dt > AUTO_STEP else "dense" if ou_nodes(kappa, nu, dt) < 400 else "local"
    make = {"dense": ou_dense, "matrix": ou_dense, "banded": ou_banded, "local": ou_local, "spectral": ou_spectral}
    return make[method](kappa, mu, nu, dt)


def jacobi_law(kappa: float, m: float, xi: float) -> tuple[float, float]:
    """The stationary Beta law of the Jacobi process."""
    return 2 * kappa * m / xi**2, 2 * kappa * (1 - m) / xi**2


def _jacobi_rule(kappa, m, xi, dt, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the law's Jacobi matrix on (-1, 1), and the eigenfunctions' decay over a step; parameters may be arrays."""
    kappa, m, xi, dt = (np.asarray(p, float)[..., None] for p in (kappa, m, xi, dt))
    a, b = jacobi_law(kappa, m, xi)
    al, be = b - 1.0, a - 1.0
    i = np.arange(k, dtype=float)
    s = 2 * i + al + be
    with np.errstate(divide="ignore", invalid="ignore"):
        diagonal = (be * be - al * al) / (s * (s + 2))
    diagonal[..., :1] = (be - al) / (al + be + 2)
    j = np.arange(1, k, dtype=float)
    s = 2 * j + al + be
    with np.errstate(divide="ignore", invalid="ignore"):
        off2 = 4 * j * (j + al) * (j + be) * (j + al + be) / (s * s * (s + 1) * (s - 1))
    off2[..., :1] = 4 * (1 + al) * (1 + be) / ((2 + al + be) ** 2 * (3 + al + be))
    decay = np.exp(-(kappa * i + xi * xi * i * (i - 1) / 2) * dt)
    return np.where(np.isfinite(diagonal), diagonal, 0.0), np.sqrt(np.maximum(off2, 0.0)), decay


def jacobi_nodes(xi: float, n: int, least: int = 40, most: int = 160) -> int:
    """Nodes as far apart as one step's deviation, which in the angle acos(1 - 2 x) is xi sqrt(dt) everywhere."""
    return int(np.clip(np.ceil(np.pi * np.sqrt(max(1, n - 1)) / xi), least, most))


def jacobi_grid(kappa: float, m: float, xi: float, n: int, k: int | None = None) -> Grid:
    """Local steps on the law's Gauss rule; their correlation is nearer to the process than :func:`jacobi_spectral`'s."""
    return jacobi_local(kappa, m, xi, n, k or jacobi_nodes(xi, n)).dense()


def jacobi_spectral(kappa: float, m: float, xi: float, n: int, k: int = 40) -> Grid:
    """Jacobi eigenfunctions: the i-th decays by exp(-(kappa i + xi^2 i (i - 1) / 2) dt). Negative weights are cut off."""
    nodes, w, move = _eigen_move(*_jacobi_rule(kappa, m, xi, 1.0 / max(1, n - 1), k))
    return Grid(np.clip((nodes + 1) / 2, 1e-6, 1 - 1e-6), w / w.sum(), metropolis(_rows(move), w / w.sum()), "jacobi")


def jacobi_moments(kappa: float, m: float, xi: float, dt: float, x):
    """Mean and variance of the process a step after x, exactly: both moments follow linear equations."""
    fall, q = np.exp(-kappa * dt), 2 * kappa + xi * xi
    second = np.exp(-q * dt)
    c = (2 * kappa * m + xi * xi) / q
    slope = (2 * kappa * m + xi * xi) / (kappa + xi * xi)
    mean = m + (x - m) * fall
    return mean, np.maximum(c * m * (1 - second) + slope * (x - m) * (fall - second) + x * x * second - mean * mean, 0.0)


def jacobi_local(kappa: float, m: float, xi: float, n: int, k: int = 160, order: int = 5) -> SparseGrid:
    """Steps of the exact mean and variance from every node of the law's own Gauss rule, to at most two nodes for each of ``order`` targets.

    Moves that the stationary law would not return are refused, so it stays exact.
    """
    dt = 1.0 / max(1, n - 1)
    diagonal, off, _ = _jacobi_rule(kappa, m, xi, dt, k)
    nodes, vec = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    x, law = np.clip((nodes + 1) / 2, 1e-6, 1 - 1e-6), vec[0] ** 2 / (vec[0] ** 2).sum()
    mean, var = jacobi_moments(kappa, m, xi, dt, x)
    e, w = gauss_hermite(order)
    low = np.clip(np.searchsorted(x, mean) - 1, 0, k - 2)
    # a move to two neighbours adds the variance between them, which the targets leave out
    spread = np.sqrt(np.maximum(var - np.clip((mean - x[low]) * (x[low + 1] - mean), 0.0, None), 0.0))
    target = np.clip(mean[:, None] + spread[:, None] * e, x[0], x[-1])
    low = np.clip(np.searchsorted(x, target.ravel()) - 1, 0, k - 2)
    part = (target.ravel() - x[low]) / (x[low + 1] - x[low])
    row, weight = np.repeat(np.arange(k), order), np.tile(w / w.sum(), k)
    g = SparseGrid.of(x, law, np.concatenate([row, row]), np.concatenate([low, low + 1]), np.concatenate([weight * (1 - part), weight * part]), "jacobi-local")
    return _sparse_metropolis(g)


def _sparse_metropolis(g: SparseGrid) -> SparseGrid:
    k, law = len(g.x), np.maximum(g.start, 1e-300)
    key, flow = g.row * k + g.column, law[g.row] * g.value
    back = g.column * k + g.row
    at = np.minimum(np.searchsorted(key, back), len(key) - 1)
    both = np.where(key[at] == back, np.minimum(flow, flow[at]), 0.0) / law[g.row]
    stay = 1.0 - np.bincount(g.row, both, k)
    i = np.arange(k)
    return SparseGrid.of(g.x, g.start, np.append(g.row, i), np.append(g.column, i), np.append(both, np.maximum(stay, 0.0)), g.kind)


def jacobi_diagnostics(g: Grid | SparseGrid, kappa: float, m: float, xi: float, n: int) -> dict:
    """How far a grid is from the process: total variation of its law over a step, its variance, and its correlation over all steps of a path."""
    a, b = jacobi_law(kappa, m, xi)
    p, x = g.start, g.x
    mean = p @ x
    var = p @ (x - mean) ** 2
    y, steps = x - mean, min(max(1, n - 1), 200)
    for _ in range(steps):
        y = g.pull(y)
    want = np.exp(-kappa * steps / max(1, n - 1))
    return {"variation": 0.5 * float(np.abs(g.push(p) - p).sum()), "variance": float(var / (a * b / ((a + b) ** 2 * (a + b + 1))) - 1.0), "correlation": float(p @ ((x - mean) * y) / var - want)}


def select_jacobi_order(kappa: float, m: float, xi: float, n: int, ladder=(40, 80, 160, 320, 640), variation: float = 1e-8, variance: float = 0.02, correlation: float = 0.05) -> tuple[SparseGrid, list[dict]]:
    """The smallest sparse grid of the ladder that meets all bounds, else the one nearest in correlation, and what each step gave."""
    tried, grids = [], []
    for k in ladder:
        g = jacobi_local(kappa, m, xi, n, k)
        d = jacobi_diagnostics(g, kappa, m, xi, n)
        passed = d["variation"] <= variation and abs(d["variance"]) <= variance and abs(d["correlation"]) <= correlation
        tried.append({"k": k, **d, "passed": bool(passed)})
        grids.append(g)
        if passed:
            return g, tried
    return grids[int(np.argmin([abs(d["correlation"]) for d in tried]))], tried


def jacobi_coefficients(copula: Copula, u, v, params, k: int = 40) -> tuple[Filtered, Grid]:
    """The filter that carries the state's density as coefficients of the eigenfunctions: a step is a product with their decay.

    Densities are floored at zero at the nodes of the rule. Returns the weights there and the grid that they are on.
    """
    kappa, m, xi = params
    diagonal, off, decay = _jacobi_rule(kappa, m, xi, 1.0 / max(1, len(u) - 1), k)
    nodes, vec = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    law = vec[0] ** 2 / (vec[0] ** 2).sum()
    basis = vec / np.where(np.abs(vec[0]) < 1e-150, 1e-150, vec[0])
    grid = Grid(np.clip((nodes + 1) / 2, 1e-6, 1 - 1e-6), law, np.eye(k), "jacobi")
    log_e = emissions(copula, u, v, parameters(copula, grid))
    a, total, out, w = np.zeros(k), 0.0, np.empty_like(log_e), law
    a[0] = 1.0
    for t, row in enumerate(log_e):
        w = law * np.maximum(basis.T @ a, 0.0)
        w = out[t] = w / w.sum()
        top = row.max()
        w = w * np.exp(row - top)
        mass = w.sum()
        total += top + np.log(mass)
        w = w / mass
        a = decay * (basis @ w)
    return Filtered(out, w, float(total)), grid


def metropolis(move: np.ndarray, law: np.ndarray) -> np.ndarray:
    """Accept moves so that ``law`` is stationary; what is refused stays."""
    law = np.maximum(law, 1e-300)
    flow = law[:, None] * move
    out = np.minimum(flow, flow.T) / law[:, None]
    out[np.diag_indices(len(out))] += 1.0 - out.sum(1)
    return out


def emissions(copula: Copula, u, v, r) -> np.ndarray:
    """log c of each row at each grid parameter, T x K."""
    return copula.log_pdf(num, np.asarray(u)[:, None], np.asarray(v)[:, None], np.asarray(r)[None, :])


def parameters(copula: Copula, grid: Grid) -> np.ndarray:
    """Grid nodes as copula parameters: by the link, or from tau on a Jacobi grid."""
    if grid.kind.startswith("jacobi"):
        return np.array([copula.start(copula.sign * float(t)) for t in grid.x])
    return copula.base.link(copula.link).forward(num, grid.x)


@dataclass(frozen=True)
class Filtered:
    predictive: np.ndarray  # T x K, before each observation
    last: np.ndarray  # after the last observation
    log_likelihood: float


def forward(grid: Grid, log_e: np.ndarray) -> Filtered:
    w, total = grid.start.copy(), 0.0
    out = np.empty_like(log_e)
    for t, row in enumerate(log_e):
        if t:
            w = grid.push(w)
        out[t] = w
        top = row.max()
        w = w * np.exp(row - top)
        mass = w.sum()
        total += top + np.log(mass)
        w = w / mass
    return Filtered(out, w, float(total))


def smooth(grid: Grid, log_e: np.ndarray) -> np.ndarray:
    """Weights of each time given all observations."""
    f = forward(grid, log_e)
    back, out = np.ones(log_e.shape[1]), np.empty_like(log_e)
    for t in range(len(log_e) - 1, -1, -1):
        e = np.exp(log_e[t] - log_e[t].max())
        w = f.predictive[t] * e * back
        out[t] = w / w.sum()
        back = grid.pull(e * back)
        back = back / back.max()
    return out


def predictive_mean(copula: Copula, grid: Grid, u, v) -> np.ndarray:
    r = parameters(copula, grid)
    return forward(grid, emissions(copula, u, v, r)).predictive @ r


def mixture_h(copula: Copula, grid: Grid, u, v) -> np.ndarray:
    """The distribution of v given u, mixed over the predictive weights."""
    r = parameters(copula, grid)
    w = forward(grid, emissions(copula, u, v, r)).predictive
    return (w * copula.transposed().h(num, np.asarray(v)[:, None], np.asarray(u)[:, None], r[None, :])).sum(1)


def terminal(copula: Copula, grid: Grid, u, v, horizon: str = "current") -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of the state after the data, or one step on."""
    w = forward(grid, emissions(copula, u, v, parameters(copula, grid))).last
    return grid.x, grid.push(w) if horizon == "next" else w


def condition(copula: Copula, grid: Grid, w: np.ndarray, u: float, v: float) -> np.ndarray:
    """Weights after one more observation (Bayes)."""
    p = w * np.exp(emissions(copula, [u], [v], parameters(copula, grid))[0])
    return p / p.sum()


def ou_log_likelihood(copula: Copula, u, v, params, method: str = "auto") -> float:
    g = ou_grid(*params, len(u), method)
    return forward(g, emissions(copula, u, v, parameters(copula, g))).log_likelihood


def jacobi_log_likelihood(copula: Copula, u, v, params) -> float:
    g = jacobi_grid(*params, len(u))
    return forward(g, emissions(copula, u, v, parameters(copula, g))).log_likelihood


def ou_paths(kappa, mu, nu, n: int, normals: np.ndarray) -> np.ndarray:
    """Exact paths from standard normals (paths x n)."""
    sigma, rho = ou_moments(kappa, nu, 1.0 / max(1, n - 1))
    x = np.empty_like(normals)
    x[:, 0] = mu + sigma * normals[:, 0]
    for t in range(1, n):
        x[:, t] = mu + rho * (x[:, t - 1] - mu) + sigma * np.sqrt(1 - rho * rho) * normals[:, t]
    return x


def mc_log_likelihood(copula: Copula, u, v, params, normals: np.ndarray) -> float:
    """Log of the mean over prior paths of their likelihood (fixed draws)."""
    x = ou_paths(*params, len(u), normals)
    r = copula.base.link(copula.link).forward(num, x)
    ll = copula.log_pdf(num, np.asarray(u)[None, :], np.asarray(v)[None, :], r).sum(1)
    top = ll.max()
    return float(top + np.log(np.mean(np.exp(ll - top))))


def eis_log_likelihood(copula: Copula, u, v, params, normals: np.ndarray, rounds: int = 5) -> float:
    """Importance sampling with Gaussian tilts exp(a x + b x^2) of each step, fitted backwards by regressions."""
    kappa, mu, nu = params
    n, link = len(u), copula.base.link(copula.link)
    sigma, rho = ou_moments(kappa, nu, 1.0 / max(1, n - 1))
    var = np.full(n, sigma**2 * (1 - rho**2))
    var[0] = sigma**2
    a, b = np.zeros(n), np.zeros(n)

    def run():
        x, log_w = np.empty_like(normals), np.zeros(len(normals))
        for t in range(n):
            m = np.full(len(normals), mu) if t == 0 else mu + rho * (x[:, t - 1] - mu)
            p = 1.0 / var[t] - 2 * b[t]
            mean = (m / var[t] + a[t]) / p
            x[:, t] = mean + normals[:, t] / np.sqrt(p)
            # the integral of prior times tilt, needed for the weights and for the regression of step t - 1
            log_chi = 0.5 * (mean * mean * p - m * m / var[t]) - 0.5 * np.log(var[t] * p)
            e = copula.log_pdf(num, u[t], v[t], link.forward(num, x[:, t]))
            log_w += e - a[t] * x[:, t] - b[t] * x[:, t] ** 2 + log_chi
        return x, log_w

    for _ in range(rounds):
        x, _ = run()
        new_a, new_b = np.zeros(n), np.zeros(n)
        for t in range(n - 1, -1, -1):
            target = copula.log_pdf(num, u[t], v[t], link.forward(num, x[:, t]))
            if t + 1 < n:
                m = mu + rho * (x[:, t] - mu)
                p = 1.0 / var[t + 1] - 2 * new_b[t + 1]
                target = target + 0.5 * ((m / var[t + 1] + new_a[t + 1]) ** 2 / p - m * m / var[t + 1])
            k = np.column_stack([np.ones(len(x)), x[:, t], x[:, t] ** 2])
            c = np.linalg.lstsq(k, target, rcond=None)[0]
            new_a[t], new_b[t] = c[1], min(c[2], 0.45 / var[t])
        a, b = 0.5 * a + 0.5 * new_a, 0.5 * b + 0.5 * new_b
    _, log_w = run()
    top = log_w.max()
    return float(top + np.log(np.mean(np.exp(log_w - top))))


def sample_latent(grid: Grid, n: int, rng: np.random.Generator) -> np.ndarray:
    """A path of grid values."""
    at = rng.choice(len(grid.x), p=grid.start / grid.start.sum())
    out = np.empty(n)
    cumulative = np.cumsum((grid if isinstance(grid, Grid) else grid.dense()).move, axis=1)
    for t in range(n):
        if t:
            at = min(int(np.searchsorted(cumulative[at], rng.uniform() * cumulative[at, -1])), len(grid.x) - 1)
        out[t] = grid.x[at]
    return out


def jacobi_euler(kappa: float, m: float, xi: float, n: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    """Euler steps in the angle y = arccos(1 - 2 tau), reflected at the ends."""
    h = 1.0 / max(1, n - 1) / steps
    a, b = jacobi_law(kappa, m, xi)
    y = np.arccos(1 - 2 * rng.beta(a, b))
    out = np.empty(n)
    for t in range(n):
        out[t] = (1 - np.cos(y)) / 2
        for _ in range(steps):
            s = max(np.sin(y), 1e-3)
            drift = (2 * kappa * (m - (1 - np.cos(y)) / 2) - xi * xi / 2 * np.cos(y)) / s
            y = y + drift * h + xi * np.sqrt(h) * rng.standard_normal()
            y = abs(y)
            y = 2 * np.pi - y if y > np.pi else y
            y = min(max(y, 1e-6), np.pi - 1e-6)
    return out
