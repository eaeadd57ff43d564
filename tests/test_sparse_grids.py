import numpy as np
import pytest

from dependra.functions.backend import num
from dependra.functions.families import Copula
from dependra.operators import latent

P = (5.0, 0.4, 0.6)


def _pairs(n=120):
    rng = np.random.default_rng(0)
    v = rng.uniform(size=n)
    return Copula("clayton").h_inv(num, rng.uniform(size=n), v, 2.0), v


def test_banded_steps_are_the_dense_ones():
    banded = latent.ou_banded(5.0, 0.0, 1.0, 1 / 99)
    dense = latent.ou_dense(5.0, 0.0, 1.0, 1 / 99, k=len(banded.x))
    w = np.random.default_rng(1).dirichlet(np.ones(len(banded.x)))
    assert np.allclose(banded.dense().move, dense.move, atol=1e-6) and len(banded.value) < 0.4 * len(banded.x) ** 2
    assert np.allclose(banded.push(w), w @ banded.dense().move) and np.allclose(banded.pull(w), banded.dense().move @ w)
    u, v = _pairs()
    c = Copula("clayton")
    e = latent.emissions(c, u, v, latent.parameters(c, banded))
    assert latent.forward(banded, e).log_likelihood == pytest.approx(latent.forward(dense, e).log_likelihood, abs=1e-4)
    assert np.allclose(latent.smooth(banded, e), latent.smooth(dense, e), atol=1e-5)


def test_exact_moments_of_a_jacobi_step():
    x = np.array([0.1, 0.4, 0.8])
    mean, var = latent.jacobi_moments(*P, 1e-5, x)
    assert np.allclose((mean - x) / 1e-5, 5.0 * (0.4 - x), atol=1e-3) and np.allclose(var / 1e-5, 0.36 * x * (1 - x), rtol=1e-3)
    a, b = latent.jacobi_law(*P)
    mean, var = latent.jacobi_moments(*P, 50.0, x)
    assert np.allclose(mean, 0.4) and np.allclose(var, a * b / ((a + b) ** 2 * (a + b + 1)))


@pytest.mark.parametrize("n", [60, 250, 1000])
def test_selected_order_is_near_the_process(n):
    g, tried = latent.select_jacobi_order(*P, n)
    assert tried[-1]["passed"] and [d["passed"] for d in tried[:-1]] == [False] * (len(tried) - 1)
    assert len(g.value) <= 11 * len(g.x) and np.allclose(g.push(g.start), g.start)
    assert abs(latent.jacobi_diagnostics(latent.jacobi_grid(*P, n), *P, n)["correlation"]) < 0.05


def test_jacobi_filters_agree():
    u, v = _pairs()
    c = Copula("clayton")
    f, grid = latent.jacobi_coefficients(c, u, v, P)
    sparse, _ = latent.select_jacobi_order(*P, len(u))
    e = latent.emissions(c, u, v, latent.parameters(c, sparse))
    s = latent.forward(sparse, e)
    assert f.log_likelihood == pytest.approx(s.log_likelihood, abs=0.3) == pytest.approx(latent.jacobi_log_likelihood(c, u, v, P), abs=0.3)
    assert np.allclose(f.predictive @ grid.x, s.predictive @ sparse.x, atol=0.02) and np.allclose(f.last.sum(), 1)
    assert np.allclose(latent.smooth(sparse, e).sum(1), 1)
