import numpy as np
import pytest

from dependra.functions.backend import num
from dependra.functions.families import FAMILIES, Copula
from dependra.operators import batches, fit, latent, latent_many


def _series(sizes=(40, 61, 45, 90, 41)):
    rng = np.random.default_rng(3)
    out = []
    for n in sizes:
        v = rng.uniform(size=n)
        out.append((Copula("clayton").h_inv(num, rng.uniform(size=n), v, rng.uniform(0.5, 4.0)), v))
    return out


def _padded(pairs):
    return (*(batches.padded([p[side] for p in pairs])[0] for side in (0, 1)), np.array([len(p[0]) for p in pairs]))


def test_densities_on_a_grid_are_those_of_the_family():
    rng = np.random.default_rng(0)
    u, v = rng.uniform(size=(2, 200, 1))
    for f in FAMILIES.values():
        for rotation in f.rotations:
            c = Copula(f.name, rotation)
            r = np.linspace(-0.9, 0.9, 7) if f.name == "gaussian" else f.lower + np.geomspace(1e-3, 30.0, 7)
            assert np.allclose(c.log_pdf_grid(u, v, r), c.log_pdf(num, u, v, r), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("p", [(5.0, 0.5, 1.0), (8.0, 0.0, 5.0), (50.0, 0.5, 1.0), (0.5, 1.0, 20.0), (200.0, 0.0, 20.0)])
def test_ou_likelihoods_are_those_of_a_fine_grid(p):
    pairs = _series()
    for c in (Copula("clayton"), Copula("gaussian")):
        got = latent_many.ou_log_likelihoods(c, *_padded(pairs), np.array([2, 0, 3, 2, 4]), np.tile(p, (5, 1)))
        for x, j in zip(got, (2, 0, 3, 2, 4)):
            u, v = pairs[j]
            grid = latent.ou_dense(*p, 1 / (len(u) - 1), k=801)
            assert x == pytest.approx(latent.forward(grid, latent.emissions(c, u, v, latent.parameters(c, grid))).log_likelihood, abs=1e-3)


@pytest.mark.parametrize("p", [(5.0, 0.4, 0.6), (5.0, 0.13, 0.01), (5.0, 0.4, 2.0), (0.1, 0.3, 0.5), (80.0, 0.02, 0.2)])
def test_jacobi_likelihoods_have_converged(p, monkeypatch):
    pairs, c = _series(), Copula("clayton")
    i, q = np.arange(5), np.tile(p, (5, 1))
    got = latent_many.jacobi_log_likelihoods(c, *_padded(pairs), i, q)
    monkeypatch.setattr(latent_many, "ORDERS", (256,))
    assert np.allclose(got, latent_many.jacobi_log_likelihoods(c, *_padded(pairs), i, q), atol=5e-3)


@pytest.mark.parametrize("method", ["scar-tm-ou", "scar-tm-jacobi"])
def test_latent_fits_side_by_side_are_those_of_each_series(method, monkeypatch):
    pairs = _series()
    for family in ("clayton", "gumbel"):
        one = [fit.fit_arrays(Copula(family), u, v, method) for u, v in pairs]
        with monkeypatch.context() as m:
            m.setattr(fit, "fit_arrays", None)  # no series is fitted by itself
            many = fit.fit_many(Copula(family), pairs, method)
        for a, b, (u, _) in zip(many, one, pairs):
            assert a["n"] == len(u) and a["success"] == b["success"]
            assert a["log_likelihood"] == pytest.approx(b["log_likelihood"], abs=1e-6)
