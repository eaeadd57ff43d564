import numpy as np
import pytest

from dependra.functions.backend import num
from dependra.functions.families import Copula
from dependra.operators import dynamic, latent


def test_equicorr_and_student_methods():
    rng = np.random.default_rng(0)
    z = rng.standard_normal((80, 1)) + rng.standard_normal((80, 3))
    u = (np.argsort(np.argsort(z, 0), 0) + 1) / 81
    e = dynamic.equicorr_emission(u)
    base = dynamic.fit_emission(e, "mle")
    assert 0.2 < base["r"] < 0.8
    for m in ("gas", "scar-tm-ou"):
        assert dynamic.fit_emission(e, m)["log_likelihood"] > base["log_likelihood"] - 0.5
    s = dynamic.student_emission(u, dynamic.tau_correlation(u))
    assert np.allclose(s.rows(6.0)[5], s.one(5, np.array([6.0]))[0])
    r, w = dynamic.posterior_weights(e, {"kappa": 5.0, "mu": 0.0, "nu": 0.5})
    assert w.shape == (80, len(r)) and np.allclose(w.sum(1), 1)


def test_moving_vine():
    rng = np.random.default_rng(1)
    c = Copula("clayton")
    b = rng.uniform(size=150)
    a, d = c.h_inv(num, rng.uniform(size=150), b, 2.0), c.h_inv(num, rng.uniform(size=150), b, 3.0)
    u = (np.argsort(np.argsort(np.column_stack([a, b, d]), 0), 0) + 1) / 151
    static = dynamic.fit_vine(u, "r", "mle")
    assert {frozenset((m.edge.a, m.edge.b)) for m in static if not m.edge.cond} == {frozenset((0, 1)), frozenset((1, 2))}
    moving = dynamic.fit_vine(u, "r", "scar-tm-ou", truncation=1)
    assert [m.method for m in moving][-1] == "mle" and moving[-1].edge.copula.family == "independence"
    m = moving[0]
    h, _ = m.h_pair(u[:, m.edge.a], u[:, m.edge.b])
    assert ((h > 0) & (h < 1)).all()


def test_condition_is_bayes():
    c = Copula("clayton")
    g = latent.ou_grid(5.0, 0.5, 1.0, 50, "dense")
    w = latent.condition(c, g, g.start, 0.3, 0.4)
    want = g.start * c.pdf(num, 0.3, 0.4, latent.parameters(c, g))
    assert np.allclose(w, want / want.sum()) and w.sum() == pytest.approx(1)
