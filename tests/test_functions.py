import math

import numpy as np
import pytest

from dependra.functions import scalars as s, special
from dependra.functions.backend import col, num
from dependra.functions.families import FAMILIES, Copula

CASES = [(f, rot, r) for f, r in (("clayton", 2.0), ("frank", 5.0), ("gumbel", 2.0), ("joe", 2.5), ("gaussian", 0.6)) for rot in FAMILIES[f].rotations]


@pytest.fixture(scope="module")
def uv():
    return np.random.default_rng(42).uniform(0.05, 0.95, (2, 60))


@pytest.mark.parametrize("family,rotation,r", CASES)
def test_density_is_slope_of_h_and_score_is_slope_of_log_density(family, rotation, r, uv):
    u, v = uv
    c, e = Copula(family, rotation), 1e-5
    slope = (c.h(num, u + e, v, r) - c.h(num, u - e, v, r)) / (2 * e)
    assert np.allclose(slope, c.pdf(num, u, v, r), rtol=2e-5)
    score = (c.log_pdf(num, u, v, r + e) - c.log_pdf(num, u, v, r - e)) / (2 * e)
    assert np.allclose(score, c.score(num, u, v, r), rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("family,rotation,r", CASES)
def test_inverse_h_and_transposition(family, rotation, r, uv):
    u, v = uv
    c = Copula(family, rotation)
    assert np.allclose(c.h_inv(num, c.h(num, u, v, r), v, r), u, atol=1e-7)
    assert np.allclose(c.log_pdf(num, u, v, r), c.transposed().log_pdf(num, v, u, r))


@pytest.mark.parametrize("family,rotation,r", CASES)
def test_tau_is_its_integral_and_maps_back(family, rotation, r):
    c = Copula(family, rotation)
    x, w = special.gauss_legendre(120)
    a, b = np.meshgrid(x, x)
    tau = 1 - 4 * np.sum(np.outer(w, w) * c.h(num, a, b, r) * c.transposed().h(num, b, a, r))
    assert tau == pytest.approx(float(c.tau(num, np.float64(r))), abs=2e-4)
    assert float(c.from_tau(num, c.tau(num, np.float64(r)))) == pytest.approx(r, rel=1e-6)


@pytest.mark.parametrize("family,rotation,r", CASES)
def test_both_evaluators_agree(spark, family, rotation, r, uv):
    from pyspark.sql import functions as F

    u, v = uv
    c = Copula(family, rotation)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(u, v)], "u double, v double")
    U, V, R = F.col("u"), F.col("v"), F.lit(r)
    got = df.select(c.log_pdf(col, U, V, R).alias("a"), c.score(col, U, V, R).alias("b"), c.h(col, U, V, R).alias("c"), c.h_inv(col, U, V, R).alias("d")).toPandas().to_numpy()
    want = np.column_stack([c.log_pdf(num, u, v, r), c.score(num, u, v, r), c.h(num, u, v, r), c.h_inv(num, u, v, r)])
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_special_functions():
    x = np.array([-8.0, -2.0, -0.3, 0.0, 0.4, 3.0, 6.0])
    assert np.allclose(special.norm_cdf(x), [0.5 * math.erfc(-t / math.sqrt(2)) for t in x], rtol=1e-13)
    p = np.array([1e-8, 0.01, 0.3, 0.5, 0.8, 0.999])
    assert np.allclose(special.norm_cdf(special.norm_ppf(p)), p, rtol=1e-12)
    for df in (2.5, 7.0, 300.0):
        assert np.allclose(special.t_cdf(special.t_ppf(p, df), df), p, rtol=1e-9)
    assert np.allclose(special.chi2_cdf(np.array([2.0, 9.0]), 2), 1 - np.exp(-np.array([1.0, 4.5])))
    x, w = special.gauss_jacobi(20, 2.5, 3.5)
    assert w.sum() == pytest.approx(1) and (w * x).sum() == pytest.approx(2.5 / 6)
    x, w = special.gauss_hermite(20)
    assert (w * x**4).sum() == pytest.approx(3)


@pytest.mark.parametrize("link", [s.softplus_link(1.0), s.exp_link(1.0), s.logistic_link(1.0), s.gaussian_link(), s.equicorr_link(4), s.student_df_link()])
def test_links(link):
    x = np.linspace(-3, 3, 31)
    assert np.allclose(link.inverse(num, link.forward(num, x)), x, atol=1e-6)
    assert np.allclose((link.forward(num, x + 1e-6) - link.forward(num, x - 1e-6)) / 2e-6, link.slope(num, x), atol=1e-6)


def test_refusals():
    with pytest.raises(ValueError):
        Copula("frank", 90)
    with pytest.raises(ValueError):
        Copula("nothing")
