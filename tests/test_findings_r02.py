import numpy as np
import pytest

from dependra.functions import special
from dependra.functions.backend import num
from dependra.functions.families import Copula
from dependra.operators import dynamic


def test_equicorr_latent_values_at_a_bound():
    rng = np.random.default_rng(0)
    e = dynamic.equicorr_emission(rng.uniform(size=(20, 3)))
    for x in (-40.0, 40.0):
        assert np.isfinite(e.rows(float(e.link.forward(num, np.float64(x))))).all()
        assert np.isfinite(e.one(0, e.link.forward(num, np.array([x])))).all()


@pytest.mark.parametrize("df", [2.001, 4.0, 6.0, 37.5])
def test_student_tables_are_the_functions(df):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.uniform(size=9000), 10 ** rng.uniform(-12, -1, 500), 1 - 10 ** rng.uniform(-12, -1, 500)])
    few = lambda f, x: np.concatenate([f(k, df) for k in np.array_split(x, 10)])
    x = special.t_ppf(p, df)
    assert np.max(np.abs(few(special.t_cdf, x) - p)) < 1e-10
    inner = (p > 1e-6) & (p < 1 - 1e-6)
    assert np.allclose(x[inner], few(special.t_ppf, p)[inner], rtol=1e-8, atol=1e-8)
    q = special.t_cdf(x, df)
    assert np.allclose(q, few(special.t_cdf, x), rtol=0, atol=1e-9)
    assert special._ppf_table.cache_info().currsize and special._cdf_table.cache_info().currsize


def test_tau_of_long_columns_is_exact(spark, monkeypatch):
    from dependra.operators import aggregates as agg, vine

    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, 3000) / 10
    y = np.round(x + rng.normal(size=3000), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double")
    assert agg.kendall_tau_long(df, "x", "y", 7) == pytest.approx(agg.kendall_tau(x, y), abs=1e-14)
    assert agg.discordances(y[:500]) == sum(int((y[:i] > y[i]).sum()) for i in range(500))
    # vine fits of long tables do not gather a pair of columns in one task
    monkeypatch.setattr(vine, "TAU_ROWS", 100)
    monkeypatch.setattr(vine, "TAU_BLOCK", 500)
    monkeypatch.setattr(vine, "kendall_tau_agg", None)
    u = (np.argsort(np.argsort(np.column_stack([x, y]), 0), 0) + 1) / 3001
    got = vine.fit(spark.createDataFrame([tuple(map(float, r)) for r in u], "u double, v double"), ["u", "v"], "r", ("clayton", "gaussian"))
    assert got.edges[0].tau == pytest.approx(agg.kendall_tau(u[:, 0], u[:, 1]), abs=1e-14)


def _pairs(sizes, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        v = rng.uniform(size=n)
        u = Copula("clayton").h_inv(num, rng.uniform(size=n), v, rng.uniform(0.5, 4.0))
        out.append((u, v))
    return out


@pytest.mark.parametrize("method", ["mle", "gas"])
def test_fits_side_by_side_are_those_of_each_series(method):
    from dependra.operators import fit

    pairs = _pairs([40, 61, 45, 90, 41])
    for family in ("clayton", "gaussian"):
        many = fit.fit_many(Copula(family), pairs, method)
        for got, (u, v) in zip(many, pairs):
            one = fit.fit_arrays(Copula(family), u, v, method)
            assert got["n"] == len(u) and got["log_likelihood"] == pytest.approx(one["log_likelihood"], abs=1e-7 if method == "mle" else 0.5)  # score-driven likelihoods are chaotic


def test_series_of_all_keys_reach_a_batch_whole(spark, monkeypatch):
    from dependra.operators import batches

    rows = [(k, t, float(t)) for k in (None, 1, 2, 3, 2**60 + 1) for t in range(7)]
    df = spark.createDataFrame(rows, "k long, t long, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = batches.map_series(df, ["x"], ["k"], ["t"], "n long, last double", lambda keys, series: [[(len(s), float(s[-1, 0]))] for s in series], rows=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.k or 0, r.n, r["last"]) for r in got) == [(0, 7, 6.0), (1, 7, 6.0), (2, 7, 6.0), (3, 7, 6.0), (2**60 + 1, 7, 6.0)]


def test_equicorr_series_side_by_side():
    rng = np.random.default_rng(4)
    series = []
    for n in (40, 55, 47, 70):
        z = rng.standard_normal((n, 1)) + rng.standard_normal((n, 3))
        series.append((np.argsort(np.argsort(z, 0), 0) + 1) / (n + 1))
    for got, u in zip(dynamic.equicorr_gas_many(series), series):
        assert got["log_likelihood"] == pytest.approx(dynamic.fit_emission(dynamic.equicorr_emission(u), "gas")["log_likelihood"], abs=0.5)


def test_vines_grow_together():
    rng = np.random.default_rng(5)
    series = []
    for n in (40, 55, 47):
        z = rng.standard_normal((n, 1)) + rng.standard_normal((n, 3))
        series.append((np.argsort(np.argsort(z, 0), 0) + 1) / (n + 1))
    for given in ((), (0, 2)):
        for got, u in zip(dynamic.fit_vine_many(series, "r", "mle", given=given), series):
            one = dynamic.fit_vine(u, "r", "mle", given=given)
            assert [m.edge.key for m in got] == [m.edge.key for m in one]
            assert [m.edge.copula for m in got] == [m.edge.copula for m in one]
            assert np.allclose([m.edge.log_likelihood for m in got], [m.edge.log_likelihood for m in one], atol=1e-7)
