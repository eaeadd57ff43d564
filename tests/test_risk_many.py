import numpy as np
import pytest

from dependra.functions.backend import num
from dependra.functions.families import Copula
from dependra.operators import fit, marginals, risk, windows


@pytest.mark.parametrize("kind", ["normal", "laplace", "logistic", "hyperbolic", "arma-garch"])
def test_marginals_of_rows_are_those_of_each_row(kind):
    rng = np.random.default_rng(1)
    x, p = rng.normal(size=(4, 20)) * 0.01, rng.uniform(size=(4, 30))
    got = marginals.ppf_rows(kind, p, marginals.fit_rows(kind, x), x)
    assert np.allclose(got, [marginals.ppf_array(kind, q, marginals.fit_array(kind, h), h) for q, h in zip(p, x)], rtol=1e-12, atol=1e-15)


def test_risk_windows_side_by_side_are_those_of_each_window(spark, monkeypatch):
    monkeypatch.setattr(risk, "PLACES", 700)
    rng = np.random.default_rng(2)
    rows = [(k, t, *map(float, rng.normal(size=2) * 0.01)) for k, n in ((1, 22), (2, 25), (3, 9)) for t in range(n)]
    df = spark.createDataFrame(rows, "k long, t int, a double, b double")
    got = risk.risk_metrics(windows.expand_windows(df, 20, ["k"], ["t"]), "a", "b", ["k", "window"], ["t"], Copula("clayton"), gammas=(0.9, 0.95), draws=(100, 50), weights=(0.3, 0.7), seed=3)
    plan = got._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan  # no window is a group of its own
    got = {(r.k, r.window, r.n_mc, r.gamma): (r["var"], r.cvar) for r in got.collect()}
    assert len(got) == (3 + 6) * 4
    for k, w in [(1, w) for w in range(20, 23)] + [(2, w) for w in range(20, 26)]:
        x = np.array([r[2:] for r in rows if r[0] == k])[w - 20 : w]
        u, v = ((np.argsort(np.argsort(d)) + 1.0) / 21.0 for d in x.T)
        r = fit.mle(Copula("clayton"), u, v)["params"]["r"]
        own = np.random.default_rng(np.random.SeedSequence([3, *repr((np.int64(k), np.int64(w))).encode()]))
        for m in (100, 50):
            own.choice(1, size=m, p=[1.0])
            e = own.uniform(size=(2, m))
            a = Copula("clayton").h_inv(num, e[1], e[0], np.full(m, r))
            ret = [marginals.ppf_array("normal", q, marginals.fit_array("normal", d)) for q, d in zip((a, e[0]), x.T)]
            loss = np.sort(1.0 - np.exp(np.column_stack(ret)) @ np.array([0.3, 0.7]))
            for g in (0.9, 0.95):
                q = loss[int(np.ceil(g * m)) - 1]
                assert got[(k, w, m, g)] == pytest.approx((q, q + np.maximum(loss - q, 0).mean() / (1 - g)), abs=1e-8)
