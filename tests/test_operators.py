from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from dependra.functions.backend import num
from dependra.functions.families import Copula
from dependra.operators import aggregates as agg, fit, gof, latent, marginals, multivariate as mv, ranks, recursions as rec, risk, sample, vine as vines, windows as win
from dependra.sources import models


def brute_tau(x, y):
    s = np.sign(np.subtract.outer(x, x)) * np.sign(np.subtract.outer(y, y))
    free = lambda a: (np.subtract.outer(a, a) != 0).sum()
    return s.sum() / np.sqrt(free(x)) / np.sqrt(free(y))


@pytest.mark.parametrize("levels", [3, 10, 10**6])
def test_kendall_tau(levels):
    rng = np.random.default_rng(levels)
    for n in (2, 3, 7, 64, 101):
        x, y = rng.integers(0, levels, n), rng.integers(0, levels, n)
        if len(set(x)) > 1 and len(set(y)) > 1:
            assert agg.kendall_tau(x, y) == pytest.approx(brute_tau(x, y))
    assert agg.kendall_tau([1, 1, 1], [1, 2, 3]) == 0.0


def test_global_rank_with_hot_value_and_nulls(spark):
    rows = [(i, None if i % 11 == 0 else float(7 if i % 3 else i % 50)) for i in range(600)]
    got = ranks.pseudo_observations(spark.createDataFrame(rows, "id long, x double"), ["x"], ["id"]).collect()
    live = sorted((x, i) for i, x in rows if x is not None)
    want = {i: (k + 1) / (len(live) + 1) for k, (_, i) in enumerate(live)}
    assert {r.id: r.u_x for r in got if r.x is not None} == pytest.approx(want)
    assert all(r.u_x is None for r in got if r.x is None)


def test_large_groups_are_ranked_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranks, "GROUP_ROWS", 10)
    rng = np.random.default_rng(8)
    rows = [(i, None if g == 3 else int(g), None if x == 9 else float(x) if g else float(rng.normal()), float(rng.integers(0, 40))) for i, (g, x) in enumerate(zip(rng.integers(0, 4, 500), rng.integers(0, 10, 500)))]
    got = ranks.pseudo_observations(spark.createDataFrame(rows, "id long, g int, x double, y double"), ["x", "y"], ["id"], ["g"]).collect()
    assert len(got) == 500
    for g in (0, 1, 2, None):
        for c, u in ((2, "u_x"), (3, "u_y")):
            own = sorted((r[c], r[0]) for r in rows if r[1] == g and r[c] is not None)
            want = {i: (k + 1) / (len(own) + 1) for k, (_, i) in enumerate(own)}
            assert {r.id: r[u] for r in got if r.g == g and r[u] is not None} == pytest.approx(want)


def test_rank_by_group_and_checks(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 0.5), (2, 9.0)], "g int, x double").withColumn("k", F.monotonically_increasing_id())
    got = sorted((r.g, r.u_x) for r in ranks.pseudo_observations(df, ["x"], ["k"], ["g"]).collect())
    assert got == [(1, 0.25), (1, 0.5), (1, 0.75), (2, 0.5)]
    with pytest.raises(Exception):
        ranks.assert_unit(df, ["x"]).collect()
    with pytest.raises(ValueError):
        ranks.numeric(spark.createDataFrame([("a",)], "x string"), ["x"])
    with pytest.raises(ValueError):
        ranks.check_dimension(["a"])
    empty = df.limit(0)
    assert ranks.pseudo_observations(empty, ["x"], ["k"]).count() == 0


def test_rolling(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "g int, t int, x double")
    got = win.rolling(df, "x", 3, ["g"], ["t"], 0.5).orderBy("t").collect()
    assert [r["var"] for r in got] == [0.0, 0.0, 3.0, 1.0, 4.0, 5.0]
    assert got[2]["cvar"] == pytest.approx(2.0)
    assert win.expand_windows(df, 3, ["g"], ["t"]).count() == 12


def test_filters_agree(spark):
    rng = np.random.default_rng(1)
    u, v = rng.uniform(0.05, 0.95, (2, 40))
    df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(u, v))], "k int, t int, u double, v double")
    c, p = Copula("gumbel", 180), (0.04, 0.12, 0.82)
    g, ll = rec.gas_path(c, u, v, p)
    row = rec.gas_filter(df, c, "u", "v", p, ["k"], ["t"]).first()
    assert row.log_likelihood == pytest.approx(ll) and row.g_last == pytest.approx(g[-1])
    assert rec.gas_likelihoods(c, u, v, np.array([p, (0.1, 0.0, 0.5)]))[0] == pytest.approx(ll)
    rows = rec.filter_groups(df, c, "u", "v", p, ["k"], ["t"]).orderBy("t").toPandas()
    assert np.allclose(rows.g, g)


def test_latent_backends_agree():
    rng = np.random.default_rng(3)
    c, n, p = Copula("clayton"), 120, (8.0, 1.0, 2.0)
    x = latent.ou_paths(*p, n, rng.standard_normal((1, n)))[0]
    v = rng.uniform(size=n)
    u = c.h_inv(num, rng.uniform(size=n), v, c.base.link("softplus").forward(num, x))
    base = latent.ou_log_likelihood(c, u, v, p, "dense")
    for m in ("banded", "local", "auto"):
        assert latent.ou_log_likelihood(c, u, v, p, m) == pytest.approx(base, abs=0.02)
    assert latent.eis_log_likelihood(c, u, v, p, rng.standard_normal((400, n))) == pytest.approx(base, abs=0.3)
    grid = latent.ou_grid(*p, n, "dense")
    e = latent.emissions(c, u, v, latent.parameters(c, grid))
    assert np.allclose(latent.smooth(grid, e)[-1], latent.forward(grid, e).last)
    g = latent.jacobi_grid(5.0, 0.4, 0.5, n)
    assert np.allclose(g.start @ g.move, g.start) and g.start @ g.x == pytest.approx(0.4)


def test_golden_latent_likelihood_is_stable():
    u = np.array([[0.2, 0.3], [0.7, 0.6], [0.4, 0.5], [0.9, 0.8], [0.1, 0.2], [0.5, 0.4]])
    a = [latent.ou_log_likelihood(Copula("clayton", 180), u[:, 0], u[:, 1], (1.15, 0.25, 0.8), m) for m in ("dense", "spectral", "local")]
    assert max(a) - min(a) < 0.01


@pytest.mark.parametrize("family,r", [("clayton", 2.0), ("frank", 5.0), ("gumbel", 2.0), ("joe", 2.5), ("gaussian", 0.5)])
def test_mle_recovers_and_large_agrees(spark, family, r):
    rng = np.random.default_rng(5)
    c, n = Copula(family), 3000
    v = rng.uniform(size=n)
    u = c.h_inv(num, rng.uniform(size=n), v, r)
    one = fit.mle(c, u, v)
    assert one["params"]["r"] == pytest.approx(r, rel=0.12)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(u, v)], "u double, v double")
    many = fit.fit_large(df, c, "u", "v")
    assert many["params"]["r"] == pytest.approx(one["params"]["r"], rel=1e-4)
    assert many["log_likelihood"] == pytest.approx(one["log_likelihood"], abs=1e-4)


def test_methods_and_selection():
    rng = np.random.default_rng(9)
    c = Copula("clayton")
    v = rng.uniform(size=250)
    u = c.h_inv(num, rng.uniform(size=250), v, 2.0)
    base = fit.fit_arrays(c, u, v, "mle")["log_likelihood"]
    for m in ("gas", "scar-tm-ou", "scar-tm-jacobi"):
        assert fit.fit_arrays(c, u, v, m)["log_likelihood"] > base - 1.0
    assert fit.select_arrays(u, v)["family"] in ("clayton", "joe", "gumbel")
    with pytest.raises(ValueError):
        fit.check_method("scar-tm-jacobi", Copula("gaussian"))
    with pytest.raises(ValueError):
        fit.check_method("nothing", c)


def test_multivariate():
    r = np.array([[1, 0.5, 0.2], [0.5, 1, 0.3], [0.2, 0.3, 1]])
    f = mv.FactorCorrelation(np.array([[0.5, 0.1], [0.6, -0.2], [0.3, 0.4]]))
    z = np.array([0.3, -1.0, 2.0])
    assert np.allclose(f.solve(z), np.linalg.solve(f.dense(), z)) and f.logdet() == pytest.approx(np.linalg.slogdet(f.dense())[1])
    assert np.allclose(agg.unpack_cholesky(agg.pack_cholesky(r), 3), r)
    assert np.linalg.eigvalsh(agg.nearest_correlation(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]]))).min() > 0
    u = mv.sample_correlated(4000, r, np.random.default_rng(0), 6.0, {1: 0.9})
    assert (u[:, 1] == 0.9).all() and u[:, 0].mean() > 0.55
    s1, s2, d = 0.7, 2.5, 4
    e = 1e-6
    diff = (mv.equicorr_log_pdf(d, 0.2 + e, s1, s2, num) - mv.equicorr_log_pdf(d, 0.2 - e, s1, s2, num)) / (2 * e)
    assert mv.equicorr_score(d, 0.2, s1, s2, num) == pytest.approx(diff, rel=1e-6)


@pytest.mark.parametrize("make", [vines.c_vine, vines.d_vine])
def test_vines(make, spark):
    v = make(4, [2, 0, 3, 1])
    v = vines.Vine(4, tuple(replace(e, copula=Copula("clayton" if len(e.cond) < 2 else "frank"), r=2.0 - 0.5 * len(e.cond)) for e in v.edges))
    w = np.random.default_rng(0).uniform(size=(200, 4))
    u = vines.sample_arrays(v, w)
    df = spark.createDataFrame([tuple(map(float, x)) for x in u], "a double, b double, c double, d double")
    e = vines.rosenblatt(vines.log_pdf(df, list("abcd"), v), list("abcd"), v).toPandas()
    assert np.allclose(e[[f"e{i}" for i in range(4)]], np.clip(w, 1e-6, 1 - 1e-6), atol=1e-6)
    assert np.allclose(e.log_pdf, vines.log_pdf_arrays(v, u))
    again = vines.Vine.from_matrix(v.matrix())
    assert {(frozenset((k.a, k.b)), k.cond) for k in again.edges} == {(frozenset((k.a, k.b)), k.cond) for k in v.edges}
    first = v.order()[0]
    assert (vines.sample_arrays(v, w, {first: 0.3})[:, first] == 0.3).all()


def test_vine_fit_finds_the_strong_pairs(spark):
    rng = np.random.default_rng(2)
    z = rng.standard_normal((800, 1)) + np.array([0.4, 0.6, 3.0]) * rng.standard_normal((800, 3))
    u = (np.argsort(np.argsort(z, 0), 0) + 1) / 801
    df = spark.createDataFrame([tuple(map(float, x)) for x in u], "a double, b double, c double")
    v = vines.fit(df, ["a", "b", "c"], "r", ("frank", "gaussian"))
    assert {frozenset((e.a, e.b)) for e in v.tree(0)} >= {frozenset((0, 1))}
    assert len(v.edges) == 3


def test_gof_and_bootstrap(spark):
    rng = np.random.default_rng(4)
    assert gof.cvm_pvalue(0.46136) == pytest.approx(0.05, abs=2e-3)
    assert gof.cvm_pvalue(0.11888) == pytest.approx(0.5, abs=3e-3)
    c = Copula("frank")
    v = rng.uniform(size=60)
    u = c.h_inv(num, rng.uniform(size=60), v, 4.0)
    a = gof.bootstrap(spark, c, u, v, 19, 3).first()
    assert 0 < a.p_value <= 1 and a == gof.bootstrap(spark, c, u, v, 19, 3).first()


def test_frailty_draws_have_their_tau(spark):
    for f, r in (("clayton", 2.0), ("frank", 5.0), ("gumbel", 2.0), ("joe", 2.5)):
        c = Copula(f)
        x = sample.sample_frailty(spark, 4000, c, r, 1).toPandas()
        assert agg.kendall_tau(x.u, x.v) == pytest.approx(float(c.tau(num, np.float64(r))), abs=0.04)


def test_uniforms_do_not_depend_on_partitions(spark):
    a = sample.uniforms(spark, 50, 2, 3).toPandas()
    b = spark.range(50).repartition(7).select("id", sample.uniform(3, "id", coordinate=1).alias("w1")).toPandas().sort_values("id")
    assert np.array_equal(a.sort_values("id").w1, b.w1)


def test_marginals_and_risk():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(400)
    for k in ("normal", "laplace", "logistic", "johnsonsu"):
        p = marginals.fit_array(k, x)
        q = marginals.ppf_array(k, np.array([0.1, 0.5, 0.9]), p)
        assert np.allclose(marginals.cdf_array(k, q, p), [0.1, 0.5, 0.9], atol=1e-8)
    g = marginals.fit_array("arma-garch", x, 1)
    assert g["alpha"] + g["beta"] < 1
    r = rng.normal(0, [0.01, 0.03], (500, 2))
    w, q, c = risk.optimal_weights(r, 0.9)
    assert w.sum() == pytest.approx(1) and w[0] > w[1] and c >= q
    with pytest.raises(ValueError):
        marginals.resolve("nothing")


def test_storage(spark, tmp_path):
    v = vines.d_vine(3)
    for m in (v, Copula("gumbel", 90), mv.FactorCorrelation(np.eye(3)[:, :1] * 0.5)):
        again = models.loads(models.dumps(m), type(m))
        assert models.dumps(again) == models.dumps(m)
    models.save(spark, v, str(tmp_path / "m"))
    assert models.load(spark, str(tmp_path / "m")) == v
    with pytest.raises(ValueError):
        models.loads('{"format": "dependra-model/1", "state": {"$class": "os.system", "state": {}}}')
    assert models.vine_from_table(models.vine_table(spark, v), 3) == v
    (tmp_path / "p.csv").write_text("Date;A;B\n2024-01-01;1;2\n2024-01-02;2;2\n2024-01-03;;1\n2024-01-04;4;8\n")
    got = models.price_panel(spark, str(tmp_path / "p.csv"), ["A", "B"]).orderBy("Date").collect()
    assert [round(x.A, 6) for x in got] == [0.693147, 0.693147]


def test_stream(spark, tmp_path):
    from dependra.streaming.filters import gas_stream

    rng = np.random.default_rng(1)
    u, v = rng.uniform(0.05, 0.95, (2, 20))
    rows = [(1, f"2024-01-01 00:{i:02d}:00", float(a), float(b)) for i, (a, b) in enumerate(zip(u, v))]
    df = spark.createDataFrame(rows, "k int, t string, u double, v double").withColumn("t", F.to_timestamp("t"))
    c, p = Copula("clayton"), (0.05, 0.1, 0.8)
    for k, part in enumerate((df.where("minute(t) < 12"), df.where("minute(t) >= 12"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = (
            gas_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), c, "k", "t", "u", "v", p)
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("t").toPandas()
    g, _ = rec.gas_path(c, u, v, p)
    assert np.allclose(got.g, g)
