import numpy as np
import pandas as pd
import pytest

from dependra.operators import batches, dynamic, latent, latent_many


def _series(sizes=(40, 55, 47, 70)):
    rng = np.random.default_rng(4)
    out = []
    for n in sizes:
        z = rng.standard_normal((n, 1)) * rng.uniform(0.2, 1.5) + rng.standard_normal((n, 3))
        out.append((np.argsort(np.argsort(z, 0), 0) + 1) / (n + 1))
    return out


def _fine(u, p):
    e, dt = dynamic.equicorr_emission(u), 1 / (len(u) - 1)
    grid = latent.ou_dense(*p, dt, k=1201)
    return latent.forward(grid, dynamic.grid_emissions(e, grid)).log_likelihood


@pytest.mark.parametrize("p", [(5.0, 0.0, 1.0), (8.0, 0.2, 5.0), (50.0, 0.5, 1.0), (1.0, 3.0, 8.0), (200.0, 0.0, 20.0)])
def test_equicorr_latent_likelihoods_are_those_of_a_fine_grid(p):
    series = _series()
    z = [dynamic.special.norm_ppf(u) for u in series]
    (a, _), (b, _) = batches.padded([x.sum(1) for x in z], 0.0), batches.padded([(x * x).sum(1) for x in z], 0.0)
    j = np.array([2, 0, 3, 2, 1])
    got = latent_many.ou_emitted(dynamic.equicorr_emit(3, a, b), np.array([len(u) for u in series]), j, np.tile(p, (5, 1)), dynamic.FINE)
    assert np.allclose(got, [_fine(series[k], p) for k in j], atol=1e-3)


def test_equicorr_latent_fits_stand_side_by_side(monkeypatch):
    series = _series()
    one = [dynamic.fit_emission(dynamic.equicorr_emission(u)) for u in series]
    alone = [dynamic.equicorr_scar_many([u])[0] for u in series]
    with monkeypatch.context() as m:
        m.setattr(dynamic, "fit_emission", None)  # no series is fitted by itself
        many = dynamic.equicorr_scar_many(series)
    for a, b, c, u in zip(many, one, alone, series):
        p = [a[k] for k in ("kappa", "mu", "nu")]
        assert a["log_likelihood"] == pytest.approx(c["log_likelihood"], abs=1e-6)
        assert a["log_likelihood"] == pytest.approx(_fine(u, p), abs=1e-2)
        # single fits have an inexact grid where steps are long
        assert a["log_likelihood"] > _fine(u, [b[k] for k in ("kappa", "mu", "nu")]) - 1e-2


def _columns(spark, n=3000):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 40, n) / 10
    a = np.column_stack([x, np.round(x + rng.normal(size=n), 1), rng.normal(size=n)])
    rows = [tuple(map(float, r)) for r in a]
    return a, spark.createDataFrame([*rows, (None, 1.0, 2.0), (1.0, None, None)], "x double, y double, z double")


def test_taus_of_many_long_pairs_are_exact(spark):
    from dependra.operators import aggregates as agg

    a, df = _columns(spark)
    want = [agg.kendall_tau(a[:, 0], a[:, 1]), agg.kendall_tau(a[:, 0], a[:, 2]), agg.kendall_tau(np.append(a[:, 1], 1.0), np.append(a[:, 2], 2.0)), agg.kendall_tau(a[:, 1], a[:, 0])]
    assert agg.kendall_taus_long(df, [("x", "y"), ("x", "z"), ("y", "z"), ("y", "x")], 7) == pytest.approx(want, abs=1e-14)
    assert np.isnan(agg.kendall_taus_long(df.limit(0), [("x", "y")], 3)[0])


def test_fits_of_many_pairs_share_scans(spark):
    from dependra.functions.families import Copula
    from dependra.operators import fit

    a, _ = _columns(spark, 1000)
    u = (np.argsort(np.argsort(a, 0), 0) + 1) / 1001
    df = spark.createDataFrame([tuple(map(float, r)) for r in u], "x double, y double, z double")
    asked = [(Copula(f, r), "x", y) for f, r in (("clayton", 0), ("clayton", 180), ("frank", 0), ("gumbel", 0), ("joe", 270), ("gaussian", 0), ("independence", 0)) for y in ("y", "z")]
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("scans"))
    spark.sparkContext.setJobGroup("scans", "")
    many = fit.fit_large_many(df, asked)
    assert jobs() <= 5  # four narrowings and the parabola's top
    spark.sparkContext.setJobGroup("others", "")
    for got, (c, x, y) in zip(many, asked):
        one = fit.fit_large(df, c, x, y)
        assert (got["n"], got["success"], got["message"]) == (one["n"], one["success"], one["message"])
        assert got["log_likelihood"] == pytest.approx(one["log_likelihood"], abs=1e-8) and got["params"] == pytest.approx(one["params"], abs=1e-6)
    assert fit.fit_large_many(df.limit(0), asked[:1])[0]["message"] == "no rows"
    # nulls take no part
    more = fit.fit_large_many(df.union(spark.createDataFrame([(None, 0.5, 0.5), (0.1, None, None)], df.schema)), asked)
    assert [m["log_likelihood"] for m in more] == pytest.approx([m["log_likelihood"] for m in many], abs=1e-8)


def test_vine_fits_make_their_columns_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from dependra.operators import vine

    a, _ = _columns(spark, 1000)
    u = (np.argsort(np.argsort(a, 0), 0) + 1) / 1001
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x

    df = spark.createDataFrame([tuple(map(float, r)) for r in u], "x double, y double, z double").withColumn("x", counted("x"))
    monkeypatch.setattr(vine, "TAU_ROWS", 100)
    monkeypatch.setattr(vine, "TAU_BLOCK", 500)
    got = vine.fit(df, ["x", "y", "z"], "r", ("clayton", "gaussian"))
    assert len(got.edges) == 3 and seen.value == 1000
    # rows with a null do not change a fit
    null = spark.createDataFrame([(None, None, None)] * 50, "x double, y double, z double")
    again = vine.fit(df.union(null), ["x", "y", "z"], "r", ("clayton", "gaussian"))
    assert [e.key for e in again.edges] == [e.key for e in got.edges] and [e.tau for e in again.edges] == pytest.approx([e.tau for e in got.edges], abs=1e-12)
    assert [e.log_likelihood for e in again.edges] == pytest.approx([e.log_likelihood for e in got.edges], abs=1e-6)


def test_ranks_in_buckets_are_those_of_sorted_groups(spark, monkeypatch):
    from dependra.operators import ranks

    rng = np.random.default_rng(6)
    rows = [(int(g), int(k), None if x > 8 else float(np.inf if x == 8 else x), float(y)) for k, (g, x, y) in enumerate(zip(rng.integers(0, 3, 900), rng.integers(0, 10, 900), rng.normal(size=900)))]
    df = spark.createDataFrame(rows, "g int, k long, x double, y double")
    want = ranks.pseudo_observations(df, ["x", "y"], ["k"], ["g"]).collect()
    monkeypatch.setattr(ranks, "GROUP_ROWS", 10)
    monkeypatch.setattr(ranks, "BUCKETS_PER_ROWS", 30)
    got = {r.k: (r.u_x, r.u_y) for r in ranks.pseudo_observations(df, ["x", "y"], ["k"], ["g"]).collect()}
    assert got == {r.k: (r.u_x, r.u_y) for r in want}
