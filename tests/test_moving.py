import numpy as np
import pytest

from dependra.functions.backend import num
from dependra.functions.families import Copula
from dependra.operators import dynamic, latent, moving, multivariate as mv, vine
from dependra.operators.vine import Edge

GAS = {"omega": 0.05, "gamma": 0.2, "beta": 0.9}
EDGES = [
    dynamic.MovingEdge(Edge(0, 1, copula=Copula("clayton")), "gas", GAS),
    dynamic.MovingEdge(Edge(1, 2, copula=Copula("gumbel", 180)), "gas", GAS),
    dynamic.MovingEdge(Edge(0, 2, frozenset({1}), Copula("frank"), 1.5), "mle", {"r": 1.5}),
]
OU = {"kappa": 5.0, "mu": 0.5, "nu": 1.5}


def test_score_driven_paths_give_their_uniforms_back():
    w = np.random.default_rng(0).uniform(0.02, 0.98, size=(3, 40, 3))
    x = moving.sample_paths(EDGES, 40, 3, np.random.default_rng(1), w)
    order = moving._vine(EDGES).order()
    for p in range(3):
        values = {(i, frozenset()): x[p, :, i] for i in range(3)}
        for m in EDGES:
            e = m.edge
            values[(e.a, e.cond | {e.b})], values[(e.b, e.cond | {e.a})] = m.h_pair(values[(e.a, e.cond)], values[(e.b, e.cond)])
        for i, v in enumerate(order):
            assert np.allclose(values[(v, frozenset(order[:i]))], w[p, :, v], atol=1e-5)


def test_paths_without_scores_are_draws_of_the_static_vine():
    still = [dynamic.MovingEdge(m.edge, "gas", {**GAS, "gamma": 0.0}) if m.method == "gas" else m for m in EDGES]
    w = np.random.default_rng(2).uniform(size=(2, 10, 3))
    r = {m.edge.key: m.edge.copula.base.link(m.edge.copula.link).forward(num, np.full(20, 0.5)) for m in still if m.method == "gas"}
    want = vine.sample_arrays(moving._vine(still), w.reshape(20, 3), r=r).reshape(2, 10, 3)
    assert np.allclose(moving.sample_paths(still, 10, 2, np.random.default_rng(0), w), want)
    latent_edges = [dynamic.MovingEdge(EDGES[0].edge, "scar-tm-ou", OU), *EDGES[1:]]
    x = moving.sample_paths(latent_edges, 10, 4, np.random.default_rng(0))
    assert x.shape == (4, 10, 3) and ((x > 0) & (x < 1)).all()


def test_paths_do_not_depend_on_partitions(spark):
    a = moving.sample_moving(spark, EDGES, 5, 7, 3, 2).orderBy("path", "t").collect()
    b = moving.sample_moving(spark, EDGES, 5, 7, 3, 2).repartition(3).orderBy("path", "t").collect()
    assert a == b and len(a) == 35


def test_forecast_conditions_states_inside_the_given_variables():
    rng = np.random.default_rng(4)
    u = moving.sample_paths(EDGES, 60, 1, rng)[0]
    edges = [dynamic.MovingEdge(EDGES[0].edge, "scar-tm-ou", OU), *EDGES[1:]]
    given = {0: 0.02, 1: 0.95}
    x, records = moving.predict(edges, u, 4000, rng, "next", given)
    assert (x[:, 0] == 0.02).all() and (x[:, 1] == 0.95).all() and len(records) == 1 and records[0]["updated"]
    c = Copula("clayton")
    grid = latent.ou_grid(OU["kappa"], OU["mu"], OU["nu"], 60)
    _, w = latent.terminal(c, grid, u[:, 0], u[:, 1], "next")
    after = latent.condition(c, grid, w / w.sum(), 0.02, 0.95)
    mean = float(after @ latent.parameters(c, grid))
    assert records[0]["after"] == pytest.approx(mean, rel=0.1) and records[0]["after"] < records[0]["before"]
    for horizon, updated in (("current", True), ("next", False)):
        _, (record,) = moving.predict(EDGES, u, 5, rng, horizon, {0: 0.02, 1: 0.95})
        assert record["updated"] is updated
        assert (record["after"] != pytest.approx(record["before"])) is updated
    x, records = moving.predict(EDGES, u, 50, rng, "next", {0: 0.3, 2: 0.4})  # these cannot come first
    assert (x[:, 0] == 0.3).all() and (x[:, 2] == 0.4).all() and not records
    with pytest.raises(ValueError):
        moving.predict(EDGES, u, 5, rng, "later")


def test_search_lets_given_variables_come_first():
    rng = np.random.default_rng(5)
    z = np.cumsum(rng.standard_normal((150, 4)), 1)
    u = (np.argsort(np.argsort(z, 0), 0) + 1) / 151
    plain = moving._vine(dynamic.fit_vine(u))
    assert set((plain.order((0, 3)) or [])[:2]) != {0, 3}
    found = moving._vine(dynamic.fit_vine(u, given=(0, 3)))
    assert set(found.order((0, 3))[:2]) == {0, 3} and len(found.edges) == 6
    cut = moving._vine(dynamic.fit_vine(u, truncation=1, given=(0, 1, 3)))
    assert set(cut.order((0, 1, 3))[:3]) == {0, 1, 3}


def test_student_draws_and_factors():
    rng = np.random.default_rng(6)
    corr = np.array([[1, 0.5, 0.3], [0.5, 1, 0.4], [0.3, 0.4, 1.0]])
    a = mv.sample_correlated(50, corr, np.random.default_rng(1), 5.0, {1: 0.2})
    b = mv.sample_correlated(50, corr, np.random.default_rng(1), np.full(50, 5.0), {1: 0.2})
    assert np.array_equal(a, b) and (a[:, 1] == 0.2).all()
    dof, path = moving.student_path(corr, {"kappa": 5.0, "mu": 1.0, "nu": 1.0}, 30, rng)
    assert len(np.unique(dof)) > 5 and path.shape == (30, 3) and ((path > 0) & (path < 1)).all()
    for method, params in (("mle", {"r": 6.0}), ("gas", GAS), ("scar-tm-ou", {"kappa": 5.0, "mu": 1.0, "nu": 1.0})):
        x = moving.student_predict(path, corr, params, method, 20, rng, "next", {0: 0.1, 2: 0.9})
        assert (x[:, 0] == 0.1).all() and (x[:, 2] == 0.9).all() and len(np.unique(x[:, 1])) == 20
    f = mv.FactorCorrelation.fit(corr, 1)
    assert np.allclose(mv.student_log_pdf(path, f, 4.0), mv.student_log_pdf(path, f.dense(), 4.0))
    grid = mv.student_grid(path, f, [4.0, 4.0 + 1e-5])
    assert np.allclose(mv.student_slope(path, f, 4.0), (grid[:, 1] - grid[:, 0]) / 1e-5, atol=1e-3)


def test_shrinking_a_correlation_is_no_worse():
    rng = np.random.default_rng(7)
    u = mv.sample_correlated(60, np.eye(3), rng, 5.0)
    corr = dynamic.tau_correlation(u)
    got = moving.fit_student_shrunk(u, "mle")
    assert got["log_likelihood"] >= dynamic.fit_emission(dynamic.student_emission(u, corr), "mle")["log_likelihood"] and 0 <= got["weight"] < 1
