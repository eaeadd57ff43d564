"""Queries of multivariate models, vines, sampling, fit tests, marginals and risk."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as s
from ..functions.backend import col
from ..functions.families import Copula
from ..operators import aggregates as agg, fit, gof, latent, marginals, multivariate as mv, ranks, recursions as rec, risk, sample, vine as vines, windows as win
from . import sql
from .catalog import LINE_TIES, PARAMETER, _AT, _BY, add, event_pobs, gas_rows_sql, lineitem_pobs, r6, read, segment_pobs

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]
_CORR = np.array([[1.0, 0.5, 0.2], [0.5, 1.0, 0.3], [0.2, 0.3, 1.0]])


def line3(spark, d) -> DataFrame:
    got = ranks.pseudo_observations(read(spark, d, "lineitem").select("l_returnflag", "l_discount", *LINE_TIES), COLUMNS, LINE_TIES, ["l_returnflag"])
    return got.select("l_returnflag", *[F.col(f"u_{c}").alias(f"u{i}") for i, c in enumerate(COLUMNS)])


def _line3_sql() -> str:
    return "SELECT l_returnflag, " + ", ".join(f"{sql.rank(c, sql.LINE_TIES, 'l_returnflag')} AS u{i}" for i, c in enumerate(COLUMNS)) + " FROM lineitem"


def _z3_sql() -> str:
    return "SELECT l_returnflag, " + ", ".join(f"{sql.norm_ppf(f'u{i}')} AS z{i}" for i in range(3)) + f" FROM ({_line3_sql()})"


def z3(spark, d) -> DataFrame:
    return line3(spark, d).select("l_returnflag", *[s.norm_ppf(col, F.col(f"u{i}")).alias(f"z{i}") for i in range(3)])


# multivariate densities
_Q = np.linalg.inv(_CORR) - np.eye(3)
_quad = "+".join(f"({float(_Q[i, j])!r}::DOUBLE)*z{i}*z{j}" for i in range(3) for j in range(3))
add(
    "gaussian3_logpdf",
    lambda spark, d: z3(spark, d).groupBy("l_returnflag").agg(r6(F.sum(mv.gaussian_log_pdf(["z0", "z1", "z2"], _CORR)), 3).alias("ll"), F.count(F.lit(1)).alias("n")),
    f"SELECT l_returnflag, round(sum({-0.5 * math.log(np.linalg.det(_CORR))!r}::DOUBLE-0.5*({_quad})), 3) + 0.0 AS ll, count(*) AS n FROM ({_z3_sql()}) GROUP BY l_returnflag",
)
add(
    "gaussian3_gram",
    lambda spark, d: z3(spark, d).groupBy("l_returnflag").agg(*[r6(F.avg(F.col(f"z{i}") * F.col(f"z{j}")), 5).alias(f"g{i}{j}") for i in range(3) for j in range(i, 3)]),
    "SELECT l_returnflag, " + ", ".join(f"round(avg(z{i}*z{j}), 5) + 0.0 AS g{i}{j}" for i in range(3) for j in range(i, 3)) + f" FROM ({_z3_sql()}) GROUP BY l_returnflag",
)


def _coordinates(spark, d) -> DataFrame:
    """Rank of every coordinate of the embeddings, as long rows."""
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    return ranks.pseudo_observations(e, ["x"], ["vec_id"], ["k"])


def _stats(spark, d) -> DataFrame:
    z = _coordinates(spark, d).withColumn("z", s.norm_ppf(col, F.col("u_x")))
    return z.groupBy("vec_id").agg(F.sum("z").alias("sum_z"), F.sum(F.col("z") * F.col("z")).alias("sum_z2"))


_COORD = f"SELECT vec_id, {sql.rank('x', 'vec_id', 'k')} AS u FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)"
_STATS = f"SELECT vec_id, sum(z) AS s1, sum(z*z) AS s2 FROM (SELECT vec_id, {sql.norm_ppf('u')} AS z FROM ({_COORD})) GROUP BY vec_id"
add("equicorr_statistics", lambda spark, d: _stats(spark, d).select("vec_id", r6(F.col("sum_z"), 5).alias("sum_z"), r6(F.col("sum_z2"), 5).alias("sum_z2")), f"SELECT vec_id, round(s1, 5) + 0.0 AS sum_z, round(s2, 5) + 0.0 AS sum_z2 FROM ({_STATS})")
add(
    "equicorr_logpdf",
    lambda spark, d: _stats(spark, d).select("vec_id", r6(mv.equicorr_log_pdf(64, 0.1), 5).alias("log_pdf"), r6(mv.equicorr_score(64, 0.1), 4).alias("score")),
    "SELECT vec_id, round(-0.5*(63*ln(0.9::DOUBLE)+ln(7.3::DOUBLE))-0.5*(0.1/0.9::DOUBLE*s2-0.1/(0.9*7.3)::DOUBLE*s1*s1), 5) + 0.0 AS log_pdf, "
    "round(-0.5*(-63/0.9::DOUBLE+63/7.3::DOUBLE)-0.5*(s2/(0.9*0.9)::DOUBLE-s1*s1*(0.9*7.3-0.1*(63*0.9-7.3))::DOUBLE/(0.9*7.3*0.9*7.3)::DOUBLE), 4) + 0.0 AS score "
    f"FROM ({_STATS})",
)
add(
    "equicorr_parameter_grid",
    lambda spark, d: _stats(spark, d).crossJoin(F.broadcast(spark.range(5).select((F.col("id") * 0.1 + 0.05).alias("rho")))).select("vec_id", F.round("rho", 2).alias("rho"), mv.equicorr_log_pdf(64, F.col("rho")).alias("x")).groupBy("rho").agg(r6(F.sum("x"), 3).alias("ll")),
    f"SELECT round(rho, 2) AS rho, round(sum(-0.5*(63*ln(1-rho)+ln(1+63*rho))-0.5*(rho/(1-rho)*s2-rho/((1-rho)*(1+63*rho))*s1*s1)), 3) + 0.0 AS ll FROM ({_STATS}), (SELECT (i*0.1+0.05)::DOUBLE AS rho FROM range(5) t(i)) GROUP BY rho",
)
_LOAD = np.array([[0.5, 0.1], [0.6, -0.2], [0.3, 0.4]])
_FACTOR = mv.FactorCorrelation(_LOAD)
_FINV = np.linalg.inv(_FACTOR.dense())
add(
    "factor_quadratic",
    lambda spark, d: z3(spark, d).withColumn("z", F.array("z0", "z1", "z2")).groupBy("l_returnflag").agg(r6(F.sum(_FACTOR.quadratic("z")), 3).alias("q")),
    "SELECT l_returnflag, round(sum(" + "+".join(f"({float(_FINV[i, j])!r}::DOUBLE)*z{i}*z{j}" for i in range(3) for j in range(3)) + f"), 3) + 0.0 AS q FROM ({_z3_sql()}) GROUP BY l_returnflag",
)

# grids
_GRID = [0.5 + 0.25 * i for i in range(16)]


def _part_pobs(spark, d) -> DataFrame:
    got = ranks.pseudo_observations(read(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], ["p_partkey"], ["p_brand"])
    return got.select("p_partkey", "p_brand", F.col("u_p_size").alias("u"), F.col("u_p_retailprice").alias("v"))


_PART = f"SELECT p_partkey, p_brand, {sql.rank('p_size', 'p_partkey', 'p_brand')} AS u, {sql.rank('p_retailprice', 'p_partkey', 'p_brand')} AS v FROM part"
add(
    "pdf_on_parameter_grid",
    lambda spark, d: _part_pobs(spark, d).crossJoin(F.broadcast(spark.range(16).select((F.col("id") * 0.25 + 0.5).alias("r")))).withColumn("c", Copula("clayton").pdf(col, F.col("u"), F.col("v"), F.col("r"))).withColumn("h", Copula("clayton").h(col, F.col("u"), F.col("v"), F.col("r"))).groupBy("p_brand", "r").agg(r6(F.avg("c"), 5).alias("pdf"), r6(F.avg("h")).alias("h")),
    f"WITH g AS (SELECT p.*, (i*0.25+0.5)::DOUBLE AS r FROM ({_PART}) p, range(16) t(i)) SELECT p_brand, r, round(avg(exp({sql.fill(sql.LOG_C['clayton'], 'u', 'v', 'r')})), 5) AS pdf, round(avg({sql.fill(sql.H['clayton'], 'u', 'v', 'r')}), 6) AS h FROM g GROUP BY p_brand, r",
)


def condition_state(spark, d) -> DataFrame:
    """Bayes update of a 16-node grid by each observation: (observation, node) rows reweighted within the observation."""
    grid = F.broadcast(spark.range(16).select((F.col("id") * 0.25 + 0.5).alias("r"), F.lit(1.0 / 16).alias("p")))
    w = _part_pobs(spark, d).crossJoin(grid).withColumn("w", F.col("p") * Copula("clayton").pdf(col, F.col("u"), F.col("v"), F.col("r")))
    return w.groupBy("p_partkey").agg(r6(F.sum(F.col("w") * F.col("r")) / F.sum("w"), 5).alias("mean_r"), r6(F.max("w") / F.sum("w"), 5).alias("top"))


add(
    "condition_state", condition_state,
    f"WITH w AS (SELECT p_partkey, (i*0.25+0.5)::DOUBLE AS r, exp({sql.fill(sql.LOG_C['clayton'], 'u', 'v', '(i*0.25+0.5)')}) / 16 AS w FROM ({_PART}) p, range(16) t(i)) SELECT p_partkey, round(sum(w*r)/sum(w), 5) AS mean_r, round(max(w)/sum(w), 5) AS top FROM w GROUP BY p_partkey",
)

# sampling from given uniforms
for _f in ("clayton", "frank"):
    add(
        f"sample_given_uniforms_{_f}",
        lambda spark, d, f=_f: sample.sample_inverse(event_pobs(spark, d), Copula(f), PARAMETER[f], "v", "u", "a", "b").groupBy("user_id").agg(r6(F.avg("a"), 5).alias("a"), r6(F.avg(F.col("a") * F.col("b")), 5).alias("ab")),
        f"WITH p AS ({sql.event_pobs()}), q AS (SELECT user_id, v, {sql.fill(sql.H_INV[_f], 'u', 'v', PARAMETER[_f])} AS a FROM p) SELECT user_id, round(avg(a), 5) AS a, round(avg(a*v), 5) AS ab FROM q GROUP BY user_id",
    )
add(
    "sample_one_given",
    lambda spark, d: sample.sample_given(event_pobs(spark, d), Copula("clayton"), 2.0, "u", {1: 0.3}, "a", "b").groupBy("user_id").agg(r6(F.avg("a"), 5).alias("a"), F.max("b").alias("b")),
    f"SELECT user_id, round(avg({sql.fill(sql.H_INV['clayton'], 'u', '0.3::DOUBLE', 2.0)}), 5) AS a, 0.3::DOUBLE AS b FROM ({sql.event_pobs()}) GROUP BY user_id",
)
add(
    "draw_from_grid",
    lambda spark, d: sample.draw_from_grid(event_pobs(spark, d), [(1.0, 0.2), (2.0, 0.5), (3.0, 0.3)], "u").groupBy("user_id").agg(F.sum("r").alias("r")),
    f"SELECT user_id, sum(CASE WHEN u <= 0.2 THEN 1.0 WHEN u <= 0.7 THEN 2.0 ELSE 3.0 END)::DOUBLE AS r FROM ({sql.event_pobs()}) GROUP BY user_id",
)
add("sample_frailty", lambda spark, d: sample.sample_frailty(spark, 5000, Copula("gumbel"), 2.0, 7))
add("sample_uniforms", lambda spark, d: sample.uniforms(spark, 1000, 3, 1).agg(*[r6(F.avg(f"w{i}")).alias(f"m{i}") for i in range(3)]))
add("sample_gaussian_given", lambda spark, d: spark.createDataFrame([tuple(map(float, r)) for r in mv.sample_correlated(200, _CORR, np.random.default_rng(1), 5.0, {0: 0.9})], "u0 double, u1 double, u2 double"))

# vines
_V3 = vines.d_vine(3)
_V3 = vines.Vine(3, tuple(replace(e, copula=Copula("clayton"), r=0.8 if not e.cond else 0.3) for e in _V3.edges))
_h = lambda a, b, r: sql.fill(sql.H["clayton"], a, b, r)
_clip = lambda x: f"greatest(1e-10::DOUBLE, least(1-1e-10::DOUBLE, {x}))"
_V3_SQL = f"SELECT l_returnflag, u0, u1, u2, {_clip(_h('u0', 'u1', 0.8))} AS a, {_clip(_h('u2', 'u1', 0.8))} AS b FROM ({_line3_sql()})"
add(
    "vine3_loglik",
    lambda spark, d: vines.log_pdf(line3(spark, d), ["u0", "u1", "u2"], _V3).groupBy("l_returnflag").agg(r6(F.sum("log_pdf"), 3).alias("ll"), F.count(F.lit(1)).alias("n")),
    f"SELECT l_returnflag, round(sum({sql.fill(sql.LOG_C['clayton'], 'u0', 'u1', 0.8)}+{sql.fill(sql.LOG_C['clayton'], 'u1', 'u2', 0.8)}+{sql.fill(sql.LOG_C['clayton'], 'a', 'b', 0.3)}), 3) + 0.0 AS ll, count(*) AS n FROM ({_V3_SQL}) GROUP BY l_returnflag",
)
_ORDER = _V3.order()  # first, second, third variable of the transform
assert sorted(_ORDER[:2]) in ([0, 1], [1, 2])
_third, _first, _second = _ORDER[2], _ORDER[0], _ORDER[1]
_num, _den = ("a", "b") if _third == 0 else ("b", "a")
_rc = lambda x: f"greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, {x}))"
add(
    "vine3_rosenblatt",
    lambda spark, d: vines.rosenblatt(line3(spark, d), ["u0", "u1", "u2"], _V3).groupBy("l_returnflag").agg(*[r6(F.avg(F.col(f"e{i}") * F.col(f"e{i}")), 5).alias(f"e{i}") for i in range(3)]),
    f"SELECT l_returnflag, round(avg(pow({_rc(f'u{_first}')}, 2)), 5) AS e{_first}, round(avg(pow({_rc(_h(f'u{_second}', f'u{_first}', 0.8))}, 2)), 5) AS e{_second}, round(avg(pow({_rc(_h(_num, _den, 0.3))}, 2)), 5) AS e{_third} FROM ({_V3_SQL}) GROUP BY l_returnflag",
)
add(
    "vine3_sample_round_trip",
    lambda spark, d: vines.rosenblatt(vines.sample_columns(line3(spark, d), ["u0", "u1", "u2"], _V3), ["x0", "x1", "x2"], _V3).groupBy("l_returnflag").agg(
        (F.max(F.greatest(*[F.abs(F.col(f"e{i}") - F.col(f"u{i}")) for i in range(3)])) < 1e-6).alias("exact"), F.count(F.lit(1)).alias("n")
    ),
    "SELECT l_returnflag, true AS exact, count(*) AS n FROM lineitem GROUP BY l_returnflag",
)
add(
    "vine_tree0_candidates",
    lambda spark, d: agg.tau_matrix(read(spark, d, "supplier").select(F.col("s_suppkey").cast("double").alias("k"), F.col("s_nationkey").cast("double").alias("n"), F.col("s_acctbal").alias("a")), ["k", "n", "a"]).select("a", "b", r6(F.abs(F.col("tau"))).alias("weight")),
    "WITH s AS (SELECT 1 AS one, s_suppkey AS id, s_suppkey AS k, s_nationkey AS n, s_acctbal AS a FROM supplier) "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS a, '{y}' AS b, round(abs(sum(sign(p.{x}-q.{x})*sign(p.{y}-q.{y}))/(sqrt(sum(CASE WHEN p.{x}<>q.{x} THEN 1 ELSE 0 END))*sqrt(sum(CASE WHEN p.{y}<>q.{y} THEN 1 ELSE 0 END)))), 6) + 0.0 AS weight FROM s p JOIN s q ON p.id < q.id"
        for x, y in (("k", "n"), ("k", "a"), ("n", "a"))
    ),
)
_TREE = "SELECT * FROM (VALUES (1, [0, 1]), (2, [1, 2]), (3, [1, 3]), (4, [3, 4])) t(edge, vars)"


def proximity_pairs(spark, d) -> DataFrame:
    """Pairs of edges of a tree that share all but one variable each."""
    tree = [vines.Edge(*x) for x in ((0, 1), (1, 2), (1, 3), (3, 4))]
    return spark.createDataFrame([(i + 1, j + 1, ",".join(map(str, sorted(e.cond)))) for i, j, e in vines.next_candidates(tree)], "x int, y int, cond string")


add("vine_proximity_pairs", proximity_pairs, f"WITH t AS ({_TREE}) SELECT a.edge AS x, b.edge AS y, array_to_string(list_intersect(a.vars, b.vars), ',') AS cond FROM t a JOIN t b ON a.edge < b.edge AND len(list_intersect(a.vars, b.vars)) = len(a.vars) - 1")


def _vine_rows(spark, v) -> DataFrame:
    return spark.createDataFrame([(k["tree"], k["a"], k["b"], ",".join(map(str, k["cond"])), k["family"], k["rotation"], float(k["r"]), float(k["tau"])) for k in v.summary()], "tree int, a int, b int, cond string, family string, rotation int, r double, tau double")


add("vine_fit_r", lambda spark, d: _vine_rows(spark, vines.fit(line3(spark, d), ["u0", "u1", "u2"], "r", ("clayton", "frank", "gaussian"))))
add("vine_sample_mcmc", lambda spark, d: spark.createDataFrame([tuple(map(float, r)) for r in vines.sample_mcmc(_V3, 50, {1: 0.8}, np.random.default_rng(3))[0]], "u0 double, u1 double, u2 double"))

# fit tests
_E2 = f"SELECT c_mktsegment, o_orderkey, greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, u)) AS e1, greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, {sql.fill(sql.H['frank'], 'v', 'u', 2.0)})) AS e2 FROM ({sql.segment_pobs()})"


def _e2(spark, d) -> DataFrame:
    return gof.rosenblatt_pair(segment_pobs(spark, d), Copula("frank"), "u", "v", 2.0)


add("rosenblatt_static", lambda spark, d: _e2(spark, d).select("o_orderkey", r6(F.col("e1"), 7).alias("e1"), r6(F.col("e2"), 6).alias("e2")), f"SELECT o_orderkey, round(e1, 7) AS e1, round(e2, 6) AS e2 FROM ({_E2})")
add(
    "cvm_statistic",
    lambda spark, d: gof.cvm_statistic(_e2(spark, d).select("c_mktsegment", "o_orderkey", "e1", "e2"), ["e1", "e2"], ["c_mktsegment"], ["o_orderkey"]).select("c_mktsegment", r6(F.col("statistic"), 4).alias("statistic"), "n"),
    f"WITH q AS (SELECT c_mktsegment, o_orderkey, 1-exp(-0.5*(pow({sql.norm_ppf('e1')},2)+pow({sql.norm_ppf('e2')},2))) AS y FROM ({_E2})), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY y, o_orderkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM q) "
    "SELECT c_mktsegment, round(1/(12.0::DOUBLE*max(n)) + sum(pow((2*i-1)/(2.0::DOUBLE*n)-y, 2)), 4) AS statistic, max(n) AS n FROM r GROUP BY c_mktsegment",
)
add("gof_test_mle", lambda spark, d: gof.gof_test(segment_pobs(spark, d), Copula("frank"), "u", "v", ["c_mktsegment"], ["o_orderkey"]))
_L = np.linalg.inv(np.linalg.cholesky(_CORR))
add("rosenblatt_gaussian", lambda spark, d: gof.rosenblatt_gaussian(line3(spark, d), ["u0", "u1", "u2"], _CORR).groupBy("l_returnflag").agg(*[r6(F.avg(f"e{i}"), 5).alias(f"e{i}") for i in range(3)]),
    f"WITH z AS ({_z3_sql()}) SELECT l_returnflag, " + ", ".join(
        f"round(avg(greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, {sql.norm_cdf('(' + '+'.join(f'({float(_L[i, k])!r}::DOUBLE)*z{k}' for k in range(i + 1)) + ')')}))), 5) + 0.0 AS e{i}" for i in range(3)
    ) + " FROM z GROUP BY l_returnflag",
)
add("rosenblatt_student", lambda spark, d: gof.rosenblatt_student(line3(spark, d), ["u0", "u1", "u2"], _CORR, 6.0).groupBy("l_returnflag").agg(*[r6(F.avg(F.col("e")[i]), 5).alias(f"e{i}") for i in range(3)]))
add("student3_logpdf", lambda spark, d: mv.student_rows(line3(spark, d), ["u0", "u1", "u2"], _CORR, 6.0).groupBy("l_returnflag").agg(r6(F.sum("log_pdf"), 3).alias("ll")))
# the same with four degrees of freedom, whose quantile has a closed form
_X4 = "SELECT l_returnflag, u0, " + ", ".join(f"{sql.t4_ppf(f'u{i}')} AS x{i}" for i in range(3)) + f" FROM ({_line3_sql()})"


def _quadratic_sql(m: np.ndarray) -> str:
    return "(" + "+".join(f"({float(m[i, k])!r}::DOUBLE)*x{i}*x{k}" for i in range(len(m)) for k in range(len(m))) + ")"


def _given_sql(i: int, dof: int = 4) -> str:
    """Coordinate i of a Student law given those before it."""
    block, side = _CORR[:i, :i], _CORR[:i, i]
    a = np.linalg.solve(block, side)
    spread = f"sqrt(({dof}+{_quadratic_sql(np.linalg.inv(block))})/{dof + i}.0*{float(1 - side @ a)!r}::DOUBLE)"
    return sql.t_cdf(f"(x{i}-" + "-".join(f"({float(a[k])!r}::DOUBLE)*x{k}" for k in range(i)) + f")/{spread}", dof + i)


_T4_CONSTANT = math.lgamma(3.5) - 3 * math.lgamma(2.5) + 2 * math.lgamma(2.0) - 0.5 * math.log(np.linalg.det(_CORR))
add("student3_logpdf_df4", lambda spark, d: mv.student_rows(line3(spark, d), ["u0", "u1", "u2"], _CORR, 4.0).groupBy("l_returnflag").agg(r6(F.sum("log_pdf"), 3).alias("ll")),
    f"SELECT l_returnflag, round(sum({_T4_CONSTANT!r}::DOUBLE - 3.5*ln(1+{_quadratic_sql(np.linalg.inv(_CORR))}/4) + 2.5*(" + "+".join(f"ln(1+x{i}*x{i}/4)" for i in range(3)) + f")), 3) + 0.0 AS ll FROM ({_X4}) GROUP BY l_returnflag",
)
add("rosenblatt_student_df4", lambda spark, d: gof.rosenblatt_student(line3(spark, d), ["u0", "u1", "u2"], _CORR, 4.0).groupBy("l_returnflag").agg(*[r6(F.avg(F.col("e")[i]), 5).alias(f"e{i}") for i in range(3)]),
    f"SELECT l_returnflag, round(avg(u0), 5) + 0.0 AS e0, " + ", ".join(f"round(avg(greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, {_given_sql(i)}))), 5) + 0.0 AS e{i}" for i in (1, 2)) + f" FROM ({_X4}) GROUP BY l_returnflag",
)


add("gof_bootstrap", lambda spark, d: gof.bootstrap_groups(_part_pobs(spark, d), Copula("frank"), "u", "v", ["p_brand"], ["p_partkey"], 39, 5))

# estimators by group
add("fit_mle_by_segment", lambda spark, d: fit.fit(segment_pobs(spark, d), Copula("frank"), "u", "v", ["c_mktsegment"], ["o_orderkey"], "mle").select("c_mktsegment", "family", r6(F.col("params")["r"], 3).alias("r"), r6(F.col("log_likelihood"), 3).alias("log_likelihood"), "n"),
    f"SELECT c_mktsegment, 'frank' AS family, round(r, 3) + 0.0 AS r, round(ll, 3) + 0.0 AS log_likelihood, n FROM ({sql.frank_mle(sql.segment_pobs(), 'c_mktsegment')})")
add("fit_select_by_segment", lambda spark, d: fit.select_family(segment_pobs(spark, d), "u", "v", ["c_mktsegment"]).select("c_mktsegment", "family", "rotation", r6(F.col("log_likelihood"), 3).alias("log_likelihood"), "n"))
for _m in ("gas", "scar-tm-ou", "scar-tm-jacobi"):
    add(f"fit_{_m.replace('-', '_')}_by_user", lambda spark, d, m=_m: fit.fit(event_pobs(spark, d), Copula("clayton"), "u", "v", ["user_id"], ["n"], m).select("user_id", "method", r6(F.col("log_likelihood"), 2).alias("log_likelihood"), "success"))
add("gas_rows", lambda spark, d: rec.filter_groups(event_pobs(spark, d).select("user_id", "n", "u", "v"), Copula("clayton"), "u", "v", (0.05, 0.1, 0.8), ["user_id"], ["n"]).groupBy("user_id").agg(r6(F.avg("r"), 4).alias("r"), r6(F.avg("e2"), 4).alias("e2")), gas_rows_sql())


def _mle_large(spark, d) -> DataFrame:
    got = fit.fit_large(lineitem_pobs(spark, d), Copula("frank"), "u", "v")
    return spark.createDataFrame([(got["family"], round(got["params"]["r"], 4), round(got["log_likelihood"], 3), got["n"], got["success"])], "family string, r double, log_likelihood double, n long, success boolean")


add("fit_large_table", _mle_large,
    f"SELECT 'frank' AS family, round(r, 4) + 0.0 AS r, round(ll, 3) + 0.0 AS log_likelihood, n, true AS success FROM ({sql.frank_mle(f'SELECT 1 AS one, u, v FROM ({sql.lineitem_pobs()})', 'one')})")
add("fit_gaussian3", lambda spark, d: spark.createDataFrame([tuple(round(float(x), 5) for x in mv.fit_gaussian(line3(spark, d), ["u0", "u1", "u2"])["correlation"][np.triu_indices(3, 1)])], "r01 double, r02 double, r12 double"),
    "SELECT " + ", ".join(f"round(sum(z{i}*z{k})/sqrt(sum(z{i}*z{i})*sum(z{k}*z{k})), 5) + 0.0 AS r{i}{k}" for i, k in ((0, 1), (0, 2), (1, 2))) + f" FROM ({_z3_sql()})",
)
add("fit_equicorr", lambda spark, d: spark.createDataFrame([(round(float(mv.fit_equicorr(_stats(spark, d), 64)["rho"]), 5),)], "rho double"),
    f"WITH t AS (SELECT count(*) AS n, sum(s2) AS b, sum(s1*s1) AS a FROM ({_STATS})), g AS (SELECT (i*1e-6-0.015)::DOUBLE AS rho FROM range(1014000) t(i)) "
    "SELECT round(arg_max(rho, -n*(63*ln(1-rho)+ln(1+63*rho))-(rho/(1-rho)*b-rho/((1-rho)*(1+63*rho))*a)), 5) + 0.0 AS rho FROM t, g")
add("predict_by_user", lambda spark, d: sample.predict(event_pobs(spark, d), Copula("clayton"), "u", "v", ["user_id"], ["n"], {"kappa": 5.0, "mu": 0.5, "nu": 1.0}, "scar-tm-ou", 20, "next", {1: 0.2}, 9).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v")), f"SELECT DISTINCT user_id, 20::BIGINT AS n, 0.2::DOUBLE AS v FROM ({sql.event_pobs()})")

# marginals and risk
_EV = "SELECT event_type, value FROM events"
for _k, _loc, _scale in (("normal", "avg(value)", "stddev_pop(value)"), ("logistic", "avg(value)", "stddev_pop(value)*sqrt(3)/pi()")):
    add(
        f"marginal_fit_{_k}",
        lambda spark, d, k=_k: marginals.fit_closed(read(spark, d, "events"), "value", k, ["event_type"]).select("event_type", r6(F.col("loc")).alias("loc"), r6(F.col("scale")).alias("scale"), "n"),
        f"SELECT event_type, round({_loc}, 6) + 0.0 AS loc, round({_scale}, 6) AS scale, count(value) AS n FROM events GROUP BY event_type",
    )
_LAP = "SELECT event_type, m AS loc, avg(abs(value-m)) AS scale, count(*) AS n FROM (SELECT *, median(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type, m"
add(
    "marginal_fit_laplace",
    lambda spark, d: marginals.fit_closed(read(spark, d, "events"), "value", "laplace", ["event_type"]).select("event_type", r6(F.col("loc")).alias("loc"), r6(F.col("scale")).alias("scale"), "n"),
    f"SELECT event_type, round(loc, 6) + 0.0 AS loc, round(scale, 6) AS scale, n FROM ({_LAP})",
)


def _laplace_values(spark, d) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "event_type", "value")
    met = e.join(marginals.fit_closed(e, "value", "laplace", ["event_type"]).drop("n"), "event_type")
    p = marginals.cdf("laplace", F.col("value"), F.col("loc"), F.col("scale"))
    return met.select("event_id", r6(p).alias("p"), r6(marginals.ppf("laplace", p, F.col("loc"), F.col("scale")), 4).alias("back"))


add(
    "marginal_laplace_cdf_ppf", _laplace_values,
    f"WITH l AS ({_LAP}) SELECT event_id, round(CASE WHEN value < loc THEN 0.5*exp((value-loc)/scale) ELSE 1-0.5*exp(-(value-loc)/scale) END, 6) + 0.0 AS p, round(value, 4) + 0.0 AS back FROM events JOIN l USING (event_type)",
)
add(
    "marginal_quantile_median_unbiased",
    lambda spark, d: marginals.median_unbiased_quantile(read(spark, d, "events"), "value", 0.1, ["event_type"], ["event_id"]).select("event_type", r6(F.col("quantile")).alias("quantile")),
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), "
    "h AS (SELECT *, greatest(1.0::DOUBLE, least(n, (n+1.0::DOUBLE/3)*0.1+1.0::DOUBLE/3)) AS pos FROM r) SELECT event_type, round(sum(value * CASE WHEN i = floor(pos) THEN 1-(pos-floor(pos)) ELSE pos-floor(pos) END), 6) + 0.0 AS quantile FROM h WHERE i IN (floor(pos), floor(pos)+1) GROUP BY event_type",
)
add("marginal_fit_johnsonsu", lambda spark, d: marginals.fit_groups(read(spark, d, "events").select("event_type", "event_id", "value"), "value", "johnsonsu", ["event_type"], ["event_id"]).select("event_type", "n", (F.col("params")["scale"] > 0).alias("ok")), "SELECT event_type, count(value) AS n, true AS ok FROM events GROUP BY event_type")
add("arma_garch_fit", lambda spark, d: marginals.fit_groups(read(spark, d, "events").select("user_id", "ts", "event_id", "value"), "value", "arma-garch", ["user_id"], ["ts", "event_id"], 1).select("user_id", "n", (F.col("params")["alpha"] + F.col("params")["beta"] < 1).alias("stationary")), "SELECT user_id, count(value) AS n, true AS stationary FROM events GROUP BY user_id")

_LOSS = "SELECT l_returnflag, 1-(0.6*exp(l_discount-0.05)+0.4*exp(0.04-l_tax)) AS loss FROM lineitem"


def _losses(spark, d) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") - 0.05).alias("a"), (0.04 - F.col("l_tax")).alias("b"))
    return rows.withColumn("loss", risk.portfolio_loss(["a", "b"], [0.6, 0.4]))


add("portfolio_loss", lambda spark, d: _losses(spark, d).groupBy("l_returnflag").agg(r6(F.avg("loss")).alias("mean"), r6(F.max("loss")).alias("worst")), f"SELECT l_returnflag, round(avg(loss), 6) + 0.0 AS mean, round(max(loss), 6) + 0.0 AS worst FROM ({_LOSS}) GROUP BY l_returnflag")
add("cvar_objective", lambda spark, d: _losses(spark, d).groupBy("l_returnflag").agg(r6(risk.cvar_objective("loss", 0.01, 0.9)).alias("objective")), f"SELECT l_returnflag, round(0.01+avg(greatest(loss-0.01, 0))/0.1, 6) + 0.0 AS objective FROM ({_LOSS}) GROUP BY l_returnflag")
add(
    "var_cvar_fixed",
    lambda spark, d: risk.var_cvar(_losses(spark, d).withColumn("loss", F.round("loss", 9)), "loss", 0.9, ["l_returnflag"]).select("l_returnflag", r6(F.col("var")).alias("var"), r6(F.col("cvar")).alias("cvar")),
    f"WITH l AS (SELECT l_returnflag, round(loss, 9) AS loss FROM ({_LOSS})), q AS (SELECT l_returnflag, quantile_disc(loss, 0.9) AS v FROM l GROUP BY 1) SELECT l_returnflag, round(v, 6) + 0.0 AS var, round(v+avg(greatest(loss-v, 0))/0.1, 6) + 0.0 AS cvar FROM l JOIN q USING (l_returnflag) GROUP BY l_returnflag, v",
)


def _risk(spark, d) -> DataFrame:
    e = event_pobs(spark, d).select("user_id", "n", ((F.col("u") - 0.5) / 50).alias("a"), ((F.col("v") - 0.5) / 50).alias("b"))
    return risk.risk_metrics(win.expand_windows(e, 20, ["user_id"], ["n"]), "a", "b", ["user_id", "window"], ["n"], Copula("clayton"), draws=(200,), weights=(0.5, 0.5)).groupBy("user_id").agg(F.count(F.lit(1)).alias("windows"), r6(F.avg("cvar"), 4).alias("cvar"))


add("risk_metrics", _risk)

# moving parameters of several variables
_EV3 = ["u", "v", "w"]


def _triples(spark, d) -> DataFrame:
    """Ranks of a value and of its two predecessors, by user."""
    from pyspark.sql import Window

    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").select("user_id", "event_id", "ts", "value").withColumn("p1", F.lag("value", 1).over(at)).withColumn("p2", F.lag("value", 2).over(at)).where("p2 is not null")
    got = ranks.pseudo_observations(e, ["value", "p1", "p2"], ["event_id"], ["user_id"])
    return got.select("user_id", "event_id", F.col("u_value").alias("u"), F.col("u_p1").alias("v"), F.col("u_p2").alias("w"))


def _dynamic(model, method):
    from ..operators import dynamic

    return lambda spark, d: dynamic.fit_series(_triples(spark, d), _EV3, ["user_id"], ["event_id"], model, method).select("user_id", "method", r6(F.col("log_likelihood"), 2).alias("log_likelihood"))


def _dynamic_vines(spark, d) -> DataFrame:
    from ..operators import dynamic

    return dynamic.fit_vines(_triples(spark, d), _EV3, ["user_id"], ["event_id"], "r", "gas").select("user_id", "tree", "a", "b", "family", "rotation", "method")


_TRIPLES = (
    "SELECT user_id, " + ", ".join(f"{sql.rank(c, 'event_id', 'user_id')} AS u{i}" for i, c in enumerate(("value", "p1", "p2")))
    + " FROM (SELECT user_id, event_id, value, lag(value, 1) OVER w AS p1, lag(value, 2) OVER w AS p2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p2 IS NOT NULL"
)
add("fit_equicorr_mle_by_user", _dynamic("equicorr", "mle"),
    f"WITH z AS (SELECT user_id, {', '.join(f'{sql.norm_ppf(f"u{i}")} AS z{i}' for i in range(3))} FROM ({_TRIPLES})), "
    "t AS (SELECT user_id, count(*) AS n, sum(pow(z0+z1+z2, 2)) AS a, sum(z0*z0+z1*z1+z2*z2) AS b FROM z GROUP BY user_id), g AS (SELECT (i*1e-4-0.4999)::DOUBLE AS rho FROM range(14998) t(i)) "
    "SELECT user_id, 'mle' AS method, round(max(-0.5*(n*(2*ln(1-rho)+ln(1+2*rho))+rho/(1-rho)*b-rho/((1-rho)*(1+2*rho))*a)), 2) + 0.0 AS log_likelihood FROM t, g GROUP BY user_id")
add("fit_equicorr_gas_by_user", _dynamic("equicorr", "gas"))
add("fit_equicorr_scar_by_user", _dynamic("equicorr", "scar-tm-ou"))
add("fit_vines_gas_by_user", _dynamic_vines)


def _predict_vines(spark, d) -> DataFrame:
    from ..operators import moving

    got = moving.predict_vines(_triples(spark, d), _EV3, ["user_id"], ["event_id"], 30, given={0: 0.3, 2: 0.6}, seed=4)
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("x0").alias("x0"), F.min("x2").alias("x2"), (F.countDistinct("x1") == 30).alias("drawn"), ((F.min("x1") > 0) & (F.max("x1") < 1)).alias("inside"))


def _sample_moving(spark, d) -> DataFrame:
    from ..operators import dynamic, moving

    state = {"omega": 0.05, "gamma": 0.2, "beta": 0.9}
    edges = [
        dynamic.MovingEdge(vines.Edge(0, 1, copula=Copula("clayton")), "gas", state), dynamic.MovingEdge(vines.Edge(1, 2, copula=Copula("gumbel", 180)), "gas", state),
        dynamic.MovingEdge(vines.Edge(0, 2, frozenset({1}), Copula("frank"), 1.5), "mle", {"r": 1.5}),
    ]
    got = moving.sample_moving(spark, edges, 100, 256, 5)
    return got.groupBy("t").agg(F.count(F.lit(1)).alias("paths"), *[((F.min(f"x{i}") > 0) & (F.max(f"x{i}") < 1)).alias(f"inside{i}") for i in range(3)])


add("predict_vines_by_user", _predict_vines, f"SELECT user_id, 30::BIGINT AS n, 0.3::DOUBLE AS x0, 0.6::DOUBLE AS x2, true AS drawn, true AS inside FROM ({sql.event_pobs()}) GROUP BY user_id HAVING count(*) > 1")
add("sample_moving_vine", _sample_moving)
add(
    "gaussian_hinv_round_trip",
    lambda spark, d: event_pobs(spark, d).groupBy("user_id").agg(
        (F.max(F.abs(Copula("gaussian").h(col, Copula("gaussian").h_inv(col, F.col("u"), F.col("v"), F.lit(0.5)), F.col("v"), F.lit(0.5)) - F.col("u"))) < 1e-7).alias("exact"), F.count(F.lit(1)).alias("n")
    ),
    f"SELECT user_id, true AS exact, count(*) AS n FROM ({sql.event_pobs()}) GROUP BY user_id",
)
