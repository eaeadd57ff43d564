"""Registered queries of the dependence engine, each with SQL that a second engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as s
from ..functions.backend import col
from ..functions.families import Copula
from ..operators import aggregates as agg, ranks, recursions as rec, windows as win
from ..shipping import ship
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PARAMETER = {"clayton": 2.0, "frank": 5.0, "gumbel": 2.0, "joe": 2.5, "gaussian": 0.5}
LINE_TIES = sql.LINE_TIES.split(", ")


def add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLE[name] = oracle


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def lineitem_pobs(spark, sf_dir) -> DataFrame:
    got = ranks.pseudo_observations(read(spark, sf_dir, "lineitem").select("l_returnflag", *LINE_TIES), ["l_quantity", "l_extendedprice"], LINE_TIES, ["l_returnflag"])
    return got.select("l_returnflag", F.col("u_l_quantity").alias("u"), F.col("u_l_extendedprice").alias("v"))


def segment_pobs(spark, sf_dir) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    got = ranks.pseudo_observations(orders.join(customer, "o_custkey"), ["o_totalprice", "c_acctbal"], ["o_orderkey"], ["c_mktsegment"])
    return got.select("c_mktsegment", "o_orderkey", F.col("u_o_totalprice").alias("u"), F.col("u_c_acctbal").alias("v"))


def event_pobs(spark, sf_dir) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = events.withColumn("prev", F.lag("value").over(at)).where("prev is not null").withColumn("n", F.row_number().over(at))
    got = ranks.pseudo_observations(events, ["value", "prev"], ["event_id"], ["user_id"])
    return got.select("user_id", "event_id", "ts", "n", F.col("u_value").alias("u"), F.col("u_prev").alias("v"))


def _summary(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy("l_returnflag").agg(r6(F.sum(value), 4).alias("total"), r6(F.avg(value)).alias("mean"), r6(F.min(value), 5).alias("least"), F.count(F.lit(1)).alias("n"))


def _summary_sql(value: str, base: str | None = None) -> str:
    return (
        f"WITH p AS ({base or sql.lineitem_pobs()}), q AS (SELECT l_returnflag, {value} AS x FROM p) "
        "SELECT l_returnflag, round(sum(x), 4) + 0.0 AS total, round(avg(x), 6) + 0.0 AS mean, round(min(x), 5) + 0.0 AS least, count(*) AS n FROM q GROUP BY l_returnflag"
    )


# pseudo-observations
add(
    "pobs_by_flag",
    lambda spark, d: lineitem_pobs(spark, d).select("l_returnflag", r6(F.col("u"), 9).alias("u"), r6(F.col("v"), 9).alias("v")),
    f"SELECT l_returnflag, round(u, 9) AS u, round(v, 9) AS v FROM ({sql.lineitem_pobs()})",
)
add(
    "pobs_global",
    lambda spark, d: ranks.pseudo_observations(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], ["o_orderkey"]).select("o_orderkey", r6(F.col("u_o_totalprice"), 9).alias("u")),
    f"SELECT o_orderkey, round({sql.rank('o_totalprice', 'o_orderkey')}, 9) AS u FROM orders",
)
add(
    "pobs_global_ties",
    lambda spark, d: ranks.pseudo_observations(read(spark, d, "part").select("p_partkey", "p_size"), ["p_size"], ["p_partkey"]).select("p_partkey", r6(F.col("u_p_size"), 9).alias("u")),
    f"SELECT p_partkey, round({sql.rank('p_size', 'p_partkey')}, 9) AS u FROM part",
)
add(
    "pobs_check",
    lambda spark, d: ranks.assert_unit(lineitem_pobs(spark, d), ["u", "v"]).groupBy("l_returnflag").agg(r6(F.min("u"), 9).alias("low"), r6(F.max("v"), 9).alias("high")),
    f"SELECT l_returnflag, round(min(u), 9) AS low, round(max(v), 9) AS high FROM ({sql.lineitem_pobs()}) GROUP BY l_returnflag",
)

# families
for _f in ("clayton", "frank", "gumbel", "joe"):
    _r = PARAMETER[_f]
    for _rot in (0, 90, 180, 270) if _f != "frank" else (0,):
        _tag = f"_{_rot}" if _rot else ""
        add(
            f"{_f}_logpdf{_tag}",
            lambda spark, d, c=Copula(_f, _rot), r=_r: _summary(lineitem_pobs(spark, d), agg.log_pdf(c, "u", "v", r)),
            _summary_sql(sql.fill(sql.LOG_C[_f], *sql.rotated("u", "v", _rot), _r)),
        )
        _x = sql.fill(sql.H[_f], *sql.rotated("u", "v", _rot), _r)
        add(
            f"{_f}_h{_tag}",
            lambda spark, d, c=Copula(_f, _rot), r=_r: _summary(lineitem_pobs(spark, d), c.h(col, F.col("u"), F.col("v"), F.lit(r))),
            _summary_sql(f"1-{_x}" if _rot in (90, 180) else _x),
        )
    add(
        f"{_f}_score",
        lambda spark, d, c=Copula(_f), r=_r: _summary(lineitem_pobs(spark, d), c.score(col, F.col("u"), F.col("v"), F.lit(r))),
        _summary_sql(sql.fill(sql.SCORE[_f], "u", "v", _r)),
    )
    add(
        f"{_f}_h_pair",
        lambda spark, d, c=Copula(_f), r=_r: _summary(lineitem_pobs(spark, d), c.h_pair(col, F.col("u"), F.col("v"), F.lit(r))[0] + 2.0 * c.h_pair(col, F.col("u"), F.col("v"), F.lit(r))[1]),
        _summary_sql(f"{sql.fill(sql.H[_f], 'u', 'v', _r)} + 2 * {sql.fill(sql.H[_f], 'v', 'u', _r)}"),
    )
    if _f in sql.H_INV:
        add(
            f"{_f}_hinv",
            lambda spark, d, c=Copula(_f), r=_r: _summary(lineitem_pobs(spark, d), c.h_inv(col, F.col("u"), F.col("v"), F.lit(r))),
            _summary_sql(sql.fill(sql.H_INV[_f], "u", "v", _r)),
        )
    add(
        f"{_f}_hinv_round_trip",
        lambda spark, d, c=Copula(_f), r=_r: event_pobs(spark, d).groupBy("user_id").agg(
            (F.max(F.abs(c.h(col, c.h_inv(col, F.col("u"), F.col("v"), F.lit(r)), F.col("v"), F.lit(r)) - F.col("u"))) < 1e-7).alias("exact"), F.count(F.lit(1)).alias("n")
        ),
        f"SELECT user_id, true AS exact, count(*) AS n FROM ({sql.event_pobs()}) GROUP BY user_id",
    )
_z = f"SELECT l_returnflag, {sql.norm_ppf('u')} AS x, {sql.norm_ppf('v')} AS y FROM ({sql.lineitem_pobs()})"
add(
    "gaussian_logpdf",
    lambda spark, d: _summary(lineitem_pobs(spark, d), agg.log_pdf(Copula("gaussian"), "u", "v", 0.5)),
    _summary_sql("-0.5*ln(0.75::DOUBLE)-0.5*(0.25*(x*x+y*y)-x*y)/0.75::DOUBLE", _z),
)
add(
    "gaussian_score",
    lambda spark, d: _summary(lineitem_pobs(spark, d), Copula("gaussian").score(col, F.col("u"), F.col("v"), F.lit(0.5))),
    _summary_sql("(0.5-(0.5*(x*x+y*y)-x*y))/0.75::DOUBLE-0.5*(0.25*(x*x+y*y)-x*y)/(0.5625::DOUBLE)", _z),
)
add(
    "normal_quantile",
    lambda spark, d: _summary(lineitem_pobs(spark, d), s.norm_ppf(col, F.col("u"))),
    _summary_sql("x", _z),
)
add(
    "independence_logpdf",
    lambda spark, d: _summary(lineitem_pobs(spark, d), agg.log_pdf(Copula("independence"), "u", "v", 0.0)),
    _summary_sql("0.0::DOUBLE"),
)

# links and parameter maps over a grid of latent values
_GRID = "SELECT event_id, (event_id % 401 - 200)::DOUBLE / 20 AS x FROM events"


def _grid(spark, d) -> DataFrame:
    return read(spark, d, "events").select("event_id", ((F.col("event_id") % 401 - 200) / F.lit(20.0)).alias("x"))


_SIG = "(1/(1+exp(-x/2)))"
for _name, _link, _forward, _slope in (
    ("softplus", s.softplus_link(1.0001), "ln(1+exp(x))+1.0001", "1/(1+exp(-x))"),
    ("xtanh", s.xtanh_link(1.0001), "x*tanh(x)+1.0001", "tanh(x)+x*(1-tanh(x)*tanh(x))"),
    ("exp", s.exp_link(1.0001), "exp(x)+1.0001", "exp(x)"),
    ("logistic", s.logistic_link(1.0001), f"1.0001+20*{_SIG}", f"10*{_SIG}*(1-{_SIG})"),
    ("gaussian_tanh", s.gaussian_link(), "0.9999*tanh(x/4)", "0.9999/4*(1-tanh(x/4)*tanh(x/4))"),
    ("equicorr", s.equicorr_link(5), "-0.25+0.625*(1+tanh(x))", "0.625*(1-tanh(x)*tanh(x))"),
    ("student_df", s.student_df_link(), "2+1e-6+ln(1+exp(x))", "1/(1+exp(-x))"),
):
    add(
        f"link_{_name}",
        lambda spark, d, k=_link: _grid(spark, d).select("event_id", r6(k.forward(col, F.col("x"))).alias("r"), r6(k.slope(col, F.col("x"))).alias("slope")),
        f"SELECT event_id, round(({_forward})::DOUBLE, 6) + 0.0 AS r, round(({_slope})::DOUBLE, 6) + 0.0 AS slope FROM ({_GRID})",
    )
add(
    "link_inverse_round_trip",
    lambda spark, d: _grid(spark, d).select("event_id", *[(F.abs(k.inverse(col, k.forward(col, F.col("x"))) - F.col("x")) < 1e-5).alias(k.name.replace("-", "_")) for k in (s.softplus_link(1.0), s.logistic_link(1.0))]),
    f"SELECT event_id, true AS softplus, true AS logistic FROM ({_GRID})",
)
add(
    "clips",
    lambda spark, d: _grid(spark, d).select("event_id", s.clip(col, F.col("x")).alias("unit"), s.clip_rosenblatt(col, F.col("x")).alias("rosenblatt"), s.clip_draw(col, F.col("x")).alias("draw")),
    f"SELECT event_id, greatest(1e-10::DOUBLE, least(1-1e-10::DOUBLE, x)) AS unit, greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, x)) AS rosenblatt, greatest(1e-12::DOUBLE, least(1-1e-12::DOUBLE, x)) AS draw FROM ({_GRID})",
)
add(
    "log1mexp_logsumexp",
    lambda spark, d: _grid(spark, d).select("event_id", r6(s.log1mexp(col, F.abs(F.col("x")) + 0.5)).alias("a"), r6(s.logsumexp(col, F.col("x"), F.col("x") * 0.5)).alias("b"), r6(s.sigmoid(col, F.col("x"))).alias("c")),
    f"SELECT event_id, round(ln(1-exp(-(abs(x)+0.5))), 6) + 0.0 AS a, round(ln(exp(x)+exp(x*0.5)), 6) + 0.0 AS b, round(1/(1+exp(-x)), 6) + 0.0 AS c FROM ({_GRID})",
)


def _taus(spark, d) -> DataFrame:
    r = F.abs(F.col("x")) + 1.001
    return _grid(spark, d).select(
        "event_id", r6(Copula("clayton").tau(col, r)).alias("clayton"), r6(Copula("gumbel").tau(col, r)).alias("gumbel"), r6(Copula("gaussian").tau(col, F.col("x") / 11.0)).alias("gaussian"),
        r6(Copula("clayton").from_tau(col, F.abs(F.col("x")) / 11.0)).alias("clayton_r"), r6(Copula("gumbel").from_tau(col, F.abs(F.col("x")) / 11.0)).alias("gumbel_r"),
        r6(Copula("gaussian").from_tau(col, F.col("x") / 11.0)).alias("gaussian_r"),
    )


add(
    "tau_maps", _taus,
    f"SELECT event_id, round((abs(x)+1.001)/(abs(x)+3.001), 6) + 0.0 AS clayton, round(1-1/(abs(x)+1.001::DOUBLE), 6) + 0.0 AS gumbel, round(2/pi()*asin(x/11), 6) + 0.0 AS gaussian, "
    f"round(2*abs(x)/11/(1-abs(x)/11), 6) + 0.0 AS clayton_r, round(1/(1-abs(x)/11), 6) + 0.0 AS gumbel_r, round(sin(pi()/2*x/11), 6) + 0.0 AS gaussian_r FROM ({_GRID})",
)
add(
    "frank_tau",
    lambda spark, d: _grid(spark, d).select("event_id", r6(Copula("frank").tau(col, F.abs(F.col("x")) + 0.5), 5).alias("tau")),
    # the integral by the midpoint rule with a correction-free fine mesh
    "WITH g AS (SELECT DISTINCT abs((event_id % 401 - 200)::DOUBLE / 20) + 0.5 AS r FROM events), m AS (SELECT (i - 0.5)::DOUBLE / 4000 AS t FROM range(1, 4001) AS k(i)), "
    "d AS (SELECT r, avg(r * t / (exp(r * t) - 1)) AS one FROM g, m GROUP BY r) "
    "SELECT event_id, round(1 - 4 / d.r * (1 - one), 5) + 0.0 AS tau FROM events JOIN d ON d.r = abs((event_id % 401 - 200)::DOUBLE / 20) + 0.5",
)

# likelihood, information criteria, screening
add(
    "loglik_by_segment",
    lambda spark, d: agg.information_criteria(agg.log_likelihood(segment_pobs(spark, d), Copula("clayton"), "u", "v", 0.5, ["c_mktsegment"])).select(
        "c_mktsegment", r6(F.col("log_likelihood"), 4).alias("log_likelihood"), r6(F.col("score"), 4).alias("score"), "n", r6(F.col("aic"), 4).alias("aic"), r6(F.col("bic"), 4).alias("bic")
    ),
    f"WITH p AS ({sql.segment_pobs()}), l AS (SELECT c_mktsegment, sum({sql.fill(sql.LOG_C['clayton'], 'u', 'v', 0.5)}) AS l, sum({sql.fill(sql.SCORE['clayton'], 'u', 'v', 0.5)}) AS s, count(*) AS n FROM p GROUP BY 1) "
    "SELECT c_mktsegment, round(l, 4) AS log_likelihood, round(s, 4) AS score, n, round(2 - 2 * l, 4) AS aic, round(ln(n) - 2 * l, 4) AS bic FROM l",
)


def screen(df: DataFrame, by: list[str], candidates: list[tuple[Copula, float]], top: int = 3) -> DataFrame:
    """Every candidate's log-likelihood in one scan, then the best ``top`` of each group."""
    wide = df.groupBy(*by).agg(*[F.sum(agg.log_pdf(c, "u", "v", r)).alias(f"s{i}") for i, (c, r) in enumerate(candidates)])
    rows = F.explode(F.array(*[F.struct(F.lit(f"{c.family}{c.rotation}").alias("family"), F.col(f"s{i}").alias("ll")) for i, (c, _) in enumerate(candidates)]))
    w = Window.partitionBy(*by).orderBy(F.desc("ll"), "family")
    return wide.select(*by, rows.alias("x")).select(*by, "x.*").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


CANDIDATES = [(Copula(f, r), 1.5 if f != "frank" else 3.0) for f in ("clayton", "frank", "gumbel", "joe") for r in Copula(f).base.rotations] + [(Copula("independence"), 0.0)]
_cases = ", ".join(
    f"('{c.family}{c.rotation}', sum({sql.fill(sql.LOG_C[c.family], *sql.rotated('u', 'v', c.rotation), r) if c.family in sql.LOG_C else '0.0::DOUBLE'}))" for c, r in CANDIDATES
)
add(
    "family_screen_top3",
    lambda spark, d: screen(segment_pobs(spark, d), ["c_mktsegment"], CANDIDATES).select("c_mktsegment", "family", r6(F.col("ll"), 4).alias("ll"), "place"),
    f"WITH p AS ({sql.segment_pobs()}), w AS (SELECT c_mktsegment, unnest([{_cases}]) AS x FROM p GROUP BY 1), "
    "f AS (SELECT c_mktsegment, x[1] AS family, x[2] AS ll FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY ll DESC, family) AS place FROM f) "
    "SELECT c_mktsegment, family, round(ll, 4) + 0.0 AS ll, place::INTEGER AS place FROM r WHERE place <= 3",
)


# rank correlation
def _tau_sql(base: str, by: str, x: str, y: str, key: str) -> str:
    sign = f"sum(sign(a.{x}-b.{x})*sign(a.{y}-b.{y}))"
    free = lambda c: f"sqrt(sum(CASE WHEN a.{c}<>b.{c} THEN 1 ELSE 0 END))"
    return f"SELECT a.{by} AS {by}, {sign}/({free(x)}*{free(y)}) AS tau FROM {base} a JOIN {base} b ON a.{by}=b.{by} AND a.{key}<b.{key} GROUP BY a.{by}"


add(
    "kendall_tau_by_brand",
    lambda spark, d: read(spark, d, "part").groupBy("p_brand").agg(agg.kendall_tau_agg(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("tau")).select("p_brand", r6(F.col("tau")).alias("tau")),
    f"SELECT p_brand, round(tau, 6) + 0.0 AS tau FROM ({_tau_sql('part', 'p_brand', 'p_size', 'p_retailprice', 'p_partkey')})",
)
add(
    "kendall_tau_blocks",
    lambda spark, d: agg.kendall_tau_blocks(read(spark, d, "part"), "p_size", "p_retailprice", 4).select(r6(F.col("tau")).alias("tau")),
    f"SELECT round(tau, 6) + 0.0 AS tau FROM ({_tau_sql('(SELECT *, 1 AS one FROM part)', 'one', 'p_size', 'p_retailprice', 'p_partkey')})",
)


def clayton_fit(df: DataFrame, by: list[str]) -> DataFrame:
    """Tau, its Clayton parameter, log-likelihood and AIC of each group."""
    tau = df.groupBy(*by).agg(agg.kendall_tau_agg("u", "v").alias("tau"))
    tau = tau.withColumn("r", Copula("clayton").from_tau(col, F.greatest(F.lit(0.01), F.col("tau"))))
    met = df.join(F.broadcast(tau), by)  # a row for each group of a categorical column
    ll = met.groupBy(*by, "tau", "r").agg(F.sum(agg.log_pdf(Copula("clayton"), "u", "v", F.col("r"))).alias("log_likelihood"), F.count(F.lit(1)).alias("n"))
    return agg.information_criteria(ll)


def _rounded_fit(df: DataFrame, by: str) -> DataFrame:
    return df.select(by, r6(F.col("tau")).alias("tau"), r6(F.col("r")).alias("r"), r6(F.col("log_likelihood"), 4).alias("log_likelihood"), "n", r6(F.col("aic"), 4).alias("aic"))


def clayton_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_fit(clayton_fit(lineitem_pobs(spark, sf_dir), ["l_returnflag"]), "l_returnflag")


add(
    "clayton_by_segment",
    lambda spark, d: _rounded_fit(clayton_fit(segment_pobs(spark, d), ["c_mktsegment"]), "c_mktsegment"),
    f"WITH p AS ({sql.segment_pobs()}), t AS ({_tau_sql('p', 'c_mktsegment', 'u', 'v', 'o_orderkey')}), q AS (SELECT p.*, tau, 2*greatest(0.01::DOUBLE, tau)/(1-greatest(0.01::DOUBLE, tau)) AS r FROM p JOIN t USING (c_mktsegment)), "
    f"l AS (SELECT c_mktsegment, tau, r, sum({sql.fill(sql.LOG_C['clayton'], 'u', 'v', 'r')}) AS l, count(*) AS n FROM q GROUP BY ALL) "
    "SELECT c_mktsegment, round(tau, 6) + 0.0 AS tau, round(r, 6) AS r, round(l, 4) + 0.0 AS log_likelihood, n, round(2 - 2 * l, 4) + 0.0 AS aic FROM l",
)
add(
    "clayton_by_flag", clayton_by_flag,
    f"WITH p AS ({sql.lineitem_pobs()}), t AS ({sql.tau_of_ranks(sql.lineitem_pobs(), 'l_returnflag')}), q AS (SELECT p.*, tau, 2*greatest(0.01::DOUBLE, tau)/(1-greatest(0.01::DOUBLE, tau)) AS r FROM p JOIN t USING (l_returnflag)), "
    f"l AS (SELECT l_returnflag, tau, r, sum({sql.fill(sql.LOG_C['clayton'], 'u', 'v', 'r')}) AS l, count(*) AS n FROM q GROUP BY ALL) "
    "SELECT l_returnflag, round(tau, 6) + 0.0 AS tau, round(r, 6) AS r, round(l, 4) + 0.0 AS log_likelihood, n, round(2 - 2 * l, 4) + 0.0 AS aic FROM l",
)
add(
    "tau_matrix",
    lambda spark, d: agg.tau_matrix(read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("s_nationkey"), "s_acctbal", (F.col("s_suppkey") % 7).cast("double").alias("k")), ["s_nationkey", "s_acctbal", "k"]).select("a", "b", r6(F.col("tau")).alias("tau")),
    "WITH s AS (SELECT 1 AS one, s_suppkey, s_nationkey, s_acctbal, s_suppkey % 7 AS k FROM supplier) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(tau, 6) + 0.0 AS tau FROM ({_tau_sql('s', 'one', a, b, 's_suppkey')})" for a, b in (("s_nationkey", "s_acctbal"), ("s_nationkey", "k"), ("s_acctbal", "k"))),
)
add(
    "normal_score_correlation",
    lambda spark, d: agg.normal_score_correlation(lineitem_pobs(spark, d), ["u", "v"], ["l_returnflag"]).select("l_returnflag", r6(F.col("rho"), 5).alias("rho")),
    f"SELECT l_returnflag, round(corr({sql.norm_ppf('u')}, {sql.norm_ppf('v')}), 5) + 0.0 AS rho FROM ({sql.lineitem_pobs()}) GROUP BY l_returnflag",
)
add(
    "log_mean_exp",
    lambda spark, d: agg.log_mean_exp(read(spark, d, "events"), "value", ["event_type"]).select("event_type", r6(F.col("log_mean_exp")).alias("lme")),
    "SELECT event_type, round(max(value) + ln(avg(exp(value - m))), 6) + 0.0 AS lme FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type",
)

# windows
_BY, _AT = ["user_id"], ["ts", "event_id"]
_OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
_ROLL = f"SELECT user_id, event_id, value, row_number() {_OVER}) AS n, list(value) {_OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w, quantile_cont(value, 0.3) {_OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS q, quantile_cont(value, 0.5) {_OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS med FROM events"


def _rolling(spark, d) -> DataFrame:
    return win.rolling(read(spark, d, "events").select("user_id", "event_id", "ts", "value"), "value", 5, _BY, _AT, 0.3)


add(
    "rolling_var_cvar",
    lambda spark, d: _rolling(spark, d).select("event_id", r6(F.col("var")).alias("var"), r6(F.col("cvar")).alias("cvar")),
    f"SELECT event_id, CASE WHEN n < 5 THEN 0.0 ELSE round(q, 6) END::DOUBLE AS var, CASE WHEN n < 5 THEN 0.0 ELSE round(list_avg(list_filter(w, lambda x: x <= q)), 6) END::DOUBLE AS cvar FROM ({_ROLL})",
)
add(
    "rolling_marginals",
    lambda spark, d: _rolling(spark, d).select("event_id", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "median", "mad")]),
    f"SELECT event_id, CASE WHEN n < 5 THEN 0.0 ELSE round(list_avg(w), 6) END::DOUBLE AS mean, CASE WHEN n < 5 THEN 0.0 ELSE round(sqrt(list_avg(list_transform(w, lambda x: (x-list_avg(w))*(x-list_avg(w))))), 6) END::DOUBLE AS std, "
    f"CASE WHEN n < 5 THEN 0.0 ELSE round(med, 6) END::DOUBLE AS median, CASE WHEN n < 5 THEN 0.0 ELSE round(list_avg(list_transform(w, lambda x: abs(x-med))), 6) END::DOUBLE AS mad FROM ({_ROLL})",
)


def _daily(spark, d) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("price"))


_DAILY = "SELECT year(o_orderdate) AS year, o_orderdate::DATE AS day, sum(o_totalprice) AS price FROM orders GROUP BY ALL"
add(
    "log_return",
    lambda spark, d: _daily(spark, d).withColumn("r", win.log_return("price", ["year"], ["day"])).where("r is not null").select(F.col("day").cast("string").alias("day"), r6(F.col("r")).alias("r")),
    f"SELECT day::VARCHAR AS day, round(r, 6) + 0.0 AS r FROM (SELECT day, ln(price / lag(price) OVER (PARTITION BY year ORDER BY day)) AS r FROM ({_DAILY})) WHERE r IS NOT NULL",
)
_AR = f"WITH e AS (SELECT *, lag(value) {_OVER}) AS p, avg(value) OVER (PARTITION BY user_id) AS mu FROM events), f AS (SELECT user_id, greatest(-0.99, least(0.99, coalesce(regr_slope(value, p), 0))) AS slope, avg(value) AS my, avg(p) AS mx, count(*) AS n FROM e WHERE p IS NOT NULL GROUP BY user_id)"


def _ar(spark, d) -> tuple[DataFrame, DataFrame]:
    events = read(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return events, win.ar1_fit(events, "value", _BY, _AT)


add(
    "ar1_fit",
    lambda spark, d: _ar(spark, d)[1].select("user_id", r6(F.col("const"), 5).alias("const"), r6(F.col("slope")).alias("slope"), "n"),
    f"{_AR} SELECT user_id, round(my - slope * mx, 5) + 0.0 AS const, round(slope, 6) + 0.0 AS slope, n FROM f",
)
add(
    "ar1_residuals",
    lambda spark, d: win.ar1_residuals(*_ar(spark, d), "value", _BY, _AT).select("event_id", r6(F.col("residual"), 5).alias("residual")),
    f"{_AR} SELECT event_id, round(CASE WHEN p IS NULL THEN value - mu ELSE value - (my - slope * mx) - slope * p END, 5) + 0.0 AS residual FROM e JOIN f USING (user_id)",
)
add(
    "rolling_pobs",
    lambda spark, d: win.rolling_pobs(read(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["value"], 4, _BY, _AT, ["event_id"]).groupBy("user_id", "window").agg(r6(F.sum(F.col("u_value") * F.col("value"))).alias("x")),
    f"WITH e AS (SELECT user_id, event_id, value, row_number() {_OVER}) AS n FROM events), w AS (SELECT a.user_id, a.n AS win, b.value, row_number() OVER (PARTITION BY a.user_id, a.n ORDER BY b.value, b.event_id) / 5.0::DOUBLE AS u FROM e a JOIN e b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 3 AND a.n WHERE a.n >= 4) "
    'SELECT user_id, win AS "window", round(sum(u * value), 6) + 0.0 AS x FROM w GROUP BY user_id, win',
)

# recursions
_OMEGA, _GAMMA, _BETA = 0.05, 0.1, 0.8


def _gas_sql(last: str | None = None) -> str:
    """The filter as a recursion over ``n``; ``last`` selects from its rows j (with state g before each observation)."""
    r, prev = "(1e-4 + ln(1+exp(g)))", "p.g"
    score = sql.fill(sql.SCORE["clayton"], "o.u", "o.v", "1e-4+ln(1+exp(p.g))")
    ll = sql.fill(sql.LOG_C["clayton"], "u", "v", "1e-4+ln(1+exp(g))")
    return (
        f"WITH RECURSIVE o AS (SELECT * FROM ({sql.event_pobs()})), f(user_id, n, g) AS (SELECT DISTINCT user_id, 1::BIGINT, ({_OMEGA}/(1-{_BETA}))::DOUBLE FROM o UNION ALL "
        f"SELECT p.user_id, p.n + 1, greatest(-50.0, least(50.0, {_OMEGA} + {_BETA} * {prev} + {_GAMMA} * greatest(-100.0, least(100.0, ({score}) / (1 + exp(-p.g)))))) FROM f p JOIN o ON o.user_id = p.user_id AND o.n = p.n), "
        f"j AS (SELECT o.*, g, count(*) OVER (PARTITION BY o.user_id) AS m FROM o JOIN f USING (user_id, n)) "
        + (last or f"SELECT user_id, round(sum({ll}), 4) + 0.0 AS log_likelihood, round(max(CASE WHEN n = m THEN g END), 5) + 0.0 AS g_last, round(max(CASE WHEN n = m THEN {r} END), 5) + 0.0 AS r_last FROM j GROUP BY user_id")
    )


def gas_rows_sql() -> str:
    e2 = sql.fill(sql.H["clayton"], "v", "u", "1e-4+ln(1+exp(g))")
    return _gas_sql(f"SELECT user_id, round(avg(1e-4+ln(1+exp(g))), 4) + 0.0 AS r, round(avg({e2}), 4) + 0.0 AS e2 FROM j GROUP BY user_id")


add(
    "gas_filter_clayton",
    lambda spark, d: rec.gas_filter(event_pobs(spark, d), Copula("clayton"), "u", "v", (_OMEGA, _GAMMA, _BETA), ["user_id"], ["n"]).select(
        "user_id", r6(F.col("log_likelihood"), 4).alias("log_likelihood"), r6(F.col("g_last"), 5).alias("g_last"), r6(F.col("r_last"), 5).alias("r_last")
    ),
    _gas_sql(),
)
add(
    "garch_filter",
    lambda spark, d: rec.garch_filter(read(spark, d, "events").select("user_id", "event_id", "ts", "value"), "value", (0.1, 0.1, 0.8), _BY, _AT).select("user_id", r6(F.col("s2_last"), 4).alias("s2_last"), r6(F.col("s2_next"), 4).alias("s2_next"), r6(F.col("log_likelihood"), 3).alias("log_likelihood")),
    f"WITH RECURSIVE o AS (SELECT user_id, value AS e, row_number() {_OVER}) AS n, count(*) OVER (PARTITION BY user_id) AS m, var_samp(value) OVER (PARTITION BY user_id) AS v FROM events), "
    "f(user_id, n, s2) AS (SELECT user_id, 1::BIGINT, greatest(0.1 / (1 - 0.1 - 0.8)::DOUBLE, coalesce(v, 0), 1e-12)::DOUBLE FROM o WHERE n = 1 UNION ALL SELECT p.user_id, p.n + 1, (0.1::DOUBLE + 0.1::DOUBLE * o.e * o.e + 0.8::DOUBLE * p.s2) FROM f p JOIN o ON o.user_id = p.user_id AND o.n = p.n), "
    "j AS (SELECT o.*, s2 FROM o JOIN f USING (user_id, n)) SELECT user_id, round(max(CASE WHEN n = m THEN s2 END), 4) AS s2_last, round(max(CASE WHEN n = m THEN 0.1 + 0.1 * e * e + 0.8 * s2 END), 4) AS s2_next, round(sum(-0.5 * (ln(s2) + e * e / s2 + ln(2 * pi()))), 3) + 0.0 AS log_likelihood FROM j GROUP BY user_id",
)
add(
    "ou_path",
    lambda spark, d: rec.ou_path(event_pobs(spark, d).withColumn("eps", F.col("u") - 0.5), "eps", 2.0, 0.3, 0.8, 0.05, ["user_id"], ["n"]).select("user_id", r6(F.element_at("path", -1)).alias("last"), r6(F.array_max("path")).alias("top"), F.size("path").alias("n")),
    f"WITH o AS (SELECT user_id, n, u - 0.5 AS eps FROM ({sql.event_pobs()})), k AS (SELECT a.user_id, a.n, 0.3 + sum(pow(exp(-0.1::DOUBLE), a.n - b.n) * b.eps) * 0.8 / sqrt(4.0) * sqrt(1 - exp(-0.2::DOUBLE)) AS x FROM o a JOIN o b ON a.user_id = b.user_id AND b.n <= a.n GROUP BY a.user_id, a.n) "
    "SELECT user_id, round(arg_max(x, n), 6) + 0.0 AS last, round(max(x), 6) + 0.0 AS top, max(n)::INTEGER AS n FROM k GROUP BY user_id",
)

from . import catalog_models  # noqa: E402, F401  (registers the remaining queries)
