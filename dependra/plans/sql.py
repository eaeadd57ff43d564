"""Formulas in plain SQL for the oracle, written from the definitions and not in the stable forms the engine uses."""

from __future__ import annotations

from ..functions import scalars as s

LINE_TIES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"

LOG_C = {
    "clayton": "ln(1+{r})-({r}+1)*(ln({u})+ln({v}))-(2+1/{r})*ln(pow({u},-{r})+pow({v},-{r})-1)",
    "frank": "ln({r})+ln(1-exp(-{r}))-{r}*({u}+{v})-2*ln(exp(-{r}*{u})*(1-exp(-{r}*{v}))+exp(-{r}*{v})*(1-exp(-{r}*(1-{v}))))",
    "gumbel": "({r}-1)*(ln(-ln({u}))+ln(-ln({v})))+(1/{r}-2)*ln(pow(-ln({u}),{r})+pow(-ln({v}),{r}))"
    "+ln({r}-1+pow(pow(-ln({u}),{r})+pow(-ln({v}),{r}),1/{r}))-pow(pow(-ln({u}),{r})+pow(-ln({v}),{r}),1/{r})-ln({u})-ln({v})",
    "joe": "({r}-1)*(ln(1-{u})+ln(1-{v}))+ln(pow(1-{u},{r})+pow(1-{v},{r})-pow((1-{u})*(1-{v}),{r})+{r}-1)"
    "-(2-1/{r})*ln(pow(1-{u},{r})+pow(1-{v},{r})-pow((1-{u})*(1-{v}),{r}))",
}
H = {
    "clayton": "pow({v},-{r}-1)*pow(pow({u},-{r})+pow({v},-{r})-1,-1-1/{r})",
    "frank": "exp(-{r}*{v})*(1-exp(-{r}*{u}))/(exp(-{r}*{u})*(1-exp(-{r}*{v}))+exp(-{r}*{v})*(1-exp(-{r}*(1-{v}))))",
    "gumbel": "pow(-ln({v}),{r}-1)*pow(pow(-ln({u}),{r})+pow(-ln({v}),{r}),1/{r}-1)*exp(-pow(pow(-ln({u}),{r})+pow(-ln({v}),{r}),1/{r}))/{v}",
    "joe": "(1-pow(1-{u},{r}))*pow(pow(1-{u},{r})+pow(1-{v},{r})-pow((1-{u})*(1-{v}),{r}),1/{r}-1)*pow(1-{v},{r}-1)",
}
SCORE = {
    "clayton": "1/(1+{r})-(ln({u})+ln({v}))+ln(pow({u},-{r})+pow({v},-{r})-1)/({r}*{r})"
    "+(2+1/{r})*(pow({u},-{r})*ln({u})+pow({v},-{r})*ln({v}))/(pow({u},-{r})+pow({v},-{r})-1)",
    "frank": "1/{r}+exp(-{r})/(1-exp(-{r}))-({u}+{v})-2*(-{u}*exp(-{r}*{u})*(1-exp(-{r}*{v}))+{v}*exp(-{r}*({u}+{v}))-{v}*exp(-{r}*{v})*(1-exp(-{r}*(1-{v})))+(1-{v})*exp(-{r}))"
    "/(exp(-{r}*{u})*(1-exp(-{r}*{v}))+exp(-{r}*{v})*(1-exp(-{r}*(1-{v}))))",
    "gumbel": "ln(-ln({u}))+ln(-ln({v}))-ln({S})/({r}*{r})+(1/{r}-2)*{dS}/{S}+(1+{dA})/({r}-1+{A})-{dA}",
    "joe": "ln(1-{u})+ln(1-{v})+({dB}+1)/({B}+{r}-1)-ln({B})/({r}*{r})-(2-1/{r})*{dB}/{B}",
}
H_INV = {
    "clayton": "pow(pow({u}*pow({v},{r}+1),-{r}/(1+{r}))+1-pow({v},-{r}),-1/{r})",
    "frank": "-ln(((1-{u})/{u}*exp(-{r}*{v})+exp(-{r}))/((1-{u})/{u}*exp(-{r}*{v})+1))/{r}",
}
TAU = {"clayton": "{r}/({r}+2)", "gumbel": "1-1/{r}", "gaussian": "2/pi()*asin({r})"}


def fill(template: str, u: str, v: str, r: float | str) -> str:
    u, v, r = f"({u})", f"({v})", f"({r}::DOUBLE)"
    if "{S}" in template:
        big = f"(pow(-ln({u}),{r})+pow(-ln({v}),{r}))"
        d = f"(pow(-ln({u}),{r})*ln(-ln({u}))+pow(-ln({v}),{r})*ln(-ln({v})))"
        a = f"pow({big},1/{r})"
        return template.format(u=u, v=v, r=r, S=big, dS=d, A=a, dA=f"({a}*({d}/({r}*{big})-ln({big})/({r}*{r})))")
    if "{B}" in template:
        b = f"(pow(1-{u},{r})+pow(1-{v},{r})-pow((1-{u})*(1-{v}),{r}))"
        d = f"(pow(1-{u},{r})*ln(1-{u})+pow(1-{v},{r})*ln(1-{v})-pow((1-{u})*(1-{v}),{r})*(ln(1-{u})+ln(1-{v})))"
        return template.format(u=u, v=v, r=r, B=b, dB=d)
    return template.format(u=u, v=v, r=r)


def rotated(u: str, v: str, rotation: int) -> tuple[str, str]:
    return (f"1-{u}" if rotation in (90, 180) else u), (f"1-{v}" if rotation in (180, 270) else v)


def _poly(x: str, c) -> str:
    out = f"({c[0]!r}::DOUBLE)"
    for v in c[1:]:
        out = f"({out}*{x}+({v!r}::DOUBLE))"
    return out


def norm_ppf(p: str) -> str:
    """The rational normal quantile for p strictly inside (1e-10, 1 - 1e-10)."""
    q, c = f"sqrt(-2*ln(least({p},1-{p})))", f"({p}-0.5::DOUBLE)"
    s2 = f"({c}*{c})"
    low = f"({_poly(q, s._C)}/({_poly(q, s._D)}*{q}+1))"
    mid = f"({c}*{_poly(s2, s._A)}/({_poly(s2, s._B)}*{s2}+1))"
    return f"(CASE WHEN least({p},1-{p})<0.02425::DOUBLE THEN CASE WHEN {p}<0.5 THEN {low} ELSE -{low} END ELSE {mid} END)"


_CDF_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_CDF_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def norm_cdf(x: str) -> str:
    """The normal distribution by a published rational form (fifteen digits for |x| below 7), another one than the engine's."""
    tail = f"(exp(-0.5*{x}*{x})*{_poly(f'abs({x})', _CDF_P)}/{_poly(f'abs({x})', _CDF_Q)})"
    return f"(CASE WHEN {x}>0 THEN 1-{tail} ELSE {tail} END)"


def tau_of_ranks(base: str, by: str) -> str:
    """Kendall's tau of rank columns u, v without ties, by counting discordant pairs level by level: at each bit of the rank of
    u, within rows that share the higher bits, those with the bit that come earlier in the order of v."""
    return (
        f"WITH b AS ({base}), r AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY u) - 1 AS ru, row_number() OVER (PARTITION BY {by} ORDER BY v) AS rv FROM b), "
        f"k AS (SELECT {by}, i, ru >> (i + 1) AS node, (ru >> i) & 1 AS bit, rv FROM r, range(0, 24) t(i)), "
        f"w AS (SELECT {by}, bit, sum(bit) OVER (PARTITION BY {by}, i, node ORDER BY rv) AS earlier FROM k), "
        f"d AS (SELECT {by}, sum(CASE WHEN bit = 0 THEN earlier ELSE 0 END) AS discordant FROM w GROUP BY {by}), n AS (SELECT {by}, count(*)::DOUBLE AS n FROM b GROUP BY {by}) "
        f"SELECT {by}, 1 - 4 * discordant / (n * (n - 1)) AS tau FROM d JOIN n USING ({by})"
    )


def rank(column: str, ties: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(row_number() OVER ({part}ORDER BY {column}, {ties}))::DOUBLE / (count(*) OVER ({part}) + 1)"


def lineitem_pobs() -> str:
    return f"SELECT l_returnflag, {rank('l_quantity', LINE_TIES, 'l_returnflag')} AS u, {rank('l_extendedprice', LINE_TIES, 'l_returnflag')} AS v FROM lineitem"


def segment_pobs() -> str:
    return (
        f"SELECT c_mktsegment, o_orderkey, {rank('o_totalprice', 'o_orderkey', 'c_mktsegment')} AS u, {rank('c_acctbal', 'o_orderkey', 'c_mktsegment')} AS v "
        "FROM orders JOIN customer ON o_custkey = c_custkey"
    )


def event_pobs() -> str:
    """Per user: rank of the value and rank of the previous value."""
    return (
        f"SELECT user_id, event_id, ts, {rank('value', 'event_id', 'user_id')} AS u, {rank('prev', 'event_id', 'user_id')} AS v, n FROM "
        "(SELECT user_id, event_id, ts, value, prev, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM "
        "(SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL)"
    )


def frank_mle(base: str, by: str, points: int = 32, levels: int = 6) -> str:
    """``by, r, ll, n``: the Frank likelihood of columns u, v at ever finer grids around the best of the one before, from its bound of 1e-4 to 80."""
    low, step = 1e-4, (80 - 1e-4) / (points - 1)
    out = f"WITH b AS MATERIALIZED ({base}), m0 AS (SELECT {by}, count(*) AS n FROM b GROUP BY {by})"
    for k in range(1, levels + 1):
        at = f"{low} + i*{step!r}::DOUBLE" if k == 1 else f"greatest({low}, r - {wide!r}::DOUBLE + i*{step!r}::DOUBLE)"
        out += (
            f", g{k} AS (SELECT DISTINCT {by}, {at} AS r FROM m{k - 1}, range({points}) t(i)), l{k} AS (SELECT {by}, r, sum({fill(LOG_C['frank'], 'u', 'v', 'r')}) AS ll FROM b JOIN g{k} USING ({by}) GROUP BY {by}, r), "
            f"m{k} AS (SELECT {by}, arg_max(r, ll) AS r, max(ll) AS ll FROM l{k} GROUP BY {by})"
        )
        wide, step = step, 2 * step / (points - 1)
    return f"{out} SELECT {by}, r, ll, n FROM m{levels} JOIN m0 USING ({by})"


def t4_ppf(p: str) -> str:
    """The closed quantile of Student's law with four degrees of freedom."""
    root = f"least(1.0, sqrt(4*{p}*(1-{p})))"
    return f"(sign({p}-0.5)*2*sqrt(greatest(0.0, cos(acos({root})/3)/{root}-1)))"


def t_cdf(x: str, df: int) -> str:
    """The closed distribution of five or six degrees of freedom."""
    a = f"atan(({x})/sqrt({df}.0))"
    c2 = f"pow(cos({a}),2)"
    return f"(0.5+({a}+sin({a})*cos({a})*(1+2*{c2}/3))/pi())" if df == 5 else f"(0.5+sin({a})*(1+{c2}/2+3*{c2}*{c2}/8)/2)"
