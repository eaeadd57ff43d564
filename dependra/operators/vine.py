"""Regular vines: structures, selection, likelihood, Rosenblatt transform, sampling and conditioning.

A vine is a list of trees of edges (a, b | cond). Values of a variable given a set are columns named after
both; a plan is a chain of projections that Catalyst evaluates row by row, without an exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import combinations
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as s
from ..functions.backend import col, num
from ..functions.families import Copula
from .aggregates import TAU_BLOCK, TAU_ROWS, kendall_tau_agg, kendall_taus_long
from .fit import candidates, fit_large_many, likelihoods

INDEPENDENT = Copula("independence")


@dataclass(frozen=True)
class Edge:
    a: int
    b: int
    cond: frozenset[int] = frozenset()
    copula: Copula = INDEPENDENT
    r: float = 0.0
    tau: float = 0.0
    log_likelihood: float = 0.0

    @property
    def variables(self) -> frozenset[int]:
        return self.cond | {self.a, self.b}

    @property
    def key(self) -> tuple[int, int, frozenset[int]]:
        return self.a, self.b, self.cond


@dataclass(frozen=True)
class Vine:
    d: int
    edges: tuple[Edge, ...] = field(default_factory=tuple)

    def __post_init__(self):
        for e in self.edges:
            if e.a == e.b or {e.a, e.b} & e.cond:
                raise ValueError(f"not an edge: {e}")
        tree0 = [e for e in self.edges if not e.cond]
        if self.d > 1 and len(tree0) != self.d - 1:
            raise ValueError(f"the first tree of {self.d} variables has {len(tree0)} edges")

    def tree(self, level: int) -> list[Edge]:
        return [e for e in self.edges if len(e.cond) == level]

    def find(self, x: int, given: frozenset[int]) -> tuple[Edge, int]:
        """The edge whose copula gives x given ``given``, and x's partner in it."""
        return self._partners[(x, given)]

    @cached_property
    def _partners(self) -> dict[tuple[int, frozenset[int]], tuple[Edge, int]]:
        out: dict = {}
        for e in self.edges:
            out.setdefault((e.a, e.cond | {e.b}), (e, e.b))
            out.setdefault((e.b, e.cond | {e.a}), (e, e.a))
        return out

    def order(self, first: Sequence[int] = ()) -> list[int] | None:
        """Variables so that each one's edges to all earlier ones are in the vine; ``first`` come first, if they can."""
        want = frozenset(first)

        def peel(left: frozenset[int], edges: tuple[Edge, ...]) -> list[int] | None:
            if len(left) <= 1:
                return list(left)
            for e in edges:
                if e.variables == left:
                    for x in sorted((e.a, e.b), key=lambda v: (v in want, v)):
                        if x in want and not left <= want:
                            continue
                        rest = peel(left - {x}, tuple(k for k in edges if x not in k.variables))
                        if rest is not None:
                            return rest + [x]
            return None

        return peel(frozenset(range(self.d)), self.complete(first).edges)

    def complete(self, first: Sequence[int] = ()) -> Vine:
        """The vine with independent edges in place of truncated trees; where there is a choice, ``first`` can come first."""
        edges, want = list(self.edges), frozenset(first)
        for level in range(self.d - 1):
            have = [e for e in edges if len(e.cond) == level]
            if len(have) == self.d - 1 - level:
                continue
            below = [e for e in edges if len(e.cond) == level - 1]
            pool = [k for k in next_candidates(below)]
            edges += spanning_tree([(float(e.variables <= want), x, y, e) for x, y, e in pool], len(below), self.d - 1 - level)
        return Vine(self.d, tuple(edges))

    def matrix(self) -> np.ndarray:
        """Natural-order matrix: column j holds a variable, and above it its partners tree by tree."""
        order = self.order()
        out = np.full((self.d, self.d), -1)
        full = self.complete()
        for j, x in enumerate(reversed(order)):
            earlier = frozenset(order[: len(order) - 1 - j])
            out[self.d - 1 - j, j] = x
            given = earlier
            while given:
                _, y = full.find(x, given)
                out[len(given) - 1, j] = y
                given = given - {y}
        return out

    @classmethod
    def from_matrix(cls, m: np.ndarray) -> Vine:
        d = len(m)
        edges = []
        for j in range(d):
            x = int(m[d - 1 - j, j])
            for level in range(d - 1 - j):
                edges.append(Edge(x, int(m[level, j]), frozenset(int(v) for v in m[:level, j])))
        return cls(d, tuple(sorted(edges, key=lambda e: len(e.cond))))

    def summary(self) -> list[dict]:
        return [dict(tree=len(e.cond), a=e.a, b=e.b, cond=sorted(e.cond), family=e.copula.family, rotation=e.copula.rotation, r=e.r, tau=e.tau, log_likelihood=e.log_likelihood) for e in self.edges]


def c_vine(d: int, order: Sequence[int] | None = None) -> Vine:
    """Stars: the root of each tree joins all later variables."""
    o = list(order or range(d))
    return Vine(d, tuple(Edge(o[t], o[j], frozenset(o[:t])) for t in range(d - 1) for j in range(t + 1, d)))


def d_vine(d: int, order: Sequence[int] | None = None) -> Vine:
    """Paths: each tree joins variables a fixed distance apart."""
    o = list(order or range(d))
    return Vine(d, tuple(Edge(o[i], o[i + t + 1], frozenset(o[i + 1 : i + t + 1])) for t in range(d - 1) for i in range(d - 1 - t)))


def next_candidates(edges: Sequence[Edge]) -> list[tuple[int, int, Edge]]:
    """Pairs of edges that share all but one variable each (the proximity condition)."""
    out = []
    for i, j in combinations(range(len(edges)), 2):
        x, y = edges[i].variables, edges[j].variables
        if len(x - y) == 1 and len(y - x) == 1:
            (a,), (b,) = x - y, y - x
            out.append((i, j, Edge(min(a, b), max(a, b), x & y)))
    return out


def spanning_tree(weighted: list[tuple[float, int, int, Edge]], nodes: int, size: int) -> list[Edge]:
    """Kruskal: the heaviest edges that close no circle."""
    parent = list(range(nodes))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for _, x, y, e in sorted(weighted, key=lambda k: (-k[0], k[3].a, k[3].b, sorted(k[3].cond))):
        if root(x) != root(y):
            parent[root(x)] = root(y)
            out.append(e)
            if len(out) == size:
                break
    return out


def name(x: int, given: frozenset[int]) -> str:
    return f"u{x}" + ("__" + "_".join(map(str, sorted(given))) if given else "")


class Values:
    """Columns (or arrays) of variables given sets, made when first asked for. ``r`` holds parameters that edges take in place of their own."""

    def __init__(self, vine: Vine, m, known: dict, r: dict | None = None):
        self.vine, self.m, self.known, self.r = vine, m, dict(known), r or {}
        self.steps: list[tuple[str, object]] = []
        self.keep: Callable | None = None

    def param(self, e: Edge):
        return self.r[e.key] if e.key in self.r else self.m.of(e.r)

    def get(self, x: int, given: frozenset[int] = frozenset()):
        key = (x, given)
        if key not in self.known:
            e, y = self.vine.find(x, given)
            below = given - {y}
            c = e.copula if e.a == x else e.copula.transposed()
            self.put(x, given, c.h(self.m, self.get(x, below), self.get(y, below), self.param(e)))
        return self.known[key]

    def put(self, x: int, given: frozenset[int], value) -> None:
        self.known[(x, given)] = self.keep(name(x, given), value) if self.keep else value


def _with_columns(df: DataFrame, columns: Sequence[str], vine: Vine) -> tuple[Values, list]:
    """Values over a frame: each new one becomes a projection, so no expression is repeated inside another."""
    values = Values(vine, col, {(i, frozenset()): F.col(c) for i, c in enumerate(columns)})
    steps: list[tuple[str, Column]] = []

    def keep(label, value):
        steps.append(("__" + label, value))
        return F.col("__" + label)

    values.keep = keep
    return values, steps


def _run(df: DataFrame, steps: list) -> DataFrame:
    for label, value in steps:
        df = df.withColumn(label, value)
    return df


def log_pdf(df: DataFrame, columns: Sequence[str], vine: Vine, out: str = "log_pdf") -> DataFrame:
    """``df`` with the vine's log-density of each row."""
    values, steps = _with_columns(df, columns, vine)
    total = F.lit(0.0)
    for e in sorted(vine.edges, key=lambda k: len(k.cond)):
        if e.copula.family != "independence":
            total = total + e.copula.log_pdf(col, values.get(e.a, e.cond), values.get(e.b, e.cond), F.lit(e.r))
    return _run(df, steps).withColumn(out, total).drop(*[k for k, _ in steps])


def rosenblatt(df: DataFrame, columns: Sequence[str], vine: Vine, prefix: str = "e") -> DataFrame:
    """``df`` with independent uniforms under the vine: each variable given all earlier ones of the vine's order."""
    full = vine.complete()
    values, steps = _with_columns(df, columns, full)
    order = full.order()
    new = {f"{prefix}{x}": s.clip_rosenblatt(col, values.get(x, frozenset(order[:i]))) for i, x in enumerate(order)}
    return _run(df, steps).withColumns(new).drop(*[k for k, _ in steps])


def _sample(values: Values, order: list[int], uniforms: dict, given: dict) -> None:
    """Fill ``values`` for all variables, inverting edge by edge from the largest set down."""
    for i, x in enumerate(order):
        if x in given:
            values.known[(x, frozenset())] = given[x]
            continue
        have = frozenset(order[:i])
        now = uniforms[x]
        values.known[(x, have)] = now
        while have:
            e, y = values.vine.find(x, have)
            below = have - {y}
            c = e.copula if e.a == x else e.copula.transposed()
            values.put(x, below, c.h_inv(values.m, now, values.get(y, below), values.param(e)))
            now, have = values.known[(x, below)], below


def sample_columns(df: DataFrame, uniforms: Sequence[str], vine: Vine, prefix: str = "x", given: dict[int, float] | None = None) -> DataFrame:
    """``df`` with a draw of the vine, made from its columns of independent uniforms. ``given`` values hold exactly.

    Exact when the given variables can come first in an order of the vine; otherwise refused, and
    :func:`sample_mcmc` is the way.
    """
    given = given or {}
    full = vine.complete(tuple(given))
    order = full.order(tuple(given))
    if order is None or set(order[: len(given)]) != set(given):
        raise ValueError("these variables cannot come first in an order of the vine; use sample_mcmc")
    values, steps = _with_columns(df, [], full)
    values.known = {}
    _sample(values, order, {i: F.col(c) for i, c in enumerate(uniforms)}, {k: F.lit(float(v)) for k, v in given.items()})
    out = {f"{prefix}{x}": values.known[(x, frozenset())] for x in range(vine.d)}
    return _run(df, steps).withColumns(out).drop(*[k for k, _ in steps])


def sample_arrays(vine: Vine, w: np.ndarray, given: dict[int, float] | None = None, r: dict | None = None) -> np.ndarray:
    """Draws from rows of uniforms; ``r`` may hold an edge's parameter of every row, by ``Edge.key``."""
    given = given or {}
    full = vine.complete(tuple(given))
    order = full.order(tuple(given))
    if order is None or set(order[: len(given)]) != set(given):
        raise ValueError("these variables cannot come first in an order of the vine; use sample_mcmc")
    values = Values(full, num, {}, r)
    _sample(values, order, {i: w[:, i] for i in range(vine.d)}, {k: np.full(len(w), float(v)) for k, v in given.items()})
    return np.column_stack([values.known[(x, frozenset())] for x in range(vine.d)])


def log_pdf_arrays(vine: Vine, u: np.ndarray, r: dict | None = None) -> np.ndarray:
    values = Values(vine, num, {(i, frozenset()): u[:, i] for i in range(vine.d)}, r)
    out = np.zeros(len(u))
    for e in vine.edges:
        if e.copula.family != "independence":
            out += e.copula.log_pdf(num, values.get(e.a, e.cond), values.get(e.b, e.cond), values.param(e))
    return out


def sample_mcmc(vine: Vine, n: int, given: dict[int, float], rng: np.random.Generator, steps: int | None = None, r: dict | None = None) -> tuple[np.ndarray, float]:
    """Metropolis within Gibbs on the free coordinates with uniform proposals: n chains side by side, last states, acceptance."""
    free = [i for i in range(vine.d) if i not in given]
    steps = steps or max(80, 30 * len(free)) + max(40, 10 * len(free))
    u = rng.uniform(size=(n, vine.d))
    for i, v in given.items():
        u[:, i] = v
    now, taken = log_pdf_arrays(vine, u, r), 0
    for _ in range(steps):
        for i in free:
            new = u.copy()
            new[:, i] = rng.uniform(size=n)
            ll = log_pdf_arrays(vine, new, r)
            yes = np.log(rng.uniform(size=n)) < ll - now
            u[yes], now = new[yes], np.where(yes, ll, now)
            taken += int(yes.sum())
    return u, taken / max(1, steps * len(free) * n)


def fit(
    df: DataFrame, columns: Sequence[str], structure: str | Vine = "r", families: Sequence[str] = ("clayton", "frank", "gumbel", "joe", "gaussian"),
    truncation: int | None = None, threshold: float = 0.0, keep: int = 3, given: Sequence[int] = (),
) -> Vine:
    """Tree by tree: candidate edges by the proximity condition, weights |tau|, a maximum spanning tree (or the
    given structure), and for each edge the family of smallest AIC after screening.

    Jobs serve all edges of a level: its taus, the screening, and each narrowing of the likelihoods' brackets. The frame
    grows by the columns of the level's conditional values. Edges among ``given`` variables go before all others, so these can
    come first in an order of the vine and :func:`sample_columns` draws exactly given them.
    """
    d, want = len(columns), frozenset(given)
    names = [f"__u{i}" for i in range(d)]
    # all levels start from the columns: kept, on disk where memory is short
    base = df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)]).persist()
    shape = structure if isinstance(structure, Vine) else {"c": c_vine, "d": d_vine}.get(structure, lambda _: None)(d)
    edges: list[Edge] = []
    below: list[Edge] = []
    for level in range(d - 1):
        if level == 0:
            pool = [(i, j, Edge(i, j)) for i, j in combinations(range(d), 2)]
        else:
            pool = next_candidates(below)
        if shape is not None:
            wanted = {(frozenset((e.a, e.b)), e.cond) for e in shape.tree(level)}
            pool = [k for k in pool if (frozenset((k[2].a, k[2].b)), k[2].cond) in wanted]
        if truncation is not None and level >= truncation:
            break
        partial_ = object.__new__(Vine)
        object.__setattr__(partial_, "d", d)
        object.__setattr__(partial_, "edges", tuple(edges))
        values, steps = _with_columns(base, names, partial_)
        sides = list(dict.fromkeys((x, e.cond) for _, _, e in pool for x in (e.a, e.b)))
        at = {k: f"__p{i}" for i, k in enumerate(sides)}
        # clips make numbers of nulls: a value is null where one that it is made of is
        there = lambda x, cond: reduce(and_, [F.col(names[k]).isNotNull() for k in (x, *sorted(cond))])
        wide = [F.when(there(*k), values.get(*k)).alias(at[k]) for k in sides]
        # scanned for taus and for the likelihoods
        frame = _run(base, steps).select(*wide)
        frame = frame.persist() if level else frame
        pairs = {e.key: (at[(e.a, e.cond)], at[(e.b, e.cond)]) for _, _, e in pool}
        if (rows := frame.count()) > TAU_ROWS:
            taus = kendall_taus_long(frame, list(pairs.values()), -(-rows // TAU_BLOCK))
        else:
            row = frame.agg(*[kendall_tau_agg(F.col(x), F.col(y)).alias(f"t{i}") for i, (x, y) in enumerate(pairs.values())]).first()
            taus = [float(row[f"t{i}"] or 0.0) for i in range(len(pool))]
        tree = spanning_tree([(abs(t) + (2.0 if e.variables <= want else 0.0), x, y, e) for t, (x, y, e) in zip(taus, pool)], d if level == 0 else len(below), d - 1 - level)
        tau = dict(zip(pairs, taus))
        below = _fit_edges(frame, [(e, *pairs[e.key], tau[e.key]) for e in tree], families, threshold, keep)
        edges += below
        if level:
            frame.unpersist()
    base.unpersist()
    return Vine(d, tuple(edges))


def _fit_edges(frame: DataFrame, asked: Sequence[tuple[Edge, str, str, float]], families, threshold: float, keep: int) -> list[Edge]:
    """Edges (edge, columns, tau) with the family of smallest AIC among the ``keep`` likeliest at the parameter of their tau."""
    pools = [[c for c in candidates(t, families) if c.family != "independence"] if abs(t) >= threshold else [] for *_, t in asked]
    screened = [(c, x, y, [c.start(t)]) for (_, x, y, t), pool in zip(asked, pools) for c in pool]
    score = iter(likelihoods(frame, screened)[1] if screened else ())
    wanted = []
    for k, ((_, x, y, _), pool) in enumerate(zip(asked, pools)):
        at = {c: float(next(score)[0]) for c in pool}
        wanted += [(k, c, x, y) for c in sorted(pool, key=lambda c: -at[c])[:keep]]
    fits: list = [[] for _ in asked]
    for (k, c, _, _), got in zip(wanted, fit_large_many(frame, [w[1:] for w in wanted]) if wanted else ()):
        fits[k].append((got, c))
    out = []
    for (e, _, _, t), own in zip(asked, fits):
        top, copula = min(own, key=lambda k: k[0]["aic"], default=({"aic": 0.0}, INDEPENDENT))
        if top["aic"] >= 0.0:
            out.append(Edge(e.a, e.b, e.cond, INDEPENDENT, 0.0, t, 0.0))
        else:
            out.append(Edge(e.a, e.b, e.cond, copula, top["params"]["r"], t, top["log_likelihood"]))
    return out
