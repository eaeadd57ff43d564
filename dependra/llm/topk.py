"""Exact top-k by inner product with pivot-table elimination.

Components become integers floor(64 x). To search a metric space, every candidate vector gets one more
coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and every query a zero there: the squared distance
of the two is then |q|^2 + M^2 - 2 <q, x>, so the nearest candidates are those of largest inner product.
Pivots are rows spread far apart in a sample of at most ``SAMPLE`` rows. The distances of all vectors to them
are computed once, when the vectors are packed in blocks, and stored with these; by the triangle inequality
``max over pivots |d(q, p) - d(x, p)|`` is a lower bound of d(q, x), hence an upper bound of the score.
Candidates are evaluated in bound order, and a query stops when no bound left can reach its k-th score. A
first round over the sample gives each query a k-th score that already stops it in every block.
The bounds carry a small allowance for rounding; scores are exact integers.

Candidate blocks and groups of query blocks, both of bounded size, meet in one task each (an equi-join on
their numbers, the stated query set against all rows): a candidate block is sent once for each group of
queries. A task keeps at most k rows of a query, and a second, windowed step takes the k best of all. Ties go
to the smaller id.

Edge cases: vectors that are null, empty or hold a null or non-finite component take no part, on either
side; vectors of another length than the most frequent one (ties: the longer) take no part either; fewer than k candidates
give all of them; repeated ids are rows of their own, and a query never meets rows of its own id; components
of any finite size count, and scores that a long cannot hold are ranked exactly and written as its largest or
smallest value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ._common import materialize, prepare, table

K = 20
PIVOTS = 24
SAMPLE = 2048  #: rows that pivots and the first round's scores come from
QUERY_BLOCK = 512
QUERY_GROUP = 4  #: query blocks that meet a candidate block in one task
CANDIDATE_BLOCK = 8192
STEP = 256  #: candidates of the first chunk, in bound order
SCALE = 64.0
EXACT = 2.0**52  #: integers below it are exact in floats
LONG = (1 << 63) - 1


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (array<double>) of the rows that take part, natively."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    good = F.coalesce(F.forall(F.col("v"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & good)
    width = v.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    return v.where(F.size("v") == (width[0].n if width else -1))


def quantized(v: np.ndarray) -> np.ndarray:
    """floor(64 x) of a matrix: integers as floats where those are exact, else Python integers."""
    with np.errstate(over="ignore"):
        q = np.floor(v * SCALE)
    if not q.size or float(np.abs(q).max()) < EXACT:
        return q
    return np.array([[math.floor(x * 64) if abs(x) < EXACT else int(x) * 64 for x in row] for row in v.tolist()], object)


@dataclass
class Space:
    """Pivots in the lifted space, and ``top``, the largest squared norm of a candidate; no pivots where floats do not reach."""

    top: float
    pivots: np.ndarray | None

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - (x**2).sum(1), 0.0))
        return np.column_stack([x, last])

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """The pivot table of rows: a line for each pivot, in single precision."""
        if self.pivots is None:
            return np.zeros((1, len(x)), np.float32)
        a, p = self.lift(x.astype(float), query), self.pivots
        return np.sqrt(np.maximum((a**2).sum(1) + (p**2).sum(1)[:, None] - 2 * p @ a.T, 0.0)).astype(np.float32)


def space_of(sample: np.ndarray, top: float, pivots: int = PIVOTS) -> Space:
    """Pivots spread far apart: each next one is the sample's row farthest from those taken."""
    if not len(sample) or not top < 1e30:
        return Space(top, None)
    x = Space(top, None).lift(sample.astype(float), False)
    take, far = [0], ((x - x[0]) ** 2).sum(1)
    for _ in range(min(pivots, len(x)) - 1):
        i = int(far.argmax())
        take.append(i)
        far = np.minimum(far, ((x - x[i]) ** 2).sum(1))
    return Space(top, x[take])


def search_block(qid, q, dq, xid, x, dx, space: Space, k: int, floors=None, step: int = STEP):
    """Exact k best of one candidate block for each query: (query row, candidate rows, scores), and the number evaluated.

    ``q`` and ``x`` are of :func:`quantized`, ``dq`` and ``dx`` their pivot tables. ``floors`` are scores that k
    candidates are known to reach: lower ones are of no use. Products are exact in floats as long as they stay
    under 2**53; larger ones are computed in Python integers. Candidates are taken in bound order, chunk by chunk
    of growing size.
    """
    peak = 0.0 if not q.size or not x.size else float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    exact = q.dtype != object and x.dtype != object and peak < EXACT
    bounded = space.pivots is not None and q.dtype != object
    q2 = (q**2).sum(1) if bounded else np.zeros(len(q))
    slack = 1e-5 * (1.0 + space.top + float(q2.max(initial=0.0))) if bounded else 0.0
    if not exact:
        q, x = (np.array([[int(c) for c in row] for row in a], object).reshape(a.shape) for a in (q, x))
    out, evaluated = [], 0
    gap = np.empty(len(x), np.float32)
    for i in range(len(q)):
        if bounded:
            lower = np.abs(dx[0] - dq[0, i])
            for row, d in zip(dx[1:], dq[1:, i]):
                np.subtract(row, d, out=gap)
                np.abs(gap, out=gap)
                np.maximum(lower, gap, out=lower)
            reach = (float(q2[i]) + space.top) / 2 + slack - lower.astype(float) ** 2 / 2  # no candidate scores more
        else:
            reach = np.full(len(x), np.inf)
        left = np.flatnonzero(xid != qid[i])
        floor = -np.inf if floors is None else floors[i]
        left = left[reach[left] >= floor]
        rows, scores, size = np.empty(0, np.int64), np.empty(0, np.int64 if exact else object), step
        while len(left):
            if len(rows) >= k:
                left = left[reach[left] >= float(scores[-1])]
            if len(left) > size:
                cut = np.argpartition(reach[left], len(left) - size)
                part, left = left[cut[len(left) - size :]], left[cut[: len(left) - size]]
            else:
                part, left = left, left[:0]
            if not len(part):
                break
            evaluated += len(part)
            size *= 4
            new = np.rint(x[part] @ q[i]).astype(np.int64) if exact else x[part] @ q[i]
            good = new >= floor
            if exact and len(part) > 4 * k:  # ties with the k-th stay
                good &= new >= np.partition(new, len(new) - k)[len(new) - k]
            good = good.astype(bool)
            part, new = part[good], new[good]
            rows, scores = np.concatenate([rows, part]), np.concatenate([scores, new])
            best = np.lexsort((xid[rows], -scores))[:k] if exact else sorted(range(len(rows)), key=lambda j: (-scores[j], xid[rows[j]]))[:k]
            rows, scores = rows[best], scores[best]
        out.append((i, rows, scores))
    return out, evaluated


def pack_blocks(rows: DataFrame, blocks: int, salt: int, cast, k: int = 0) -> DataFrame:
    """``block``, ``ids``, ``data`` (matrix of doubles) and ``near`` (pivot table) of rows dealt evenly; of queries (k > 0) also ``floors``."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        space, sample_ids, sample = cast.value
        pdf = pdf.sort_values("vec_id", kind="stable")
        ids, v = pdf.vec_id.to_numpy(np.int64), np.stack(pdf.v.to_numpy()).astype("<f8")
        x = quantized(v)
        near = space.distances(x, bool(k)) if x.dtype != object else np.zeros((1, len(x)), np.float32)
        floors = np.full(len(ids), -np.inf)
        if k and x.dtype != object and sample.dtype != object:
            # the k-th score of real candidates, less what rounding may have added
            own = x @ sample.T
            own[ids[:, None] == sample_ids[None, :]] = -np.inf
            if own.shape[1] >= k:
                floors = np.partition(own, own.shape[1] - k, 1)[:, own.shape[1] - k]
                most = float(np.abs(x).max()) * float(np.abs(sample).max()) * x.shape[1]
                if most >= EXACT:
                    floors = floors - most * x.shape[1] * 1e-15
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "ids": [ids.tobytes()], "data": [v.tobytes()], "near": [near.tobytes()], "floors": [floors.tobytes()]})

    # dealt by row, not by id: one id may hold many rows
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(salt), F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(pack, "block int, ids binary, data binary, near binary, floors binary")


def _search(q: pd.DataFrame, x: pd.DataFrame, space: Space, k: int) -> pd.DataFrame:
    parts = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})]
    for c in x.itertuples():
        xid = np.frombuffer(c.ids, np.int64)
        xs, dx = quantized(np.frombuffer(c.data, "<f8").reshape(len(xid), -1)), np.frombuffer(c.near, np.float32).reshape(-1, len(xid))
        for r in q.itertuples():
            qid = np.frombuffer(r.ids, np.int64)
            qs, dq = quantized(np.frombuffer(r.data, "<f8").reshape(len(qid), -1)), np.frombuffer(r.near, np.float32).reshape(-1, len(qid))
            found, _ = search_block(qid, qs, dq, xid, xs, dx, space, k, np.frombuffer(r.floors, "<f8"))
            for i, rows, scores in found:
                parts.append(pd.DataFrame({"query_id": qid[i], "vec_id": xid[rows], "score": np.array([max(-LONG - 1, min(LONG, int(v))) for v in scores], np.int64)}))
    return pd.concat(parts)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` that satisfy ``is_query`` (over ``vec_id``)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = materialize(usable(vectors, vec_id, embedding), "vectors")
    queries = rows.where(is_query)
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + F.pow(F.abs(c) * SCALE + 1.0, 2.0))
    n, top = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    m = queries.count()
    q_blocks, x_blocks = max(1, -(-m // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    q_groups = -(-q_blocks // QUERY_GROUP)
    taken = rows.select("vec_id", "v", F.xxhash64(F.lit("pivot"), "vec_id", "v").alias("h")).orderBy("h", "vec_id").limit(SAMPLE).collect()
    sample = quantized(np.array([r.v for r in taken], float).reshape(len(taken), len(taken[0].v) if taken else 0))
    space = space_of(sample if sample.dtype != object else sample[:0], float(top or 0.0))
    cast = spark.sparkContext.broadcast((space, np.array([r.vec_id for r in taken], np.int64), sample))
    q = materialize(pack_blocks(queries, q_blocks, 1, cast, k), "queries")
    x = materialize(pack_blocks(rows, x_blocks, 2, cast), "candidates")
    # every group of query blocks meets every candidate block: an equi-join on their numbers
    q = q.withColumn("group", F.pmod("block", F.lit(q_groups))).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))))
    x = x.withColumn("at", F.col("block")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))))
    found = q.groupBy("at", "group").cogroup(x.groupBy("at", "group")).applyInPandas(lambda a, b: _search(a, b, cast.value[0], k), "query_id long, vec_id long, score long")
    # Spark keeps k rows of a query on each side of this exchange, since the rank is bounded
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
