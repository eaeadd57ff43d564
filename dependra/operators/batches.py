"""Many series in one task: series are dealt to tasks by key, read in order, and handed over some hundreds at a time.

A fit of one short series is mostly the interpreter's own time. Here series stand side by side as the rows of padded
arrays, and optimisers advance all of them together, each by the steps it would take alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .optimize import Optimum

ROWS = 131_072  #: rows that are handed over together, or one longer series
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "map<string,double>": pa.map_(pa.string(), pa.float64())}


def _starts(keys: list[pa.Array]) -> np.ndarray:
    """Rows at which another series begins."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        null = k.is_null().to_numpy(zero_copy_only=False)
        v = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if not pa.types.is_floating(k.type) else k.fill_null(0).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):
            same = (v[1:] == v[:-1]) | ((v[1:] != v[1:]) & (v[:-1] != v[:-1]))
        new[1:] |= ~same | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def _keys(keys: list[pa.Array], at: np.ndarray) -> list[tuple]:
    """Values of the keys as a frame of the series alone would hold them."""
    columns = []
    for k in keys:
        k = k.take(pa.array(at))
        if pa.types.is_integer(k.type) or pa.types.is_floating(k.type):
            null, v = k.is_null().to_numpy(zero_copy_only=False), k.fill_null(0).to_numpy(zero_copy_only=False)
            columns.append([np.float64("nan") if b else x for b, x in zip(null, v)])
        else:
            columns.append(list(k.to_pandas()))
    return list(zip(*columns))


def map_series(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str], schema: str, run: Callable, rows: int = ROWS) -> DataFrame:
    """``by`` and ``schema`` (names and types), any number of rows a series.

    ``run(keys, series)`` takes the keys and the rows x columns of some series and returns each one's result rows. No
    result may depend on which series come together.
    """
    by, columns = list(by), list(columns)
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(", ")]
    own = [f for f in df.schema if f.name in by]
    by = [f.name for f in own]
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)] + [F.col(k).alias(f"__o{i}") for i, k in enumerate(order)] + [F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)]
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ks, cs = [f"__k{i}" for i in range(len(by))], [f"__c{i}" for i in range(len(columns))]
    ready = df.select(*named).repartition(tasks, *ks).sortWithinPartitions(*ks, *[F.asc_nulls_last(f"__o{i}") for i in range(len(order))]).select(*ks, *cs)

    def handed(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(k).combine_chunks() for k in ks]
        keys = [k.chunk(0) if isinstance(k, pa.ChunkedArray) else k for k in keys]
        at = _starts(keys)
        data = np.column_stack([table.column(c).to_numpy() for c in cs])
        got = run(_keys(keys, at), np.split(data, at[1:]))
        which = np.repeat(at, [len(g) for g in got])
        flat = [r for g in got for r in g]
        arrays = [k.take(pa.array(which)) for k in keys] + [pa.array([r[i] for r in flat], _TYPES[kind]) for i, (_, kind) in enumerate(fields)]
        return pa.RecordBatch.from_arrays(arrays, [*by, *[name for name, _ in fields]])

    def task(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < rows:
                continue
            table = pa.Table.from_batches(held)
            keys = [table.column(k).combine_chunks() for k in ks]
            last = int(_starts([k.chunk(0) if isinstance(k, pa.ChunkedArray) else k for k in keys])[-1])
            for part in pieces(table.slice(0, last)) if last else ():
                yield handed(part)
            held = table.slice(last).to_batches()
            size = 0 if last else size  # a series as long as this is looked at again after as many rows more
        if held and sum(b.num_rows for b in held):
            for part in pieces(pa.Table.from_batches(held)):
                yield handed(part)

    def pieces(table: pa.Table):
        """Whole series of some ``rows`` together."""
        keys = [table.column(k).combine_chunks() for k in ks]
        at = _starts([k.chunk(0) if isinstance(k, pa.ChunkedArray) else k for k in keys])
        begin = 0
        for end in [*at[1:], table.num_rows]:
            if end - begin >= rows or end == table.num_rows:
                yield table.slice(begin, end - begin)
                begin = end

    return ready.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", " + schema)


def alike(lengths: Sequence[int], most: int = 524_288) -> list[np.ndarray]:
    """Series of similar length together: padding adds at most half, and a padded array has at most ``most`` places, or one row."""
    order = np.argsort(lengths, kind="stable")
    out, begin = [], 0
    for k in range(1, len(order) + 1):
        if k == len(order) or lengths[order[k]] > 1.5 * max(lengths[order[begin]], 4) or (k + 1 - begin) * lengths[order[k]] > most:
            out.append(order[begin:k])
            begin = k
    return out


def padded(arrays: Sequence[np.ndarray], fill: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Series x places, and which places are real."""
    n = np.array([len(a) for a in arrays])
    real = np.arange(n.max(initial=0)) < n[:, None]
    out = np.full(real.shape, fill)
    out[real] = np.concatenate(arrays) if len(arrays) else []
    return out, real


def golden_many(f: Callable, lo: np.ndarray, hi: np.ndarray, tol: float = 1e-9, most: int = 200) -> list[Optimum]:
    """:func:`optimize.golden` of many functions: ``f(i, x)`` are the values of functions i at x."""
    ratio = (np.sqrt(5) - 1) / 2
    a, b = np.array(lo, float), np.array(hi, float)
    every = np.arange(len(a))
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(every, c), f(every, d)
    n = np.full(len(a), 2)
    while len(i := np.flatnonzero((np.abs(b - a) > tol * (1 + np.abs(a) + np.abs(b))) & (n < most))):
        left = fc[i] < fd[i]
        l, r = i[left], i[~left]
        b[l], d[l], fd[l] = d[l], c[l], fc[l]
        c[l] = b[l] - ratio * (b[l] - a[l])
        a[r], c[r], fc[r] = c[r], d[r], fd[r]
        d[r] = a[r] + ratio * (b[r] - a[r])
        v = f(i, np.where(left, c[i], d[i]))
        fc[l], fd[r] = v[left], v[~left]
        n[i] += 1
    x = (a + b) / 2
    v = f(every, x)
    return [Optimum(np.array([p]), float(q), bool(k < most), int(k) + 1, "converged" if k < most else "too many evaluations") for p, q, k in zip(x, v, n)]


def bfgs_many(f: Callable, x0, lo, hi, tol: float = 1e-5, most: int = 200) -> list[Optimum]:
    """:func:`optimize.projected_bfgs` of many functions: ``f(i, X)`` are the values of functions i at the rows of X."""
    lo, hi = np.asarray(lo, float), np.asarray(hi, float)
    x = np.clip(np.asarray(x0, float), lo, hi)
    m, p = x.shape
    count, out = np.zeros(m, int), [None] * m

    k = np.arange(p)
    fx, fy, g, y = np.empty(m), np.empty(m), np.empty((m, p)), x.copy()
    way, step, inverse = np.zeros((m, p)), np.zeros(m), np.tile(np.eye(p), (m, 1, 1))
    tries, steps = np.zeros(m, int), np.zeros(m, int)
    searching, sloping = np.zeros(m, bool), np.ones(m, bool)

    def sides(y):
        h = 1e-5 * (1 + np.abs(y))
        both = np.repeat(y[:, None, None], 2, 1).repeat(p, 2)
        both[:, 0, k, k], both[:, 1, k, k] = np.minimum(y + h, hi), np.maximum(y - h, lo)
        return both

    def values(i, q):
        np.add.at(count, i, 1)
        v = f(i, q)
        return np.where(np.isfinite(v), v, 1e10)

    def end(i, at, val, ok, message):
        searching[i] = sloping[i] = False
        for j, q, v in zip(i, at, val):
            out[j] = Optimum(q.copy(), float(v), ok, int(count[j]), message)

    def begin(i):
        """Stop at x, or set out from it."""
        tired = steps[i] >= most
        end(i[tired], x[i[tired]], fx[i[tired]], False, "too many iterations")
        i = i[~tired]
        free = ~(((x[i] <= lo + 1e-12) & (g[i] > 0)) | ((x[i] >= hi - 1e-12) & (g[i] < 0)))
        small = np.where(free, np.abs(g[i]), 0.0).max(1, initial=0.0) < tol * (1 + np.abs(fx[i]))
        small |= ~free.any(1)
        end(i[small], x[i[small]], fx[i[small]], True, "projected gradient is small")
        i, free = i[~small], free[~small]
        held = np.where(free, g[i], 0.0)
        to = -np.where(free, (inverse[i] @ held[:, :, None])[:, :, 0], 0.0)
        back = (to * g[i]).sum(1) >= 0
        inverse[i[back]] = np.eye(p)
        to[back] = -held[back]
        way[i], step[i], tries[i] = to, np.minimum(1.0, 2.0 / (np.abs(to).max(1, initial=0.0) + 1e-12)), 0
        searching[i], sloping[i] = True, False

    fx[:] = values(np.arange(m), x)
    first = True
    # each function goes on at its own pace: a round evaluates the trial of some and the slopes of others
    while (searching | sloping).any():
        i, j = np.flatnonzero(searching), np.flatnonzero(sloping)
        trial, both = np.clip(x[i] + step[i, None] * way[i], lo, hi), sides(y[j])
        v = values(np.concatenate([i, np.repeat(j, 2 * p)]), np.concatenate([trial, both.reshape(-1, p)]))
        v, slope = v[: len(i)], v[len(i) :].reshape(-1, 2, p)
        slope = (slope[:, 0] - slope[:, 1]) / (both[:, 0, k, k] - both[:, 1, k, k])
        ok = v <= fx[i] + 1e-4 * (g[i] * (trial - x[i])).sum(1)
        y[i[ok]], fy[i[ok]] = trial[ok], v[ok]
        searching[i[ok]], sloping[i[ok]] = False, True
        no = i[~ok]
        step[no] /= 2
        tries[no] += 1
        lost = no[tries[no] >= 30]
        end(lost, x[lost], fx[lost], True, "no lower value along the search direction")
        if first:
            g[:], first = slope, False
            begin(j)
            continue
        s, d = y[j] - x[j], slope - g[j]
        bend = (s * d).sum(1)
        c = bend > 1e-12
        rho = 1.0 / np.where(c, bend, 1.0)
        e = np.eye(p) - rho[:, None, None] * s[:, :, None] * d[:, None, :]
        new = e @ inverse[j] @ e.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
        inverse[j] = np.where(c[:, None, None], new, inverse[j])
        settled = np.abs(fx[j] - fy[j]) < 1e-10 * (1 + np.abs(fx[j]))
        x[j], fx[j], g[j] = y[j], fy[j], slope
        steps[j] += 1
        end(j[settled], x[j[settled]], fx[j[settled]], True, "the value has settled")
        begin(j[~settled])
    return out
