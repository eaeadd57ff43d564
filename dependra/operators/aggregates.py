"""Likelihoods, rank correlations and sufficient statistics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as s
from ..functions.backend import col
from ..functions.families import Copula


def log_pdf(copula: Copula, u: str, v: str, r) -> Column:
    return copula.log_pdf(col, F.col(u), F.col(v), r if isinstance(r, Column) else F.lit(float(r)))


def log_likelihood(df: DataFrame, copula: Copula, u: str, v: str, r, by: Sequence[str] = ()) -> DataFrame:
    """``log_likelihood, score, n`` in one pass: map-side sums, one exchange of a row for each group and task."""
    r = r if isinstance(r, Column) else F.lit(float(r))
    return df.groupBy(*by).agg(
        F.sum(copula.log_pdf(col, F.col(u), F.col(v), r)).alias("log_likelihood"),
        F.sum(copula.score(col, F.col(u), F.col(v), r)).alias("score"),
        F.count(F.lit(1)).alias("n"),
    )


def information_criteria(df: DataFrame, loglik: str = "log_likelihood", k: str | int = 1, n: str = "n") -> DataFrame:
    k = F.col(k) if isinstance(k, str) else F.lit(float(k))
    return df.withColumn("aic", 2.0 * k - 2.0 * F.col(loglik)).withColumn("bic", k * F.log(F.col(n).cast("double")) - 2.0 * F.col(loglik))


def discordances(y: np.ndarray) -> int:
    """Number of inversions; equal values are no inversion.

    Ranks are split bit by bit from the top: inside each group of equal higher bits, what has a one before a zero is
    counted, then zeros go before ones in their order. Groups fill places of their own, so no step sorts.
    """
    n = len(y)
    a = np.empty(n, np.int64)
    a[np.argsort(y, kind="stable")] = at = np.arange(n)
    total = 0
    for bit in range(max(0, n - 1).bit_length() - 1, -1, -1):
        first = a >> (bit + 1) << (bit + 1)  # of the group, whose ranks are its places
        one = (a >> bit & 1).astype(bool)
        ones = np.concatenate([[0], np.cumsum(one)])
        before = ones[:-1] - ones[first]
        total += int(before[~one].sum())
        out = np.empty_like(a)
        out[np.where(one, first + (1 << bit) + before, at - before)] = a
        a = out
    return total


def kendall_tau(x, y) -> float:
    """Kendall's tau; tau-b when either side has ties; 0 for a constant side, nan for fewer than two rows."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if n < 2:
        return float("nan")
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    pairs = n * (n - 1) // 2
    ties = lambda c: int((c.astype(np.int64) * (c - 1) // 2).sum())
    tx = ties(np.unique(x, return_counts=True)[1])
    ty = ties(np.unique(y, return_counts=True)[1])
    both = ties(np.unique(np.column_stack([x, y]), axis=0, return_counts=True)[1])
    if tx == pairs or ty == pairs:
        return 0.0
    concordant_less = pairs - tx - ty + both - 2 * discordances(y)
    return float(concordant_less / np.sqrt(float(pairs - tx)) / np.sqrt(float(pairs - ty)))


def kendall_tau_agg(x, y) -> Column:
    """Grouped aggregate: one task holds a group, so groups should be of bounded size; :func:`kendall_tau_blocks` is for longer ones."""

    @F.pandas_udf("double")
    def tau(a: pd.Series, b: pd.Series) -> float:
        live = a.notna() & b.notna()
        return kendall_tau(a[live].to_numpy(), b[live].to_numpy())

    return tau(x, y)


def tau_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``a, b, tau`` for every pair of columns i < j, in one pass of grouped aggregates."""
    pairs = list(combinations(columns, 2))
    wide = df.groupBy(*by).agg(*[kendall_tau_agg(a, b).alias(f"t{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"t{i}").alias("tau")) for i, (a, b) in enumerate(pairs)]))
    return wide.select(*by, rows.alias("x")).select(*by, "x.a", "x.b", "x.tau")


def kendall_tau_blocks(df: DataFrame, x: str, y: str, blocks: int = 16) -> DataFrame:
    """``tau`` of two columns of any length: discordant pairs inside and between blocks of x-ranks.

    Rows are dealt to blocks by quantiles of x; inside a block inversions are counted, and between two
    blocks a sorted merge of their y values counts pairs, so no task holds more than two blocks.
    """
    cuts = sorted(set(df.approxQuantile(x, [i / blocks for i in range(1, blocks)], 0.1 / blocks)))
    block = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(x))) if cuts else F.lit(0)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), block.cast("int").alias("b"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(len(cuts))))).select(
        "x", "y", "b", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j")
    )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        a, b = pdf[pdf.b == i], pdf[pdf.b == j]
        if i == j:
            order = np.lexsort((a.y, a.x))
            c = lambda v: int((np.unique(v, axis=0, return_counts=True)[1].astype(np.int64) * (np.unique(v, axis=0, return_counts=True)[1] - 1) // 2).sum())
            n = len(a)
            return pd.DataFrame({"pairs": [n * (n - 1) // 2], "tx": [c(a.x.to_numpy())], "ty": [c(a.y.to_numpy())], "both": [c(a[["x", "y"]].to_numpy())], "swaps": [discordances(a.y.to_numpy()[order])]})
        ys = np.sort(a.y.to_numpy())
        less, upto = np.searchsorted(ys, b.y, "left"), np.searchsorted(ys, b.y, "right")
        return pd.DataFrame({"pairs": [len(a) * len(b)], "tx": [0], "ty": [int((upto - less).sum())], "both": [0], "swaps": [int((len(ys) - upto).sum())]})

    sums = met.groupBy("i", "j").applyInPandas(count, "pairs long, tx long, ty long, both long, swaps long").agg(*[F.sum(c).alias(c) for c in ("pairs", "tx", "ty", "both", "swaps")])
    free = lambda t: F.sqrt((F.col("pairs") - F.col(t)).cast("double"))
    return sums.select(((F.col("pairs") - F.col("tx") - F.col("ty") + F.col("both") - 2 * F.col("swaps")) / free("tx") / free("ty")).alias("tau"))


TAU_ROWS = 1_000_000  #: columns of up to so many rows are one task's work
TAU_BLOCK = 200_000  #: rows of a block of longer ones


def _equal_pairs(*columns: np.ndarray) -> int:
    """Pairs of rows that are equal in all columns, whose equal rows stand together."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= np.diff(c) != 0
    c = np.diff(np.append(np.flatnonzero(new), len(new)))
    return int((c * (c - 1) // 2).sum())


def kendall_tau_long(df: DataFrame, x: str, y: str, blocks: int) -> float:
    """Exactly :func:`kendall_tau` of two columns of any length; a row takes part in two tasks."""
    return kendall_taus_long(df, [(x, y)], blocks)[0]


def kendall_taus_long(df: DataFrame, pairs: Sequence[tuple[str, str]], blocks: int) -> list[float]:
    """Exactly :func:`kendall_tau` of pairs of columns of any length; a row takes part in one task for each column.

    Rows fall into blocks of each column by values. Discordant pairs of one block of x are counted there, those of two
    blocks of x and one of y in that of y, and those of two blocks of both from the numbers of rows in the cells. Rows are
    dealt once for each column, whatever the number of pairs that it stands in.
    """
    columns = sorted({c for p in pairs for c in p})
    at = [(columns.index(x), columns.index(y)) for x, y in pairs]
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    cuts = [np.array(sorted(set(c))) for c in rows.approxQuantile(rows.columns, [i / blocks for i in range(1, blocks)], 0.1 / blocks)]

    def arrays(batch) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Values, and whether they are there."""
        batch = [batch.column(i) for i in range(len(cuts))]
        return [c.to_numpy(zero_copy_only=False) for c in batch], [c.is_valid().to_numpy(zero_copy_only=False) for c in batch]

    def cells(batches):
        held, size = [[] for _ in at], 0

        def told():
            for k, parts in enumerate(held):
                cell, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k)), pa.array(cell), pa.array(n)], ["pair", "cell", "n"])

        for b in batches:
            v, live = arrays(b)
            place = [np.searchsorted(c, x) for c, x in zip(cuts, v)]
            for k, (i, j) in enumerate(at):
                held[k].append((place[i] * (len(cuts[j]) + 1) + place[j])[live[i] & live[j]])
            size += b.num_rows
            if size >= 1 << 20:
                yield from told()
                held, size = [[] for _ in at], 0
        if size:
            yield from told()

    count = [np.zeros((len(cuts[i]) + 1, len(cuts[j]) + 1), object) for i, j in at]
    for r in rows.mapInArrow(cells, "pair long, cell long, n long").groupBy("pair", "cell").agg(F.sum("n").alias("n")).collect():
        count[r["pair"]][divmod(r["cell"], count[r["pair"]].shape[1])] = r["n"]

    def counted(i: int):
        def task(batches):
            """What the blocks of column i have: of pairs that it is x in, and of pairs that it is y in."""
            held = [arrays(b) for b in batches if b.num_rows]
            if not held:
                return
            v, live = ([np.concatenate([h[side][k] for h in held]) for k in range(len(cuts))] for side in (0, 1))
            held.clear()
            own = np.searchsorted(cuts[i], v[i])
            order = np.argsort(own, kind="stable")
            out = []
            for block in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                for k, (x, y) in enumerate(at):
                    if i not in (x, y):
                        continue
                    r = block[live[x][block] & live[y][block]]
                    b = v[y][r]
                    if i == x:
                        a = v[x][r]
                        by = np.lexsort((b, a))
                        a, b = a[by], b[by]
                        out.append((k, 0, discordances(b), _equal_pairs(a), _equal_pairs(a, b)))
                    else:
                        b = b[np.lexsort((b, np.searchsorted(cuts[x], v[x][r])))]
                        out.append((k, 1, discordances(b), _equal_pairs(np.sort(b)), 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, ["pair", "side", "swaps", "ties", "both"])

        return task

    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-blocks // 4))
    sums = np.zeros((len(pairs), 2, 3), object)
    for i, c in enumerate(cuts):
        place = F.pandas_udf(lambda v, c=c: pd.Series(np.searchsorted(c, v.to_numpy()).astype(np.int32)), "int")
        dealt = rows.where(F.col(f"c{i}").isNotNull()).withColumn("b", place(F.col(f"c{i}"))).repartition(tasks, "b").drop("b")
        got = dealt.mapInArrow(counted(i), "pair long, side long, swaps long, ties long, both long")
        for r in got.groupBy("pair", "side").agg(*[F.sum(F.col(k).cast("decimal(38,0)")).alias(k) for k in ("swaps", "ties", "both")]).collect():
            sums[r["pair"], r["side"]] += [int(r[k]) for k in ("swaps", "ties", "both")]
    out = []
    for cell, ((s1, tx, both), (s2, ty, _)) in zip(count, sums):
        # cells of later blocks and lower bins
        later = np.zeros_like(cell)
        later[:-1, 1:] = np.cumsum(np.cumsum(cell[::-1], 0)[::-1], 1)[1:, :-1]
        n = int(cell.sum())
        pair = n * (n - 1) // 2
        if n < 2:
            out.append(float("nan"))
        elif tx == pair or ty == pair:
            out.append(0.0)
        else:
            out.append(float((pair - tx - ty + both - 2 * (int((cell * later).sum()) + s1 + s2)) / np.sqrt(float(pair - tx)) / np.sqrt(float(pair - ty))))
    return out


def normal_scores(df: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    return df.withColumns({prefix + c: s.norm_ppf_refined(col, F.col(c)) for c in columns})


def normal_score_correlation(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``a, b, rho``: Pearson correlation of normal scores of pseudo-observations, one pass."""
    z = normal_scores(df, columns, "__z_")
    pairs = list(combinations(columns, 2))
    wide = z.groupBy(*by).agg(*[F.corr(f"__z_{a}", f"__z_{b}").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("rho")) for i, (a, b) in enumerate(pairs)]))
    return wide.select(*by, rows.alias("x")).select(*by, "x.a", "x.b", "x.rho")


def matrix_of(pairs: list, columns: Sequence[str], value: str, transform=lambda x: x) -> np.ndarray:
    """A symmetric matrix with unit diagonal from collected (a, b, value) rows; d x d, on the driver."""
    at = {c: i for i, c in enumerate(columns)}
    out = np.eye(len(columns))
    for p in pairs:
        v = p[value]
        v = 0.0 if v is None or not np.isfinite(v) else transform(v)
        out[at[p["a"]], at[p["b"]]] = out[at[p["b"]], at[p["a"]]] = v
    return out


def nearest_correlation(matrix: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """Eigenvalues clipped from below, diagonal scaled back to one."""
    m = (np.asarray(matrix, float) + np.asarray(matrix, float).T) / 2
    w, q = np.linalg.eigh(m)
    if w.min() < floor:
        m = (q * np.maximum(w, floor)) @ q.T
    d = np.sqrt(np.diag(m))
    m = m / np.outer(d, d)
    np.fill_diagonal(m, 1.0)
    return m


def shrink_correlation(matrix: np.ndarray, raw: float) -> np.ndarray:
    a = 1.0 / (1.0 + np.exp(-raw))
    return a * np.asarray(matrix, float) + (1 - a) * np.eye(len(matrix))


def pack_cholesky(matrix: np.ndarray) -> np.ndarray:
    """Below-diagonal entries of the row-scaled Cholesky factor, each row divided by its diagonal."""
    c = np.linalg.cholesky(nearest_correlation(matrix))
    c = c / np.diag(c)[:, None]
    return c[np.tril_indices(len(c), -1)]


def unpack_cholesky(raw: np.ndarray, d: int) -> np.ndarray:
    c = np.eye(d)
    c[np.tril_indices(d, -1)] = raw
    c = c / np.linalg.norm(c, axis=1, keepdims=True)
    m = c @ c.T
    np.fill_diagonal(m, 1.0)
    return m


def equicorr_statistics(df: DataFrame, array: str | None = None, columns: Sequence[str] = (), sum_z: str = "sum_z", sum_z2: str = "sum_z2") -> DataFrame:
    """Per row the sums of z and z^2 over normal scores, of an array column (any width) or of columns."""
    if array:
        # norm_ppf expands its argument many times, so it works on elements, not on the whole expression
        z = F.transform(F.col(array), lambda u: s.norm_ppf_refined(col, u))
        df = df.withColumn("__z", z)
        fold = lambda f: F.aggregate("__z", F.lit(0.0), lambda acc, x: acc + f(x))
        return df.withColumn(sum_z, fold(lambda x: x)).withColumn(sum_z2, fold(lambda x: x * x)).drop("__z")
    z = normal_scores(df, columns, "__z_")
    names = [F.col(f"__z_{c}") for c in columns]
    return z.withColumn(sum_z, sum(names[1:], names[0])).withColumn(sum_z2, sum((x * x for x in names[1:]), names[0] * names[0])).drop(*[f"__z_{c}" for c in columns])


def equicorr_statistics_long(df: DataFrame, row: str, u: str) -> DataFrame:
    """The same from long rows (row, variable, u): one exchange, sums before it."""
    z = df.withColumn("__z", s.norm_ppf_refined(col, F.col(u)))
    return z.groupBy(row).agg(F.sum("__z").alias("sum_z"), F.sum(F.col("__z") * F.col("__z")).alias("sum_z2"), F.count(F.lit(1)).alias("d"))


def log_mean_exp(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Stable log of the mean of exp(x) by group."""
    top = df.groupBy(*by).agg(F.max(x).alias("__top"))
    met = df.join(F.broadcast(top), list(by)) if by else df.crossJoin(F.broadcast(top))
    return met.groupBy(*by).agg((F.max("__top") + F.log(F.avg(F.exp(F.col(x) - F.col("__top"))))).alias("log_mean_exp"))


def ridge(df: DataFrame, y: str, xs: Sequence[str], penalty: float = 0.0) -> np.ndarray:
    """Intercept and slopes of ridge least squares; the sums of products are one aggregate, the solve is on the driver."""
    names = ["1", *xs]
    term = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    aggs = [F.sum(term(a) * term(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    row = df.agg(*aggs, *[F.sum(term(a) * F.col(y)).alias(f"y{i}") for i, a in enumerate(names)]).first()
    k = len(names)
    a = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    a[np.arange(1, k), np.arange(1, k)] += penalty
    return np.linalg.solve(a, np.array([row[f"y{i}"] for i in range(k)], float))
