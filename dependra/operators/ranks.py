"""Pseudo-observations: ordinal ranks over (n + 1), by group or over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

BUCKETS_PER_ROWS = 250_000  #: rows of a bucket of the global rank; several a task, so that tasks are even
MOST_BUCKETS = 10_000
GROUP_ROWS = 1_000_000  #: groups of at most so many rows are sorted whole, each in a task


def pseudo_observations(df: DataFrame, columns: Sequence[str], ties: Sequence[str], by: Sequence[str] = (), prefix: str = "u_") -> DataFrame:
    """``df`` with ``{prefix}{column}`` = ordinal rank / (n + 1).

    Ranks are ordinal, so ``ties`` should name a unique key: equal values are ordered by it. Nulls of a
    column get a null and do not count. With ``by`` every group is ranked on its own. No task sorts a large group:
    values fall into buckets between approximate quantiles of the whole table, ranks are taken in each bucket of
    a group and the sizes of the group's lower buckets are added. Only groups of up to ``GROUP_ROWS`` rows are
    sorted whole, if there are no larger ones.
    """
    columns, ties, by = list(columns), list(ties), list(by)
    n = df.count()
    if by and (n <= GROUP_ROWS or df.groupBy(*by).count().agg(F.max("count")).first()[0] <= GROUP_ROWS):
        for c in columns:
            df = _whole(df, c, ties, by, prefix)
        return df
    buckets = max(8, min(MOST_BUCKETS, -(-n // BUCKETS_PER_ROWS)))
    cuts = df.approxQuantile(columns, [i / buckets for i in range(1, buckets)], 0.25 / buckets) if n else [[]] * len(columns)
    # a value that fills several buckets is split by the first tie key, whose order continues the value's
    number = dict(df.dtypes)[ties[0]] in ("bigint", "int", "double", "float")
    second = sorted(set(df.approxQuantile(ties[0], [i / buckets for i in range(1, buckets)], 0.25 / buckets))) if n and number else []
    base = df
    for c, own in zip(columns, cuts):
        df = _bucketed(df, base, c, ties, by, prefix, sorted(set(own)), second)
    return df


def _whole(df: DataFrame, c: str, ties: list[str], by: list[str], prefix: str) -> DataFrame:
    live = F.col(c).isNotNull()
    order = Window.partitionBy(*by, live).orderBy(c, *ties)
    whole = Window.partitionBy(*by, live)
    rank = F.row_number().over(order) / (F.count(F.lit(1)).over(whole) + 1.0)
    return df.withColumn(prefix + c, F.when(live, rank))


def _bucketed(df: DataFrame, base: DataFrame, c: str, ties: list[str], by: list[str], prefix: str, cuts: list[float], second: list[float]) -> DataFrame:
    """``df`` with the rank of ``c``; buckets are counted in ``base``, which has the same rows before any column was ranked."""

    def tagged(f: DataFrame) -> DataFrame:
        many = F.col(c).isin(cuts)
        f = _bucket(_bucket(f, "__b1", c, cuts), "__b2", ties[0], second)
        # one number in the order of (bucket, whether the value is a cut, bucket of the tie key); null for nulls
        number = (F.col("__b1") * 2 + F.when(many, 1).otherwise(0)).cast("long") * (len(second) + 1) + F.when(many, F.col("__b2")).otherwise(0)
        # a struct, so that groups with a null key meet in the join; rows are exchanged once, by group and bucket
        return f.withColumn("__b", F.when(F.col(c).isNotNull(), number)).withColumn("__g", F.struct(*by) if by else F.struct(F.lit(0).alias("all"))).drop("__b1", "__b2")

    marked, counted = tagged(df), tagged(base)
    sizes = counted.where("__b is not null").groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__n"))
    # a small table: some rows a group and bucket
    group = Window.partitionBy("__g")
    before = sizes.select("__g", "__b", (F.sum("__n").over(group.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(group).alias("__all"))
    # buckets before groups, since numbers are compared first and faster
    ranked = marked.withColumn("__r", F.row_number().over(Window.partitionBy("__b", "__g").orderBy(c, *ties))).join(before, ["__b", "__g"], "left")
    return ranked.withColumn(prefix + c, F.when(F.col("__b").isNotNull(), (F.col("__r") + F.col("__before")) / (F.col("__all") + 1.0))).drop("__g", "__b", "__r", "__before", "__all")


def _bucket(df: DataFrame, out: str, c: str, cuts: list[float]) -> DataFrame:
    """``df`` with the number of cuts below a value, by bisection: equal values share a bucket with nothing that is not next to them.

    Each halving is a projection of its own, so it is compiled and no expression is repeated inside another.
    """
    df, x, bits = df.withColumn(out, F.lit(0)), F.col(c).cast("double"), len(cuts).bit_length()
    table = F.lit([*cuts, *[float("inf")] * ((1 << bits) - 1 - len(cuts))]) if cuts else None
    for k in reversed(range(bits)):
        df = df.withColumn(out, F.col(out) + F.when(F.element_at(table, F.col(out) + (1 << k)) < x, 1 << k).otherwise(0))
    return df


def assert_unit(df: DataFrame, columns: Sequence[str], allow_boundary: bool = False) -> DataFrame:
    """``df`` with a check that fails the query on a value that is null, not finite or outside (0, 1)."""
    for c in columns:
        inside = F.col(c).between(0.0, 1.0) if allow_boundary else (F.col(c) > 0.0) & (F.col(c) < 1.0)
        df = df.withColumn(c, F.when(F.coalesce(inside & ~F.isnan(c), F.lit(False)), F.col(c)).otherwise(F.raise_error(F.lit(f"{c}: not a pseudo-observation")).cast("double")))
    return df


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles; text, complex and nested types are refused before any job runs."""
    kinds = dict(df.dtypes)
    bad = [c for c in columns if c not in kinds or not any(kinds[c].startswith(k) for k in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal"))]
    if bad:
        raise ValueError(f"not numeric columns: {bad}")
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def check_dimension(columns: Sequence[str], least: int = 2, exactly: int | None = None) -> None:
    if len(set(columns)) != len(columns):
        raise ValueError("columns repeat")
    if exactly is not None and len(columns) != exactly or len(columns) < least:
        raise ValueError(f"{len(columns)} columns; needed: {exactly or f'at least {least}'}")
