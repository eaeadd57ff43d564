"""Trailing-window risk measures and simple time-series expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _order(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def rolling(df: DataFrame, x: str, width: int, by: Sequence[str], order: Sequence[str], gamma: float = 0.05, prefix: str = "") -> DataFrame:
    """``var, cvar, mean, std, median, mad`` over the last ``width`` rows; 0 for the first ``width - 1`` rows of a group.

    VaR is the interpolated gamma-quantile of the window, CVaR the mean of its values up to VaR (lower tail).
    One window partitioning serves all columns.
    """
    at = _order(by, order)
    frame = at.rowsBetween(-(width - 1), 0)
    full = F.row_number().over(at) >= width
    values = F.collect_list(x).over(frame)
    got = df.withColumn("__v", F.percentile(x, F.lit(gamma)).over(frame)).withColumn("__w", values).withColumn("__full", full)
    got = got.withColumn("__median", F.percentile(x, F.lit(0.5)).over(frame)).withColumn("__mean", F.avg(x).over(frame)).withColumn("__std", F.stddev_pop(x).over(frame))
    low = F.filter("__w", lambda e: e <= F.col("__v"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, e: acc + e) / F.size(a)
    keep = lambda c: F.when(F.col("__full"), c).otherwise(0.0)
    out = {
        "var": F.col("__v"), "cvar": mean(low), "mean": F.col("__mean"), "std": F.col("__std"),
        "median": F.col("__median"), "mad": mean(F.transform("__w", lambda e: F.abs(e - F.col("__median")))),
    }
    return got.withColumns({prefix + k: keep(v) for k, v in out.items()}).drop("__v", "__w", "__full", "__median", "__mean", "__std")


def log_return(price: str, by: Sequence[str], order: Sequence[str]) -> Column:
    return F.log(F.col(price) / F.lag(price, 1).over(_order(by, order)))


def ar1_fit(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``const, slope, n`` of x on its lag by group; the slope is clipped to +-0.99."""
    lagged = df.withColumn("__lag", F.lag(x, 1).over(_order(by, order)))
    fit = lagged.where("__lag is not null").groupBy(*by).agg(
        F.regr_slope(x, "__lag").alias("__slope"), F.avg(x).alias("__my"), F.avg("__lag").alias("__mx"), F.count(F.lit(1)).alias("n")
    )
    slope = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.coalesce("__slope", F.lit(0.0))))
    return fit.withColumn("slope", slope).select(*by, (F.col("__my") - F.col("slope") * F.col("__mx")).alias("const"), "slope", "n")


def ar1_residuals(df: DataFrame, fit: DataFrame, x: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """x_t - c - a x_(t-1); the first residual is its distance from the group's mean."""
    at = _order(by, order)
    mean = F.avg(x).over(Window.partitionBy(*by))
    rows = df.withColumn("__lag", F.lag(x, 1).over(at)).withColumn("__mean", mean).join(fit.select(*by, "const", "slope"), list(by))
    return rows.withColumn("residual", F.when(F.col("__lag").isNull(), F.col(x) - F.col("__mean")).otherwise(F.col(x) - F.col("const") - F.col("slope") * F.col("__lag"))).drop("__lag", "__mean")


def expand_windows(df: DataFrame, width: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each row once for every full trailing window that holds it: ``window`` is the row number of the window's end.

    For per-window refits; a row is repeated ``width`` times, so keep the width bounded.
    """
    n = F.row_number().over(_order(by, order))
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = df.withColumn("__n", n).withColumn("__total", total)
    first, last = F.greatest(F.col("__n"), F.lit(width)), F.least(F.col("__n") + width - 1, F.col("__total"))
    return rows.where(last >= first).withColumn("window", F.explode(F.sequence(first, last))).drop("__n", "__total")


def rolling_pobs(df: DataFrame, columns: Sequence[str], width: int, by: Sequence[str], order: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Pseudo-observations inside every trailing window."""
    from .ranks import pseudo_observations

    return pseudo_observations(expand_windows(df, width, by, order), columns, ties, [*by, "window"])
