"""Models and prepared statistics on storage: tagged JSON, Parquet tables, price panels."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import fields, is_dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.families import Copula
from ..operators.multivariate import CorrelationPolicy, FactorCorrelation
from ..operators.vine import Edge, Vine

FORMAT = "dependra-model/1"
#: The only classes that a file may name.
CLASSES = {c.__name__: c for c in (Copula, Edge, Vine, FactorCorrelation, CorrelationPolicy)}


def encode(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (np.integer, int)):
        return int(x)
    if isinstance(x, (np.floating, float)):
        x = float(x)
        return x if math.isfinite(x) else {"$float": "nan" if x != x else "inf" if x > 0 else "-inf"}
    if isinstance(x, np.ndarray):
        return {"$array": [encode(v) for v in x.ravel().tolist()], "shape": list(x.shape)}
    if is_dataclass(x) and type(x).__name__ in CLASSES:
        return {"$class": type(x).__name__, "state": {f.name: encode(getattr(x, f.name)) for f in fields(x)}}
    if isinstance(x, tuple):
        return {"$tuple": [encode(v) for v in x]}
    if isinstance(x, (set, frozenset)):
        return {"$set": [encode(v) for v in sorted(x)]}
    if isinstance(x, list):
        return [encode(v) for v in x]
    if isinstance(x, dict):
        return {"$dict": [[encode(k), encode(v)] for k, v in x.items()]}
    raise TypeError(f"cannot be stored: {type(x).__name__}")


def decode(x):
    if isinstance(x, list):
        return [decode(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "$float" in x:
        return float(x["$float"])
    if "$array" in x:
        return np.array([decode(v) for v in x["$array"]]).reshape(x["shape"])
    if "$tuple" in x:
        return tuple(decode(v) for v in x["$tuple"])
    if "$set" in x:
        return frozenset(decode(v) for v in x["$set"])
    if "$dict" in x:
        return {decode(k): decode(v) for k, v in x["$dict"]}
    if "$class" in x:
        if x["$class"] not in CLASSES:
            raise ValueError(f"the file names an unknown class {x['$class']!r}")
        return CLASSES[x["$class"]](**{k: decode(v) for k, v in x["state"].items()})
    raise ValueError(f"unknown tag in {sorted(x)}")


def dumps(model, data: dict | None = None) -> str:
    return json.dumps({"format": FORMAT, "class": type(model).__name__, "include_data": data is not None, "state": encode(model), "data": encode(data)})


def loads(text: str, expected: type | None = None):
    raw = json.loads(text)
    if raw.get("format") != FORMAT:
        raise ValueError(f"unknown format {raw.get('format')!r}")
    model = decode(raw["state"])
    if expected is not None and not isinstance(model, expected):
        raise TypeError(f"the file holds a {type(model).__name__}, not a {expected.__name__}")
    return model


def save(spark: SparkSession, model, path: str, data: dict | None = None) -> None:
    """One text row at any path that Spark writes."""
    spark.createDataFrame([(dumps(model, data),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, expected: type | None = None):
    return loads("".join(r.value for r in spark.read.text(path).collect()), expected)


def vine_table(spark: SparkSession, vine: Vine) -> DataFrame:
    """``tree, a, b, cond, family, rotation, r, tau, log_likelihood`` rows."""
    return spark.createDataFrame(vine.summary(), "tree int, a int, b int, cond array<int>, family string, rotation int, r double, tau double, log_likelihood double")


def vine_from_table(df: DataFrame, d: int) -> Vine:
    """The vine of a table of at most d (d - 1) / 2 rows."""
    return Vine(d, tuple(Edge(r.a, r.b, frozenset(r.cond), Copula(r.family, r.rotation), r.r, r.tau, r.log_likelihood) for r in df.orderBy("tree", "a", "b").collect()))


def write_statistics(stats: DataFrame, path: str) -> None:
    """Prepared sufficient statistics (t, sum_z, sum_z2) as a Parquet table."""
    missing = {"sum_z", "sum_z2"} - set(stats.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    stats.write.mode("overwrite").parquet(path)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def price_panel(spark: SparkSession, path: str, assets: Sequence[str], date: str = "Date", sep: str = ";") -> DataFrame:
    """``date`` and the log-returns of each asset from a delimited file of prices, rows with gaps left out."""
    schema = f"`{date}` date, " + ", ".join(f"`{a}` double" for a in assets)
    raw = spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=False).dropna(subset=list(assets))
    w = Window.partitionBy(F.lit(0)).orderBy(date)  # one panel: a row a day
    logs = raw.select(date, *[F.log(F.col(a) / F.lag(a).over(w)).alias(a) for a in assets])
    return logs.dropna(subset=list(assets))
