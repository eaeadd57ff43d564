"""Two evaluators for one set of formulas: Catalyst expressions and NumPy arrays.

A formula takes the evaluator ``m`` and values that support the arithmetic operators; ``col`` builds Spark
``Column`` expressions, which stay in code generation, and ``num`` computes arrays inside grouped functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


class Columns:
    """Evaluator that builds ``Column`` expressions."""

    log, exp, log1p, expm1 = staticmethod(F.log), staticmethod(F.exp), staticmethod(F.log1p), staticmethod(F.expm1)
    sqrt, tanh, abs = staticmethod(F.sqrt), staticmethod(F.tanh), staticmethod(F.abs)
    sin, asin, atanh = staticmethod(F.sin), staticmethod(F.asin), staticmethod(F.atanh)

    @staticmethod
    def of(x) -> Column:
        return x if isinstance(x, Column) else F.lit(float(x))

    @classmethod
    def where(cls, test, a, b) -> Column:
        return F.when(test, cls.of(a)).otherwise(cls.of(b))

    @classmethod
    def least(cls, a, b) -> Column:
        return F.least(cls.of(a), cls.of(b))

    @classmethod
    def greatest(cls, a, b) -> Column:
        return F.greatest(cls.of(a), cls.of(b))

    @staticmethod
    def let(x: Column, f) -> Column:
        """``f`` of a value that it uses many times: bound once, so the expression stays small."""
        return F.transform(F.array(x), f)[0]

    @classmethod
    def bisect(cls, f, lo, hi, steps: int) -> Column:
        """The root of an increasing ``f`` between ``lo`` and ``hi`` by halving, as one higher-order expression."""

        def halve(s, _):
            mid = (s["lo"] + s["hi"]) / 2
            low = f(mid) < 0
            return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

        start = F.struct(cls.of(lo).alias("lo"), cls.of(hi).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)


class Numbers:
    """Evaluator over NumPy arrays and floats."""

    log, exp, log1p, expm1 = staticmethod(np.log), staticmethod(np.exp), staticmethod(np.log1p), staticmethod(np.expm1)
    sqrt, tanh, abs = staticmethod(np.sqrt), staticmethod(np.tanh), staticmethod(np.abs)
    sin, asin, atanh = staticmethod(np.sin), staticmethod(np.arcsin), staticmethod(np.arctanh)
    where, least, greatest = staticmethod(np.where), staticmethod(np.minimum), staticmethod(np.maximum)

    @staticmethod
    def of(x):
        return x

    @staticmethod
    def let(x, f):
        return f(x)

    @staticmethod
    def bisect(f, lo, hi, steps: int):
        lo, hi = np.broadcast_arrays(np.asarray(lo, float), np.asarray(hi, float))
        for _ in range(steps):
            mid = (lo + hi) / 2
            low = f(mid) < 0
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        return (lo + hi) / 2


col, num = Columns(), Numbers()
