"""One set of formulas for two engines: Spark columns and NumPy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Columns:
    """Formulas over columns; what repeats is for the optimiser to share."""

    sin, cos, tan, asin, atan, sinh, cosh, tanh = F.sin, F.cos, F.tan, F.asin, F.atan, F.sinh, F.cosh, F.tanh
    asinh, atanh, sqrt, exp, log, abs, floor = F.asinh, F.atanh, F.sqrt, F.exp, F.log, F.abs, F.floor
    atan2 = staticmethod(F.atan2)

    @staticmethod
    def where(test, a, b):
        return F.when(test, a).otherwise(b)

    @staticmethod
    def radians(x):
        return x * (np.pi / 180)

    @staticmethod
    def degrees(x):
        return x * (180 / np.pi)

    @staticmethod
    def clip(x, lo, hi):
        return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


class _Arrays:
    sin, cos, tan, asin, atan, sinh, cosh, tanh = np.sin, np.cos, np.tan, np.arcsin, np.arctan, np.sinh, np.cosh, np.tanh
    asinh, atanh, sqrt, exp, log, abs, floor = np.arcsinh, np.arctanh, np.sqrt, np.exp, np.log, np.abs, np.floor
    atan2, where, radians, degrees, clip = np.arctan2, np.where, np.radians, np.degrees, np.clip


def engine(x) -> type:
    """The functions that suit a value."""
    return _Columns if isinstance(x, Column) else _Arrays
