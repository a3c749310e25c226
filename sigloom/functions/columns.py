"""Column expressions: array arithmetic, windows, scalar functions of the signal library."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from sigloom.functions.spectrum import WINDOW_TERMS


def total(x) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a, b) -> Column:
    """Inner product over the common prefix."""
    return total(F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x * y))


def norm_sq(a) -> Column:
    return total(F.transform(a, lambda x: x * x))


def distance_sq(a, b) -> Column:
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y)))


def euclidean(a, b) -> Column:
    return F.sqrt(distance_sq(a, b))


def ncc(a, b) -> Column:
    """Cosine of two waveforms, 0 where one has no energy."""
    norm = F.sqrt(norm_sq(a) * norm_sq(b))
    return F.when(norm > 1e-30, dot(a, b) / norm).otherwise(0.0)


def window_coefficient(kind: str, index: Column, length: int | Column) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    at = 2 * math.pi * index / (n - 1)
    w = F.lit(0.0)
    for k, a in enumerate(WINDOW_TERMS[kind]):
        w = w + F.lit((-1) ** k * a) * (F.cos(at * k) if k else F.lit(1.0))
    return F.when(n <= 1, 1.0).otherwise(F.greatest(w, F.lit(0.0)))


def apply_window(x, kind: str) -> Column:
    n = F.size(x)
    return F.transform(x, lambda v, i: v * window_coefficient(kind, i, n))


def matvec(rows: list[list[float]], x) -> Column:
    """A constant matrix times an array column."""
    return F.array(*(sum((F.element_at(x, k + 1) * float(w) for k, w in enumerate(row)), F.lit(0.0)) for row in rows))


def soft_threshold(x: Column, limit: Column | float) -> Column:
    lam = F.lit(limit) if isinstance(limit, (int, float)) else limit
    return F.when(lam <= 0, x).otherwise(F.signum(x) * F.greatest(F.abs(x) - lam, F.lit(0.0)))


def hard_threshold(x: Column, limit: Column | float) -> Column:
    lam = F.lit(limit) if isinstance(limit, (int, float)) else limit
    return F.when((lam <= 0) | (F.abs(x) >= lam), x).otherwise(0.0)


def universal_threshold(sigma: Column, n: Column) -> Column:
    return F.when(n <= 1, 0.0).otherwise(sigma * F.sqrt(2 * F.ln(n)))


def log_of(x: Column, base: str = "e") -> Column:
    """Logarithm that is -infinity at 0, as IEEE arithmetic has it (Spark's is null)."""
    f = {"e": F.ln, "2": F.log2, "10": F.log10}[base]
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(f(x))


def round_away(x: Column) -> Column:
    """Half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def copysign(x: Column, y: Column) -> Column:
    """Of -0.0, whose sign no comparison sees, the text tells; nothing is divided by it."""
    return F.when((y < 0) | ((y == 0) & F.startswith(y.cast("double").cast("string"), F.lit("-"))), -F.abs(x)).otherwise(F.abs(x))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _libm(f: Callable[..., float], outside: Callable[..., float]) -> Callable[..., Column]:
    """A function of the C library over columns of doubles, which SQL engines share to the last bit (Java's differ there and so, rarely,
    in a rounded sum). ``outside`` gives what IEEE arithmetic has where Python raises."""

    def one(*v: float) -> float:
        try:
            return f(*v)
        except (ValueError, OverflowError):
            return outside(*v)

    @pandas_udf(DoubleType())
    def of_one(x: pd.Series) -> pd.Series:
        return pd.Series([one(v) for v in x.tolist()], dtype=float)

    @pandas_udf(DoubleType())
    def of_two(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(*v) for v in zip(x.tolist(), y.tolist())], dtype=float)

    def column(*c: Column) -> Column:
        there = reduce(Column.__and__, [x.isNotNull() for x in c])
        made = (of_two if len(c) == 2 else of_one)(*(F.coalesce(x.cast("double"), F.lit(0.0)) for x in c))
        return F.when(there, F.coalesce(made, F.lit(math.nan)))  # pandas gives NaN back as null

    return column


_LOGARITHM = lambda x: -math.inf if x == 0 else math.nan
_LARGE = lambda *v: math.inf

#: Elementary functions by name, one argument (two for atan2 and pow).
ELEMENTARY = {
    "sqrt": F.sqrt, "abs": F.abs, "exp": _libm(math.exp, _LARGE), "log": _libm(math.log, _LOGARITHM), "log2": _libm(math.log2, _LOGARITHM), "log10": _libm(math.log10, _LOGARITHM),
    "sin": _libm(math.sin, lambda x: math.nan), "cos": _libm(math.cos, lambda x: math.nan), "tan": _libm(math.tan, lambda x: math.nan), "atan": _libm(math.atan, _LARGE), "atan2": _libm(math.atan2, _LARGE),
    "tanh": _libm(math.tanh, _LARGE), "sinh": _libm(math.sinh, lambda x: math.copysign(math.inf, x)), "pow": _libm(math.pow, lambda x, y: float(np.power(x, y))),
    "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "round": round_away, "copysign": copysign, "is_finite": is_finite,
}


def silhouette_of(intra, inter) -> Column:
    """(b - a) / max(a, b): mean of the distances inside against the least of the mean distances to other clusters; null without either."""
    a, b = total(intra) / F.size(intra), F.array_min(inter)
    most = F.greatest(a, b)
    return F.when((F.size(intra) > 0) & (F.size(inter) > 0), F.when(most > 0, (b - a) / most).otherwise(0.0))


def bin_frequencies(size: int, fs: float) -> Column:
    """Frequencies of a one-sided spectrum as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(size // 2)), lambda k: k * (fs / size))
