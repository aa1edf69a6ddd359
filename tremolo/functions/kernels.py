"""Similarity kernels and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KERNELS = ("IES", "RBF", "EXP", "IMK", "CCK")


def similarity(d: Column, kernel: str = "IES", gamma: float = 0.5) -> Column:
    g = gamma * d
    if kernel == "IES":
        return 1 / (1 + g)
    if kernel == "RBF":
        return F.exp(-gamma * d * d)
    if kernel == "EXP":
        return F.exp(-g)
    if kernel == "IMK":
        return 1 / F.sqrt(1 + g * g)
    if kernel == "CCK":
        return 1 / (1 + g * g)
    raise ValueError(f"kernel {kernel!r}")


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def norm(v: Column, p: float = 2) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x * x if p == 2 else F.pow(F.abs(x), F.lit(float(p)))))
    return F.sqrt(total) if p == 2 else F.pow(total, F.lit(1.0 / p))


def minkowski(a: Column, b: Column, p: float = 2) -> Column:
    return norm(difference(a, b), p)


def mahalanobis(a: Column, b: Column, precision: list[list[float]]) -> Column:
    """sqrt((a - b)' P (a - b)) for a small matrix P."""
    d = difference(a, b)
    rows = F.array(*(F.aggregate(F.zip_with(d, F.array(*map(F.lit, row)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for row in precision))
    return F.sqrt(F.greatest(F.aggregate(F.zip_with(d, rows, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def gradient(v: Column, kernel: str = "IES", gamma: float = 0.5) -> Column:
    """Gradient of the similarity at the difference v, an array; zero for IES where v is zero."""
    d = norm(v)
    s = similarity(d, kernel, gamma)
    factor = {"IES": F.when(d > 2.220446049250313e-16, s / d).otherwise(0.0), "RBF": F.lit(2.0), "EXP": F.try_divide(F.lit(1.0), d), "IMK": 2 * gamma * s, "CCK": 2 * gamma * s}[kernel]
    return F.transform(v, lambda x: -gamma * x * s * factor)


def l2_normalise(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def db_to_linear(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10)


def linear_to_db(x: Column) -> Column:
    return F.when(x > 0, 10 * F.log10(x))


def log_odds(p: Column) -> Column:
    return F.ln(p) - F.ln(1 - p)
