"""The thirteen-feature bank of a signal as aggregate expressions, and its entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_bank(x: str | Column) -> dict[str, Column]:
    """Aggregates of one pass: RMS, SRA, kurtosis and so on; a ratio by zero is null."""
    x = F.col(x) if isinstance(x, str) else x
    rms, sra = F.sqrt(F.avg(x * x)), F.pow(F.avg(F.sqrt(F.abs(x))), F.lit(2.0))
    peak, mean_abs = F.max(F.abs(x)), F.avg(F.abs(x))
    return {
        "RMS": rms,
        "SRA": sra,
        "Krt": F.kurtosis(x),
        "Skw": F.skewness(x),
        "PPK": F.max(x) - F.min(x),
        "CF": F.try_divide(peak, rms),
        "ImF": F.try_divide(peak, mean_abs),
        "MrF": F.try_divide(peak, sra),
        "ShF": F.try_divide(rms, mean_abs),
        "KrF": F.try_divide(F.kurtosis(x), rms),
        "Mu": F.avg(x),
        "SD": F.stddev_pop(x),
    }


def rounded(cols: dict[str, Column], digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(k) for k, c in cols.items()]


def entropy(samples: DataFrame, by: list[str], x: str = "x", width: float = 0.2) -> DataFrame:
    """(by, Ent): entropy of a histogram with bins of the given width from the minimum on.

    The edges stop short of the maximum, so samples beyond the last edge drop out; the last bin is
    closed on the right. Fewer than two edges give 0. Two aggregations on the same keys: the bins of a
    group are counted before they meet.
    """
    ends = samples.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    edges = F.ceil((F.col("_hi") - F.col("_lo")) / width)
    at = (F.col(x) - F.col("_lo")) / width
    rows = samples.join(ends, by).withColumn("_edges", edges).withColumn("_b", F.when(at == F.col("_edges") - 1, F.col("_edges") - 2).otherwise(F.floor(at)))
    counts = rows.where((F.col("_edges") >= 2) & (F.col("_b") < F.col("_edges") - 1)).groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # -sum(p ln p) = ln N - sum(n ln n) / N
    ent = counts.groupBy(*by).agg((F.ln(F.sum("_n")) - F.sum(F.col("_n") * F.ln(F.col("_n"))) / F.sum("_n")).alias("Ent"))
    return ends.select(*by).join(ent, by, "left").withColumn("Ent", F.coalesce("Ent", F.lit(0.0)))


def kde_entropy(samples: DataFrame, by: list[str], x: str = "x", n_grid: int = 32, bandwidth: float = 0.2) -> DataFrame:
    """(by, Ent): entropy of a Gaussian kernel density on a grid of n_grid points from minimum to maximum."""
    ends = samples.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    grid = samples.join(ends, by).select(*by, x, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("_g"))
    point = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_g") / (n_grid - 1)
    d = (F.col(x) - point) / bandwidth
    dens = grid.groupBy(*by, "_g").agg(F.avg(F.exp(-d * d / 2)).alias("_d"))
    total = F.sum("_d")
    return dens.groupBy(*by).agg((F.ln(total) - F.sum(F.when(F.col("_d") > 0, F.col("_d") * F.ln("_d")).otherwise(0.0)) / total).alias("Ent"))
