"""Sequential decisions over ordered samples: probability ratio test and filter choice."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def sprt_labels(odds: np.ndarray, low: float, high: float) -> np.ndarray:
    """Label of each sample: its running sum starts again from the sample that decided."""
    out, total = np.zeros(len(odds), np.int32), 0.0
    for i, x in enumerate(odds.tolist()):
        total += x
        if total > high:
            out[i], total = 1, x
        elif total < low:
            out[i], total = -1, x
    return out


def sprt(s: DataFrame, p: str, alpha: float = 0.1, beta: float = 0.1) -> DataFrame:
    """(rec, i, label): the sums of log odds decide at +1 or -1 and start again from the sample that decided.

    One pass over each recording's samples, an Arrow array a recording; label 0 where nothing is decided.
    """
    low, high = math.log(beta / (1 - alpha)), math.log((1 - beta) / alpha)

    @pandas_udf("array<int>")
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([sprt_labels(np.asarray(x, float), low, high) for x in xs], xs.index, object)

    odds = F.ln(F.col(p)) - F.ln(1 - F.col(p))
    got = s.withColumn("_l", odds).groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("i", F.col("_l").alias("l")))).alias("s"))
    rows = got.select("rec", F.transform("s", lambda v: v["i"]).alias("at"), run(F.transform("s", lambda v: v["l"])).alias("label"))
    return rows.select("rec", F.explode(F.arrays_zip(F.col("at").alias("i"), "label")).alias("r")).select("rec", "r.i", "r.label")


def propagate(s: DataFrame) -> DataFrame:
    """An undecided label becomes the last decision before it, a decision becomes the next one."""
    w = Window.partitionBy("rec").orderBy("i")
    made = F.when(F.col("label") != 0, F.col("label"))
    before, after = F.last(made, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(made, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return s.withColumn("label", F.when(F.col("label") == 0, F.coalesce(before, F.lit(0))).otherwise(F.coalesce(after, F.col("label"))))


def filtered(x: np.ndarray, size: int) -> np.ndarray:
    """As windows.median_filter, on one array."""
    half = size // 2
    front, behind = x[:half][::-1], x[size:][::-1][:half]
    ext = np.concatenate([front, x, behind, np.zeros(max(0, half - len(behind)))])
    windows = np.lib.stride_tricks.sliding_window_view(ext, size)[: len(x)]
    step = max(1, (1 << 22) // size)
    return np.concatenate([np.median(windows[i : i + step], 1) for i in range(0, len(windows), step)])


def fit_median_size(s: DataFrame, largest: int = 1443, threshold: float = 0.5) -> DataFrame:
    """(rec, size, accuracy): the odd filter size, 1 for none, whose filtered score tells label best.

    Sizes end below the number of samples less one; the smallest of equally good ones wins, as does no filter.
    """

    @pandas_udf("struct<size: int, accuracy: double>")
    def run(xs: pd.Series, labels: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(xs, labels, strict=True):
            x, y = np.asarray(x, float), np.asarray(y)
            best = 1, float(((x > threshold) == y).mean())
            for size in range(3, min(largest + 1, len(x) - 1), 2):
                acc = float(((filtered(x, size) > threshold) == y).mean())
                if acc > best[1]:
                    best = size, acc
            out.append(best)
        return pd.DataFrame(out, xs.index, ["size", "accuracy"])

    got = s.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("i", "score", "label"))).alias("s"))
    best = got.select("rec", run(F.transform("s", lambda v: v["score"]), F.transform("s", lambda v: v["label"])).alias("b"))
    return best.select("rec", "b.size", F.round("b.accuracy", 6).alias("accuracy"))
