"""Stationary wavelet transform of recordings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tremolo.sources.tables import arrays

# Decomposition filters (low, high) of the wavelets.
_R = 0.7071067811865476
FILTERS = {
    "db1": ([_R, _R], [-_R, _R]),
    "bior6.8": (
        [0, 0.0019088317364812906, -0.0019142861290887667, -0.016990639867602342, 0.01193456527972926, 0.04973290349094079, -0.07726317316720414, -0.09405920349573646, 0.4207962846098268, 0.8259229974584023, 0.4207962846098268, -0.09405920349573646, -0.07726317316720414, 0.04973290349094079, 0.01193456527972926, -0.016990639867602342, -0.0019142861290887667, 0.0019088317364812906],
        [0, 0, 0, 0.014426282505624435, -0.014467504896790148, -0.07872200106262882, 0.04036797903033992, 0.41784910915027457, -0.7589077294536541, 0.41784910915027457, 0.04036797903033992, -0.07872200106262882, -0.014467504896790148, 0.014426282505624435, 0, 0, 0, 0],
    ),
}


def swt(x: np.ndarray, wavelet: str, level: int) -> list[tuple[str, np.ndarray]]:
    """(name, coefficients) from the last level to the first, approximation before detail.

    Level j spreads the filters by 2**(j-1); everything is periodic. x is as long as a multiple of 2**level.
    """
    low, high = (np.asarray(f, float) for f in FILTERS[wavelet])
    n, found = len(x), []
    for j in range(1, level + 1):
        gap = 1 << (j - 1)
        at = (np.arange(n)[:, None] + (len(low) // 2 - np.arange(len(low))) * gap) % n
        taps = x[at]
        found.append((f"cD{j}", taps @ high))
        x = taps @ low
        found.append((f"cA{j}", x))
    return found[::-1]


def column_names(columns: list[str], wavelet: str, level: int) -> list[str]:
    return [f"{c}_{wavelet}_{part}{j}" for c in columns for j in range(level, 0, -1) for part in ("cA", "cD")]


def coefficients(s: DataFrame, wavelet: str = "bior6.8", level: int = 4) -> DataFrame:
    """(rec, coef, i, value) of recordings cut to a multiple of 2**level samples; shorter ones drop out."""

    @pandas_udf("array<struct<coef: string, v: array<double>>>")
    def run(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            x = np.asarray(x, float)
            x = x[: len(x) >> level << level]
            out.append([{"coef": c, "v": v.tolist()} for c, v in swt(x, wavelet, level)] if len(x) else [])
        return pd.Series(out, xs.index, object)

    rows = arrays(s).select("rec", F.explode(run("xs")).alias("c")).select("rec", "c.coef", F.posexplode("c.v").alias("i", "value"))
    return rows.select("rec", "coef", F.col("i").cast("bigint").alias("i"), "value")
