"""Partition around medoids, on bounded distance matrices, and its sampled form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.functions.kernels import minkowski
from tremolo.operators.similarity import distances
from tremolo.operators.vectors import matrix, nearest


#: Rows whose distances to each other are held at once.
MAX_CLUSTERED = 5_000


def build(d: np.ndarray, k: int) -> list[int]:
    """Starting medoids: the row of least total distance, then each time that which shortens the
    distances of all rows to their nearest medoid most, the first of equal ones."""
    medoids: list[int] = []
    nearest_one = np.full(len(d), np.inf)
    for _ in range(min(k, len(d))):
        totals = np.minimum(nearest_one[:, None], d).sum(0)
        totals[medoids] = np.inf
        medoids.append(int(totals.argmin()))
        nearest_one = np.minimum(nearest_one, d[:, medoids[-1]])
    return sorted(medoids)


def pam(d: np.ndarray, k: int, rounds: int = 20) -> tuple[list[int], np.ndarray, float]:
    """(medoids, index of each row's medoid, total distance): swaps until no swap lowers the total."""
    medoids = build(d, k)
    for _ in range(rounds):
        before = list(medoids)
        for slot in range(k):
            rest = [m for j, m in enumerate(medoids) if j != slot]
            base = d[:, rest].min(1) if rest else np.full(len(d), np.inf)
            totals = np.minimum(base[:, None], d).sum(0)
            best = int(totals.argmin())
            if best not in medoids and totals[best] < np.minimum(base, d[:, medoids[slot]]).sum() - 1e-12:
                medoids[slot] = best
        medoids.sort()
        if medoids == before:
            break
    return medoids, d[:, medoids].argmin(1), float(d[:, medoids].min(1).sum())


def pam_table(df: DataFrame, k: int) -> tuple[list[int], DataFrame]:
    """Medoid ids and every row with its medoid; they come from MAX_CLUSTERED rows at most, by hash."""
    ids, x, _ = matrix(df, most=MAX_CLUSTERED)
    medoids, _, _ = pam(distances(x, x), k)
    centres = [(int(ids[m]), x[m].tolist()) for m in medoids]
    return [c for c, _ in centres], nearest(df, centres)


def clara(df: DataFrame, k: int, inits: int = 10, size: int | None = None, seed: int = 7) -> tuple[list[int], DataFrame]:
    """Medoids of the best of several samples, judged on all rows, and every row with its medoid.

    Samples are drawn by hash and solved side by side; the totals of all candidates over the whole
    table come from one aggregation.
    """
    size = size or 80 + 2 * k
    ranked = df.select("id", "v", F.explode(F.sequence(F.lit(1), F.lit(inits))).alias("init")).withColumn("r", F.xxhash64("id", "init", F.lit(seed)))
    picks = None
    for i in range(1, inits + 1):
        one = ranked.where(F.col("init") == i).orderBy("r").limit(size)
        picks = one if picks is None else picks.unionByName(one)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["v"])
        medoids, _, _ = pam(distances(x, x), min(k, len(x)))
        return pd.DataFrame({"init": pdf["init"].iloc[medoids].to_numpy(), "id": pdf["id"].iloc[medoids].to_numpy(), "v": list(x[medoids])})

    found = picks.groupBy("init").applyInPandas(solve, "init int, id bigint, v array<double>").collect()
    by: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r.init, r.id)):
        by.setdefault(r.init, []).append((r.id, list(r.v)))
    totals = df.agg(*(F.sum(_distance(c)).alias(f"t{i}") for i, c in by.items())).first()
    best = min(by, key=lambda i: (totals[f"t{i}"], i))
    return [c for c, _ in by[best]], nearest(df, by[best])


def _distance(centres: list) -> Column:
    return F.array_min(F.array(*(minkowski(F.col("v"), F.array(*map(F.lit, map(float, c)))) for _, c in centres)))
