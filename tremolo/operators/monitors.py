"""Linear auto-associative monitors, Mahalanobis and one-class detectors, and a model registry."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, is_dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tremolo.functions.kernels import mahalanobis
from tremolo.operators.similarity import THETAS, ClassSimilarityModel, SimilarityModel, kernel, products, spread, theta_of
from tremolo.operators.vectors import Chunks, covariance_matrix, matrix, moments, whole


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def hat_matrix(rows: np.ndarray) -> np.ndarray:
    """Projection onto the span of the rows."""
    return rows.T @ np.linalg.pinv(rows @ rows.T) @ rows


@dataclass
class LinearMonitor:
    """Projects samples onto rows picked one after the other for what they explain of the rest."""

    kernel: str = "IES"
    gamma: float = 0.01
    min_err: float = 0.01
    max_itr: int = 100
    seed: int = 42
    hat: np.ndarray | None = None
    theta: float = 0.5
    picked: int = 0

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        return kernel(np.linalg.norm(x - x @ self.hat, axis=1), self.kernel, self.gamma)

    def _tuned(self, x: np.ndarray, y: np.ndarray) -> LinearMonitor:
        s = self.score_rows(x)
        return replace(self, theta=THETAS[theta_of([float(((s > t) == y).mean()) for t in THETAS])])

    def fit_rows(self, x: np.ndarray, y: np.ndarray) -> LinearMonitor:
        """Adds rows while the validation error falls; two at least, as many as there are dimensions at most."""
        y = np.asarray(y, bool)
        held = np.random.default_rng(self.seed).permutation(len(x)) < round(0.33 * len(x))
        p = x[~held][y[~held]]
        left, rows, best = unit_rows(p), [], None
        for _ in range(min(self.max_itr, len(p), p.shape[1]) + 1):
            gain = ((left @ (left.T @ left)) * left).sum(1)
            rows.append(int(gain.argmax()))
            left = unit_rows(left - left[rows[-1]])
            left[rows] = 0
            if len(rows) < 2:
                continue
            m = replace(self, hat=hat_matrix(p[rows]), picked=len(rows))._tuned(x[~held], y[~held])
            err = float(((m.score_rows(x[held]) > m.theta) != y[held]).mean())
            if best is None or err < best[0]:
                best = err, m
            else:
                break
            if err < self.min_err:
                break
        return best[1]

    def fit(self, df: DataFrame) -> LinearMonitor:
        _, x, y = matrix(df)
        return self.fit_rows(x, y > 0)

    def transform(self, df: DataFrame) -> DataFrame:
        own = self

        @pandas_udf("double")
        def run(v: pd.Series) -> pd.Series:
            return pd.Series(own.score_rows(np.stack(v)), v.index)

        return df.withColumn("score", run("v")).withColumn("predicted", (F.col("score") > self.theta).cast("int"))


@dataclass
class LinearClassMonitor:
    """One linear monitor a class; the first class of the highest score wins."""

    base: LinearMonitor = field(default_factory=LinearMonitor)
    classes: list = field(default_factory=list)
    models: list = field(default_factory=list)

    def fit(self, df: DataFrame) -> LinearClassMonitor:
        _, x, y = matrix(df)
        classes = sorted(set(y.tolist()))
        return replace(self, classes=classes, models=[self.base.fit_rows(x, y == c) for c in classes])

    def transform(self, df: DataFrame) -> DataFrame:
        models, classes = self.models, np.array(self.classes)

        @pandas_udf("bigint")
        def run(v: pd.Series) -> pd.Series:
            x = np.stack(v)
            return pd.Series(classes[np.stack([m.score_rows(x) for m in models], 1).argmax(1)], v.index)

        return df.withColumn("predicted", run("v"))


@dataclass
class MahalanobisDetector:
    """Score exp(-(tau d)**2); rows at or above the contamination percentile of the scores are inliers."""

    contamination: float = 0.1
    tau: float = 0.01
    rcond: float = 1e-15
    mean: np.ndarray | None = None
    precision: np.ndarray | None = None
    threshold: float = 0.0

    def fit(self, df: DataFrame, dims: int) -> MahalanobisDetector:
        mean, _ = moments(df, dims)
        own = replace(self, mean=mean, precision=np.linalg.pinv(covariance_matrix(df, dims), rcond=self.rcond))
        share = min(self.contamination, 0.5)
        return replace(own, threshold=own.scores(df).agg(F.percentile("score", F.lit(share))).first()[0])

    def scores(self, df: DataFrame) -> DataFrame:
        d = mahalanobis(F.col("v"), F.array(*map(F.lit, self.mean.tolist())), self.precision.tolist())
        return df.withColumn("score", F.exp(-F.pow(self.tau * d, F.lit(2.0))))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scores(df).withColumn("label", F.when(F.col("score") >= self.threshold, 1).otherwise(-1).cast("bigint"))


@dataclass
class OneClassSvm:
    """The nu one-class machine with a Gaussian kernel, on all rows, by pairwise updates.

    An update takes two columns of the kernel matrix, which are computed as they are needed.
    """

    nu: float = 0.1
    gamma: float = 0.1
    tol: float = 1e-4
    max_itr: int = 20_000
    support: np.ndarray | None = None
    alpha: np.ndarray | None = None
    rho: float = 0.0

    def _gram(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.exp(-self.gamma * np.maximum(d, 0))

    def fit_rows(self, x: np.ndarray) -> OneClassSvm:
        """Minimises a'Ka / 2 with 0 <= a <= 1 / (nu n) and sum 1: weight moves to the least gradient."""
        n = len(x)
        top = 1 / (self.nu * n)
        gram = replace(self, support=None, alpha=None)._gram
        a = np.zeros(n)
        full = int(self.nu * n)
        a[:full] = top
        if full < n:
            a[full] = 1 - full * top
        on = a > 0
        g = spread(gram, x, x[on], a[on, None])[:, 0]
        for _ in range(self.max_itr):
            down, up = np.where(a > 1e-12, g, -np.inf), np.where(a < top - 1e-12, g, np.inf)
            i, j = int(down.argmax()), int(up.argmin())
            if g[i] - g[j] < self.tol:
                break
            k = gram(x, x[[i, j]])
            move = min((g[i] - g[j]) / max(k[i, 0] + k[j, 1] - 2 * k[i, 1], 1e-12), a[i], top - a[j])
            a[i] -= move
            a[j] += move
            g += move * (k[:, 1] - k[:, 0])
        inner = (a > 1e-12) & (a < top - 1e-12)
        rho = float(g[inner].mean() if inner.any() else g[a > 1e-12].max())
        return replace(self, support=x[a > 1e-12], alpha=a[a > 1e-12], rho=rho)

    def fit(self, df: DataFrame) -> OneClassSvm:
        return self.fit_rows(whole(df)[1])

    def transform(self, df: DataFrame) -> DataFrame:
        pieces = ((self.support[i : i + Chunks.ROWS], self.alpha[i : i + Chunks.ROWS, None]) for i in range(0, len(self.support), Chunks.ROWS))
        chunks, gram, rho = Chunks(df.sparkSession, pieces), replace(self, support=None, alpha=None)._gram, self.rho

        @pandas_udf("double")
        def run(v: pd.Series) -> pd.Series:
            x = np.stack(v)
            return pd.Series(sum(products(gram, x, s, a)[:, 0] for s, a in chunks) - rho, v.index)

        return df.withColumn("score", run("v")).withColumn("label", F.when(F.col("score") >= 0, 1).otherwise(-1).cast("bigint"))


class Registry:
    """Fitted models by key."""

    def __init__(self, models: dict | None = None):
        self.models = dict(models or {})

    def __setitem__(self, key, model):
        self.models[key] = model

    def __getitem__(self, key):
        return self.models[key]

    def __contains__(self, key) -> bool:
        return key in self.models


def _encoded(x):
    if is_dataclass(x):
        return {"kind": type(x).__name__, "state": {k: _encoded(v) for k, v in x.__dict__.items()}}
    if isinstance(x, np.ndarray):
        return {"array": x.tolist(), "type": str(x.dtype)}
    if isinstance(x, (list, tuple)):
        return [_encoded(v) for v in x]
    return x.item() if isinstance(x, np.generic) else x


def _decoded(x):
    kinds = {k.__name__: k for k in (LinearMonitor, LinearClassMonitor, MahalanobisDetector, OneClassSvm, SimilarityModel, ClassSimilarityModel)}
    if isinstance(x, list):
        return [_decoded(v) for v in x]
    if isinstance(x, dict):
        return np.array(x["array"], x["type"]) if "array" in x else kinds[x["kind"]](**{k: _decoded(v) for k, v in x["state"].items()})
    return x


def save_model(model, path: str) -> None:
    """Any monitor or detector, single or by class, as JSON."""
    with open(path, "w") as f:
        json.dump(_encoded(model), f)


def load_model(path: str):
    with open(path) as f:
        return _decoded(json.load(f))
