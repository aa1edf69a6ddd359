"""Splits, balancing, search and evaluation of classifiers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(id_: Column, salt: str = "") -> Column:
    """0 to 99 from the md5 of an id: the same split on every engine and at every size."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), id_.cast("string"))), 1, 8), 16, 10).cast("bigint") % 100


def split(df: DataFrame, test_percent: int = 20, key: str = "id", salt: str = "") -> DataFrame:
    return df.withColumn("split", F.when(bucket(F.col(key), salt) < test_percent, "test").otherwise("train"))


def label_shares(df: DataFrame, label: str = "label", part: str = "split") -> DataFrame:
    """(label, all, train, test): percentages of each label, by label."""
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), one(F.col(part) == "train").alias("n_train"), one(F.col(part) == "test").alias("n_test"))
    total = counts.agg(F.sum("n").alias("t"), F.sum("n_train").alias("t_train"), F.sum("n_test").alias("t_test"))
    joined = counts.crossJoin(F.broadcast(total))  # one row
    return joined.select(label, *(F.try_divide(100.0 * F.col(f"n{x}"), F.col(f"t{x}")).alias(a) for x, a in (("", "all"), ("_train", "train"), ("_test", "test"))))


# Evaluation


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, predicted, n, share of the label's rows)."""
    counts = df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy(label).agg(F.sum("n").alias("_t"))
    return counts.join(rows, label).select(label, predicted, "n", (F.col("n") / F.col("_t")).alias("share"))


def report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support): one pass over the rows, then one row a class."""
    counts = df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), "n", (F.col(label) == F.col(predicted)).alias("hit"))
    per = sides.groupBy(F.col("s.c").alias("label")).agg(F.sum(F.col("n") * F.col("s.t")).alias("support"), F.sum(F.col("n") * F.col("s.p")).alias("made"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("s.t")).otherwise(0)).alias("tp"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return per.select("label", zero(F.col("tp"), F.col("made")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2.0 * F.col("tp"), F.col("made") + F.col("support")).alias("f1"), "support")


def report_with_averages(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """report() with its rows' plain mean and their mean weighted by support; label is text."""
    rows = report(df, label, predicted)
    plain = [F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")]
    whole = lambda name, cols: rows.agg(*cols, F.sum("support").alias("support")).select(F.lit(name).alias("label"), "precision", "recall", "f1", "support")
    return rows.withColumn("label", F.col("label").cast("string")).unionByName(whole("macro avg", plain)).unionByName(whole("weighted avg", weighted))


def scores(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, f1_macro (unweighted mean over classes) and f1_micro."""
    r = report(df, label, predicted)
    hits = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    return r.agg(hits.alias("accuracy"), F.avg("f1").alias("f1_macro"), hits.alias("f1_micro"), F.sum("support").alias("n"))


def weighted_vote(votes: DataFrame, key: str = "id", label: str = "vote", weight: str = "weight") -> DataFrame:
    """(key, label) of the greatest sum of weights; the smallest of equal ones."""
    sums = votes.groupBy(key, label).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(key).agg(F.max_by(label, F.struct("_w", -F.col(label))).alias(label))


# Models


def with_features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("v")).withColumn("label", F.col("label").cast("double"))


def components_for(df: DataFrame, share: float = 0.99) -> tuple[int, list[float]]:
    """Least number of principal components of the scaled features whose variance exceeds the share."""
    dims = len(df.select("v").first().v)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(df).transform(df)
    explained = PCA(k=dims, inputCol="scaled", outputCol="p").fit(scaled).explainedVariance.toArray()
    return int(np.searchsorted(np.cumsum(explained), share, "right") + 1) if share < 1 else dims, explained.tolist()


def forest(trees: int = 100, depth: int = 10, impurity: str = "gini", seed: int = 33, k: int | None = None, bootstrap: bool = True):
    """A random forest, after scaling and k principal components if k is given; depth ends at 30."""
    f = RandomForestClassifier(numTrees=trees, maxDepth=min(depth, 30), impurity=impurity, seed=seed, bootstrap=bootstrap, featuresCol="reduced" if k else "features")
    if not k:
        return f
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), PCA(k=k, inputCol="scaled", outputCol="reduced"), f])


def boosted(depth: int = 5, rate: float = 0.1, rounds: int = 20, gamma: float = 0.0, seed: int = 33):
    """Boosted trees for any number of classes, one against the rest."""
    g = GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=min(depth, 30), minInfoGain=gamma, seed=seed)
    return OneVsRest(classifier=g)


def cross_validated(df: DataFrame, estimator, grid: list | None = None, folds: int = 10, seed: int = 33, metric: str = "logLoss", parallelism: int = 2):
    """(best model, metric of each point) by k-fold cross-validation."""
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid or ParamGridBuilder().build(), evaluator=MulticlassClassificationEvaluator(metricName=metric), numFolds=folds, seed=seed, parallelism=parallelism)
    m = cv.fit(df)
    return m.bestModel, m.avgMetrics


def evaluated(train: DataFrame, test: DataFrame, estimator, grid: list | None = None, folds: int = 10, metric: str = "logLoss") -> tuple[object, DataFrame, DataFrame]:
    """(model, report with averages, predictions): the best point by cross-validation, fitted on all of train."""
    model, _ = cross_validated(train, estimator, grid, folds, metric=metric)
    predictions = model.transform(test).select(F.col("prediction").cast("bigint").alias("y_pred"), F.col("label").cast("bigint").alias("y_test"))
    return model, report_with_averages(predictions, "y_test", "y_pred"), predictions


def search_boosted(df: DataFrame, bounds: dict[str, tuple[float, float]], folds: int = 10, steps: int = 1, start: int = 2, seed: int = 33) -> tuple[dict[str, float], float]:
    """(parameters, accuracy): boosted trees by cross-validated accuracy; bounds of depth, rate, rounds or gamma."""
    whole = {"depth", "rounds"}

    def score(p: dict[str, float]) -> float:
        trees = boosted(**{k: int(round(v)) if k in whole else v for k, v in p.items()}, seed=seed)
        return cross_validated(df, trees, folds=folds, metric="accuracy")[1][0]

    return bayes_search(score, bounds, steps, start, seed)


def bayes_search(score, bounds: dict[str, tuple[float, float]], steps: int = 5, start: int = 4, seed: int = 33) -> tuple[dict[str, float], float]:
    """Parameters of the highest score: a Gaussian process on the points tried picks the next by expected gain."""
    rng = np.random.default_rng(seed)
    names = list(bounds)
    low, high = (np.array([bounds[n][i] for n in names], float) for i in (0, 1))
    xs = rng.random((start, len(names)))
    ys = [score(dict(zip(names, (low + x * (high - low)).tolist(), strict=True))) for x in xs]
    gram = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / 0.18)
    phi = np.vectorize(lambda z: (1 + math.erf(z / math.sqrt(2))) / 2)
    for _ in range(steps):
        y = np.array(ys)
        z = (y - y.mean()) / (y.std() or 1)
        k = gram(xs, xs) + 1e-6 * np.eye(len(xs))
        cand = rng.random((256, len(names)))
        c = gram(cand, xs)
        mean = c @ np.linalg.solve(k, z)
        dev = np.sqrt(np.maximum(1 - (c * np.linalg.solve(k, c.T).T).sum(1), 1e-12))
        u = (mean - z.max()) / dev
        gain = dev * (u * phi(u) + np.exp(-u * u / 2) / math.sqrt(2 * math.pi))
        xs = np.vstack([xs, cand[gain.argmax()]])
        ys.append(score(dict(zip(names, (low + xs[-1] * (high - low)).tolist(), strict=True))))
    best = int(np.argmax(ys))
    return dict(zip(names, (low + xs[best] * (high - low)).tolist(), strict=True)), float(ys[best])


def rusboost(df: DataFrame, target: int, rounds: int = 3, trees: int = 5, proportion: float = 2.0, seed: int = 7, depth: int = 5, checkpoint=None) -> tuple[list, list[float]]:
    """Forests on all target rows and weighted draws of the others, and the weight of each one's vote.

    Rows that a forest gets wrong weigh more in the next draw. The draw takes the least of -ln(u) / w
    of every row, so it is one top-n over the table; u comes from the row's id and the round. A
    perfect forest's vote weight is capped, as it would be without bound.
    """
    rows = df.withColumn("w", F.lit(1.0))
    n_target = rows.where(F.col("label") == target).count()
    models, weights = [], []
    for r in range(rounds):
        u = (bucket(F.col("id"), f"{seed}_{r}_") + (F.xxhash64("id", F.lit(seed), F.lit(r)) % 10_000 + 10_000) / 20_001.0) / 101.0 + 1e-6
        drawn = rows.where(F.col("label") != target).orderBy(-F.ln(u) / F.col("w"), "id").limit(int(round(n_target * proportion)))
        model = forest(trees, depth, seed=seed + r, bootstrap=False).fit(drawn.unionByName(rows.where(F.col("label") == target)).drop("w"))
        missed = model.transform(rows).withColumn("miss", (F.col("prediction") != F.col("label")).cast("double"))
        loss = missed.agg(F.sum(F.col("w") * F.col("miss")) / F.sum("w")).first()[0]
        alpha = max(loss, 1e-6) / max(1 - loss, 1e-6)
        models.append(model)
        weights.append(math.log(1 / alpha))
        rows = missed.withColumn("w", F.col("w") * (1 + F.col("miss") * alpha)).select(*rows.columns)
        rows = checkpoint(rows, r) if checkpoint else rows
    return models, weights


def boosted_votes(df: DataFrame, models: list, weights: list[float]) -> DataFrame:
    """(id, vote): the weighted majority of the forests."""
    votes = None
    for m, w in zip(models, weights, strict=True):
        one = m.transform(df).select("id", F.col("prediction").cast("bigint").alias("vote"), F.lit(w).alias("weight"))
        votes = one if votes is None else votes.unionByName(one)
    return weighted_vote(votes)
