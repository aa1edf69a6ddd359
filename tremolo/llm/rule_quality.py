"""Quality classifier: tree paths become conjunctive rules, weighted by lasso and run as columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.llm.base import WORD_SPLIT, train_fold
from tremolo.llm.fit import lasso_logistic, log_loss, sigmoid

#: Labelled rows to fit on, at most; they are those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
STATISTICS = ("n_words", "word_length", "symbols", "capitals", "digits", "distinct_words", "repeated_lines", "stops", "shouts", "words_per_line", "beyond_ascii")


def with_statistics(rows: DataFrame, text: str) -> DataFrame:
    """Adds a column s_<name> for each of the STATISTICS of a whole text; all are 0 for null, empty and blank texts.

    Words and lines are columns of their own first, so that the expressions stay in generated code.
    """
    t, ws, ls = F.col("_t"), F.col("_ws"), F.col("_ls")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    rows = rows.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({"_ws": F.array_remove(F.split(t, WORD_SPLIT), ""), "_ls": F.array_remove(F.split(t, r"\n[\x20\x09-\x0D]*"), "")})
    rows = rows.withColumns(
        {
            "_n": F.size(ws).cast("double"),
            "_letters": F.length(F.regexp_replace(t, WORD_SPLIT, "")).cast("double"),
            "_lines": F.size(ls).cast("double"),
            "_symbols": count(r"[#*$%&|<>~^]"),
            "_capitals": count("[A-Z]"),
            "_digits": count("[0-9]"),
            "_stops": count("[.?]"),
            "_shouts": count("!"),
            "_beyond": (F.octet_length(t) - F.length(t)).cast("double"),
            "_words": F.size(F.array_distinct(ws)).cast("double"),
            "_texts": F.size(F.array_distinct(ls)).cast("double"),
        }
    )
    ratio = lambda x, of: F.when(F.col("_n") > 0, F.col(x) / F.greatest(F.col(of), F.lit(1.0))).otherwise(0.0)
    stats = (
        F.col("_n"),
        ratio("_letters", "_n"),
        ratio("_symbols", "_letters"),
        ratio("_capitals", "_letters"),
        ratio("_digits", "_letters"),
        ratio("_words", "_n"),
        F.when(F.col("_n") > 0, 1 - F.col("_texts") / F.greatest(F.col("_lines"), F.lit(1.0))).otherwise(0.0),
        ratio("_stops", "_n"),
        ratio("_shouts", "_n"),
        ratio("_n", "_lines"),
        ratio("_beyond", "_letters"),
    )
    rows = rows.withColumns({f"s_{k}": x for k, x in zip(STATISTICS, stats, strict=True)})
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, above, threshold) triples; above is x > threshold, else x <= it."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.all([(x[:, i] > c) == above for i, above, c in self.terms], axis=0)

    def column(self) -> Column:
        stats = [F.col(f"s_{STATISTICS[i]}") for i, _, _ in self.terms]
        return reduce(lambda a, b: a & b, ((x > c) if above else (x <= c) for x, (_, above, c) in zip(stats, self.terms, strict=True)))


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.holds(x)
        return sigmoid(z)

    def column(self) -> Column:
        """The score as an expression over the columns that with_statistics adds."""
        z = reduce(lambda a, b: a + b, (F.when(r.column(), w).otherwise(0.0) for r, w in zip(self.rules, self.weights, strict=True)), F.lit(self.intercept))
        return 1 / (1 + F.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, features: int, least: int = 10) -> list[tuple]:
    """Paths of one tree grown by Gini gain over quantile cuts; every inner path counts too."""
    paths: list[tuple] = []

    def split(rows: np.ndarray, path: tuple, left: int) -> None:
        if path:
            paths.append(path)
        p = y[rows].mean()
        if not left or len(rows) < 2 * least or p in (0.0, 1.0):
            return
        best = (1e-9, None)
        for i in rng.choice(x.shape[1], features, replace=False):
            v = x[rows, i]
            cuts = np.unique(np.quantile(v, np.linspace(0.02, 0.98, 33), method="lower"))
            above = v[:, None] > cuts
            n1 = above.sum(0)
            ok = (n1 >= least) & (len(rows) - n1 >= least)
            if not ok.any():
                continue
            s1 = (above * y[rows][:, None]).sum(0)
            n0, s0 = len(rows) - n1, y[rows].sum() - s1
            gini = np.where(ok, s1 * (1 - s1 / np.maximum(n1, 1)) + s0 * (1 - s0 / np.maximum(n0, 1)), np.inf)
            j = int(gini.argmin())
            gain = len(rows) * p * (1 - p) - gini[j]
            if gain > best[0]:
                best = (gain, (int(i), float(cuts[j])))
        if best[1]:
            i, c = best[1]
            high = x[rows, i] > c
            split(rows[high], (*path, (i, True, c)), left - 1)
            split(rows[~high], (*path, (i, False, c)), left - 1)

    split(np.arange(len(y)), (), depth)
    return paths


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, seed: int = 7, strengths: tuple[float, ...] = (0.01, 0.005, 0.0025, 0.0012)) -> RuleModel:
    """Trees on resampled rows, their paths as rules, and lasso weights; a held quarter picks l1."""
    base = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    if len(y) < 40 or len(np.unique(y)) < 2:
        return RuleModel(float(np.log(base / (1 - base))))
    rng = np.random.default_rng(seed)
    found: dict[bytes, Rule] = {}
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), 4000))
        for path in grow(x[rows], y[rows], rng, depth, max(3, x.shape[1] // 2)):
            rule = Rule(path)
            found.setdefault(np.packbits(rule.holds(x)).tobytes(), rule)  # rules that hold alike count once
    rules = list(found.values())
    m = np.stack([r.holds(x) for r in rules], 1).astype(float)
    held = np.arange(len(y)) % 4 == 0
    scored = []
    for l1 in strengths:
        b, w = lasso_logistic(m[~held], y[~held], l1)
        scored.append((log_loss(y[held], sigmoid(b + m[held] @ w)), l1))
    # The sparsest of those that are nearly as good as the best.
    b, w = lasso_logistic(m, y, max(l1 for loss, l1 in scored if loss <= 1.1 * min(scored)[0] + 0.002))
    used = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(b, [rules[i] for i in used], [float(w[i]) for i in used])


def fit_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fits on at most sample_rows labelled documents of the train fold; null ids and labels don't count.

    Only their statistics reach the driver. Of several rows with one id those of the least hash of the text count.
    """
    chosen = labels.where(labels[key].isNotNull() & labels[label].isNotNull() & train_fold(labels[key])).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).join(F.broadcast(chosen), "k")
    rows = rows.groupBy("k", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = with_statistics(rows, "t").withColumn("h", F.xxhash64("k")).drop("t").toPandas()
    rows = rows.sort_values(["h", "k"], kind="stable")
    x = rows[[f"s_{k}" for k in STATISTICS]].to_numpy(float)
    return fit_rules(x, rows["y"].to_numpy(float))


def quality_scores(docs: DataFrame, model: RuleModel, *, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per input row: key as doc_id, held_out, score and predicted.

    The score is the model's value of the text's statistics alone. Null, empty and blank texts have
    statistics of 0 and are scored like others; null keys give a null held_out. Repeated rows stay,
    other columns are ignored, an empty table gives an empty result.
    """
    stats = with_statistics(docs.select(docs[key].alias("doc_id"), docs[text].alias("t")), "t")
    return stats.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
