"""Fits, searches and monitors against NumPy: what has no SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.functions import kernels
from tremolo.operators import cluster, learning, monitors, similarity, vectors
from tremolo.operators.estimators import MonitorEstimator, MonitorModel
from tremolo.plans import all_queries
from tremolo.plans.models import _binary
from tremolo.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    """(ids, vectors, labels) of the whole table."""
    return vectors.matrix(tables.vectors(spark, SF))


def _dist(a, b, p=2):
    return (np.abs(a[:, None] - b[None]) ** p).sum(2) ** (1 / p)


def _blobs(seed=0, n=60, dims=3, centres=((0, 0, 0), (6, 0, 0))):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(c, 1, (n, dims)) for c in centres])
    return x, np.repeat(np.arange(len(centres)), n)


def _table(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, label long").repartition(3)


def test_distances():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(70, 9)), r.normal(size=(41, 9))
    for p in (1, 2, 3):
        assert np.allclose(similarity.distances(a, b, p), _dist(a, b, p))
    q = np.cov(a, rowvar=False)
    want = np.sqrt([[(x - y) @ q @ (x - y) for y in b] for x in a])
    assert np.allclose(similarity.distances(a, b, precision=q), want)
    assert similarity.distances(a[:0], b, 3).shape == (0, 41)


def test_thresholds_are_counted(spark):
    r = np.random.default_rng(2)
    s = np.r_[r.random(500), [0.0, 1.0, 0.5, 0.29, 0.57, 1.2, -0.1]]
    y = r.random(len(s)) < s
    theta, acc = similarity.find_theta(spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "score double, y boolean"))
    every = [float(((s > t) == y).mean()) for t in similarity.THETAS]
    k = similarity.theta_of(every)
    assert theta == similarity.THETAS[k] and acc == pytest.approx(every[k])


def test_large_tables_are_sampled(spark):
    df = spark.range(1000).select("id", F.array(F.col("id").cast("double")).alias("v"), F.lit(1).alias("label"))
    ids, x, _ = vectors.matrix(df, most=100)
    again, _, _ = vectors.matrix(df.repartition(7), most=100)
    assert len(ids) == 100 and (ids == again).all() and (np.diff(ids) > 0).all() and (x[:, 0] == ids).all()


def test_extreme_rows(spark):
    r = np.random.default_rng(6)
    x = r.integers(-3, 4, (200, 5)).astype(float)  # many ties
    df = _table(spark, x, np.zeros(200)).repartition(6)
    want = {int(i) for k in range(5) for i in (x[:, k].argmax(), x[:, k].argmin())}
    assert {r.id for r in vectors.extreme_rows(df, 5).collect()} == want and vectors.extreme_rows(df.limit(0), 5).count() == 0


def test_sbm_estimate(spark, data):
    ids, x, y = data
    m = similarity.SimilarityModel(gamma=0.5).fit(_binary(spark, SF), "original")
    pos = x[y >= 5]
    order = np.lexsort((-ids[y >= 5], -np.linalg.norm(pos, axis=1)))
    rows = {*pos.argmax(0), *pos.argmin(0), *order[::5]}
    assert {tuple(d) for d in np.round(m.D, 9)} == {tuple(d) for d in np.round(pos[sorted(rows)], 9)}
    sim = lambda a, b: 1 / (1 + 0.5 * _dist(a, b))
    w = np.linalg.pinv(sim(m.D, m.D)) @ sim(m.D, x)
    guess = (w / w.sum(0)).T @ m.D
    got = all_queries.QUERIES["sbm_estimate"](spark, SF).orderBy("id").toPandas()
    assert np.allclose(got[[f"e{k + 1}" for k in range(64)]], guess, atol=2e-4)
    score = 1 / (1 + 0.5 * np.linalg.norm(x - guess, axis=1))
    assert np.allclose(got["score"], score, atol=2e-5)
    every = [((score > t) == (y >= 5)).mean() for t in similarity.THETAS]
    assert m.theta == similarity.THETAS[similarity.theta_of(every)]


@pytest.mark.parametrize("method", similarity.METHODS)
def test_fits(spark, data, method):
    """Prototypes are what the method says; scores and decisions follow from them."""
    _, x, y = data
    y = y >= 5
    m = similarity.SimilarityModel(gamma=0.1, tau=0.5, max_itr=8, scale=True).fit(_binary(spark, SF), method)
    z = (x - x[y].mean(0)) / x[y].std(0)
    if method != "kmeans":
        rows = {tuple(v) for v in np.round(z[y], 6)}
        assert all(tuple(v) in rows for v in np.round(m.D, 6))
    sim = lambda a, b: 1 / (1 + 0.1 * _dist(a, b))
    w = np.linalg.pinv(sim(m.D, m.D)) @ sim(m.D, z)
    guess = (w / w.sum(0)).T @ m.D
    score = 1 / (1 + 0.1 * np.linalg.norm(z - guess, axis=1))
    got = all_queries.QUERIES[f"sbm_fit_{method}"](spark, SF).orderBy("id").toPandas()
    assert (got["prototypes"] == len(m.D)).all() and np.allclose(got["score"], score, atol=1e-4)
    clear = np.abs(score - m.theta) > 1e-4
    assert ((got["predicted"] == 1) == (score > m.theta))[clear].all()
    near = sim(m.D, z[y])
    if method == "dummy":
        assert len(m.D) == y.sum()
    if method in ("threshold", "centroids"):  # nothing is farther from all prototypes than tau
        assert (near.max(0) >= 0.5 - 1e-9).all()
    if method == "threshold2":
        assert (score[y] >= 0.5 - 1e-9).all() or len(m.D) == y.sum()
    if method == "greedy":
        cover = 1 - sim(m.D, z[~y]) < 0.5
        assert ((1 - near < 0.5).sum(1) > cover.sum(1)).all() or len(m.D) == 1


def test_cover_counts_the_others():
    m = similarity.SimilarityModel(gamma=1.0, tau=0.4)
    good = np.array([[0.0], [0.1], [5.0], [5.1], [5.2]])
    bad = np.array([[5.05], [5.15], [5.1]])
    assert m._cover(good, bad[:0]).ravel().tolist() == [5.0, 0.0]
    assert m._cover(good, bad).ravel().tolist() == [0.0]


def test_separable_classes_are_told_apart(spark):
    x, y = _blobs()
    df = _table(spark, x, y)
    for method in ("perceptron", "kmeans", "greedy", "rgreedy", "threshold"):
        m = similarity.SimilarityModel(gamma=0.5, tau=0.5, max_itr=20, scale=True).fit(df, method)
        hits = m.transform(df).agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]
        assert hits > 0.9, (method, hits)
    own = similarity.SimilarityModel(gamma=0.5, mahalanobis=True).fit(df, "dummy")
    assert np.allclose(own.precision, np.linalg.pinv(np.cov(x[y == 1], rowvar=False)))
    a = own.transform(df, residual=True)
    assert a.columns == ["id", "v", "label", "score", "predicted", "residual"]


def test_linear_monitor(spark, data):
    _, x, y = data
    m = monitors.LinearMonitor(gamma=0.5).fit(_binary(spark, SF))
    assert np.allclose(m.hat @ m.hat, m.hat) and np.allclose(m.hat, m.hat.T) and round(np.trace(m.hat)) == m.picked >= 2
    score = 1 / (1 + 0.5 * np.linalg.norm(x - x @ m.hat, axis=1))
    got = all_queries.QUERIES["linear_monitor"](spark, SF).orderBy("id").toPandas()
    assert np.allclose(got["score"], score, atol=2e-5) and ((score > m.theta) == (got["predicted"] == 1))[np.abs(score - m.theta) > 1e-5].all()
    c = monitors.LinearClassMonitor(monitors.LinearMonitor(gamma=0.5)).fit(tables.vectors(spark, SF))
    each = np.stack([1 / (1 + 0.5 * np.linalg.norm(x - x @ k.hat, axis=1)) for k in c.models], 1)
    got = all_queries.QUERIES["linear_monitor_classes"](spark, SF).orderBy("id").toPandas()
    assert c.classes == sorted(set(y.tolist())) and (np.array(c.classes)[each.argmax(1)] == got["predicted"]).all()


def test_medoids(spark, data):
    ids, x, _ = data
    d = _dist(x, x)
    assert np.allclose([r.total for r in vectors.distance_sums(tables.vectors(spark, SF)).orderBy("id").collect()], d.sum(1))
    picked = [int(d.sum(1).argmin())]  # the first two of the published steps, pair by pair
    gains = [sum(max(d[j, picked[0]] - d[j, c], 0) for j in range(len(d))) if c not in picked else -1 for c in range(len(d))]
    assert cluster.build(d, 2) == sorted([*picked, int(np.argmax(gains))])
    medoids, _, total = cluster.pam(d, 4)
    for slot in range(4):  # no single exchange is better
        rest = [m for i, m in enumerate(medoids) if i != slot]
        assert np.minimum(d[:, rest].min(1)[:, None], d).sum(0).min() >= total - 1e-9
    got = all_queries.QUERIES["pam"](spark, SF).orderBy("id").toPandas()
    assert set(got["centre"]) == set(ids[medoids]) and np.allclose(got["distance"], d[:, medoids].min(1), atol=1e-5)
    got = all_queries.QUERIES["clara"](spark, SF).orderBy("id").toPandas()
    at = np.searchsorted(ids, sorted(set(got["centre"])))
    assert len(at) == 4 and np.allclose(got["distance"], d[:, at].min(1), atol=1e-5) and total - 1e-6 <= got["distance"].sum() < 1.15 * total


def test_one_class_svm(spark, data):
    _, x, _ = data
    m = monitors.OneClassSvm(nu=0.1, gamma=0.5).fit_rows(x)
    top = 1 / (0.1 * len(x))
    assert m.alpha.sum() == pytest.approx(1) and (m.alpha <= top + 1e-12).all()
    score = np.exp(-0.5 * _dist(x, m.support) ** 2) @ m.alpha - m.rho
    assert (score < -1e-3).mean() <= 0.1 + 1e-9 and len(m.support) >= 0.1 * len(x) - 1
    got = all_queries.QUERIES["one_class_svm"](spark, SF).orderBy("id").toPandas()
    assert np.allclose(got["score"], score, atol=2e-4)


def test_components(spark, data):
    _, x, _ = data
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    shares = np.sort(np.linalg.eigvalsh(np.cov(z, rowvar=False)))[::-1]
    shares = np.cumsum(shares / shares.sum())
    r = all_queries.QUERIES["pca_variance_cut"](spark, SF).first()
    assert r.components == int(np.searchsorted(shares, 0.99, "right") + 1) and r.share == pytest.approx(shares[r.components - 1], abs=1e-4)


def test_bayes_search_finds_the_top():
    tried = []
    best, value = learning.bayes_search(lambda p: tried.append(p) or -((p["a"] - 3) ** 2) - (p["b"] + 1) ** 2, {"a": (0, 10), "b": (-5, 5)}, steps=25, start=5)
    assert len(tried) == 30 and value == max(-((p["a"] - 3) ** 2) - (p["b"] + 1) ** 2 for p in tried) > -0.6 and abs(best["a"] - 3) < 0.8


def test_forests_and_boosting_learn(spark):
    x, y = _blobs(3, 50, 3, ((0, 0, 0), (5, 0, 0), (0, 5, 0)))
    df = learning.with_features(learning.split(_table(spark, x, y))).cache()
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    model, report, predictions = learning.evaluated(train, test, learning.forest(5, 4, k=3), folds=3)
    rows = {r.label: r for r in report.collect()}
    y_pred, y_test = (np.array(predictions.toPandas()[c]) for c in ("y_pred", "y_test"))
    recall = [np.mean(y_pred[y_test == c] == c) for c in range(3)]
    assert rows["macro avg"].recall == pytest.approx(np.mean(recall)) and rows["weighted avg"].recall == pytest.approx(np.mean(y_pred == y_test)) and np.mean(y_pred == y_test) > 0.85
    boosted = learning.boosted(depth=2, rounds=2).fit(train).transform(test)
    assert boosted.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.85
    models, weights = learning.rusboost(df, 0, rounds=2, trees=3)
    votes = learning.boosted_votes(df, models, weights).join(df, "id")
    assert len(weights) == 2 and votes.agg(F.avg((F.col("vote") == F.col("label")).cast("double"))).first()[0] > 0.85
    df.unpersist()


def test_search_of_boosted_trees(spark):
    x, y = _blobs(5, 30)
    df = learning.with_features(_table(spark, x, y))
    best, accuracy = learning.search_boosted(df, {"depth": (1, 2), "rounds": (1, 2)}, folds=2, steps=0, start=1)
    assert accuracy > 0.85 and 1 <= best["depth"] <= 2


def test_models_come_back(spark, tmp_path):
    x, y = _blobs(7, 40)
    df = _table(spark, x, y)
    base = similarity.SimilarityModel(gamma=0.5, scale=True)
    fitted = [
        base.fit(df, "original"),
        similarity.ClassSimilarityModel(base).fit(df),
        monitors.LinearMonitor(gamma=0.5).fit(df),
        monitors.LinearClassMonitor(monitors.LinearMonitor(gamma=0.5)).fit(df),
        monitors.MahalanobisDetector(tau=0.1).fit(df, 3),
        monitors.OneClassSvm(nu=0.1, gamma=0.5).fit(df),
    ]
    reg = monitors.Registry()
    for i, m in enumerate(fitted):
        monitors.save_model(m, f"{tmp_path}/{i}.json")
        reg[type(m).__name__] = monitors.load_model(f"{tmp_path}/{i}.json")
        assert sorted(reg[type(m).__name__].transform(df).collect()) == sorted(m.transform(df).collect())
    assert "OneClassSvm" in reg and "other" not in reg


def test_pipeline_stages(spark, tmp_path):
    from pyspark.ml import Pipeline

    x, y = _blobs(9, 40)
    df = _table(spark, x, y)
    stage = MonitorEstimator(similarity.SimilarityModel, "dummy", gamma=0.5)
    assert stage.getOrDefault("kernel") == "IES" and {p.name for p in stage.params} >= {"gamma", "tau", "norm", "scale"}
    fitted = Pipeline(stages=[stage]).fit(df)
    want = similarity.SimilarityModel(gamma=0.5).fit(df, "dummy")
    assert sorted(fitted.transform(df).collect()) == sorted(want.transform(df).collect())
    other = stage.fit(df, {stage.gamma: 2.0})
    assert other.model.gamma == 2.0 and stage.getOrDefault("gamma") == 0.5
    other.save(f"{tmp_path}/m.json")
    assert MonitorModel.load(f"{tmp_path}/m.json").transform(df).count() == df.count()


def test_kernel_helpers(spark):
    df = spark.createDataFrame([(0.5,), (2.0,)], "x double")
    got = df.select(kernels.log_odds(F.col("x") / 3).alias("o"), kernels.linear_to_db(F.col("x")).alias("d")).collect()
    assert got[0].o == pytest.approx(np.log(0.5 / 3 / (1 - 0.5 / 3))) and np.isfinite(got[1].d)
