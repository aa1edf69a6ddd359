"""Sources, sinks and feature tables on a small tree of recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.operators import features, learning, vectors
from tremolo.sources import recordings as src

PATHS = {
    "normal/12.288.csv": (0, None, 12.288, 0.0, 0.0),
    "imbalance/20g/14.336.csv": (1, None, 14.336, 20.0, 0.0),
    "horizontal-misalignment/0,51mm/21.5.csv": (2, None, 21.5, 0.0, 0.51),
    "vertical-misalignment/1.27mm/30.csv": (3, None, 30.0, 0.0, 1.27),
    "underhang/cage_fault/6g/15.1.csv": (4, 0, 15.1, 6.0, 0.0),
    "overhang/ball_fault/0g/16.2.csv": (5, 2, 16.2, 0.0, 0.0),
}
RATE, N = 2000.0, 400


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root, r, data = tmp_path_factory.mktemp("tree"), np.random.default_rng(3), {}
    for path, (_, _, freq, _, _) in PATHS.items():
        t = np.arange(N) / RATE
        x = np.stack([np.sin(2 * np.pi * 2 * freq * t) * (1 + c) + 0.3 * np.sin(2 * np.pi * 4 * freq * t + c) + r.normal(0, 0.05, N) for c in range(8)], 1).round(6)
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("\n".join(",".join(map(str, row)) for row in x) + "\n")
        data[path] = x
    (root / "notes.txt").write_text("no recording")
    return str(root), data


def _short(path):
    return next(p for p in PATHS if path.endswith(p))


def test_read_recordings(spark, tree):
    root, data = tree
    rows = src.read_recordings(spark, root).toPandas()
    assert len(rows) == N * len(PATHS)
    for path, g in rows.groupby("path"):
        g, want = g.sort_values("i"), PATHS[_short(path)]
        assert g["i"].tolist() == list(range(N)) and np.allclose(g[list(src.CHANNELS)], data[_short(path)])
        bearing = g["Bearing"].iloc[0]
        assert (g["Class"].iloc[0], None if np.isnan(bearing) else int(bearing), g["RotFreq"].iloc[0], g["Weigth"].iloc[0], g["Shift"].iloc[0]) == want
    one = src.read_anonymous(spark, f"{root}/normal/12.288.csv")
    assert one.columns == [f"_c{i}" for i in range(8)] and one.count() == N


def _entropy(x, width=0.2):
    edges = np.arange(x.min(), x.max(), width)
    if len(edges) < 2:
        return 0.0
    p = np.histogram(x, edges)[0]
    p = p[p > 0] / p.sum()
    return float(-(p * np.log(p)).sum())


def test_feature_table(spark, tree):
    root, data = tree
    out = features.feature_table(src.read_recordings(spark, root), RATE, 5, 700)
    assert len(out.columns) == 159 and out.columns[1] == "Ent_TCH" and out.columns[-6:] == list(src.LABEL_COLUMNS)
    rows = {_short(r.path): r for r in out.collect()}
    assert set(rows) == set(PATHS)
    for path, r in rows.items():
        x = data[path]
        freqs = np.arange(N // 2 + 1) * RATE / N
        at = (freqs >= 5) & (freqs <= 700)
        mags = np.abs(np.fft.rfft(x, axis=0))[at]
        left, found = mags[:, 0].copy(), []
        for _ in range(4):
            i = int(left.argmax())
            found.append(i)
            left[slice(i - 15, i + 16)] = -np.inf
        first = min(found)  # of the tachometer, for all channels
        assert r.Fr == pytest.approx(freqs[at][first]) and (r.Class, r.RotFreq, r.Weigth, r.Shift) == (PATHS[path][0], *PATHS[path][2:])
        ladder = np.round(np.linspace(first, min(3 * first, len(mags) - 4), 3)).astype(int)
        for j, c in enumerate(src.CHANNELS):
            v, m = x[:, j], mags[:, j]
            for h, k in enumerate(ladder):
                assert r[f"F0{h}_{c}"] == pytest.approx(m[max(k - 3, 0) : k + 4].max())
            assert [r[f"FC_{c}"], r[f"RMSF_{c}"], r[f"RVF_{c}"]] == pytest.approx([m.mean(), np.sqrt((m * m).mean()), m.std()])
            rms, sra, mean_abs = np.sqrt((v * v).mean()), np.sqrt(np.abs(v)).mean() ** 2, np.abs(v).mean()
            z = (v - v.mean()) / v.std()
            kurtosis, skew, peak = (z**4).mean() - 3, (z**3).mean(), np.abs(v).max()
            want = [_entropy(v), rms, sra, kurtosis, skew, np.ptp(v), peak / rms, peak / mean_abs, peak / sra, rms / mean_abs, kurtosis / rms, v.mean(), v.std()]
            assert [r[f"{k}_{c}"] for k in features.STATISTICS] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_wavelet_table(spark, tree):
    from tremolo.operators.wavelet import swt

    root, data = tree
    out = features.wavelet_table(src.read_recordings(spark, root).where("Class < 2"), level=2)
    assert len(out.columns) == 1 + 13 * 32 + 1
    for r in out.collect():
        for j, c in enumerate(src.CHANNELS[:3]):
            for name, v in swt(data[_short(r.path)][:, j], "bior6.8", 2):
                got = [r[f"{k}_{c}_bior6.8_{name}"] for k in ("Ent", "RMS", "Mu", "SD")]
                assert got == pytest.approx([_entropy(v), np.sqrt((v * v).mean()), v.mean(), v.std()], rel=1e-6, abs=1e-9)


def test_sinks_and_projection(spark, tree, tmp_path):
    root, _ = tree
    table = features.feature_table(src.read_recordings(spark, root), RATE, 5, 700).cache()
    src.write_features(table.drop("path"), f"{tmp_path}/f", "Class")
    back = src.read_features(spark, f"{tmp_path}/f").orderBy("Sample")
    assert [r.Sample for r in back.select("Sample").collect()] == list(range(6)) and [r.Class for r in back.select("Class").collect()] == list(range(6))
    src.write_features(table.drop("path"), f"{tmp_path}/p", "Class", form="parquet")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 6
    x, y = features.features_and_target(back)
    assert len(x.columns) == 152 and not set(x.columns) & {*src.LABEL_COLUMNS, "Sample"} and y.columns == ["Class"]
    src.write_predictions(spark.createDataFrame([(1, 0, 9)], "y_pred int, y_test int, more int"), f"{tmp_path}/y")
    assert src.read_features(spark, f"{tmp_path}/y").columns == ["y_pred", "y_test"]
    split = learning.split(table.withColumn("id", F.xxhash64("path")), 50)
    src.write_split(split, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").where("split = 'test'").count() == split.where("split = 'test'").count()
    table.unpersist()


def test_memoised(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3 + len(built))

    path = f"file://{tmp_path}/m"
    assert [src.memoised(spark, path, build).count() for _ in range(2)] == [4, 4] and len(built) == 1
    assert src.memoised(spark, path, build, refresh=True).count() == 5


def test_sample_numbers(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("a"))
    rows = src.with_sample(df, "a").collect()
    assert sorted((r.a, r.Sample) for r in rows) == [(i, i) for i in range(1000)]


def test_covariance_of_many_dimensions(spark):
    r = np.random.default_rng(4)
    x = r.normal(1000, 1, (300, 20))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    assert np.allclose(vectors.covariance_matrix(df, 20), np.cov(x, rowvar=False))
