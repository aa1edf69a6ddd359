"""Signal queries without SQL, by direct sums in NumPy."""

import cmath
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.operators import sequential, windows
from tremolo.plans import all_queries
from tremolo.plans.spectra import APART, HIGH, LOW, RATE
from tremolo.sources.tables import signal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def recs(spark):
    rows = signal(spark, SF).orderBy("rec", "i").toPandas()
    return {rec: g.reset_index(drop=True) for rec, g in rows.groupby("rec")}


def _dft(x):
    n = len(x)
    return [sum(v * cmath.exp(-2j * math.pi * k * t / n) for t, v in enumerate(x)) for k in range(n // 2 + 1)]


def _frames(x, size, step):
    ext = [x[0]] * (size - 1) + list(x)
    w = [0.5 - 0.5 * math.cos(2 * math.pi * t / (size - 1)) for t in range(size)]
    return [[a * b for a, b in zip(ext[p : p + size], w, strict=True)] for p in range(0, len(ext) - size + 1, step)]


def test_median_filter_fit(spark, recs):
    got = {r.rec: r for r in all_queries.QUERIES["median_filter_fit"](spark, SF).collect()}
    assert set(got) == set(recs)
    for rec, g in recs.items():
        x, y = [v / (v + 50) for v in g["x"]], [k == "click" for k in g["kind"]]
        n, best = len(x), (1, np.mean([(v > 0.5) == c for v, c in zip(x, y, strict=True)]))
        for size in range(3, n - 1, 2):
            h = size // 2
            ext = [x[i] for i in range(h - 1, -1, -1)] + x
            behind = [x[i] for i in range(n - 1, size - 1, -1)][:h]
            ext += behind + [0.0] * (h - len(behind))
            acc = np.mean([(sorted(ext[i : i + size])[h] > 0.5) == y[i] for i in range(n)])
            best = (size, acc) if acc > best[1] else best
        assert got[rec]["size"] == best[0] and got[rec].accuracy == pytest.approx(best[1], abs=1e-6)


def test_sizes_go_on_to_the_largest(spark):
    r = np.random.default_rng(1)
    y = np.repeat([0, 1, 0, 1], 400)
    x = y * 0.6 + 0.2 + r.normal(0, 0.5, len(y))
    rows = [(1, i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    best = sequential.fit_median_size(spark.createDataFrame(rows, "rec long, i long, score double, label int")).first()
    assert best["size"] > 9 and best.accuracy > 0.95


def test_sequential_test_of_a_long_recording(spark):
    r = np.random.default_rng(2)
    p = np.clip(r.beta(2, 2, 60_000), 0.01, 0.99)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(p)], "rec long, i long, p double").repartition(4)
    total, want = 0.0, []
    for odds in np.log(p) - np.log(1 - p):
        total += odds
        want.append(1 if total > math.log(9) else -1 if total < -math.log(9) else 0)
        total = odds if want[-1] else total
    assert [x.label for x in sequential.sprt(df, "p").orderBy("i").collect()] == want


def test_augment_copies(spark, recs):
    got = all_queries.QUERIES["augment_copies"](spark, SF).orderBy("rec", "copy", "i").toPandas()

    def uniform(tag, event, copy):
        return (int(hashlib.md5(f"{tag}{event}_{copy}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32

    for rec, g in recs.items():
        x = g["x"].to_numpy()
        for copy in (1, 2, 3):  # each copy from the one before
            noise = [math.sqrt(-2 * math.log(uniform("a", e, copy))) * math.cos(2 * math.pi * uniform("b", e, copy)) for e in g["event_id"]]
            x = x + math.sqrt(np.mean(x * x) / 100) * np.array(noise)
            assert np.allclose(got[(got["rec"] == rec) & (got["copy"] == copy)]["x"], x, atol=2e-6)


def test_norm_spec(spark, recs):
    got = all_queries.QUERIES["norm_spec"](spark, SF).orderBy("rec", "frame", "k").toPandas()
    inverse = lambda half, n: [sum((1 if k in (0, n / 2) else 2) * (c * cmath.exp(2j * math.pi * k * t / n)).real for k, c in enumerate(half)) / n for t in range(n)]
    for rec in sorted(recs)[:12]:
        want = []
        for frame in _frames(recs[rec]["x"].tolist(), 16, 8):
            mag = [abs(c) for c in _dft(frame)]
            m = max(int(round(16 * (20.0 + rec % 10) / 24.0)), 2)
            full = _dft(inverse(mag, 16))
            keep = (full + [0] * m)[: m // 2 + 1]
            if m < 16 and m % 2 == 0:  # the last bin of an even transform is real
                keep[-1] = complex(keep[-1].real, 0)
            back = [v * m / 16 for v in inverse(keep, m)]
            want += [abs(c) for c in _dft((back + [0.0] * 17)[:17])]
        assert np.allclose(got[got["rec"] == rec]["mag"], want, atol=1e-4)


def test_rolling_freq_bank(spark, recs):
    got = all_queries.QUERIES["rolling_freq_bank"](spark, SF).orderBy("rec", "i").toPandas()
    assert len(got) == sum(max(0, len(g) - 15) for g in recs.values())
    at = [k for k in range(9) if LOW <= k * RATE / 16 <= HIGH]
    for rec in sorted(recs)[:40]:
        x = recs[rec]["x"].tolist()
        for p in range(len(x) - 15):
            mag = [abs(c) for c in _dft(x[p : p + 16])]
            m = [mag[k] for k in at]
            left, found = list(m), []
            for _ in range(4):
                if not left or max(left) == -math.inf:
                    break
                i = left.index(max(left))
                found.append(i)
                for j in range(*slice(i - APART, i + APART + 1).indices(len(left))):
                    left[j] = -math.inf
            first = min(found)
            row = got[(got["rec"] == rec) & (got["i"] == p + 15)].iloc[0]
            last = min(3 * first, len(m) - 4)
            tones = [max(m[max(i - 3, 0) : i + 4]) for i in (round(first + (last - first) * t / 2) for t in range(3))]
            assert np.allclose(row[["h1", "h2", "h3"]].astype(float), tones, atol=2e-5)
            assert np.allclose(row[["f_mean", "f_rms", "f_std"]].astype(float), [np.mean(m), np.sqrt(np.mean(np.square(m))), np.std(m)], atol=2e-5)


def test_swt_bior68_stats(spark, recs):
    from tremolo.operators.wavelet import FILTERS

    got = all_queries.QUERIES["swt_bior68_stats"](spark, SF).toPandas().set_index(["rec", "coef"])
    low, high = FILTERS["bior6.8"]
    for rec in [r for r in sorted(recs) if len(recs[r]) >= 16][:6]:
        x = recs[rec]["x"].tolist()
        a = x[: len(x) // 16 * 16]
        n = len(a)
        for level in range(1, 5):
            gap = 2 ** (level - 1)
            filtered = lambda f, a=a, gap=gap: [sum(c * a[(i + (9 - j) * gap) % n] for j, c in enumerate(f)) for i in range(n)]
            d, a = filtered(high), filtered(low)
            for part, v in (("cD", d), ("cA", a)):
                row, v = got.loc[(rec, f"{part}{level}")], np.array(v)
                rms = np.sqrt(np.mean(v * v))
                assert np.allclose([row["RMS"], row["PPK"], row["CF"], row["Mu"], row["SD"]], [rms, np.ptp(v), np.abs(v).max() / rms, v.mean(), v.std()], rtol=1e-4, atol=1e-4)


def test_elapsed(spark):
    s = spark.createDataFrame([(1, 0, 1.0), (1, 3, 2.0)], "rec long, i long, x double")
    assert [r.t.total_seconds() for r in windows.elapsed(s, 2000.0).orderBy("i").collect()] == [0.0, 0.0015]
    assert windows.elapsed(s, 2.0).agg(F.max("t")).first()[0].total_seconds() == 1.5
