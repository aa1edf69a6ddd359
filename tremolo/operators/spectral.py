"""Spectra of recordings: each recording's samples are one array, transformed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tremolo.sources.tables import arrays


def _each(fn: Callable[[np.ndarray], object], kind: str):
    """A function of one array as a column function over batches of arrays."""

    @pandas_udf(kind)
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([fn(np.asarray(x, float)) for x in xs], xs.index, object)

    return run


def magnitudes(x: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(x))


def spectrum(s: DataFrame) -> DataFrame:
    """(rec, k, mag): magnitudes of the real transform, k up to half the length."""
    mags = _each(lambda x: magnitudes(x).tolist(), "array<double>")
    return arrays(s).select("rec", F.posexplode(mags("xs")).alias("k", "mag")).select("rec", F.col("k").cast("bigint").alias("k"), "mag")


def band(n: int, rate: float, low: float, high: float) -> np.ndarray:
    """Indices of the bins of an n-sample transform whose frequency is in [low, high]."""
    f = np.arange(n // 2 + 1) * rate / n
    return np.flatnonzero((f >= low) & (f <= high))


def find_peaks(x: np.ndarray, count: int = 4, distance: int = 3) -> list[tuple[int, float]]:
    """(index, value) of the highest values, each blanking its neighbourhood, by index.

    A peak nearer to the start than distance blanks nothing unless the wrapped slice is not empty, as
    the neighbourhood begins at a negative index; it is found again.
    """
    left = np.where(np.isnan(x), -np.inf, x)
    out = []
    for _ in range(count):
        if not len(left) or np.isneginf(left.max()):
            break
        i = int(left.argmax())
        out.append((i, float(left[i])))
        left[i - distance : i + distance + 1] = -np.inf
    return sorted(out)


def harmonics(mag: np.ndarray, first: int, count: int = 3, reach: int = 3) -> list[tuple[int, float]]:
    """(index, amplitude) of evenly spaced multiples of an index: the largest value within reach.

    Windows that would begin before the spectrum begin at its start.
    """
    ladder = np.round(np.linspace(first, min(count * first, len(mag) - reach - 1), count)).astype(int)
    return [(int(i), float(mag[max(i - reach, 0) : i + reach + 1].max())) for i in ladder]


PEAKS = "array<struct<k: bigint, v: double>>"


def peaks(s: DataFrame, count: int = 4, distance: int = 3) -> DataFrame:
    """(rec, peak, k, mag): the greedy peaks of each spectrum, numbered by index."""
    f = _each(lambda x: [{"k": k, "v": v} for k, v in find_peaks(magnitudes(x), count, distance)], PEAKS)
    rows = arrays(s).select("rec", F.posexplode(f("xs")).alias("peak", "p"))
    return rows.select("rec", F.col("peak").cast("bigint").alias("peak"), F.col("p.k").alias("k"), F.col("p.v").alias("mag"))


def spectral_features(s: DataFrame, rate: float, low: float, high: float, distance: int = 15, reach: int = 3) -> DataFrame:
    """One row per recording: rotation frequency, three harmonics and FC, RMSF, RVF of the band.

    The rotation frequency is that of the lowest of the four peaks of the band. Recordings whose band
    has no bin have nulls.
    """

    def one(x: np.ndarray) -> dict:
        mag, at = magnitudes(x), band(len(x), rate, low, high)
        if not len(at):
            return dict.fromkeys(("Fr", "F00", "F01", "F02", "FC", "RMSF", "RVF"))
        m = mag[at]
        k = find_peaks(m, 4, distance)[0][0]
        f = [v for _, v in harmonics(m, k, 3, reach)]
        return {"Fr": float(at[k] * rate / len(x)), "F00": f[0], "F01": f[1], "F02": f[2], "FC": float(m.mean()), "RMSF": float(np.sqrt((m * m).mean())), "RVF": float(m.std())}

    kind = "struct<" + ", ".join(f"{n}: double" for n in ("Fr", "F00", "F01", "F02", "FC", "RMSF", "RVF")) + ">"

    @pandas_udf(kind)
    def run(xs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(np.asarray(x, float)) for x in xs], columns=["Fr", "F00", "F01", "F02", "FC", "RMSF", "RVF"], dtype=float)

    return arrays(s).select("rec", run("xs").alias("f")).select("rec", "f.*")


def one_feature(features: DataFrame, which: str) -> DataFrame:
    """(rec, value): a spectral feature by its name, -999 for unknown names."""
    names = {"first_harmonic": "F00", "second_harmonic": "F01", "third_harmonic": "F02", "freq_mean": "FC", "freq_rms": "RMSF", "freq_std": "RVF", "smallest_freq": "Fr"}
    return features.select("rec", (F.col(names[which]) if which in names else F.lit(-999.0)).alias("value"))


def hanning(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) if n > 1 else np.ones(n)


def _frames(s: DataFrame, cut: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(rec, frame, k, mag) from a function that gives a recording's matrix of frames."""
    f = _each(lambda x: np.abs(np.fft.rfft(cut(x), axis=1)).tolist(), "array<array<double>>")
    rows = arrays(s).select("rec", F.posexplode(f("xs")).alias("frame", "m")).select("rec", "frame", F.posexplode("m").alias("k", "mag"))
    return rows.select("rec", F.col("frame").cast("bigint").alias("frame"), F.col("k").cast("bigint").alias("k"), "mag")


def stft_padded(s: DataFrame, size: int = 512, overlap: int = 256) -> DataFrame:
    """Hanning frames that end at every (size - overlap)-th sample; the first sample pads the start."""
    step, w = max(size - overlap, 1), hanning(size)

    def cut(x: np.ndarray) -> np.ndarray:
        ext = np.r_[np.full(size - 1, x[0]), x]
        return np.lib.stride_tricks.sliding_window_view(ext, size)[::step] * w

    return _frames(s, cut)


def stft_plain(s: DataFrame, size: int, overlap: float = 0.75) -> DataFrame:
    """Hanning frames from every floor(size (1 - overlap))-th sample on; zeros follow the end."""
    step, w = max(int(size * (1 - overlap)), 1), hanning(size)

    def cut(x: np.ndarray) -> np.ndarray:
        n = -(-len(x) // step)
        ext = np.r_[x, np.zeros(size)]
        return np.stack([ext[j * step : j * step + size] for j in range(n)]) * w

    return _frames(s, cut)


def stft_centred(s: DataFrame, size: int, overlap: float = 0.75) -> DataFrame:
    """Frames of a signal with half a window of zeros at both ends, the last frame first."""
    step, w = max(int(size * (1 - overlap)), 1), hanning(size)

    def cut(x: np.ndarray) -> np.ndarray:
        ext = np.r_[np.zeros(size // 2), x, np.zeros(size // 2)]
        return np.lib.stride_tricks.sliding_window_view(ext, size)[::step][::-1] * w

    return _frames(s, cut)


def normalise_spectrum(mag: np.ndarray, ratio: float) -> np.ndarray:
    """A frame's magnitudes as if the machine turned 1 / ratio times as fast.

    Back to time, to round(len * ratio) samples by cutting or padding the transform, forward again,
    and cut or padded to the bins of a signal of 2 * bins - 1 samples.
    """
    n = 2 * (len(mag) - 1)
    m = max(int(round(n * ratio)), 2)
    full = np.fft.rfft(np.fft.irfft(mag, n))
    keep = np.zeros(m // 2 + 1, complex)
    k = min(len(full), len(keep))
    keep[:k] = full[:k]
    resampled = np.fft.irfft(keep, m) * (m / n)
    size = 2 * len(mag) - 1
    fitted = np.r_[resampled, np.zeros(max(size - m, 0))][:size]
    return np.abs(np.fft.rfft(fitted))


def norm_spec(s: DataFrame, size: int, overlap: int, norm_frequency: float, rotation: str) -> DataFrame:
    """stft_padded with every frame normalised by the recording's rotation / norm_frequency."""
    step, w = max(size - overlap, 1), hanning(size)

    @pandas_udf("array<array<double>>")
    def run(xs: pd.Series, rot: pd.Series) -> pd.Series:
        out = []
        for x, r in zip(xs, rot, strict=True):
            x = np.asarray(x, float)
            ext = np.r_[np.full(size - 1, x[0]), x]
            frames = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(ext, size)[::step] * w, axis=1))
            out.append([normalise_spectrum(m, r / norm_frequency).tolist() for m in frames])
        return pd.Series(out, xs.index, object)

    rot = s.groupBy("rec").agg(F.first(rotation).alias("rot"))
    rows = arrays(s).join(rot, "rec").select("rec", F.posexplode(run("xs", "rot")).alias("frame", "m")).select("rec", "frame", F.posexplode("m").alias("k", "mag"))
    return rows.select("rec", F.col("frame").cast("bigint").alias("frame"), F.col("k").cast("bigint").alias("k"), "mag")


def decibels(spectra: DataFrame) -> DataFrame:
    return spectra.withColumn("db", F.when(F.col("mag") > 0, 10 * F.log10("mag")))


def rolling_spectral(s: DataFrame, size: int, rate: float, low: float, high: float, distance: int = 15) -> DataFrame:
    """(rec, i, six features) of full trailing windows; one transform serves all six."""
    names = ("h1", "h2", "h3", "f_mean", "f_rms", "f_std")

    def bank(x: np.ndarray) -> list[list[float]]:
        if len(x) < size:
            return []
        at = band(size, rate, low, high)
        mags = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, size), axis=1))[:, at]
        out = []
        for m in mags:
            k = find_peaks(m, 4, distance)[0][0]
            out.append([*(v for _, v in harmonics(m, k)), float(m.mean()), float(np.sqrt((m * m).mean())), float(m.std())])
        return out

    f = _each(bank, "array<array<double>>")
    rows = arrays(s).select("rec", F.posexplode(f("xs")).alias("j", "v"))
    return rows.select("rec", (F.col("j") + size - 1).cast("bigint").alias("i"), *(F.col("v")[n].alias(c) for n, c in enumerate(names)))
