"""Feature tables of multi-channel recordings: statistics, spectra and wavelet coefficients, a row a recording."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tremolo.functions.stats import entropy, feature_bank
from tremolo.operators.spectral import band, find_peaks, harmonics, magnitudes
from tremolo.operators.wavelet import coefficients, column_names
from tremolo.sources.recordings import CHANNELS, LABEL_COLUMNS

STATISTICS = ("Ent", "RMS", "SRA", "Krt", "Skw", "PPK", "CF", "ImF", "MrF", "ShF", "KrF", "Mu", "SD")
SPECTRAL = ("F00", "F01", "F02", "FC", "RMSF", "RVF")


def channel_rows(recordings: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(path, channel, i, x): the channels of each sample below each other."""
    cells = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("x")) for c in channels))
    return recordings.select("path", "i", F.explode(cells).alias("c")).select("path", "c.channel", "i", "c.x")


def statistics_table(recordings: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(path, <statistic>_<channel>): one aggregation of the rows, and one of their histograms for the entropy."""
    bank = {c: feature_bank(c) for c in channels}
    stats = recordings.groupBy("path").agg(*(bank[c][k].alias(f"{k}_{c}") for k in STATISTICS[1:] for c in channels))
    ent = entropy(channel_rows(recordings, channels), ["path", "channel"])
    wide = ent.groupBy("path").pivot("channel", list(channels)).agg(F.first("Ent"))
    return stats.join(wide.select("path", *(F.col(c).alias(f"Ent_{c}") for c in channels)), "path").select("path", *(f"{k}_{c}" for k in STATISTICS for c in channels))


def channel_spectra(x: np.ndarray, rate: float, low: float, high: float, distance: int = 15, reach: int = 3) -> list[float] | None:
    """F00 of each column, then F01 and so on, and last the rotation frequency; None without a bin in the band.

    The first column is the tachometer: the lowest of its four peaks is the rotation frequency, at
    whose multiples the harmonics of all columns are taken.
    """
    at = band(len(x), rate, low, high)
    if not len(at):
        return None
    mags = [magnitudes(x[:, j])[at] for j in range(x.shape[1])]
    first = find_peaks(mags[0], 4, distance)[0][0]
    tones = [[v for _, v in harmonics(m, first, 3, reach)] for m in mags]
    rows = [[t[h] for t in tones] for h in range(3)] + [[m.mean() for m in mags], [np.sqrt((m * m).mean()) for m in mags], [m.std() for m in mags]]
    return [float(v) for row in rows for v in row] + [float(at[first] * rate / len(x))]


def spectral_table(recordings: DataFrame, rate: float = 5e4, low: float = 5, high: float = 700, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(path, <feature>_<channel>, Fr): a recording is the unit of work, its samples one array a channel."""
    names = [f"{k}_{c}" for k in SPECTRAL for c in channels] + ["Fr"]

    @pandas_udf("struct<" + ", ".join(f"{n}: double" for n in names) + ">")
    def run(cols: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in cols.itertuples(index=False):
            found = channel_spectra(np.stack([np.asarray(c, float) for c in row], 1), rate, low, high)
            rows.append(found or [None] * len(names))
        return pd.DataFrame(rows, columns=names, dtype=float)

    got = recordings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", *channels))).alias("s"))
    arrays = F.struct(*(F.col(f"s.{c}").alias(c) for c in channels))  # a field of an array of structs is an array
    return got.select("path", run(arrays).alias("f")).select("path", "f.*")


def feature_table(recordings: DataFrame, rate: float = 5e4, low: float = 5, high: float = 700) -> DataFrame:
    """(path, 158 features and labels) of recordings as sources.recordings.read_recordings gives them."""
    labels = recordings.groupBy("path").agg(*(F.first(c).alias(c) for c in LABEL_COLUMNS if c != "Fr"))
    out = statistics_table(recordings).join(spectral_table(recordings, rate, low, high), "path").join(labels, "path")
    names = [f"{k}_{c}" for k in (*STATISTICS, *SPECTRAL) for c in CHANNELS]
    return out.select("path", *names, *LABEL_COLUMNS)


def wavelet_table(recordings: DataFrame, wavelet: str = "bior6.8", level: int = 4, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(path, <statistic>_<channel>_<wavelet>_<part><level>, Class): the statistics of every coefficient series."""
    samples = channel_rows(recordings, channels).select(F.struct("path", "channel").alias("rec"), "i", "x")
    series = coefficients(samples, wavelet, level).select(F.col("rec.path").alias("path"), F.concat_ws("_", "rec.channel", F.lit(wavelet), "coef").alias("series"), "value")
    stats = series.groupBy("path", "series").agg(*(c.alias(k) for k, c in feature_bank("value").items()))
    stats = stats.join(entropy(series.select("path", "series", F.col("value").alias("x")), ["path", "series"]), ["path", "series"])
    names = column_names(list(channels), wavelet, level)
    wide = stats.groupBy("path").pivot("series", names).agg(*(F.first(k).alias(k) for k in STATISTICS))
    labels = recordings.groupBy("path").agg(F.first("Class").alias("Class"))
    return wide.join(labels, "path").select("path", *(F.col(f"`{n}_{k}`").alias(f"{k}_{n}") for k in STATISTICS for n in names), "Class")


def features_and_target(df: DataFrame, target: str = "Class") -> tuple[DataFrame, DataFrame]:
    """(X, y): what isn't a label or an index, and the target alone."""
    return df.drop(*LABEL_COLUMNS, "path", "Sample"), df.select(target)
