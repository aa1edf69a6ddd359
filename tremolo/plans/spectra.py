"""Queries on spectra and wavelets of single signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.functions import stats
from tremolo.operators import spectral, wavelet
from tremolo.plans.registry import query
from tremolo.sources.tables import SIGNAL_SQL, signal

#: The sampling rate and band of the queries, and the distance of peaks.
RATE, LOW, HIGH, APART = 2000.0, 100.0, 900.0, 3

_DFT = f"""{SIGNAL_SQL}, len AS (SELECT rec, count(*) AS n FROM sig GROUP BY rec),
 bins AS (SELECT rec, n, unnest(range(0, n // 2 + 1)) AS k FROM len),
 spec AS (SELECT b.rec, b.n, b.k, sqrt(pow(sum(x*cos(2*pi()*((k*i) % n)/n)), 2) + pow(sum(x*sin(2*pi()*((k*i) % n)/n)), 2)) AS mag FROM bins b JOIN sig s ON s.rec = b.rec GROUP BY 1, 2, 3)"""
_BAND = f"{_DFT}, band AS (SELECT rec, n, k, mag, row_number() OVER (PARTITION BY rec ORDER BY k) - 1 AS b, count(*) OVER (PARTITION BY rec) AS nb FROM spec WHERE k*{RATE}/n BETWEEN {LOW} AND {HIGH})"


def _peaks_sql(source: str, key: str, size: str, distance: int, count: int = 4) -> str:
    """CTEs q1 to q<count>: peak number p of each recording; wrapped slices blank nothing or what they hold."""
    out, left = [], source
    for p in range(1, count + 1):
        out.append(f"q{p} AS (SELECT rec, arg_max({key}, (mag, -{key})) AS j, max(mag) AS v FROM {left} GROUP BY rec)")
        out.append(f"l{p} AS (SELECT s.* FROM {left} s JOIN q{p} USING (rec) WHERE NOT CASE WHEN j >= {distance} THEN s.{key} BETWEEN j - {distance} AND j + {distance} ELSE s.{key} BETWEEN {size} + j - {distance} AND j + {distance} END)")
        left = f"l{p}"
    return ", ".join(out)


@query(f"WITH {_DFT} SELECT rec, k, round(mag, 5) AS mag FROM spec")
def dft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.spectrum(signal(spark, sf_dir)).select("rec", "k", F.round("mag", 5).alias("mag"))


@query(f"WITH {_BAND} SELECT rec, k, round(mag, 5) AS mag FROM band")
def band_filter_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    n = s.groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    return spectral.spectrum(s).join(n, "rec").where((F.col("k") * RATE / F.col("n")).between(LOW, HIGH)).select("rec", "k", F.round("mag", 5).alias("mag"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.spectral_features(signal(spark, sf_dir), RATE, LOW, HIGH, APART)


@query(f"WITH {_BAND} SELECT rec, round(avg(mag), 5) AS FC, round(sqrt(avg(mag*mag)), 5) AS RMSF, round(stddev_pop(mag), 5) AS RVF FROM band GROUP BY rec")
def spectral_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("rec", *(F.round(c, 5).alias(c) for c in ("FC", "RMSF", "RVF")))


@query(f"WITH {_DFT.replace('spec AS', 'spec0 AS')}, spec AS (SELECT *, n // 2 + 1 AS nb FROM spec0), {_peaks_sql('spec', 'k', 'nb', 3)}, u AS (" + " UNION ALL ".join(f"SELECT rec, j, v, {p} AS p FROM q{p}" for p in range(1, 5)) + ") SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY j, p) - 1 AS peak, j AS k, round(v, 5) AS mag FROM u")
def find_peaks_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.peaks(signal(spark, sf_dir)).select("rec", "peak", "k", F.round("mag", 5).alias("mag"))


_FIRST = f"{_BAND}, {_peaks_sql('band', 'b', 'nb', APART)}, low AS (SELECT rec, min(j) AS b FROM (" + " UNION ALL ".join(f"SELECT rec, j FROM q{p}" for p in range(1, 5)) + ") GROUP BY rec)"


@query(f"WITH {_FIRST} SELECT low.rec, round(band.k*{RATE}/band.n, 5) AS Fr FROM low JOIN band USING (rec, b)")
def rotation_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("rec", F.round("Fr", 5).alias("Fr"))


@query(
    f"""WITH {_FIRST}, lad AS (SELECT rec, b, h, round_even(b + (least(3*b, nb - 4) - b)*h/2.0, 0) AS at FROM low JOIN (SELECT DISTINCT rec, nb FROM band) USING (rec), (SELECT unnest(range(0, 3)) AS h) hs)
 SELECT lad.rec, round(max(CASE WHEN h = 0 THEN mag END), 5) AS F00, round(max(CASE WHEN h = 1 THEN mag END), 5) AS F01, round(max(CASE WHEN h = 2 THEN mag END), 5) AS F02
 FROM lad JOIN band ON band.rec = lad.rec AND band.b BETWEEN lad.at - 3 AND lad.at + 3 GROUP BY lad.rec"""
)
def harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("rec", *(F.round(c, 5).alias(c) for c in ("F00", "F01", "F02")))


@query(f"WITH {_BAND} SELECT rec, round(sqrt(avg(mag*mag)), 5) AS value FROM band GROUP BY rec")
def one_spectral_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.one_feature(_features(spark, sf_dir), "freq_rms").select("rec", F.round("value", 5).alias("value"))


def _stft_sql(frames: str, at: str, value: str, size: int) -> str:
    """Frames are (rec, frame); sample t of a frame is x at position `at`, or `value` where there is none."""
    return f"""WITH {SIGNAL_SQL}, len AS (SELECT rec, count(*) AS n, min_by(x, i) AS x0 FROM sig GROUP BY rec), fr AS ({frames}),
 w AS (SELECT fr.rec, fr.frame, t, coalesce(s.x, {value})*(0.5-0.5*cos(2*pi()*t/{size - 1})) AS y FROM fr CROSS JOIN (SELECT unnest(range(0, {size})) AS t) ts LEFT JOIN sig s ON s.rec = fr.rec AND s.i = {at})
 SELECT rec, frame, k, round(sqrt(pow(sum(y*cos(2*pi()*k*t/{size})), 2) + pow(sum(y*sin(2*pi()*k*t/{size})), 2)), 5) AS mag FROM w, (SELECT unnest(range(0, {size // 2 + 1})) AS k) ks GROUP BY 1, 2, 3"""


_STFT_PADDED = _stft_sql("SELECT rec, x0, unnest(range(0, (n + 7) // 8)) AS frame FROM len", "fr.frame*8 - 15 + t", "fr.x0", 16)


@query(_STFT_PADDED)
def stft_hann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.stft_padded(signal(spark, sf_dir), 16, 8).withColumn("mag", F.round("mag", 5))


@query(_stft_sql("SELECT rec, unnest(range(0, (n + 3) // 4)) AS frame FROM len", "fr.frame*4 + t", "0", 16))
def stft_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.stft_plain(signal(spark, sf_dir), 16).withColumn("mag", F.round("mag", 5))


@query(_stft_sql("SELECT rec, n // 4 AS last, unnest(range(0, n // 4 + 1)) AS frame FROM len", "(fr.last - fr.frame)*4 - 8 + t", "0", 16))
def stft_zero_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.stft_centred(signal(spark, sf_dir), 16).withColumn("mag", F.round("mag", 5))


@query(f"SELECT rec, frame, k, round(10*log10(nullif(mag, 0)), 4) AS db FROM ({_STFT_PADDED.replace(', 5) AS mag', ', 9) AS mag')}) WHERE mag > 0.001")
def spectrogram_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectral.stft_padded(signal(spark, sf_dir), 16, 8).withColumn("mag", F.round("mag", 9)).where("mag > 0.001")
    return spectral.decibels(s).select("rec", "frame", "k", F.round("db", 4).alias("db"))


@query()
def norm_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir).withColumn("rot", 20.0 + F.col("rec") % 10)
    return spectral.norm_spec(s, 16, 8, 24.0, "rot").withColumn("mag", F.round("mag", 5))


@query()
def rolling_freq_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spectral.rolling_spectral(signal(spark, sf_dir), 16, RATE, LOW, HIGH, APART)
    return f.select("rec", "i", *(F.round(c, 5).alias(c) for c in f.columns[2:]))


_HAAR = f"""{SIGNAL_SQL}, c0 AS (SELECT rec, i, x, count(*) OVER (PARTITION BY rec) // 4 * 4 AS n FROM sig), a0 AS (SELECT * FROM c0 WHERE i < n),
 l1 AS (SELECT a.rec, a.n, a.i, (a.x + b.x)*0.7071067811865476 AS ca, (a.x - b.x)*0.7071067811865476 AS cd FROM a0 a JOIN a0 b ON a.rec = b.rec AND b.i = (a.i + 1) % a.n),
 l2 AS (SELECT a.rec, a.i, (a.ca + b.ca)*0.7071067811865476 AS ca, (a.ca - b.ca)*0.7071067811865476 AS cd FROM l1 a JOIN l1 b ON a.rec = b.rec AND b.i = (a.i + 2) % a.n)"""


@query(f"WITH {_HAAR} " + " UNION ALL ".join(f"SELECT rec, 'c{p}{j}' AS coef, i, round(c{p.lower()}, 5) AS value FROM l{j}" for j in (1, 2) for p in "AD"))
def swt_haar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.coefficients(signal(spark, sf_dir), "db1", 2).withColumn("value", F.round("value", 5))


@query()
def swt_bior68_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature bank of every coefficient series, in long form; a pivot of it is the wide table."""
    c = wavelet.coefficients(signal(spark, sf_dir), "bior6.8", 4)
    return c.groupBy("rec", "coef").agg(*stats.rounded(stats.feature_bank("value")))
