"""Queries on single signals: feature bank, windows, resampling, filters, sequential tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremolo.functions import stats
from tremolo.operators import sequential, windows
from tremolo.plans.registry import query
from tremolo.sources import recordings
from tremolo.sources.tables import SIGNAL_SQL, signal, table

BANK_SQL = """round(sqrt(avg(x*x)),6) AS RMS, round(pow(avg(sqrt(abs(x))),2),6) AS SRA, round(kurtosis_pop(x),6) AS Krt,
 round((avg(x*x*x)-3*avg(x)*avg(x*x)+2*pow(avg(x),3))/nullif(pow(stddev_pop(x),3),0),6) AS Skw, round(max(x)-min(x),6) AS PPK,
 round(max(abs(x))/nullif(sqrt(avg(x*x)),0),6) AS CF, round(max(abs(x))/nullif(avg(abs(x)),0),6) AS ImF,
 round(max(abs(x))/nullif(pow(avg(sqrt(abs(x))),2),0),6) AS MrF, round(sqrt(avg(x*x))/nullif(avg(abs(x)),0),6) AS ShF,
 round(kurtosis_pop(x)/nullif(sqrt(avg(x*x)),0),6) AS KrF, round(avg(x),6) AS Mu, round(stddev_pop(x),6) AS SD"""


@query(f"SELECT user_id AS rec, count(*) AS n, {BANK_SQL} FROM (SELECT user_id, value AS x FROM events) GROUP BY user_id")
def feat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), F.col("value").alias("x"))
    return e.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), *stats.rounded(stats.feature_bank("x")))


CHANNEL_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("WITH u AS (" + " UNION ALL ".join(f"SELECT l_suppkey AS rec, '{c}' AS channel, {c} AS x FROM lineitem" for c in CHANNEL_COLUMNS) + f") SELECT rec, channel, count(*) AS n, {BANK_SQL} FROM u GROUP BY rec, channel")
def feat_stats_multichannel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rec"), *CHANNEL_COLUMNS)
    long = li.unpivot("rec", list(CHANNEL_COLUMNS), "channel", "x")
    return long.groupBy("rec", "channel").agg(F.count(F.lit(1)).alias("n"), *stats.rounded(stats.feature_bank("x")))


@query(
    """WITH g AS (SELECT user_id AS rec, min(value) AS lo, ceil((max(value)-min(value))/20.0) AS e FROM events GROUP BY 1),
 b AS (SELECT rec, e, CASE WHEN (value-lo)/20.0 = e-1 THEN e-2 ELSE floor((value-lo)/20.0) END AS b FROM events JOIN g ON user_id = rec),
 c AS (SELECT rec, b, count(*) AS n FROM b WHERE e >= 2 AND b < e-1 GROUP BY 1, 2),
 h AS (SELECT rec, -sum(p*ln(p)) AS v FROM (SELECT rec, n/sum(n) OVER (PARTITION BY rec) AS p FROM c) GROUP BY 1)
 SELECT g.rec, round(coalesce(v, 0), 6) AS Ent FROM g LEFT JOIN h ON g.rec = h.rec"""
)
def feat_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), F.col("value").alias("x"))
    return stats.entropy(e, ["rec"], width=20.0).select("rec", F.round("Ent", 6).alias("Ent"))


@query(
    """WITH g AS (SELECT user_id AS rec, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
 d AS (SELECT rec, k, avg(exp(-pow((value-(lo+(hi-lo)*k/31.0))/20.0, 2)/2)) AS d FROM events JOIN g ON user_id = rec, (SELECT unnest(range(0,32)) AS k) ks GROUP BY 1, 2),
 p AS (SELECT rec, d/sum(d) OVER (PARTITION BY rec) AS p FROM d)
 SELECT rec, round(-sum(CASE WHEN p > 0 THEN p*ln(p) ELSE 0 END), 6) AS Ent FROM p GROUP BY rec"""
)
def feat_entropy_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), F.col("value").alias("x"))
    return stats.kde_entropy(e, ["rec"], n_grid=32, bandwidth=20.0).select("rec", F.round("Ent", 6).alias("Ent"))


PATHS_SQL = """paths AS (SELECT p_partkey, '/data/' || CASE p_partkey % 7 WHEN 0 THEN 'normal/' WHEN 1 THEN 'imbalance/' || p_size || 'g/' WHEN 2 THEN 'horizontal-misalignment/0,' || (50 + p_size) || 'mm/'
 WHEN 3 THEN 'vertical-misalignment/1,' || (20 + p_size) || 'mm/' WHEN 4 THEN 'underhang/ball_fault/' || p_size || 'g/' WHEN 5 THEN 'overhang/cage_fault/' || p_size || 'g/' ELSE 'overhang/outer_race/' || p_size || 'g/' END
 || (p_partkey % 60) || '.' || (100 + p_partkey % 800) || '.csv' AS path FROM part)"""


@query(
    f"""WITH {PATHS_SQL}, k AS (SELECT p_partkey, path, regexp_extract(path, '/(normal|imbalance|horizontal-misalignment|vertical-misalignment|underhang|overhang)/', 1) AS c FROM paths),
 n AS (SELECT *, CASE c WHEN 'normal' THEN 0 WHEN 'imbalance' THEN 1 WHEN 'horizontal-misalignment' THEN 2 WHEN 'vertical-misalignment' THEN 3 WHEN 'underhang' THEN 4 ELSE 5 END AS code FROM k)
 SELECT p_partkey, CAST(code AS BIGINT) AS Class, CAST(CASE WHEN path LIKE '%/cage_fault/%' THEN 0 WHEN path LIKE '%/outer_race/%' THEN 1 WHEN path LIKE '%/ball_fault/%' THEN 2 END AS BIGINT) AS Bearing,
 CAST(regexp_extract(path, '([0-9]+[.][0-9]+)[.]csv$', 1) AS DOUBLE) AS RotFreq,
 CASE WHEN code IN (1,4,5) THEN CAST(regexp_extract(path, '/([0-9]+)g/', 1) AS DOUBLE) ELSE 0.0 END AS Weigth,
 CASE WHEN code IN (2,3) THEN CAST(replace(regexp_extract(path, '/([0-9,]+)mm/', 1), ',', '.') AS DOUBLE) ELSE 0.0 END AS Shift FROM n"""
)
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    g = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    folder = F.when(k % 7 == 0, "normal/").when(k % 7 == 1, g("imbalance/", size, "g/")).when(k % 7 == 2, g("horizontal-misalignment/0,", 50 + size, "mm/")).when(k % 7 == 3, g("vertical-misalignment/1,", 20 + size, "mm/")).when(k % 7 == 4, g("underhang/ball_fault/", size, "g/")).when(k % 7 == 5, g("overhang/cage_fault/", size, "g/")).otherwise(g("overhang/outer_race/", size, "g/"))
    paths = table(spark, sf_dir, "part").select("p_partkey", g("/data/", folder, k % 60, ".", 100 + k % 800, ".csv").alias("path"))
    return recordings.parse_path(paths).drop("path")


W = 10
_PAD = f"""{SIGNAL_SQL}, w AS (SELECT rec, i, x, first_value(x) OVER (PARTITION BY rec ORDER BY i) AS x0, list(x) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS l FROM sig),
 pad AS (SELECT rec, i, x, list_concat(list_transform(range(0, {W} - len(l)), lambda z: x0), l) AS l FROM w)"""


@query(f"WITH {_PAD} SELECT rec, i, round(list_sum(l)/{W}, 6) AS roll_mean FROM pad")
def roll_mean_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.padded_stats(signal(spark, sf_dir), W).select("rec", "i", F.round("roll_mean", 6).alias("roll_mean"))


@query(f"WITH {_PAD} SELECT rec, i, round(list_stddev_pop(l), 6) AS roll_std FROM pad")
def roll_std_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.padded_stats(signal(spark, sf_dir), W).select("rec", "i", F.round("roll_std", 6).alias("roll_std"))


@query(f"WITH {_PAD} SELECT rec, i, round(list_sum(l)/{W}, 6) AS roll_mean, round(x - list_sum(l)/{W}, 6) AS centred, round(list_stddev_pop(l), 6) AS roll_std FROM pad")
def time_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.padded_stats(signal(spark, sf_dir), W)
    return s.select("rec", "i", F.round("roll_mean", 6).alias("roll_mean"), F.round(F.col("x") - F.col("roll_mean"), 6).alias("centred"), F.round("roll_std", 6).alias("roll_std"))


@query(f"WITH {_PAD} SELECT rec, i, " + ", ".join(f"l[{k + 1}] AS t{k}" for k in range(W)) + " FROM pad WHERE i % 2 = 0")
def lag_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window j of step 2 covers the samples up to 2j, padded in front with the first sample."""
    s = windows.padded(signal(spark, sf_dir), W, 2)
    return s.select("rec", "i", *(F.col("window")[k].alias(f"t{k}") for k in range(W)))


KINDS_SQL = "(SELECT kind, dense_rank() OVER (ORDER BY kind) - 1 AS code FROM (SELECT DISTINCT event_type AS kind FROM events))"


@query(
    f"""WITH {SIGNAL_SQL}, s AS (SELECT rec, i, code FROM sig JOIN {KINDS_SQL} USING (kind)),
 p AS (SELECT a.rec, a.i, coalesce(b.code, c.code) AS code FROM s a CROSS JOIN (SELECT unnest(range(0, 9)) AS o) o LEFT JOIN s b ON b.rec = a.rec AND b.i = a.i - o JOIN s c ON c.rec = a.rec AND c.i = 0),
 n AS (SELECT rec, i, code, count(*) AS n FROM p GROUP BY 1, 2, 3)
 SELECT rec, i, CAST(code AS BIGINT) AS mode FROM (SELECT *, row_number() OVER (PARTITION BY rec, i ORDER BY n DESC, code) AS r FROM n) WHERE r = 1"""
)
def mode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    kinds = s.select("kind").distinct().agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    coded = s.crossJoin(F.broadcast(kinds)).withColumn("x", (F.array_position("kinds", F.col("kind")) - 1).cast("bigint")).drop("kinds")
    return windows.mode_filter(coded, 9).select("rec", "i", "mode")


_ROLL = ("mean", "median", "std", "min", "max", "skew", "kurtosis", "q25", "q75")
_ROLL_SQL = """avg(x) OVER w AS mean, median(x) OVER w AS median, stddev_samp(x) OVER w AS std, min(x) OVER w AS min, max(x) OVER w AS max,
 (avg(x*x*x) OVER w - 3*(avg(x) OVER w)*(avg(x*x) OVER w) + 2*pow(avg(x) OVER w, 3))/nullif(pow(stddev_pop(x) OVER w, 3), 0) AS skew,
 kurtosis_pop(x) OVER w AS kurtosis, quantile_cont(x, 0.25) OVER w AS q25, quantile_cont(x, 0.75) OVER w AS q75, count(*) OVER w AS n"""


def _rolling_sql(frame: str) -> str:
    cols = ", ".join(f"CASE WHEN n = 10 THEN round({c}, 6) END AS x_{c}" for c in _ROLL)
    return f"WITH {SIGNAL_SQL}, r AS (SELECT rec, i, {_ROLL_SQL} FROM sig WINDOW w AS (PARTITION BY rec ORDER BY i {frame})) SELECT rec, i, {cols} FROM r"


@query(_rolling_sql("ROWS BETWEEN 9 PRECEDING AND CURRENT ROW"))
def rolling_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling_bank(signal(spark, sf_dir), 10).select("rec", "i", *(F.round(f"x_{c}", 6).alias(f"x_{c}") for c in _ROLL))


@query(_rolling_sql("ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING"))
def rolling_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling_bank(signal(spark, sf_dir), 10, center=True).select("rec", "i", *(F.round(f"x_{c}", 6).alias(f"x_{c}") for c in _ROLL))


@query(f"WITH {SIGNAL_SQL} SELECT rec, CAST(i // 25 AS BIGINT) AS bin, round(avg(x), 6) AS x FROM sig GROUP BY 1, 2")
def downsample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.downsample(signal(spark, sf_dir), 25).select("rec", "bin", F.round("x", 6).alias("x"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).withColumn("x", F.when(F.col("event_id") % 5 != 0, F.col("x")))


def _interp_sql(at: str) -> str:
    return f"""WITH {SIGNAL_SQL}, g AS (SELECT rec, i, {at} AS t, CASE WHEN event_id % 5 <> 0 THEN x END AS x FROM sig),
 n AS (SELECT *, last_value(x IGNORE NULLS) OVER p AS x0, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0,
 first_value(x IGNORE NULLS) OVER f AS x1, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1 FROM g
 WINDOW p AS (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY rec ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT rec, i, round(CASE WHEN x IS NOT NULL THEN x WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 ELSE x0 + (x1-x0)*(t-t0)/(t1-t0) END, 6) AS x FROM n"""


@query(_interp_sql("CAST(i AS DOUBLE)"))
def linear_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.linear_interp(_gaps(spark, sf_dir)).select("rec", "i", F.round("x", 6).alias("x"))


@query(_interp_sql("CAST(i*i + 3*i AS DOUBLE)"))
def linear_interp_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _gaps(spark, sf_dir).withColumn("t", (F.col("i") * F.col("i") + 3 * F.col("i")).cast("double"))
    return windows.linear_interp(s, at="t").select("rec", "i", F.round("x", 6).alias("x"))


@query(f"WITH {SIGNAL_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY rec) AS n FROM sig) SELECT rec, i, round(x, 6) AS x FROM n WHERE i < n - n % 16")
def truncate_pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.truncate(signal(spark, sf_dir), 4).select("rec", "i", F.round("x", 6).alias("x"))


@query(f"WITH {SIGNAL_SQL}, n AS (SELECT rec, max(i) AS m, max_by(x, i) AS x FROM sig GROUP BY rec) SELECT rec, i, round(x, 6) AS x FROM sig UNION ALL SELECT rec, m + k AS i, round(x, 6) AS x FROM n, (SELECT unnest(range(1, 6)) AS k) ks")
def pad_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pad_last(signal(spark, sf_dir), 5).select("rec", "i", F.round("x", 6).alias("x"))


def _median_sql(size: int) -> str:
    """A mirrored border of size samples on either side, then the median of size values."""
    half = size // 2
    return f"""n AS (SELECT rec, i, x, count(*) OVER (PARTITION BY rec) AS n FROM sig),
 e AS (SELECT rec, i AS j, x FROM n UNION ALL SELECT rec, -1 - i, x FROM n WHERE i < {size} UNION ALL SELECT rec, 2*n - 1 - i, x FROM n WHERE i >= {size} AND i >= n - {half}),
 m AS (SELECT rec, j, median(x) OVER (PARTITION BY rec ORDER BY j ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS y FROM e)
 SELECT m.rec, m.j AS i, round(y, 6) AS y FROM m JOIN n ON n.rec = m.rec AND n.i = m.j"""


@query(f"WITH {SIGNAL_SQL}, {_median_sql(5)}")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.median_filter(signal(spark, sf_dir), 5).select("rec", "i", F.round("y", 6).alias("y"))


@query()
def median_filter_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best size of each recording to tell the kind 'click' from a score; rows by test, not SQL."""
    s = signal(spark, sf_dir).withColumn("score", F.col("x") / (F.col("x") + 50)).withColumn("label", (F.col("kind") == "click").cast("int"))
    return sequential.fit_median_size(s)


P_SQL = "s AS (SELECT rec, i, 0.05 + 0.9*x/(x+50) AS p FROM sig)"
_SPRT_SQL = f"""RECURSIVE {SIGNAL_SQL}, {P_SQL}, l AS (SELECT rec, i, ln(p) - ln(1-p) AS l FROM s),
 r AS (SELECT rec, i, CASE WHEN l > ln(9.0) OR l < ln(0.1/0.9) THEN l ELSE l END AS acc, CASE WHEN l > ln((1-0.1)/0.1) THEN 1 WHEN l < ln(0.1/(1-0.1)) THEN -1 ELSE 0 END AS label FROM l WHERE i = 0
 UNION ALL SELECT l.rec, l.i, CASE WHEN r.acc + l.l > ln((1-0.1)/0.1) OR r.acc + l.l < ln(0.1/(1-0.1)) THEN l.l ELSE r.acc + l.l END, CASE WHEN r.acc + l.l > ln((1-0.1)/0.1) THEN 1 WHEN r.acc + l.l < ln(0.1/(1-0.1)) THEN -1 ELSE 0 END FROM r JOIN l ON l.rec = r.rec AND l.i = r.i + 1)"""


def _probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).withColumn("p", 0.05 + 0.9 * F.col("x") / (F.col("x") + 50))


@query(f"WITH {_SPRT_SQL} SELECT rec, i, CAST(label AS BIGINT) AS label FROM r")
def sprt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.sprt(_probability(spark, sf_dir), "p").select("rec", "i", F.col("label").cast("bigint").alias("label"))


@query(
    f"""WITH {_SPRT_SQL}, q AS (SELECT rec, i, label, last_value(nullif(label,0) IGNORE NULLS) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 first_value(nullif(label,0) IGNORE NULLS) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM r)
 SELECT rec, i, CAST(CASE WHEN label = 0 THEN coalesce(before, 0) ELSE coalesce(after, label) END AS BIGINT) AS label FROM q"""
)
def sprt_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.propagate(sequential.sprt(_probability(spark, sf_dir), "p")).select("rec", "i", F.col("label").cast("bigint").alias("label"))


@query("SELECT a.user_id AS rec, a.n, round(a.mu, 6) AS Mu, round(b.top, 6) AS top FROM (SELECT user_id, count(*) AS n, avg(value) AS mu FROM events GROUP BY 1) a JOIN (SELECT user_id, max(value) AS top FROM events WHERE event_type = 'click' GROUP BY 1) b USING (user_id)")
def unify_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feature tables joined on the recording, not on a row number that two listings may not share."""
    e = table(spark, sf_dir, "events")
    a = e.groupBy(F.col("user_id").alias("rec")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("Mu"))
    b = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("rec")).agg(F.round(F.max("value"), 6).alias("top"))
    return a.join(b, "rec")


@query("WITH u AS (SELECT event_type AS kind, value AS x FROM events UNION ALL SELECT event_type, value*2 FROM events WHERE event_type = 'view') SELECT kind, count(*) AS n, round(sum(x), 4) AS total FROM u GROUP BY kind")
def union_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("x"))
    both = e.unionByName(e.where("kind = 'view'").withColumn("x", F.col("x") * 2))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query("SELECT event_id FROM events EXCEPT SELECT event_id FROM events WHERE value > 100")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id").distinct().join(e.where("value > 100").select("event_id"), "event_id", "left_anti")


@query(
    f"""WITH {SIGNAL_SQL}, g AS (SELECT rec, i, CASE WHEN event_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE x END AS x FROM sig)
 SELECT rec, count(*) AS valid FROM g WHERE NOT isnan(x) GROUP BY rec"""
)
def nan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir).withColumn("x", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("x")))
    return s.where(~F.isnan("x") & F.col("x").isNotNull()).groupBy("rec").agg(F.count(F.lit(1)).alias("valid"))


# Noise: uniforms from md5, so that every engine draws the same numbers.
def _noise_sql(copies: int) -> str:
    return f"""{SIGNAL_SQL}, pw AS (SELECT rec, avg(x*x)/pow(10, 20/10.0) AS v FROM sig GROUP BY rec),
 u AS (SELECT sig.rec, i, x, c, v, (('0x' || substr(md5('a' || event_id || '_' || c), 1, 8))::BIGINT + 0.5)/4294967296.0 AS u1, (('0x' || substr(md5('b' || event_id || '_' || c), 1, 8))::BIGINT + 0.5)/4294967296.0 AS u2 FROM sig JOIN pw USING (rec), (SELECT unnest(range(1, {copies + 1})) AS c) cs)"""


@query(f"WITH {_noise_sql(1)} SELECT rec, i, round(x + sqrt(v)*sqrt(-2*ln(u1))*cos(2*pi()*u2), 6) AS x FROM u")
def snr_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.add_noise(signal(spark, sf_dir), 20.0, 1).select("rec", "i", F.round("x", 6).alias("x"))


@query()
def augment_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies, each the one before with noise of its own power added again."""
    return windows.augment(signal(spark, sf_dir), 20.0, 3).select("rec", "i", "copy", F.round("x", 6).alias("x"))


@query("SELECT event_type AS kind, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY event_type")
def label_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    # The window spans one row per label, not the samples.
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))
