"""Window operators on ordered samples (rec, i, x): rolling, padded, resampled, mirrored, noisy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(by: str = "rec"):
    return Window.partitionBy(by).orderBy("i")


def padded(s: DataFrame, size: int, step: int = 1) -> DataFrame:
    """Adds window: the last size samples, the first sample standing in for those before it; every step-th row."""
    w = _order().rowsBetween(-(size - 1), 0)
    got, first = F.collect_list("x").over(w), F.first("x").over(_order().rowsBetween(Window.unboundedPreceding, 0))
    out = s.withColumns({"_l": got, "_x0": first}).withColumn("window", F.concat(F.array_repeat("_x0", F.lit(size) - F.size("_l")), F.col("_l"))).drop("_l", "_x0")
    return out.where(F.col("i") % step == 0) if step > 1 else out


def padded_stats(s: DataFrame, size: int) -> DataFrame:
    """Adds roll_mean and roll_std (population) of the padded window, from its frame's aggregates.

    The padding is a second group of equal values, so its part is added by the rule for pooled
    variances and no window is materialised.
    """
    w = _order().rowsBetween(-(size - 1), 0)
    first = F.first("x").over(_order().rowsBetween(Window.unboundedPreceding, 0))
    out = s.withColumns({"_n": F.count("x").over(w), "_m": F.avg("x").over(w), "_v": F.var_pop("x").over(w), "_x0": first})
    share = F.col("_n") / size
    mean = share * F.col("_m") + (1 - share) * F.col("_x0")
    gap = F.col("_m") - F.col("_x0")
    return out.withColumns({"roll_mean": mean, "roll_std": F.sqrt(share * F.col("_v") + share * (1 - share) * gap * gap)}).drop("_n", "_m", "_v", "_x0")


def mode_filter(s: DataFrame, size: int) -> DataFrame:
    """Adds mode of the padded window of non-negative integers; the smallest of the most frequent."""
    w = padded(s, size)
    counts = F.transform(F.array_sort(F.array_distinct("window")), lambda v: F.struct(F.size(F.filter("window", lambda y: y == v)).alias("n"), (-v).alias("v")))
    return w.withColumn("mode", -F.array_max(counts)["v"]).drop("window")


def rolling_bank(s: DataFrame, size: int, center: bool = False, column: str = "x") -> DataFrame:
    """Nine rolling statistics of full windows, trailing or centred; others are null."""
    back = size // 2 if center else size - 1
    w = _order().rowsBetween(-back, size - 1 - back)
    x = F.col(column)
    cols = {
        "mean": F.avg(x).over(w),
        "median": F.percentile(x, F.lit(0.5)).over(w),
        "std": F.stddev_samp(x).over(w),
        "min": F.min(x).over(w),
        "max": F.max(x).over(w),
        "skew": F.skewness(x).over(w),
        "kurtosis": F.kurtosis(x).over(w),
        "q25": F.percentile(x, F.lit(0.25)).over(w),
        "q75": F.percentile(x, F.lit(0.75)).over(w),
    }
    full = F.count(x).over(w) == size
    return s.withColumns({f"{column}_{k}": F.when(full, c) for k, c in cols.items()})


def downsample(s: DataFrame, rate: int) -> DataFrame:
    """(rec, bin, x): means of rate consecutive samples."""
    return s.groupBy("rec", F.floor(F.col("i") / rate).cast("bigint").alias("bin")).agg(F.avg("x").alias("x"))


def elapsed(s: DataFrame, rate: float, into: str = "t") -> DataFrame:
    """Adds the time since the first sample as an interval; rate is in samples a second."""
    return s.withColumn(into, F.make_dt_interval(secs=(F.col("i") / F.lit(float(rate))).cast("decimal(18,6)")))


def linear_interp(s: DataFrame, at: str | None = None) -> DataFrame:
    """Fills null and NaN samples on the line between their valid neighbours, flat beyond the ends."""
    t = F.col(at) if at else F.col("i").cast("double")
    x = F.when(~F.isnan("x"), F.col("x"))
    back, ahead = _order().rowsBetween(Window.unboundedPreceding, 0), _order().rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({"_x": x, "_t": t}).withColumn("_tv", F.when(F.col("_x").isNotNull(), F.col("_t")))
    s = s.withColumns({"_x0": F.last("_x", True).over(back), "_t0": F.last("_tv", True).over(back), "_x1": F.first("_x", True).over(ahead), "_t1": F.first("_tv", True).over(ahead)})
    line = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * F.try_divide(F.col("_t") - F.col("_t0"), F.col("_t1") - F.col("_t0"))
    return s.withColumn("x", F.coalesce("_x", line, "_x0", "_x1")).drop("_x", "_t", "_tv", "_x0", "_t0", "_x1", "_t1")


def truncate(s: DataFrame, level: int) -> DataFrame:
    """Drops the tail that keeps the length of a recording from being a multiple of 2**level."""
    n = F.count(F.lit(1)).over(Window.partitionBy("rec"))
    return s.withColumn("_n", n).where(F.col("i") < F.col("_n") - F.col("_n") % (1 << level)).drop("_n")


def pad_last(s: DataFrame, size: int) -> DataFrame:
    """(rec, i, x) with the last sample repeated size times."""
    last = s.groupBy("rec").agg(F.max("i").alias("_m"), F.max_by("x", "i").alias("x"))
    more = last.select("rec", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("_k"), "_m", "x").select("rec", (F.col("_m") + F.col("_k")).alias("i"), "x")
    return s.select("rec", "i", "x").unionByName(more)


def median_filter(s: DataFrame, size: int) -> DataFrame:
    """(rec, i, y): median of size samples (odd) with mirrored borders, zeros beyond the mirror.

    The border in front mirrors the first size samples and that behind the samples from size on.
    """
    half = size // 2
    xs = s.groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("xs"))
    n = F.size("xs")
    front = F.reverse(F.slice("xs", 1, half))
    behind = F.slice(F.reverse(F.slice("xs", size + 1, F.greatest(n - size, F.lit(0)))), 1, half)
    ext = F.concat(front, F.col("xs"), behind, F.array_repeat(F.lit(0.0), F.lit(half) - F.size(behind)))
    rows = xs.select("rec", ext.alias("e"), n.alias("n")).select("rec", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda j: F.array_sort(F.slice("e", j, size))[half])).alias("i", "y"))
    return rows.select("rec", F.col("i").cast("bigint").alias("i"), "y")


def _uniform(tag: str, copy: Column) -> Column:
    """In (0, 1), from the md5 of the sample and the copy."""
    digits = F.substring(F.md5(F.concat(F.lit(tag), F.col("event_id").cast("string"), F.lit("_"), copy.cast("string"))), 1, 8)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / 4294967296.0


def _normal(copy: Column) -> Column:
    return F.sqrt(-2 * F.ln(_uniform("a", copy))) * F.cos(2 * math.pi * _uniform("b", copy))


def add_noise(s: DataFrame, snr_db: float, copy: int = 1) -> DataFrame:
    """x plus normal noise whose power lies snr_db below that of the recording."""
    power = F.avg(F.col("x") * F.col("x")).over(Window.partitionBy("rec"))
    return s.withColumn("x", F.col("x") + F.sqrt(power / 10 ** (snr_db / 10)) * _normal(F.lit(copy)))


def augment(s: DataFrame, snr_db: float, copies: int) -> DataFrame:
    """Copies 1 to copies of each recording; copy c is copy c - 1 with noise added to it.

    The noise of a copy needs the power of the one before, so copies are columns made one after the
    other on the same partitioning, and rows are multiplied last.
    """
    w = Window.partitionBy("rec")
    last = F.col("x")
    for c in range(1, copies + 1):
        s = s.withColumn(f"_p{c}", F.avg(last * last).over(w))
        s = s.withColumn(f"_c{c}", last + F.sqrt(F.col(f"_p{c}") / 10 ** (snr_db / 10)) * _normal(F.lit(c)))
        last = F.col(f"_c{c}")
    out = s.select("rec", "i", F.posexplode(F.array(*(f"_c{c}" for c in range(1, copies + 1)))).alias("_k", "x"))
    return out.select("rec", "i", (F.col("_k") + 1).cast("bigint").alias("copy"), "x")
