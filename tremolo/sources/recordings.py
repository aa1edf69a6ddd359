"""Sources and sinks of machine recordings: CSV trees, feature tables, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data format: channels, classes and bearing faults, in the order of their codes.
CHANNELS = ("TCH", "IAA", "IRA", "ITA", "EAA", "ERA", "ETA", "MIC")
CLASSES = ("normal", "imbalance", "horizontal-misalignment", "vertical-misalignment", "underhang", "overhang")
FAULTS = ("cage_fault", "outer_race", "ball_fault")
LABEL_COLUMNS = ("Fr", "RotFreq", "Weigth", "Shift", "Bearing", "Class")

RECORDING_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in CHANNELS])


def read_recordings(spark: SparkSession, root: str) -> DataFrame:
    """Every headerless CSV below root, one row per sample, with its path and its metadata.

    Samples are numbered within a file by the reader's row order, which holds for a file that one
    task reads; multiLine keeps each file whole.
    """
    raw = spark.read.schema(RECORDING_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("multiLine", True).csv(root, header=False)
    numbered = raw.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_at"), "*")
    first = F.min("_at").over(Window.partitionBy("path"))
    return parse_path(numbered.withColumn("i", F.col("_at") - first).drop("_at"), "path")


def read_anonymous(spark: SparkSession, path: str, columns: int = 8) -> DataFrame:
    """A headerless CSV under the names _c0, _c1 and so on."""
    schema = T.StructType([T.StructField(f"_c{i}", T.DoubleType()) for i in range(columns)])
    return spark.read.schema(schema).csv(path, header=False)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A headered feature table; Sample is its index."""
    return spark.read.csv(path, header=True, inferSchema=True)


def with_sample(df: DataFrame, *order: str) -> DataFrame:
    """Adds Sample, numbered from 0 in the given order.

    Ranges are sorted in parallel, and each range starts from the count of those before it, so no
    task sees all rows. The ends of the ranges are fixed first, from rows of least hash: what
    repartitionByRange draws differs from one reading of the plan to the next, so that rows were
    counted by other ranges than they were numbered in.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*order)
    drawn = keys.orderBy(F.xxhash64(*order), *order).limit(100 * n).orderBy(*order).collect()
    ends = [drawn[k * len(drawn) // n] for k in range(1, n)] if drawn else []
    row, each = F.struct(*order), [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, keys.schema, strict=True))) for r in ends]
    tagged = df.withColumn("_p", F.size(F.filter(F.array(*each), lambda end: end < row)) if each else F.lit(0))
    counts = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_start"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return tagged.join(F.broadcast(starts), "_p").withColumn("Sample", F.col("_start") + at - 1).drop("_p", "_start")


def write_features(df: DataFrame, path: str, *order: str, form: str = "csv") -> None:
    """Writes a feature table with its Sample index, as CSV with header or as Parquet."""
    out = with_sample(df, *order)
    out = out.select("Sample", *[c for c in df.columns])
    writer = out.write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.format(form).save(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("y_pred", "y_test").write.mode("overwrite").csv(path, header=True)


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """Train and test rows of one table, a folder each."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def memoised(spark: SparkSession, path: str, build, refresh: bool = False) -> DataFrame:
    """The table at path; built and written first if it isn't there or refresh is asked for."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
    if refresh or not there:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _component(path: Column, names: tuple[str, ...]) -> Column:
    return F.regexp_extract(path, "/(" + "|".join(names) + ")/", 1)


def code_of(name: Column, names: tuple[str, ...]) -> Column:
    """Index of a name among names, null if it isn't one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), name) - 1, F.lit(-1).cast("bigint"))


def parse_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds Class, Bearing, RotFreq, Weigth and Shift as the path tells them.

    Weights ('20g') belong to imbalance and bearing classes, shifts ('0,51mm') to misalignments;
    Bearing is null where no fault is named.
    """
    p = F.col(path)
    kind = _component(p, CLASSES)
    parent = F.element_at(F.split(p, "/"), -2)
    code = code_of(kind, CLASSES)
    weight = F.regexp_extract(parent, r"^([0-9.]+)g$", 1)
    shift = F.replace(F.regexp_extract(parent, r"^([0-9,.]+)mm$", 1), F.lit(","), F.lit("."))
    return df.withColumns(
        {
            "Class": code,
            "Bearing": code_of(_component(p, FAULTS), FAULTS),
            "RotFreq": F.regexp_extract(p, r"([0-9]+(?:\.[0-9]+)?)\.csv$", 1).try_cast("double"),
            "Weigth": F.when(code.isin(1, 4, 5), F.coalesce(weight.try_cast("double"), F.lit(0.0))).otherwise(0.0),
            "Shift": F.when(code.isin(2, 3), F.coalesce(shift.try_cast("double"), F.lit(0.0))).otherwise(0.0),
        }
    )
