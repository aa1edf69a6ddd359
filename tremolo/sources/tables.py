"""The driver's tables as recordings and feature matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples (rec, i, x, kind, event_id): the events of a user in the order of time."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("rec"), (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.col("value").alias("x"), F.col("event_type").alias("kind"), "event_id", "ts")


SIGNAL_SQL = "sig AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x, event_type AS kind, event_id, ts FROM events)"


def arrays(samples: DataFrame, by: str = "rec") -> DataFrame:
    """(rec, xs): the samples of each recording as one array in order; the recording is the unit of work."""
    got = F.array_sort(F.collect_list(F.struct("i", "x")))
    return samples.groupBy(by).agg(F.transform(got, lambda s: s["x"]).alias("xs"))


def vectors(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """(id, v, label): embeddings as arrays of doubles, their first dims if asked."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.slice(v, 1, dims) if dims else v).alias("v"), F.col("label").cast("bigint").alias("label"))


def vectors_sql(dims: int = 64) -> str:
    """(id, label, k, a): the vectors in long form, k from 1."""
    return f"vec AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, k, CAST(embedding[k] AS DOUBLE) AS a FROM embeddings, (SELECT unnest(range(1, {dims + 1})) AS k) ks)"
