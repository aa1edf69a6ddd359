"""Queries on splits, evaluation, balancing, search and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.operators import learning
from tremolo.plans.registry import query
from tremolo.sources.tables import SIGNAL_SQL, table, vectors
from tremolo.streaming import flows

_BUCKET = "('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 100"
_SPLIT = f"s AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CASE WHEN {_BUCKET} < 20 THEN 'test' ELSE 'train' END AS split FROM embeddings)"


@query(f"WITH {_SPLIT} SELECT id, label, split FROM s")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.split(vectors(spark, sf_dir)).select("id", "label", "split")


@query(
    f"""WITH {_SPLIT}, c AS (SELECT label, count(*) AS n, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM s GROUP BY label)
 SELECT label, round(100.0*n/sum(n) OVER (), 6) AS "all", round(100.0*a/sum(a) OVER (), 6) AS train, round(100.0*b/sum(b) OVER (), 6) AS test FROM c"""
)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = learning.label_shares(learning.split(vectors(spark, sf_dir)))
    return d.select("label", *(F.round(c, 6).alias(c) for c in ("all", "train", "test")))


# A fixed rule stands for a classifier: the class whose index is the place of the first component in [-1, 1].
_PRED = "p AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(CASE WHEN CAST(embedding[1] AS DOUBLE) > 0 THEN label ELSE (label + 1 + vec_id % 3) % 10 END AS BIGINT) AS predicted FROM embeddings)"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir, 1)
    return df.select("id", "label", F.when(F.col("v")[0] > 0, F.col("label")).otherwise((F.col("label") + 1 + F.col("id") % 3) % 10).alias("predicted"))


@query(f"WITH {_PRED} SELECT label, predicted, count(*) AS n FROM p GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.confusion(_predicted(spark, sf_dir)).select("label", "predicted", "n")


@query(f"WITH {_PRED}, c AS (SELECT label, predicted, count(*) AS n FROM p GROUP BY 1, 2) SELECT label, predicted, round(n/sum(n) OVER (PARTITION BY label), 6) AS share FROM c")
def confusion_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.confusion(_predicted(spark, sf_dir)).select("label", "predicted", F.round("share", 6).alias("share"))


_REPORT = f"""{_PRED}, k AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT predicted FROM p),
 t AS (SELECT c, count(*) FILTER (label = c AND predicted = c) AS tp, count(*) FILTER (label = c) AS support, count(*) FILTER (predicted = c) AS made FROM p, k GROUP BY c),
 r AS (SELECT c AS label, coalesce(tp/nullif(made, 0), 0) AS prec, coalesce(tp/nullif(support, 0), 0) AS rec, coalesce(2.0*tp/nullif(made + support, 0), 0) AS f1, support FROM t)"""


@query(f"WITH {_REPORT} SELECT label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, support FROM r")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = learning.report(_predicted(spark, sf_dir))
    return r.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(
    f"""WITH {_REPORT} SELECT CAST(label AS VARCHAR) AS label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r
 UNION ALL SELECT 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r
 UNION ALL SELECT 'weighted avg', round(sum(prec*support)/sum(support), 6), round(sum(rec*support)/sum(support), 6), round(sum(f1*support)/sum(support), 6), CAST(sum(support) AS BIGINT) FROM r"""
)
def report_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = learning.report_with_averages(_predicted(spark, sf_dir))
    return r.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {_REPORT}, a AS (SELECT avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) AS acc, count(*) AS n FROM p) SELECT round(acc, 6) AS accuracy, round((SELECT avg(f1) FROM r), 6) AS f1_macro, round(acc, 6) AS f1_micro, n FROM a")
def f1_macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = learning.scores(_predicted(spark, sf_dir))
    return s.select(*(F.round(c, 6).alias(c) for c in ("accuracy", "f1_macro", "f1_micro")), "n")


@query("WITH v AS (SELECT user_id AS id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS vote, value AS w FROM events), s AS (SELECT id, vote, sum(w) AS w FROM v GROUP BY 1, 2) SELECT id, CAST(arg_max(vote, (w, -vote)) AS BIGINT) AS vote FROM s GROUP BY id")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2).cast("bigint").alias("vote"), F.col("value").alias("weight"))
    return learning.weighted_vote(votes)


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.with_features(learning.split(vectors(spark, sf_dir)))


@query()
def pca_variance_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, explained = learning.components_for(_train(spark, sf_dir))
    return spark.createDataFrame([(k, round(sum(explained[:k]), 5))], "components int, share double")


@query()
def rf_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated depth of a forest after scaling and components; predictions of the test part."""
    df = _train(spark, sf_dir)
    f = learning.forest(trees=10, depth=4, k=6)
    from pyspark.ml.tuning import ParamGridBuilder

    grid = ParamGridBuilder().addGrid(f.getStages()[-1].maxDepth, [3, 5]).build()
    best, _ = learning.cross_validated(df.where("split = 'train'"), f, grid, folds=10)
    return best.transform(df.where("split = 'test'")).select("id", F.col("label").cast("bigint").alias("label"), F.col("prediction").cast("bigint").alias("predicted"))


@query()
def gbt_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _train(spark, sf_dir)
    m = learning.boosted(depth=3, rounds=3).fit(df.where("split = 'train'"))
    return m.transform(df.where("split = 'test'")).select("id", F.col("label").cast("bigint").alias("label"), F.col("prediction").cast("bigint").alias("predicted"))


@query()
def bayes_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and size of a forest chosen by a Gaussian process on held-out accuracy."""
    df = _train(spark, sf_dir).cache()
    train, test = df.where("split = 'train'"), df.where("split = 'test'")

    def score(p: dict[str, float]) -> float:
        m = learning.forest(int(p["trees"]), int(p["depth"])).fit(train)
        return m.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]

    best, value = learning.bayes_search(score, {"trees": (2, 8), "depth": (2, 6)}, steps=1, start=2)
    df.unpersist()
    return spark.createDataFrame([(int(best["trees"]), int(best["depth"]), round(value, 5))], "trees int, depth int, accuracy double")


@query()
def rusboost(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _train(spark, sf_dir)
    models, weights = learning.rusboost(df, 0, rounds=2, trees=3)
    return learning.boosted_votes(df, models, weights)


EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.select(F.col("user_id").alias("rec"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"))


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tremolo-")
    base = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    return f"{base}/out", f"{base}/state"


@query("WITH s AS (SELECT user_id AS rec, time_bucket(INTERVAL '1 day', ts) AS start, value AS x FROM events) SELECT rec, strftime(start, '%Y-%m-%d') AS start, round(avg(x), 6) AS mean, count(*) AS n FROM s GROUP BY rec, s.start HAVING s.start + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'")
def stream_tumbling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of a stream, each window written as Parquet once the watermark, an hour late, has passed it."""
    daily = flows.tumbling_means(_stream(spark, sf_dir), "1 day", "1 hour")
    closed = flows.run_to_end(daily, *_folders(spark, "tumbling"))
    return closed.select("rec", F.date_format("start", "yyyy-MM-dd").alias("start"), F.round("mean", 6).alias("mean"), "n")


@query(
    f"""WITH RECURSIVE {SIGNAL_SQL}, l AS (SELECT rec, event_id, i, ln(0.05 + 0.9*x/(x+50)) - ln(1 - (0.05 + 0.9*x/(x+50))) AS l FROM sig),
 r AS (SELECT rec, event_id, i, l AS acc, CASE WHEN l > ln(9) THEN 1 WHEN l < -ln(9) THEN -1 ELSE 0 END AS label FROM l WHERE i = 0
 UNION ALL SELECT l.rec, l.event_id, l.i, CASE WHEN abs(r.acc + l.l) > ln(9) THEN l.l ELSE r.acc + l.l END, CASE WHEN r.acc + l.l > ln(9) THEN 1 WHEN r.acc + l.l < -ln(9) THEN -1 ELSE 0 END FROM r JOIN l ON l.rec = r.rec AND l.i = r.i + 1)
 SELECT rec, event_id, CAST(label AS BIGINT) AS label FROM r"""
)
def stream_sprt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir).withColumn("p", 0.05 + 0.9 * F.col("x") / (F.col("x") + 50))
    return flows.run_to_end(flows.stateful_sprt(s), *_folders(spark, "sprt"))


@query("SELECT user_id AS rec, count(*) AS n FROM events WHERE value >= 5 AND value <= 700 GROUP BY user_id")
def band_filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inclusive range reaches the scan as a pushed filter."""
    return table(spark, sf_dir, "events").where(F.col("value").between(5, 700)).groupBy(F.col("user_id").alias("rec")).agg(F.count(F.lit(1)).alias("n"))
