"""Queries on sample vectors: kernels, distances, monitors, detectors, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.functions import kernels
from tremolo.operators import cluster, monitors, similarity
from tremolo.operators import vectors as vec
from tremolo.plans.registry import query
from tremolo.sources.tables import vectors

D64 = "v AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, list_transform(embedding[1:64], lambda z: CAST(z AS DOUBLE)) AS v FROM embeddings)"


def _dist(a: str, b: str, dims: int = 64) -> str:
    return f"sqrt(list_sum(list_transform(range(1, {dims + 1}), lambda q: pow({a}[q] - {b}[q], 2))))"


_SIM_SQL = {"IES": "1/(1+0.5*d)", "RBF": "exp(-0.5*d*d)", "EXP": "exp(-0.5*d)", "IMK": "1/sqrt(1+pow(0.5*d,2))", "CCK": "1/(1+pow(0.5*d,2))"}
_TO_FIRST = f"WITH {D64}, d AS (SELECT v.id, {_dist('v.v', 'z.v')} AS d, list_transform(range(1, 65), lambda q: v.v[q] - z.v[q]) AS g FROM v, (SELECT v FROM v WHERE id = (SELECT min(id) FROM v)) z)"


def _first(df: DataFrame) -> list[float]:
    """The vector of least id: one row, whatever the table's size."""
    return list(df.orderBy("id").limit(1).first().v)


def _kernel_query(name: str):
    @query(f"{_TO_FIRST} SELECT id, round({_SIM_SQL[name]}, 6) AS sim FROM d", f"kernel_{name.lower()}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = vectors(spark, sf_dir)
        d = kernels.minkowski(F.col("v"), F.array(*map(F.lit, _first(df))))
        return df.select("id", F.round(kernels.similarity(d, name, 0.5), 6).alias("sim"))


for _k in kernels.KERNELS:
    _kernel_query(_k)

_GRAD_SQL = {"IES": "CASE WHEN d > 2.220446049250313e-16 THEN s/d ELSE 0 END", "RBF": "2", "EXP": "1/nullif(d, 0)", "IMK": "2*0.5*s", "CCK": "2*0.5*s"}


@query(
    f"{_TO_FIRST}, k AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kernel, id, d, g, {_SIM_SQL[k]} AS s FROM d" for k in kernels.KERNELS) + "), f AS (SELECT *, CASE kernel " + " ".join(f"WHEN '{k}' THEN {e}" for k, e in _GRAD_SQL.items()) + " END AS f FROM k) SELECT kernel, id, " + ", ".join(f"round(-0.5*g[{j + 1}]*s*f, 6) + 0 AS g{j}" for j in range(64)) + " FROM f"
)
def kernel_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    diff = df.withColumn("d", kernels.difference(F.col("v"), F.array(*map(F.lit, _first(df)))))
    each = [F.struct(F.lit(k).alias("kernel"), kernels.gradient(F.col("d"), k, 0.5).alias("g")) for k in kernels.KERNELS]
    return diff.select("id", F.explode(F.array(*each)).alias("x")).select("x.kernel", "id", *((F.round(F.col("x.g")[j], 6) + 0).alias(f"g{j}") for j in range(64)))


@query(f"WITH {D64} SELECT a.id AS a, b.id AS b, round(pow(list_sum(list_transform(range(1, 65), lambda q: pow(abs(a.v[q] - b.v[q]), 3))), 1/3.0), 6) AS d FROM v a JOIN v b ON a.id < b.id")
def pairwise_minkowski(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec.pairs(vectors(spark, sf_dir), 3, 6)


_COV2 = "m AS (SELECT avg(v[1]) AS m1, avg(v[2]) AS m2, var_samp(v[1]) AS a, var_samp(v[2]) AS c, covar_samp(v[1], v[2]) AS b FROM v)"


@query(f"WITH {D64}, {_COV2} SELECT id, round(sqrt((c*pow(v[1]-m1, 2) - 2*b*(v[1]-m1)*(v[2]-m2) + a*pow(v[2]-m2, 2))/(a*c-b*b)), 6) AS d FROM v, m")
def mahalanobis_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir, 2)
    m = monitors.MahalanobisDetector().fit(df, 2)
    return df.select("id", F.round(kernels.mahalanobis(F.col("v"), F.array(*map(F.lit, m.mean.tolist())), m.precision.tolist()), 6).alias("d"))


@query(
    f"""WITH {D64}, {_COV2}, s AS (SELECT id, exp(-0.01*(c*pow(v[1]-m1, 2) - 2*b*(v[1]-m1)*(v[2]-m2) + a*pow(v[2]-m2, 2))/(a*c-b*b)) AS s FROM v, m)
 SELECT id, round(s, 6) AS score, CAST(CASE WHEN s >= (SELECT quantile_cont(s, 0.1) FROM s) THEN 1 ELSE -1 END AS BIGINT) AS label FROM s"""
)
def mahal_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir, 2)
    return monitors.MahalanobisDetector(tau=0.1).fit(df, 2).transform(df).select("id", F.round("score", 6).alias("score"), "label")


@query(f"WITH {D64}, l AS (SELECT id, unnest(range(1, 65)) AS k, unnest(v) AS a FROM v), m AS (SELECT k, avg(a) AS m, stddev_pop(a) AS s FROM l GROUP BY k) SELECT id, k, round(CASE WHEN s > 0 THEN (a - m)/s ELSE 0 END, 6) AS a FROM l JOIN m USING (k)")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec.long_form(vec.zscore(vectors(spark, sf_dir), 64)).withColumn("a", F.round("a", 6))


@query(f"WITH {D64}, l AS (SELECT id, unnest(range(1, 65)) AS k, unnest(v) AS a, {_dist('v', 'list_transform(v, lambda z: 0.0)', 64)} AS n FROM v) SELECT id, k, round(a/n, 6) AS a FROM l")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return vec.long_form(df.withColumn("v", kernels.l2_normalise(F.col("v")))).withColumn("a", F.round("a", 6))


@query(f"WITH {D64}, l AS (SELECT id, unnest(range(1, 65)) AS k, unnest(v) AS a FROM v) SELECT x.k AS j, y.k AS k, round(covar_samp(x.a, y.a), 6) AS cov FROM l x JOIN l y USING (id) GROUP BY 1, 2")
def cov_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec.covariance(vectors(spark, sf_dir), 64).select("j", "k", F.round("cov", 6).alias("cov"))


# Positives are the samples of label 5 and more.
_PROTO = f"""{D64}, p AS (SELECT * FROM v WHERE label >= 5), pl AS (SELECT id, unnest(range(1, 65)) AS k, unnest(v) AS a FROM p),
 ends AS (SELECT arg_max(id, (a, -id)) AS id FROM pl GROUP BY k UNION SELECT arg_min(id, (a, id)) AS id FROM pl GROUP BY k),
 rk AS (SELECT id, row_number() OVER (ORDER BY sqrt(list_sum(list_transform(v, lambda z: z*z))) DESC, id DESC) - 1 AS r FROM p),
 proto AS (SELECT p.* FROM p WHERE id IN (SELECT id FROM ends) OR id IN (SELECT id FROM rk WHERE r % 5 = 0))"""


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumn("label", (F.col("label") >= 5).cast("bigint"))


@query(f"WITH {_PROTO} SELECT id FROM proto")
def extrema_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec.extrema_prototypes(_binary(spark, sf_dir).where("label > 0"), 64, 5).select("id")


_AAKR = f"""{_PROTO}, w AS (SELECT v.id, v.v, p.v AS pv, 1/(1+0.5*{_dist('v.v', 'p.v')}) AS w FROM v, proto p),
 e AS (SELECT id, any_value(v) AS v, """ + ", ".join(f"sum(w*pv[{k}])/sum(w) AS e{k}" for k in range(1, 65)) + " FROM w GROUP BY id), s AS (SELECT *, 1/(1+0.5*sqrt(" + " + ".join(f"pow(v[{k}]-e{k}, 2)" for k in range(1, 65)) + ")) AS s FROM e)"


def _aakr(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, similarity.SimilarityModel]:
    df = _binary(spark, sf_dir)
    _, d, _ = vec.whole(vec.extrema_prototypes(df.where("label > 0"), 64, 5))
    return df, similarity.SimilarityModel(gamma=0.5, auto_associative=True).with_prototypes(d)


@query(f"WITH {_AAKR} SELECT id, " + ", ".join(f"round(e{k}, 6) AS e{k}" for k in range(1, 65)) + " FROM s")
def aakr_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, m = _aakr(spark, sf_dir)
    return m.estimate(df).select("id", *(F.round(F.col("estimate")[k - 1], 6).alias(f"e{k}") for k in range(1, 65)))


@query(f"WITH {_AAKR} SELECT id, round(s, 6) AS score, " + ", ".join(f"round(v[{k}]-e{k}, 6) AS r{k}" for k in range(1, 65)) + " FROM s")
def aakr_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, m = _aakr(spark, sf_dir)
    return m.transform(df, residual=True).select("id", F.round("score", 6).alias("score"), *(F.round(F.col("residual")[k - 1], 6).alias(f"r{k}") for k in range(1, 65)))


_THETA = f"""{_AAKR}, sc AS (SELECT s.id, s.s, label >= 5 AS y FROM s JOIN v USING (id)),
 acc AS (SELECT k, avg(CASE WHEN (s > 1 - k/100.0) = y THEN 1.0 ELSE 0.0 END) AS acc FROM sc, (SELECT unnest(range(0, 101)) AS k) ks GROUP BY k),
 fall AS (SELECT coalesce(min(k), 101) AS f FROM (SELECT k, acc, lag(acc) OVER (ORDER BY k) AS before FROM acc) WHERE acc < before)"""


@query(f"WITH {_THETA} SELECT round(1 - k/100.0, 6) AS theta, round(acc, 6) AS accuracy FROM acc, fall WHERE k = f - 1")
def theta_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, m = _aakr(spark, sf_dir)
    theta, acc = similarity.find_theta(m.transform(df).withColumn("y", F.col("label") > 0))
    return spark.createDataFrame([(round(theta, 6), round(acc, 6))], "theta double, accuracy double")


@query()
def sbm_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _binary(spark, sf_dir)
    m = similarity.SimilarityModel(gamma=0.5).fit(df, "original")
    # One estimate a row gives both, and the model is sent once.
    return m.transform(df, residual=True).select("id", *(F.round(F.col("v")[k] - F.col("residual")[k], 4).alias(f"e{k + 1}") for k in range(64)), F.round("score", 5).alias("score"), "predicted")


def _fit_query(method: str):
    @query(None, f"sbm_fit_{method}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _binary(spark, sf_dir)
        m = similarity.SimilarityModel(gamma=0.1, tau=0.5, max_itr=8, scale=True).fit(df, method)
        return m.transform(df).select("id", F.lit(len(m.D)).alias("prototypes"), F.round("score", 5).alias("score"), "predicted")


for _m in similarity.METHODS:
    _fit_query(_m)


def _class_sql(groups: str) -> str:
    """Scores of one auto-associative model a class, every row of the class a prototype."""
    return f"""WITH {D64}, c AS (SELECT *, {groups} AS c FROM v), w AS (SELECT a.id, a.v, p.c, p.v AS pv, 1/(1+0.5*{_dist('a.v', 'p.v')}) AS w FROM c a, c p),
 e AS (SELECT id, c, any_value(v) AS v, """ + ", ".join(f"sum(w*pv[{k}])/sum(w) AS e{k}" for k in range(1, 65)) + " FROM w GROUP BY id, c), s AS (SELECT id, c, 1/(1+0.5*sqrt(" + " + ".join(f"pow(v[{k}]-e{k}, 2)" for k in range(1, 65)) + ")) AS s FROM e) SELECT id, CAST(arg_max(c, (s, -c)) AS BIGINT) AS predicted, round(max(s), 6) AS score FROM s GROUP BY id"


def _by_class(df: DataFrame) -> DataFrame:
    m = similarity.ClassSimilarityModel(similarity.SimilarityModel(gamma=0.5, auto_associative=True), "dummy").fit(df)
    return m.transform(df).select("id", "predicted", F.round(F.array_max("scores"), 6).alias("score"))


@query(_class_sql("CASE WHEN label >= 5 THEN 1 ELSE 0 END"))
def bsbm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_class(_binary(spark, sf_dir))


@query(_class_sql("label"))
def msbm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_class(vectors(spark, sf_dir))


@query()
def linear_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _binary(spark, sf_dir)
    return monitors.LinearMonitor(gamma=0.5).fit(df).transform(df).select("id", F.round("score", 5).alias("score"), "predicted")


@query()
def linear_monitor_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return monitors.LinearClassMonitor(monitors.LinearMonitor(gamma=0.5)).fit(df).transform(df).select("id", "predicted")


@query(
    f"""WITH RECURSIVE {D64}, o AS (SELECT *, row_number() OVER (ORDER BY id) AS r FROM v),
 m AS (SELECT CAST(0 AS BIGINT) AS r, [""" + ", ".join(f"avg(v[{k}])" for k in range(1, 65)) + f"""] AS m FROM v
 UNION ALL SELECT m.r + 1, list_transform(range(1, 65), lambda q: CASE WHEN {_dist('o.v', 'm.m')} > 1e-9 THEN m.m[q] + 0.1/{_dist('o.v', 'm.m')}*(o.v[q] - m.m[q]) ELSE m.m[q] END) FROM m JOIN o ON o.r = m.r + 1),
 e AS (SELECT m FROM m ORDER BY r DESC LIMIT 1), n AS (SELECT id, v, {_dist('v.v', 'e.m')} AS d FROM v, e)
 SELECT id, """ + ", ".join(f"round(v[{k}], 6) AS m{k}" for k in range(1, 65)) + " FROM n ORDER BY d, id LIMIT 1"
)
def geometric_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = vec.geometric_median(vectors(spark, sf_dir), 64)
    return spark.createDataFrame([(i, *(round(x, 6) for x in v))], "id bigint, " + ", ".join(f"m{k} double" for k in range(1, 65)))


_MEDOIDS = "mdd AS (SELECT min(id) AS id FROM v GROUP BY label)"


@query(f"WITH {D64}, {_MEDOIDS}, d AS (SELECT v.id, m.id AS centre, {_dist('v.v', 'c.v')} AS d FROM v, mdd m JOIN v c ON c.id = m.id) SELECT id, arg_min(centre, (d, centre)) AS centre, round(min(d), 6) AS distance FROM d GROUP BY id")
def nearest_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    first = df.groupBy("label").agg(F.min(F.struct("id", "v")).alias("m")).select("m.id", "m.v").orderBy("id")
    centres = [(r.id, list(r.v)) for r in vec.gathered(first)]
    return vec.nearest(df, centres).select("id", "centre", F.round("distance", 6).alias("distance"))


@query(f"WITH {D64}, t AS (SELECT a.id, sum({_dist('a.v', 'b.v')}) AS total FROM v a, v b GROUP BY a.id) SELECT id, round(total, 4) AS total FROM t ORDER BY total, id LIMIT 1")
def pam_build_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = vec.distance_sums(vectors(spark, sf_dir))
    return totals.select("id", F.round("total", 4).alias("total")).orderBy("total", "id").limit(1)


@query()
def pam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.pam_table(vectors(spark, sf_dir), 4)[1].select("id", "centre", F.round("distance", 5).alias("distance"))


@query()
def clara(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.clara(vectors(spark, sf_dir), 4, inits=4)[1].select("id", "centre", F.round("distance", 5).alias("distance"))


@query()
def one_class_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return monitors.OneClassSvm(nu=0.1, gamma=0.5).fit(df).transform(df).select("id", F.round("score", 4).alias("score"), "label")
