"""K-means curves, centroids and relative-distance outliers."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.columns import euclidean
from churnlens.functions.ranking import exact_median
from churnlens.operators.kstarts import finite, kmeans_starts, nearest

STARTS = 10  # fixed value: starts of the reference's library


def total_sum_of_squares(df: DataFrame, cols) -> float:
    """SSE of one cluster (k = 1): sum over columns of var_pop * n."""
    aggs = [F.var_pop(F.col(f"`{c}`").cast("double")) for c in cols]
    r = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    n = r[0]
    return float(sum((v or 0.0) * n for v in r[1:]))


def _points(df: DataFrame, cols) -> DataFrame:
    return df.withColumn("x", F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))


def sse_curve(df: DataFrame, cols, ks=range(1, 10), seed: int = 0, max_iter: int = 300, starts: int = STARTS) -> DataFrame:
    """(k, sse) - within-cluster sum of squares per k (elbow table), the best of ``starts``."""
    many = [k for k in ks if k > 1]
    best = kmeans_starts(_points(df, cols), many, starts, seed, max_iter) if many else {}
    rows = [(k, total_sum_of_squares(df, cols) if k == 1 else best[k].cost if k in best else 0.0) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, sse double")


def silhouette_curve(df: DataFrame, cols, ks=range(2, 10), seed: int = 0, max_iter: int = 300, starts: int = STARTS) -> DataFrame:
    """(k, silhouette) of the best of ``starts``, with Spark's ``ClusteringEvaluator`` (squared
    Euclidean, linear time) - the pairwise Euclidean form would need all pairs."""
    best = kmeans_starts(_points(df, cols), list(ks), starts, seed, max_iter)
    v = finite(_points(df, cols)).select("x", array_to_vector("x").alias("features"))
    v = v.select("features", *[nearest("x", b.centers).alias(f"p{k}") for k, b in best.items()]).persist()
    rows = []
    for k in best:
        ev = ClusteringEvaluator(featuresCol="features", predictionCol=f"p{k}")
        rows.append((k, float(ev.evaluate(v))))
    v.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def kmeans_fit(df: DataFrame, cols, id_col: str, k: int = 4, max_iter: int = 500, seed: int = 0, starts: int = STARTS):
    """K-means, the best of ``starts``; returns (assignments (id, cluster), centroids (cluster, center array))."""
    pts = _points(df, cols)
    centers = kmeans_starts(pts, [k], starts, seed, max_iter)
    centers = centers[k].centers if centers else []
    assign = finite(pts).select(F.col(f"`{id_col}`").alias(id_col), (nearest("x", centers) if len(centers) else F.lit(None).cast("int")).alias("cluster"))
    cent = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "cluster int, center array<double>")
    return assign, cent


def cluster_sizes(assign: DataFrame) -> DataFrame:
    return assign.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def relative_distance(points: DataFrame, centroids: DataFrame, id_col: str = "id",
                      x_col: str = "x", cluster_col: str = "cluster") -> DataFrame:
    """score = ||x - c|| / median ||x - c|| inside the cluster.

    ``centroids`` has one row per cluster (bounded by k, broadcast).  The median
    is exact and computed without gathering a cluster into one task.  A zero
    median gives a null score.
    """
    d = (points.join(F.broadcast(centroids), cluster_col)
         .withColumn("dist", euclidean(x_col, "center")).select(id_col, cluster_col, "dist"))
    med = exact_median(d, [cluster_col], "dist", id_col, "median_dist")
    return (d.join(F.broadcast(med), cluster_col)
            .withColumn("score", F.when(F.col("median_dist") > 0, F.col("dist") / F.col("median_dist"))))


def remove_outliers(scored: DataFrame, threshold: float = 2.0, score_col: str = "score") -> DataFrame:
    """Keep rows whose score is at most ``threshold``."""
    return scored.where(F.col(score_col) <= threshold)
