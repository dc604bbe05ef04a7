"""SMOTE oversampling to class parity (L12), drawn deterministically.

Draw j (0 <= j < n_major - n_minor) starts from the minority row with index
j mod n_minor (id order), picks neighbour number md5(seed:j:nb) mod k among
that row's k nearest minority rows, and interpolates
x + u (x_nb - x) with u = md5(seed:j:gap) / 2^32.  All steps are equi-joins on
unique keys; the neighbour search is the exact kNN of the metric index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.columns import hash_u32, hash_unit
from churnlens.functions.ranking import ordinal_within
from churnlens.operators.neighbors import MetricIndex, _kind, knn


def smote(points: DataFrame, k: int = 5, seed: int = 2, minority: float | None = None) -> DataFrame:
    """Synthetic minority rows for ``points`` (id, x array<double>, y).

    Returns (draw, base_id, nb_id, x, y) - one row per synthetic sample.
    """
    points = points.select("id", "x", "y").persist()  # read by the counts, the index and the kNN
    counts = {r.y: r.n for r in points.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if minority is None:
        minority = min(counts, key=lambda c: (counts[c], c))
    n_min = counts[minority]
    need = max(counts.values()) - n_min
    spark = points.sparkSession
    mino = points.where(F.col("y") == minority).select("id", "x")
    if need <= 0 or n_min < 2:  # one row has no neighbour to draw towards
        return spark.createDataFrame([], "draw long, base_id long, nb_id long, x array<double>, y double")
    idx = ordinal_within(mino.select("id"), [], ["id"], "_i", "_n").select("id", "_i")
    nb = knn(mino, mino, k, exclude_self=True).select(
        F.col("query_id").alias("base_id"), F.col("ref_id").alias("nb_id"), "rank")
    kk = F.least(F.lit(k), F.lit(n_min - 1))
    draws = (spark.range(need).withColumnRenamed("id", "draw")
             .withColumn("_i", F.col("draw") % n_min)
             .withColumn("rank", hash_u32(F.lit(seed), F.col("draw"), F.lit("nb")) % kk)
             .withColumn("u", hash_unit(F.lit(seed), F.col("draw"), F.lit("gap"))))
    d = (draws.join(idx, "_i").withColumnRenamed("id", "base_id")
         .join(nb, ["base_id", "rank"])
         .join(mino.select(F.col("id").alias("base_id"), F.col("x").alias("xb")), "base_id")
         .join(mino.select(F.col("id").alias("nb_id"), F.col("x").alias("xn")), "nb_id"))
    synth = F.zip_with("xb", "xn", lambda a, b: a + F.col("u") * (b - a))
    return d.select("draw", "base_id", "nb_id", synth.alias("x"), F.lit(float(minority)).alias("y"))


def oversample(points: DataFrame, k: int = 5, seed: int = 2) -> DataFrame:
    """Original rows plus SMOTE rows (synthetic ids are -(draw + 1))."""
    s = smote(points, k, seed)
    return points.select("id", "x", "y").unionByName(
        s.select((-(F.col("draw") + 1)).alias("id"), "x", "y"))


def fold_neighbors(mino: DataFrame, folds, k: int = 5) -> DataFrame:
    """(fold, base_id, nb_id, rank): for every fold and every row outside it, the k nearest
    rows outside it, from one search.

    A part leaves out one fold only, so most neighbours are those of several parts; the index
    searches for all parts at once.  ``mino`` has id, x, fold."""
    rows = mino.select("id", "x", F.col("fold").alias("y"))
    index = MetricIndex.build(rows.where(F.col("y").isin(list(folds))), k, groups=list(folds))
    if index is None:
        return mino.sparkSession.createDataFrame([], f"fold int, base_id {_kind(mino)}, nb_id {_kind(mino)}, rank int")
    return index.outside(rows, k, exclude_self=True).select(
        F.col("left_out").cast("int").alias("fold"), F.col("query_id").alias("base_id"), F.col("ref_id").alias("nb_id"), "rank")


def smote_folds(points: DataFrame, k: int = 5, seed: int = 2) -> DataFrame:
    """SMOTE inside every training part: (fold, draw, base_id, nb_id, x, y), the rows that
    bring the part without ``fold`` to parity; no parent lies in ``fold``.

    ``points`` has id, x, y, fold.  Draw j starts from the minority row j mod n of the part
    in id order, as ``smote`` does.  A part with one class, at parity or with fewer than two
    minority rows gets none; rows without fold or label take no part."""
    spark = points.sparkSession
    points = points.where("fold IS NOT NULL AND y IS NOT NULL").select("id", "x", "y", F.col("fold").cast("int").alias("fold"))
    counts = {(r.fold, r.y): r.n for r in points.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    folds, classes = sorted({f for f, _ in counts}), sorted({y for _, y in counts})
    totals = {y: sum(n for (_, c), n in counts.items() if c == y) for y in classes}
    empty = spark.createDataFrame([], "fold int, draw long, base_id long, nb_id long, x array<double>, y double")
    if len(classes) < 2:
        return empty
    minority = min(classes, key=lambda y: (totals[y], y))
    draws = []
    for f in folds:
        part = {y: totals[y] - counts.get((f, y), 0) for y in classes}
        need, n = max(part.values()) - part[minority], part[minority]
        if need > 0 and n > 1:
            draws.append(spark.range(need).select(
                F.lit(f).alias("fold"), F.col("id").alias("draw"), (F.col("id") % n).alias("_i"),
                (hash_u32(F.lit(seed), F.lit(f), F.col("id"), F.lit("nb")) % min(k, n - 1)).alias("rank"),
                hash_unit(F.lit(seed), F.lit(f), F.col("id"), F.lit("gap")).alias("u")))
    if not draws:
        return empty
    mino = points.where(F.col("y") == minority).select("id", "x", "fold").persist()
    members = (mino.select("id", F.col("fold").alias("_f")).withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds])))
               .where(F.col("fold") != F.col("_f")).select("fold", "id"))
    idx = ordinal_within(members, ["fold"], ["id"], "_i", "_n").select("fold", F.col("id").alias("base_id"), "_i")
    d = (reduce(DataFrame.unionByName, draws).join(idx, ["fold", "_i"])
         .join(fold_neighbors(mino, folds, k), ["fold", "base_id", "rank"])
         .join(mino.select(F.col("id").alias("base_id"), F.col("x").alias("xb")), "base_id")
         .join(mino.select(F.col("id").alias("nb_id"), F.col("x").alias("xn")), "nb_id"))
    synth = F.zip_with("xb", "xn", lambda a, b: a + F.col("u") * (b - a))
    return d.select("fold", "draw", "base_id", "nb_id", synth.alias("x"), F.lit(float(minority)).alias("y"))
