"""K-means from several starts against plain numpy runs from the same starts."""

import numpy as np

from churnlens.operators import cluster as clu
from churnlens.operators.kstarts import finite, kmeans_starts, nearest, plus_plus


def _frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, x array<double>")


def _blobs():
    rng = np.random.default_rng(1)
    return np.concatenate([rng.normal(c, 0.3, size=(40, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5), (20, 20))]).round(3)


def test_equals_plain_runs_and_keeps_the_least_cost(spark):
    x = _blobs()
    found = kmeans_starts(_frame(spark, x), [3, 5], starts=4, tol=0.0)
    for k, best in found.items():
        c = best.centers.copy()
        near = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
        assert np.allclose(best.cost, ((x - c[near]) ** 2).sum())
        # The centres stand still: each is the mean of its rows.
        assert np.allclose(c, [x[near == j].mean(0) for j in range(k)])
        assert best.cost == min(best.costs) and len(best.costs) == 4
    assert found[5].cost < 2 * 0.09 * 200 * 1.3  # all five blobs found


def test_one_run_follows_lloyd(spark):
    x = _blobs()
    two = kmeans_starts(_frame(spark, x).coalesce(1), [4], starts=1, max_iter=2, tol=0.0)[4]
    shift = x.mean(0)
    drawn = finite(_frame(spark, x)).coalesce(1).selectExpr("x", "xxhash64(x, monotonically_increasing_id(), 0) AS h").orderBy("h").collect()
    c = plus_plus(np.array([r.x for r in drawn]) - shift, 4, np.random.default_rng([0, 4, 0]))
    z = x - shift
    near = ((z[:, None] - c) ** 2).sum(-1).argmin(1)
    c = np.array([z[near == j].mean(0) if (near == j).any() else c[j] for j in range(4)])
    assert np.allclose(two.centers, c + shift)


def test_curve_falls_and_edges(spark):
    x = _blobs()
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    sse = [r.sse for r in clu.sse_curve(df, ["a", "b"], range(1, 7)).collect()]
    assert sse == sorted(sse, reverse=True)
    sil = {r.k: r.silhouette for r in clu.silhouette_curve(df, ["a", "b"], range(2, 6), starts=3).collect()}
    assert all(-1 <= v <= 1 for v in sil.values())
    empty = spark.createDataFrame([], "id long, x array<double>")
    assert kmeans_starts(empty, [2]) == {}
    # Fewer different rows than centres, and rows that take no part.
    few = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [4.0, 1.0]), (4, None), (5, [None, 1.0]),
                                 (6, [float("nan"), 1.0])], "id long, x array<double>")
    assert kmeans_starts(few, [3], starts=2)[3].cost == 0.0


def test_nearest_takes_the_first_of_equals(spark):
    df = _frame(spark, [[1.0, 0.0], [4.0, 0.0]])
    got = [r.c for r in df.select("id", nearest("x", np.array([[2.0, 0.0], [0.0, 0.0], [5.0, 0.0]])).alias("c")).orderBy("id").collect()]
    assert got == [0, 2]


def test_a_pass_has_a_task_a_core_whatever_the_partitions(spark, monkeypatch):
    from churnlens.operators import kstarts

    passes = []

    def seen(*a):
        run = made(*a)
        passes.append(1)
        return run

    made = kstarts._pass
    monkeypatch.setattr(kstarts, "_pass", seen)
    parts = []
    persist = type(spark.range(0)).persist
    monkeypatch.setattr(type(spark.range(0)), "persist", lambda df, *a: parts.append(df.rdd.getNumPartitions()) or persist(df, *a))
    x = _blobs()
    found = kmeans_starts(_frame(spark, x).repartition(57), [2, 5], starts=3)
    assert parts == [spark.sparkContext.defaultParallelism]  # 57 before
    for k, best in found.items():
        assert np.allclose(best.cost, ((x[:, None] - best.centers) ** 2).sum(-1).min(1).sum())
    assert len(passes) >= 2
