"""SMOTE inside folds, rows of one model only, and the kernel classifier."""

import numpy as np
from pyspark.ml.feature import VectorAssembler

from churnlens.operators import resample as rs
from churnlens.plans import boosting as bst
from churnlens.plans import models as mdl


def _points(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.integers(0, 6, 2)], float(i % 4 == 0), int(rng.integers(0, 3))) for i in range(80)]
    return rows, spark.createDataFrame(rows, "id long, x array<double>, y double, fold int")


def test_fold_neighbors_equal_a_search_per_part(spark):
    rows, df = _points(spark)
    mino = [r for r in rows if r[2] == 1]
    got = {}
    for r in rs.fold_neighbors(df.where("y = 1"), [0, 1, 2], 4).orderBy("rank").collect():
        got.setdefault((r.fold, r.base_id), []).append(r.nb_id)
    want = {}
    for f in (0, 1, 2):
        part = [r for r in mino if r[3] != f]
        for a in part:
            near = sorted((sum((p - q) ** 2 for p, q in zip(a[1], b[1])), b[0]) for b in part if b[0] != a[0])
            want[f, a[0]] = [b for _, b in near[:4]]
    assert got == want


def test_smote_folds_reach_parity_without_held_out_parents(spark):
    rows, df = _points(spark)
    fold = {r[0]: r[3] for r in rows}
    x = {r[0]: np.array(r[1]) for r in rows}
    new = rs.smote_folds(df, 4).collect()
    for f in (0, 1, 2):
        mine = [r for r in new if r.fold == f]
        part = [r for r in rows if r[3] != f]
        n = sum(r[2] for r in part)
        assert len(mine) == len(part) - 2 * n and sorted(r.draw for r in mine) == list(range(len(mine)))
        assert all(fold[r.base_id] != f and fold[r.nb_id] != f and r.y == 1 for r in mine)
    for r in new:  # on the way from the one parent to the other
        a, b, z = x[r.base_id], x[r.nb_id], np.array(r.x)
        step = b - a
        u = (z - a) @ step / (step @ step) if step.any() else 0.0
        assert 0 <= u <= 1 and np.allclose(a + u * step, z)


def test_smote_folds_edges(spark):
    schema = "id long, x array<double>, y double, fold int"
    one = spark.createDataFrame([(1, [0.0], 1.0, 0), (2, [1.0], 1.0, 1)], schema)
    assert rs.smote_folds(one).count() == 0
    assert rs.smote_folds(spark.createDataFrame([], schema)).count() == 0
    single = spark.createDataFrame([(1, [0.0], 1.0, 0)] + [(i, [1.0], 0.0, i % 2) for i in range(2, 8)], schema)
    assert rs.smote_folds(single).count() == 0


def test_own_rows_train_their_model_only(spark):
    rng = np.random.default_rng(5)
    x, y, fold = rng.integers(0, 9, (120, 2)).astype(float), rng.integers(0, 2, 120), np.arange(120) % 2
    extra = [(8.0, 0.0, 1, bst.own_rows(0))] * 30

    def fit(rows):
        df = spark.createDataFrame([(float(a), float(b), float(c), int(f)) for a, b, c, f in rows], "a double, b double, label double, fold int")
        models = [bst.Model((0, 1), f, 2) for f in (0, 1)]
        return bst.fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df), 2, models, 3)

    base = [(*r, c, f) for r, c, f in zip(x, y, fold)]
    plain, more, all_one = fit(base), fit(base + extra), fit(base + [(a, b, c, 1) for a, b, c, _ in extra])
    # Model 1 (held out: fold 1) does not see them; model 0 trains on them as on rows of fold 1.
    assert np.isclose(plain.start[1], more.start[1]) and np.isclose(all_one.start[0], more.start[0])
    assert not np.isclose(plain.start[0], more.start[0])
    for a, b in zip(more.trees, all_one.trees):
        assert np.allclose(a.value[0], b.value[0])
    # Nobody is scored on them.
    assert more.recall.shape == plain.recall.shape and np.isclose(more.recall[0, 1], plain.recall[0, 1])


def test_kernel_svc_separates_a_ring(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-2, 2, (400, 2))
    y = (np.hypot(*x.T) < 1.1).astype(float)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame([(*map(float, r), float(c)) for r, c in zip(x, y)], "a double, b double, label double")).persist()

    def right(est):
        return est.fit(df).transform(df).where("label = prediction").count() / 400

    assert right(mdl.kernel_svc(2)) > 0.95 > 0.85 > right(mdl.linear_svc())


def test_fourier_features_approach_the_kernel(spark):
    x = np.array([[0.0, 0.0], [0.5, -0.25], [1.0, 1.0]])
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double"))
    step = mdl.FourierFeatures(2, size=4000, gamma=0.7)
    z = np.array([r.fourier.toArray() for r in step.transform(df).collect()])
    w = step.weights()
    assert np.allclose(z, np.sqrt(2 / 4000) * np.cos(x @ w[:, :2].T + w[:, 2]))
    kernel = np.exp(-0.7 * ((x[:, None] - x) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 0.06
