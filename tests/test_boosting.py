"""Boosting in lock step against a plain boosting in Python, model by model."""
import math
import random

import numpy as np
import pytest

from churnlens.plans import boosting as bst
from churnlens.plans import models as mdl
from churnlens.plans.select import BoostedSweep

COLS = ["b", "a", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        x = (float(rng.randint(0, 12)), rng.choice([0.5, 1.5, 2.5]), float(rng.randint(0, 5)))
        rows.append((i, *x, int(rng.random() < 1 / (1 + math.exp(-(x[0] - 6) * (x[1] - 1.2)))), i % 4))
    df = spark.createDataFrame(rows, "id long, b double, a double, c double, y int, fold int").repartition(3)
    return rows, mdl.to_vectors(df, COLS, "y", "id", keep=("fold",)).persist()


def _grow(rows, model, level):
    """rows: (x, residual, curvature).  A nested (column, bound, left, right) or a leaf value."""
    leaf = sum(r for _, r, _ in rows) / sum(h for _, _, h in rows) if sum(h for _, _, h in rows) > 1e-150 else 0.0
    if level == model.depth or len(rows) < model.min_split:
        return leaf
    best = None
    for c in model.columns:
        for bound in sorted({x[c] for x, _, _ in rows})[:-1]:
            left = [r for x, r, _ in rows if x[c] <= bound]
            right = [r for x, r, _ in rows if x[c] > bound]
            if min(len(left), len(right)) < model.min_leaf:
                continue
            gain = len(left) * len(right) / len(rows) * (sum(left) / len(left) - sum(right) / len(right)) ** 2
            if best is None or gain > best[0] * (1 + 1e-9):
                best = gain, c, bound
    if best is None or best[0] <= 1e-12:
        return leaf
    _, c, bound = best
    return (c, bound, _grow([r for r in rows if r[0][c] <= bound], model, level + 1),
            _grow([r for r in rows if r[0][c] > bound], model, level + 1))


def _value(node, x):
    while isinstance(node, tuple):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def _plain(rows, model, trees, rate=0.1):
    """Scores of all rows after each number of trees."""
    train = [(r[1:4], r[4]) for r in rows if r[5] != model.fold]
    yes = sum(y for _, y in train)
    start = math.log(yes / (len(train) - yes))
    scores, held = [start] * len(train), [start] * len(rows)
    out = [list(held)]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        tree = _grow([(x, y - q, q * (1 - q)) for (x, y), q in zip(train, p)], model, 0)
        scores = [s + rate * _value(tree, x) for s, (x, _) in zip(scores, train)]
        held = [s + rate * _value(tree, r[1:4]) for s, r in zip(held, rows)]
        out.append(list(held))
    return out


def test_every_model_equals_plain_boosting_at_every_number_of_trees(frame, monkeypatch):
    monkeypatch.setattr(bst, "FOLD", 3)
    monkeypatch.setattr(bst, "ROWS_PER_TASK", 100)
    rows, df = frame
    models = [bst.Model((0, 1, 2), 0), bst.Model((1,), 2, depth=2), bst.Model((0, 2), 3, depth=4, min_split=60),
              bst.Model((0, 1), None, min_leaf=25), bst.Model((2,), 1, depth=1)]
    found = bst.fit(df, 3, models, trees=8)
    x = np.array([r[1:4] for r in rows])
    got = bst.predict_scores(found, x)
    for m, model in enumerate(models):
        staged = _plain(rows, model, 8)
        assert np.allclose(got[:, m], staged[-1], atol=1e-9)
        for n, scores in enumerate(staged):
            held = [(s > 0, r[4]) for s, r in zip(scores, rows) if r[5] == model.fold]
            tp, said, real = sum(s and y for s, y in held), sum(s for s, _ in held), sum(y for _, y in held)
            assert found.recall[n, m] == (tp / real if real else 0) and found.precision[n, m] == (tp / said if said else 0)
    assert np.allclose(found.importance.sum(axis=1), 1) and found.importance[1].tolist() == [0, 1, 0]


def test_one_class_and_constant_columns_do_not_crash(spark):
    df = mdl.to_vectors(spark.createDataFrame([(i, 1.0, float(i), 1, i % 2) for i in range(20)], "id long, a double, b double, y int, fold int"),
                        ["a", "b"], "y", "id", keep=("fold",))
    found = bst.fit(df, 2, [bst.Model((0,), 0), bst.Model((0, 1), 1)], trees=2)
    assert found.recall[-1].tolist() == [1.0, 1.0]


def test_sweeps_of_a_planted_column(spark):
    rows = [(i, float(i * 7919 % 101), float(i % 2), float(i * 104729 % 89), i % 2, i // 2 % 4) for i in range(240)]
    df = mdl.to_vectors(spark.createDataFrame(rows, "id long, b double, a double, c double, y int, fold int"), COLS, "y", "id",
                        keep=("fold",)).persist()
    sweep = BoostedSweep(df, COLS, trees=3, depth=2)
    scores = spark.createDataFrame([("a", 9.0), ("c", 2.0), ("b", 1.0)], "feature string, score double")
    table, best, left = sweep.best_k(scores, "score")
    assert [(r.k, r.recall) for r in table.orderBy("k").collect()] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert best == 1 and left == ["c", "b"]
    alone = {r.feature: r.recall for r in sweep.single_columns().collect()}
    assert alone["a"] == 1.0 and alone["b"] < 1.0 and alone["c"] < 1.0
    table, columns = sweep.eliminate()
    assert [(r.n_features, r.recall) for r in table.orderBy("n_features").collect()] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert columns == ["a"]
    staged = {r.trees: r.recall for r in sweep.tree_counts([1, 2, 4], 2).collect()}
    assert staged == {1: 1.0, 2: 1.0, 4: 1.0}
    grid = sweep.grid({(d, s): {"depth": d, "min_split": s} for d in (1, 2) for s in (2, 500)}, 2)
    assert {(r.depth, r.min_split): r.recall for r in grid.collect()}[1, 2] == 1.0


def test_every_core_gets_rows_and_old_states_go(spark, frame, monkeypatch):
    monkeypatch.setattr(bst, "LEAST_ROWS", 100)
    tasks, kept = [], []
    held = spark.sparkContext._jsc.getPersistentRDDs
    before = len(held())
    run = bst._sums

    def seen(*a):
        kept.append(len(held()) - before)
        return run(*a)

    monkeypatch.setattr(bst, "_sums", seen)
    binned = bst._binned
    monkeypatch.setattr(bst, "_binned", lambda df, *a: tasks.append(df.rdd.getNumPartitions()) or binned(df, *a))
    found = bst.fit(frame[1], 3, [bst.Model((0, 1, 2), 0)], trees=6)
    assert tasks == [3]  # 300 rows, 100 a task at least; one task before
    assert max(kept) <= 2  # a state and the one before; before, all since the last checkpoint
    assert len(held()) == before and found.recall.shape == (7, 1)


def test_nodes_of_wide_levels_equal_those_told_apart(monkeypatch):
    rng = np.random.default_rng(5)
    tree = bst.Tree.empty(1, 9)
    tree.column[0, :512] = rng.integers(-1, 3, 512)
    tree.bin[0] = rng.integers(0, 30, 1024)
    x = rng.integers(0, 32, (3, 500)).astype(np.uint8)
    for levels in (0, 1, 5, 9):
        want = []
        for row in x.T:
            k = 1
            for _ in range(levels):
                k = k if tree.column[0, k] < 0 else 2 * k + int(row[tree.column[0, k]] > tree.bin[0, k])
            want.append(k)
        for masked in (0, 4, 1 << 9):
            monkeypatch.setattr(bst, "MASKED", masked)
            assert tree.nodes(0, x, levels).tolist() == want


def test_threshold_sets_are_fitted_together(spark, monkeypatch):
    rows = [(i, float(i * 7919 % 101), float(i % 2), float(i * 104729 % 89), i % 2, i // 2 % 4) for i in range(240)]
    df = mdl.to_vectors(spark.createDataFrame(rows, "id long, b double, a double, c double, y int, fold int"), COLS, "y", "id",
                        keep=("fold",)).persist()
    sweep, fits = BoostedSweep(df, COLS, trees=2, depth=2), []
    fit = bst.fit
    monkeypatch.setattr(bst, "fit", lambda *a: fits.append(len(a[2])) or fit(*a))
    weights = sweep.importances()
    assert {r.feature: r.importance for r in weights.collect()}["a"] == 1.0
    scores = spark.createDataFrame([("a", 9.0), ("c", 2.0), ("b", 1.0)], "feature string, score double")
    table, best = sweep.thresholds(scores, "score", [1.0, 2.0, 9.0, 10.0])
    assert [(r.n_features, r.recall) for r in table.orderBy("threshold").collect()] == [(3, 1.0), (2, 1.0), (1, 1.0), (0, 0.0)] and best == 1.0
    assert fits == [1, 12]  # one fit for all sets and folds; one a set before


def test_dealt_vectors_have_a_partition_a_core(spark):
    df = spark.range(1000).repartition(200)
    parts = mdl.dealt(df, "id").rdd.getNumPartitions()
    assert parts == max(mdl.PARTS, spark.sparkContext.defaultParallelism) and mdl.dealt(df, "id").count() == 1000


def test_small_sums_take_no_shuffle(spark, monkeypatch):
    from pyspark import RDD
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    x = rng.integers(0, 40, size=(3 * bst.LEAST_ROWS, 3)).astype(float)
    y = (x[:, 0] + rng.integers(0, 20, size=len(x)) > 35).astype(float)
    rows = [(r.tolist(), float(c), k % 3) for k, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x array<double>, label double, fold int").select(
        array_to_vector(F.col("x")).alias("features"), "label", "fold").persist()
    models = [bst.Model((0, 1, 2), f) for f in (0, 1, 2, None)]
    shuffled, calls = RDD.reduceByKey, []
    monkeypatch.setattr(RDD, "reduceByKey", lambda rdd, *a, **k: calls.append(1) or shuffled(rdd, *a, **k))
    direct = bst.fit(df, 3, models, 4)
    assert not calls
    monkeypatch.setattr(bst, "DIRECT", 0)
    added = bst.fit(df, 3, models, 4)
    assert calls
    for a, b in zip(direct.trees, added.trees):
        assert (a.column == b.column).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)
    assert np.array_equal(direct.precision, added.precision) and np.array_equal(direct.recall, added.recall)


def test_blocks_are_summed_for_the_models_of_their_fold_only(frame):
    _, df = frame
    edges = [np.arange(13.0), np.array([0.5, 1.5]), np.arange(5.0)]
    own = df.select("features", "label", "fold").unionByName(df.select("features", "label", bst.own_rows(df.fold).alias("fold")))
    blocks = bst._binned(own.repartition(2), edges, "fold").collect()
    assert sorted({b.fold for b in blocks}) == [-5, -4, -3, -2, 0, 1, 2, 3] and sum(b.n for b in blocks) == 600  # all folds in a block before
    models = [bst.Model((0, 1, 2), f) for f in (0, 1, 2, None)]
    tree, touched = bst.Tree.empty(4, 3), {}
    for b in blocks:
        x, y = np.frombuffer(b.x, np.uint8).reshape(-1, b.n), np.frombuffer(b.y, np.float64)
        scores = np.zeros((len(bst._concerned(models, b.fold)), b.n))
        found = dict(bst._sums(models, tree, 0, bst.BINS)([(x, y, b.fold, scores)]))
        assert all(v[:, 0].sum() == 3 * b.n for m, v in found.items() if m >= 0)
        touched.setdefault(b.fold, set()).update(found)
        assert bst._added(models, tree, 3, 0.1)((x, y, b.fold, scores))[3].shape == scores.shape
    assert touched[0] == {-1, 1, 2, 3} and touched[3] == {0, 1, 2, 3}
    assert touched[bst.own_rows(0)] == {0} and touched[bst.own_rows(2)] == {2} and touched[bst.own_rows(3)] == set()


def _both(fit, monkeypatch):
    """What dealt models and dealt rows give."""
    monkeypatch.setattr(bst, "FOLD", 1)
    dealt = fit()
    monkeypatch.setattr(bst, "WHOLE", 0)
    return dealt, fit()


def test_dealt_models_grow_the_same_trees(spark, frame, monkeypatch):
    monkeypatch.setattr(bst, "CHUNK", 70)
    _, df = frame
    extra = df.where("fold = 1").withColumn("fold", bst.own_rows(df.fold))
    models = [bst.Model((0, 1, 2), 0), bst.Model((1,), 2, depth=2), bst.Model((2, 0), 1, depth=4, min_split=60), bst.Model((0, 1), None, min_leaf=25),
              bst.Model((0, 1, 2), 3, depth=6)]
    for some in (df, df.unionByName(extra)):
        dealt, passes = _both(lambda: bst.fit(some, 3, models, 8), monkeypatch)
        monkeypatch.undo()
        assert np.array_equal(dealt.recall, passes.recall) and np.array_equal(dealt.precision, passes.precision)
        assert np.allclose(dealt.importance, passes.importance) and np.allclose(dealt.start, passes.start)
        for a, b in zip(dealt.trees, passes.trees):
            assert (a.column == b.column).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value, atol=1e-9)


def test_an_elimination_needs_no_pass_a_level(spark, frame):
    sc = spark.sparkContext
    sc.setJobGroup("elimination", "elimination")
    table, _ = BoostedSweep(frame[1], COLS, trees=bst.FOLD, depth=3).eliminate()
    jobs = len(sc.statusTracker().getJobIdsForGroup("elimination"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert table.count() == 3 and jobs <= 30  # 3 fits of 25 trees: 225 passes before


def test_models_are_dealt_by_their_width():
    models = [bst.Model(tuple(range(k)), f) for k in range(1, 18) for f in range(5)]
    groups = bst._dealt(models, 12)
    assert sorted(m for g in groups for m in g) == list(range(85))
    work = [sum(len(models[m].columns) for m in g) for g in groups]
    assert max(work) <= 1.15 * sum(work) / 12
    assert bst._dealt(models[:2], 12) == [[0], [1]]


def test_wide_tables_and_short_fits_keep_passes(spark, frame, monkeypatch):
    dealt = []
    monkeypatch.setattr(bst, "_fit_dealt", lambda *a: dealt.append(1) or {})
    two = [bst.Model((0, 1), 0), bst.Model((2,), 1)]
    bst.fit(frame[1], 3, two, bst.FOLD - 1)
    bst.fit(frame[1], 3, two[:1], bst.FOLD)
    monkeypatch.setattr(bst, "WHOLE", 3 * 300 - 1)
    bst.fit(frame[1], 3, two, bst.FOLD)
    assert not dealt
    monkeypatch.setattr(bst, "WHOLE", 3 * 300)
    bst.fit(frame[1], 3, two, bst.FOLD)
    assert dealt == [1]
