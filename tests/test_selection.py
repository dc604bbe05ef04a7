"""Selection sweeps on a planted column: ``a`` is the label, the others are unrelated."""
import pytest

from churnlens.plans import models as mdl
from churnlens.plans.select import Sweep

COLS = ["b", "a", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    rows = [(i, float(i * 7919 % 101), float(i % 2), float(i * 104729 % 89), i % 2, i // 2 % 4) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, b double, a double, c double, y int, fold int")
    return mdl.to_vectors(df, COLS, "y", "id", keep=("fold",)).persist()


def test_best_k_and_thresholds(spark, planted):
    sweep = Sweep(planted, COLS, mdl.forest(numTrees=1, featureSubsetStrategy="all"))
    scores = spark.createDataFrame([("a", 9.0), ("c", 2.0), ("b", 1.0)], "feature string, score double")
    table, best, left = sweep.best_k(scores, "score")
    assert [(r.k, r.recall) for r in table.orderBy("k").collect()] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert best == 1 and left == ["c", "b"]
    table, best = sweep.thresholds(scores, "score", [2.0, 9.0, 10.0])
    assert [(r.n_features, r.recall) for r in table.orderBy("threshold").collect()] == [(2, 1.0), (1, 1.0), (0, 0.0)] and best == 2.0
    table, _ = sweep.thresholds(scores, "score", [2.0, 9.0], strict=True)
    assert [r.n_features for r in table.orderBy("threshold").collect()] == [1, 0]
    assert set(sweep._known) == {("a",), ("a", "c"), ("b", "a", "c")}  # each set was fitted once


def test_single_columns_and_elimination(planted):
    sweep = Sweep(planted, COLS, mdl.forest(numTrees=1, featureSubsetStrategy="all"))
    alone = {r.feature: r.recall for r in sweep.single_columns().collect()}
    assert alone["a"] == 1.0 and alone["b"] < 1.0 and alone["c"] < 1.0
    table, columns = sweep.eliminate()
    assert [(r.n_features, r.recall) for r in table.orderBy("n_features").collect()] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert columns == ["a"]
