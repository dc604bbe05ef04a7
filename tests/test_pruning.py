"""Forests pruned to smaller depths and larger splits, against forests grown that way."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from churnlens.plans import pruning
from churnlens.plans.models import forest


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.4, size=300) > 0).astype(float)
    rows = [(*map(float, r), float(c), k % 3) for k, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, label double, fold int")
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).coalesce(1).persist()


def _x(df):
    return np.array([r.features.toArray() for r in df.collect()])


def test_pruned_depth_equals_a_forest_grown_to_it(spark, frame):
    deep = pruning.read_nodes(spark, forest(numTrees=6, maxDepth=8, featureSubsetStrategy="all").fit(frame))
    for depth in (1, 3, 5, 8):
        grown = forest(numTrees=6, maxDepth=depth, featureSubsetStrategy="all").fit(frame).transform(frame)
        votes = deep.votes(_x(frame), depth, 2)[:, -1]
        raw = np.array([r.rawPrediction.toArray() for r in grown.select("rawPrediction").collect()])
        assert np.allclose(votes, raw, atol=1e-12)


def test_small_nodes_stay_closed(spark, frame):
    nodes = pruning.read_nodes(spark, forest(numTrees=3, maxDepth=6, featureSubsetStrategy="all").fit(frame))

    def leaf(k, x, depth, min_split):  # where a tree grown with min_split ends for x
        if nodes.column[k] < 0 or nodes.level[k] >= depth or nodes.rows[k] < min_split:
            return k
        return leaf(nodes.left[k] if x[nodes.column[k]] <= nodes.cut[k] else nodes.right[k], x, depth, min_split)

    x = _x(frame)
    for depth, split in ((6, 40), (4, 2), (6, 1000)):
        want = np.array([[nodes.shares[leaf(r, row, depth, split)] for r in nodes.roots] for row in x])
        got = np.diff(np.concatenate([np.zeros((len(x), 1, 2)), nodes.votes(x, depth, split)], axis=1), axis=1)
        # A closed pair of leaves that say the same says it too, with the shares of both.
        assert ((want[..., 1] > want[..., 0]) == (got[..., 1] > got[..., 0])).all()
    assert (nodes.closed(6, 1000)[nodes.roots]).all()


def test_grid_scores_equal_separate_fits(spark, frame):
    forests = pruning.fit_forests(frame, 5, 7, subset="all")
    points = [pruning.Point(5, d) for d in (2, 4, 7)]
    for p, (precision, recall) in zip(points, pruning.score(frame, forests, points)):
        each = []
        for f in range(3):
            model = forest(numTrees=5, maxDepth=p.depth, featureSubsetStrategy="all").fit(frame.where(f"fold != {f}"))
            rows = model.transform(frame.where(f"fold = {f}")).select("label", "prediction").collect()
            hits = sum(r.label == r.prediction == 1 for r in rows)
            each.append((hits / max(1, sum(r.prediction for r in rows)), hits / sum(r.label for r in rows)))
        assert np.allclose((precision, recall), np.mean(each, axis=0))


def test_stages_keep_the_first_best(frame):
    search = pruning.ForestSearch(frame, 4)
    search.stage("trees", trees=[2, 5])
    best = search.stage("depth", depth=[1, 4], min_split=[2, 30])
    search.stage("features", max_features=[2, 4])
    rows = search.table().collect()
    assert [r.stage for r in rows] == ["trees"] * 2 + ["depth"] * 4 + ["features"] * 2
    second = [r for r in rows if r.stage == "depth"]
    top = max(r.recall for r in second)
    first = next(r for r in second if r.recall == top)
    assert (best["depth"], best["min_split"]) == (first.depth, first.min_split)


def test_a_search_gathers_few_rows(spark, frame):
    # A partition a few rows makes every task send the sums of all nodes of a level.
    search = pruning.ForestSearch(frame.repartition(24), 4)
    assert search.df.rdd.getNumPartitions() == 1
    assert sorted(map(str, search.df.collect())) == sorted(map(str, frame.collect()))


def test_nodes_are_those_of_the_model(spark, frame):
    model = forest(numTrees=4, maxDepth=6, seed=3).fit(frame)
    nodes = pruning.read_nodes(spark, model)
    assert len(nodes.roots) == 4 and len(nodes.left) == model.totalNumNodes
    assert (nodes.column[nodes.left == np.arange(len(nodes.left))] == -1).all()
    raw = np.array([r.rawPrediction.toArray() for r in model.transform(frame).select("rawPrediction").collect()])
    assert np.allclose(nodes.votes(_x(frame), 6, 0)[:, -1], raw, atol=1e-12)
