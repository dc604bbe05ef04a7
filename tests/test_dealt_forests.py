"""Forests with trees dealt to tasks, against plain trees and against Spark's."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from churnlens.plans import boosting, pruning
from churnlens.plans import dealt_forests as dealt
from churnlens.plans.models import forest


def _rows(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 4))
    return x, (x[:, 0] + x[:, 1] * x[:, 2] / 6 + rng.normal(scale=2, size=n) > 10).astype(float)


@pytest.fixture(scope="module")
def frame(spark):
    x, y = _rows()
    rows = [(*map(float, r), float(c), k % 3) for k, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows + [(9.0, 9.0, 9.0, 9.0, 1.0, None)], "a double, b double, c double, d double, label double, fold int")
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).repartition(3).persist()


def _plain(x, yes, weight, depth, min_leaf, level=0):
    """(column, bin, left, right), or a leaf's (no, yes)."""
    at = lambda m: np.array([weight[m & ~yes].sum(), weight[m & yes].sum()], float)
    every = np.ones(len(x), bool)
    total, best = at(every), (1e-12, None)
    if level == depth or not total.all():
        return tuple(total)
    pure = lambda c: (c ** 2).sum() / c.sum()
    for c in range(x.shape[1]):
        for b in range(31):
            left = at(x[:, c] <= b)
            right = total - left
            if min(left.sum(), right.sum()) >= max(1, min_leaf):
                gain = (pure(left) + pure(right) - pure(total)) / total.sum()
                if gain > best[0] * (1 + 1e-9):
                    best = gain, (c, b)
    if best[1] is None:
        return tuple(total)
    c, b = best[1]
    down = x[:, c] <= b
    return (c, b, *[_plain(x[m], yes[m], weight[m], depth, min_leaf, level + 1) for m in (down, ~down)])


def _nested(tree, k=0):
    if tree[2][k] < 0:
        assert tree[0][k] == tree[1][k] == k
        return tuple(tree[6][k] * tree[5][k])
    return int(tree[2][k]), int(tree[3][k]), _nested(tree, tree[0][k]), _nested(tree, tree[1][k])


def _same(a, b):
    if len(a) != len(b):
        return False
    return np.allclose(a, b) if len(a) == 2 else a[:2] == b[:2] and _same(a[2], b[2]) and _same(a[3], b[3])


@pytest.mark.parametrize("opened", [1 << 15, 3])
def test_a_tree_equals_a_plain_one(monkeypatch, opened):
    monkeypatch.setattr(dealt, "OPEN", opened)
    monkeypatch.setattr(dealt, "STEP", 100)
    x, y = _rows(300)
    weight = np.random.default_rng(1).integers(1, 4, 300)
    for depth, min_leaf in ((1, 1), (4, 1), (9, 1), (9, 25), (5, 400)):
        tree = dealt.grow(x.astype(np.uint8), y > 0, weight, depth, min_leaf, 4, np.random.default_rng(0))
        assert _same(_nested(tree), _plain(x, y > 0, weight, depth, min_leaf))
        assert tree[4].max() <= depth and tree[5][0] == weight.sum()
        known = dealt.root_sums(x.astype(np.uint8), y > 0, weight)
        again = dealt.grow(x.astype(np.uint8), y > 0, weight, depth, min_leaf, 4, np.random.default_rng(0), root=known)
        assert all(np.array_equal(a, b) for a, b in zip(tree, again))


def test_nodes_draw_their_own_columns():
    x, y = _rows(2000)
    tree = dealt.grow(x.astype(np.uint8), y > 0, np.ones(len(x)), 12, 1, 1, np.random.default_rng(0))
    at_three = tree[2][(tree[4] == 3) & (tree[2] >= 0)]
    assert len(set(at_three.tolist())) > 1  # nodes of a level do not share their draw
    assert dealt.n_asked("auto", 17, 85) == 5 and dealt.n_asked("auto", 17, 1) == 17 and dealt.n_asked("3", 17, 85) == 3


def test_one_tree_is_sparks(frame):
    rows = frame.where("fold is not null").coalesce(1).persist()
    edges = boosting.column_edges(rows, 4, boosting.BINS)
    every = rows.collect()
    x, yes = np.array([r.features.toArray() for r in every]), np.array([r.label > 0 for r in every])
    bins = np.stack([np.searchsorted(e, x[:, c]) for c, e in enumerate(edges)], axis=1).astype(np.uint8)
    for depth, min_leaf in ((1, 1), (3, 1), (5, 20)):
        model = forest(numTrees=1, maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="all", bootstrap=False).fit(rows)
        tree = pruning.Nodes(np.zeros(1, np.int64), *dealt.grow(bins, yes, np.ones(len(x)), depth, min_leaf, 4, np.random.default_rng(0)))
        raw = np.array([r.probability.toArray() for r in model.transform(rows).select("probability").collect()])
        assert np.allclose(tree.votes(bins, depth, 2)[:, 0], raw)


def test_grids_equal_the_votes_of_the_same_trees(spark, frame, monkeypatch):
    monkeypatch.setattr(dealt, "STEP", 64)
    dealer = dealt.Dealer(frame, 4)
    variants = [(1, "auto"), (20, "3")]
    points = [[pruning.Point(t, d, s) for t in (2, 7) for d in (3, 8) for s in (2, 60)], [pruning.Point(5, 8, 2)]]
    found = dealer.scores(variants, points, seed=4)
    assert found == dealer.scores(variants, points, seed=4) != dealer.scores(variants, points, seed=5)
    blocks = [(np.frombuffer(x, np.uint8).reshape(-1, n), np.frombuffer(y, np.float64), f) for _, (n, x, y, f) in sorted(dealer.blocks.collect())]
    for (min_leaf, subset), own, got in zip(variants, points, found):
        ratios = [[] for _ in own]
        for f in range(3):
            x, yes = dealt._train(blocks, f)
            held, real = np.concatenate([b[0].T for b in blocks if b[2] == f]), np.concatenate([b[1] for b in blocks if b[2] == f]) > 0
            drawn = [np.bincount(r.integers(0, len(x), r.poisson(len(x))), minlength=len(x)) for r in (np.random.default_rng([4, f, t]) for t in range(7))]
            assert abs(np.mean(drawn) - 1) < 0.1 and abs(np.mean(np.array(drawn) == 0) - np.exp(-1)) < 0.05
            trees = [pruning.Nodes(np.zeros(1, np.int64), *dealt.grow(x[w > 0], yes[w > 0], w[w > 0], 8, min_leaf, dealt.n_asked(subset, 4, 7), np.random.default_rng([4, f, t, 1])))
                     for t, w in enumerate(drawn)]
            for each, p in zip(ratios, own):
                votes = sum(t.votes(held, p.depth, p.min_split)[:, 0] for t in trees[:p.trees])
                said = votes[:, 1] > votes[:, 0] + 1e-9
                each.append(((said & real).sum() / max(1, said.sum()), (said & real).sum() / real.sum()))
        assert np.allclose(got, [np.mean(each, axis=0) for each in ratios])


def test_no_node_of_a_large_search_reaches_the_driver(frame, monkeypatch):
    monkeypatch.setattr(pruning, "DEALT_ROWS", 100)
    monkeypatch.setattr(pruning, "read_nodes", None)  # every forest passed here before
    search = pruning.ForestSearch(frame, 4)
    search.stage("trees", trees=[2, 5])
    best = search.stage("depth", depth=[1, 4], min_split=[2, 30])
    search.stage("leaf", min_leaf=[1, 40])
    search.stage("features", max_features=[2, 4])
    rows = search.table().collect()
    assert [r.stage for r in rows] == ["trees"] * 2 + ["depth"] * 4 + ["leaf"] * 2 + ["features"] * 2
    second = [r for r in rows if r.stage == "depth"]
    first = next(r for r in second if r.recall == max(r.recall for r in second))
    assert (best["depth"], best["min_split"]) == (first.depth, first.min_split)
    assert all(0.5 < r.recall <= 1 for r in rows if r.depth > 1)


def test_what_is_not_dealt(spark, frame, monkeypatch):
    assert pruning.ForestSearch(frame, 4).dealer is None  # few rows
    monkeypatch.setattr(pruning, "DEALT_ROWS", 100)
    monkeypatch.setattr(boosting, "WHOLE", 100)
    assert pruning.ForestSearch(frame, 4).dealer is None  # more than a task may hold
    with pytest.raises(ValueError):
        dealt.Dealer(frame.withColumn("label", frame.label * 2), 4)
    one = dealt.Dealer(frame.where("fold = 1"), 4)  # nothing to train on
    assert one.scores([(1, "auto")], [[pruning.Point(3, 4)]]) == [[(0.0, 0.0)]]
