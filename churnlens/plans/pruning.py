"""Forest grids by pruning (J9-J12): one deep forest a fold scores every point of a grid.

A greedy tree of depth d whose nodes split only with ``min_split`` rows is the deeper tree
with its lower and its smaller nodes closed, so depth and minimum split need no fit of
their own; the first m trees of a forest are a forest of m trees.  Leaf size and columns
per split change the splits: they cost one forest a value and fold.

Spark closes a node whose two leaves say the same class; after pruning that is done again,
so the votes are those of a forest grown with the smaller depth (equal to Spark's where
the splits draw no columns; tested).  Rows of a node are counted in the tree's own
bootstrap sample.

A search over ``DEALT_ROWS`` rows or more, while their bins are at most ``boosting.WHOLE``
bytes, deals the trees to tasks (``dealt_forests``), and no node reaches the driver.  Below
and above that Spark fits the forests.  Their nodes then pass through the driver, as the
fitted model itself does in Spark: at most trees x 2^(depth + 1).  The rows are scored where
they stand; a task returns three counts a grid point and fold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.plans import boosting, dealt_forests
from churnlens.plans.models import forest
from churnlens.plans.tune import _pmap
from churnlens.session import scratch_path, ship_package


FITS = 8  # fits at a time
LEAST_ROWS, MOST_ROWS = 16_384, 262_144  # of a partition
DEALT_ROWS = 16_384  # from so many rows on, a search deals its trees to tasks


class Point(NamedTuple):
    trees: int
    depth: int
    min_split: int = 2


class Nodes(NamedTuple):
    """All nodes of a forest, tree by tree; a leaf is its own child."""
    roots: np.ndarray
    left: np.ndarray
    right: np.ndarray
    column: np.ndarray  # -1: leaf
    cut: np.ndarray     # rows above it go right
    level: np.ndarray
    rows: np.ndarray
    shares: np.ndarray  # (nodes, 2): class shares

    def closed(self, depth: int, min_split: int) -> np.ndarray:
        """Which nodes are leaves after pruning; what lies below them is not reached."""
        shut = (self.column < 0) | (self.level >= depth) | (self.rows < min_split)
        says = self.shares[:, 1] > self.shares[:, 0]
        for level in range(int(self.level.max(initial=0)) - 1, -1, -1):
            at = np.flatnonzero((self.level == level) & ~shut)
            a, b = self.left[at], self.right[at]
            shut[at] = shut[a] & shut[b] & (says[a] == says[b])
        return shut

    def votes(self, x: np.ndarray, depth: int, min_split: int, shut: np.ndarray | None = None) -> np.ndarray:
        """(rows, trees, 2): running sums over the trees of their class shares; ``shut`` is what
        ``closed`` says, if known."""
        shut = self.closed(depth, min_split) if shut is None else shut
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(min(depth, int(self.level.max(initial=0)))):
            down = np.where(x[rows, np.maximum(self.column[at], 0)] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(shut[at], at, down)
        return np.cumsum(self.shares[at], axis=1)


def read_nodes(spark: SparkSession, model: RandomForestClassificationModel) -> Nodes:
    """The nodes of a fitted two-class forest over numbers."""
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
    model.write().save(path)
    node, split = F.col("nodeData"), F.col("nodeData.split")
    found = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["rawCount"].cast("double").alias("rows"), F.size(node["impurityStats"]).alias("classes"),
        node["impurityStats"][0].alias("no"), node["impurityStats"][1].alias("yes"), split["featureIndex"].alias("column"),
        split["numCategories"].alias("kinds"), F.try_element_at(split["leftCategoriesOrThreshold"], F.lit(1)).alias("cut")).toArrow()
    # Plain columns: a row object a node took longer than the fit of a small forest.
    of = {c: found.column(c).to_numpy() for c in found.column_names}
    order = np.lexsort((of["id"], of["tree"]))
    of = {c: v[order] for c, v in of.items()}
    if (of["classes"] != 2).any():
        raise ValueError("two classes are needed")
    inner = np.flatnonzero(of["left"] >= 0)
    if (of["kinds"][inner] >= 0).any():
        raise ValueError("categorical splits are not pruned")
    n = len(order)
    name = of["tree"].astype(np.int64) << 32 | of["id"].astype(np.int64)
    left, right, column, cut, level = np.arange(n), np.arange(n), np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
    for down, side in ((left, "left"), (right, "right")):
        down[inner] = np.searchsorted(name, of["tree"][inner].astype(np.int64) << 32 | of[side][inner].astype(np.int64))
    column[inner], cut[inner] = of["column"][inner], of["cut"][inner]
    roots = np.flatnonzero(of["id"] == 0)
    at = roots[column[roots] >= 0]
    while len(at):
        under = np.concatenate([left[at], right[at]])
        level[under] = np.tile(level[at] + 1, 2)
        at = under[column[under] >= 0]
    counts = np.stack([of["no"], of["yes"]], axis=1).astype(float)
    return Nodes(roots, left, right, column, cut, level, of["rows"], counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300))


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as its rows need: ``LEAST_ROWS`` each up to a task a core,
    ``MOST_ROWS`` beyond.  A task of a forest's fit sends the sums of all nodes of a level,
    whatever its rows, so few rows in many partitions cost more there than the rows."""
    rows = df.count()
    return df.repartition(max(1, -(-rows // MOST_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS))))


def fit_variants(df: DataFrame, trees: int, depth: int, variants: Sequence[tuple[int, str]], fold_col: str = "fold",
                 seed: int = 0) -> dict[tuple[int, str], dict[int, Nodes]]:
    """For each variant (min_leaf, subset) one forest per fold of ``df`` (features, label 0/1,
    fold), on the rows of the others; fits run from ``FITS`` driver threads."""
    folds = sorted(int(r[0]) for r in df.select(fold_col).distinct().collect() if r[0] is not None)

    def one(at):
        (min_leaf, subset), f = at
        est = forest(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy=subset, seed=seed)
        return read_nodes(df.sparkSession, est.fit(df.where(F.col(fold_col) != f)))

    every = [(v, f) for v in variants for f in folds]
    out: dict[tuple[int, str], dict[int, Nodes]] = {v: {} for v in variants}
    for (v, f), nodes in zip(every, _pmap(one, every, FITS)):
        out[v][f] = nodes
    return out


def fit_forests(df: DataFrame, trees: int, depth: int, min_leaf: int = 1, subset: str = "auto",
                fold_col: str = "fold", seed: int = 0) -> dict[int, Nodes]:
    """One forest per fold."""
    return fit_variants(df, trees, depth, [(min_leaf, subset)], fold_col, seed)[min_leaf, subset]


def _counts(forests: dict[int, Nodes], points: Sequence[Point]):
    shapes = sorted({(p.depth, p.min_split) for p in points})

    def run(batches: Iterable[pd.DataFrame]):
        shut = {(f, s): nodes.closed(*s) for f, nodes in forests.items() for s in shapes}
        for batch in batches:
            out = []
            for fold, part in batch.groupby("fold"):
                x, real = np.stack(part["x"].to_numpy()), part["y"].to_numpy() > 0
                for shape in shapes:
                    votes = forests[int(fold)].votes(x, *shape, shut[int(fold), shape])
                    for k, p in enumerate(points):
                        if (p.depth, p.min_split) == shape:
                            said = votes[:, p.trees - 1, 1] > votes[:, p.trees - 1, 0]
                            out.append((k, int(fold), int((said & real).sum()), int(said.sum()), int(real.sum())))
            yield pd.DataFrame(out, columns=["point", "fold", "hits", "said", "actual"])

    return run


def score(df: DataFrame, forests: dict[int, Nodes], points: Sequence[Point], fold_col: str = "fold") -> list[tuple[float, float]]:
    """Mean precision and recall over the folds of every point (0 where nothing is said,
    or nothing there to find), from one pass over the rows."""
    ship_package(df.sparkSession)
    rows = df.where(F.col(fold_col).isNotNull()).select(
        vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), F.col(fold_col).cast("long").alias("fold"))
    sums = (rows.mapInPandas(_counts(forests, points), "point int, fold long, hits long, said long, actual long")
            .groupBy("point", "fold").agg(F.sum("hits").alias("hits"), F.sum("said").alias("said"), F.sum("actual").alias("actual")))
    found = {(r.point, r.fold): r for r in sums.collect()}
    out = []
    for k in range(len(points)):
        each = [found[k, f] for f in forests]
        out.append((float(np.mean([r.hits / r.said if r.said else 0.0 for r in each])),
                    float(np.mean([r.hits / r.actual if r.actual else 0.0 for r in each]))))
    return out


# Columns of a table of scores.
STAGE_SCHEMA = ("stage string, trees int, depth int, min_split int, min_leaf int, max_features int, "
                "precision double, recall double")


class ForestSearch:
    """Staged search (J9-J12): number of trees, depth x split, split x leaf, columns per
    split, each from the best of the stages before; the first of best recall wins.

    ``rows`` collects (stage, trees, depth, min_split, min_leaf, max_features or None,
    precision, recall)."""

    def __init__(self, df: DataFrame, n_columns: int, fold_col: str = "fold"):
        self.df, self.n_columns, self.fold_col = gathered(df).persist(), n_columns, fold_col
        rows = self.df.count()
        self.dealer = dealt_forests.Dealer(self.df, n_columns, fold_col) if rows >= DEALT_ROWS and rows * n_columns <= boosting.WHOLE else None
        self.best = dict(trees=10, depth=30, min_split=2, min_leaf=1, max_features=None)
        self.rows: list[tuple] = []

    def stage(self, name: str, **axes) -> dict:
        """Every combination of ``axes`` over the best values so far, the first axis slowest."""
        grid = [dict(self.best)]
        for axis, values in axes.items():
            grid = [{**g, axis: v} for g in grid for v in values]
        fits: dict[tuple[int, str], list[dict]] = {}
        for g in grid:
            fits.setdefault((g["min_leaf"], "auto" if g["max_features"] is None else str(g["max_features"])), []).append(g)
        if self.dealer:
            points = [[Point(g["trees"], g["depth"], g["min_split"]) for g in gs] for gs in fits.values()]
            found = {tuple(g.values()): s for gs, each in zip(fits.values(), self.dealer.scores(list(fits), points)) for g, s in zip(gs, each)}
            return self._chosen(name, grid, found)
        grown = fit_variants(self.df, max(g["trees"] for g in grid), max(g["depth"] for g in grid), list(fits), self.fold_col)

        def scores(variant):
            points = [Point(g["trees"], g["depth"], g["min_split"]) for g in fits[variant]]
            return score(self.df, grown[variant], points, self.fold_col)

        found = {tuple(g.values()): s for v, each in zip(fits, _pmap(scores, list(fits), FITS)) for g, s in zip(fits[v], each)}
        return self._chosen(name, grid, found)

    def _chosen(self, name: str, grid: list[dict], found: dict) -> dict:
        scored = [(name, *g.values(), *found[tuple(g.values())]) for g in grid]
        self.rows += scored
        self.best = grid[max(range(len(grid)), key=lambda k: (scored[k][-1], -k))]
        return self.best

    def table(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(self.rows, STAGE_SCHEMA)
