"""Forests whose trees are dealt to tasks (J9-J12 on larger tables).

A deep tree has few rows a node, and a pass over all rows a level, with the sums of all
nodes, costs more than the rows do.  Binned rows are a byte a column: while they are at most
``boosting.WHOLE`` bytes, a shuffle hands them to every task, which grows the trees dealt to
it level by level.  A tree goes from its task to those that score its fold's rows; the driver
gets three counts a grid point and part, never a node.

A tree is that of a random forest: rows drawn by Poisson(1), columns drawn anew for every node, Gini, at most ``BINS`` quantile bins, both sides
of a split with ``min_leaf`` drawn rows.  Draws are seeded by fold and tree, so variants
of a forest share their rows.  Of equal splits the first column, then the lowest bin, wins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.plans import boosting
from churnlens.session import ensure_checkpoint_dir, ship_package

STEP = 65_536     # rows worked on at a time
OPEN = 32_768     # nodes whose sums are held at a time
PART = 262_144    # rows scored by a task
LEAST_GAIN = 1e-12


def n_asked(subset: str, n_columns: int, trees: int) -> int:
    """Columns drawn for a node, as Spark reads ``featureSubsetStrategy``."""
    if subset == "auto":
        subset = "all" if trees == 1 else "sqrt"
    named = {"all": n_columns, "sqrt": math.ceil(math.sqrt(n_columns))}
    return named[subset] if subset in named else min(n_columns, int(subset))


def root_sums(x: np.ndarray, yes: np.ndarray, weight: np.ndarray, bins: int = boosting.BINS) -> np.ndarray:
    """(columns, bins, 2): what every variant's root sums of the same rows."""
    return np.stack([np.bincount(2 * own.astype(np.int64) + yes, weight, minlength=2 * bins).reshape(bins, 2) for own in x.T])


def _best(flat, off, slot, yes, weight, counts, drawn, min_leaf: int, bins: int, known=None):
    """Per open node: (column or -1, bin, left counts) of its best split.  ``off``: where a row
    begins in ``flat``; ``slot``: its node; ``counts`` (nodes, 2); ``known``: the sums of a
    single node, if they are there already."""
    m = len(counts)
    gain, column, cut, lefts = np.full(m, LEAST_GAIN), np.full(m, -1), np.zeros(m, np.int64), np.zeros((m, 2))
    n = counts.sum(axis=1)
    pure = (counts ** 2).sum(axis=1) / n
    size, every = m * 2 * bins, np.arange(m)
    step = max(STEP, size)
    base = slot * (2 * bins) + yes
    for own in drawn.T:
        own, sums = np.ascontiguousarray(own), np.zeros(size) if known is None else known[own[0]]
        for s in range(0, len(off), step) if known is None else ():
            part = slice(s, s + step)
            sums += np.bincount(base[part] + 2 * flat[off[part] + own[slot[part]]].astype(np.int64), weight[part], minlength=size)
        left = np.cumsum(sums.reshape(m, bins, 2), axis=1)[:, :-1]
        right = counts[:, None] - left
        ln, rn = left.sum(axis=2), right.sum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            new = ((left ** 2).sum(axis=2) / ln + (right ** 2).sum(axis=2) / rn - pure[:, None]) / n[:, None]
        new[(ln < min_leaf) | (rn < min_leaf)] = -1
        at = new.argmax(axis=1)
        better = new[every, at] > gain * (1 + 1e-9)
        gain[better], column[better], cut[better], lefts[better] = new[every, at][better], own[better], at[better], left[every, at][better]
    return column, cut, lefts


def grow(x: np.ndarray, yes: np.ndarray, weight: np.ndarray, depth: int, min_leaf: int, asked: int, rng, bins: int = boosting.BINS, root=None) -> tuple:
    """A tree over rows ``x`` (rows, columns) of bins: arrays (left, right, column, cut, level,
    rows, shares) by node, level by level; a leaf is its own child.  ``root``: ``root_sums``,
    if known."""
    n_columns = x.shape[1]
    flat, off = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * n_columns
    yes, weight, at = yes.astype(np.int64), weight.astype(float), np.zeros(len(x), np.int64)
    counts = np.bincount(yes, weight, minlength=2)[None]
    first, levels = 0, []
    for level in range(depth + 1):
        m = len(counts)
        column, cut, left = np.full(m, -1, np.int16), np.zeros(m, np.uint8), np.arange(first, first + m)
        levels.append((left, column, cut, np.full(m, level, np.uint8), counts))
        opened = np.flatnonzero((counts > 0).all(axis=1)) if level < depth else ()
        if not len(opened):
            break
        slot = np.full(m, -1)
        slot[opened] = np.arange(len(opened))
        mine = slot[at]
        off, yes, weight, mine = (v[mine >= 0] for v in (off, yes, weight, mine))
        lefts = np.zeros((m, 2))
        for a in range(0, len(opened), OPEN):
            nodes = opened[a:a + OPEN]
            drawn = (np.sort(rng.random((len(nodes), n_columns)).argsort(axis=1)[:, :asked], axis=1) if asked < n_columns
                     else np.tile(np.arange(n_columns), (len(nodes), 1)))
            rows = (off, mine, yes, weight)
            if len(opened) > OPEN:
                here = (mine >= a) & (mine < a + OPEN)
                rows = (off[here], mine[here] - a, yes[here], weight[here])
            column[nodes], cut[nodes], lefts[nodes] = _best(flat, *rows, counts[nodes], drawn, max(1, min_leaf), bins, None if level else root)
        split = np.flatnonzero(column >= 0)
        child = np.full(m, -1)
        child[split] = 2 * np.arange(len(split))
        left[split] = first + m + child[split]
        node = opened[mine]
        kept = column[node] >= 0
        off, yes, weight, node = (v[kept] for v in (off, yes, weight, node))
        at = child[node] + (flat[off + column[node]] > cut[node])
        counts = np.stack([lefts[split], counts[split] - lefts[split]], axis=1).reshape(-1, 2)
        first += m
        if not len(split):
            break
    left, column, cut, level, counts = (np.concatenate(v) for v in zip(*levels))
    rows = counts.sum(axis=1)
    return (left.astype(np.int32), np.where(column >= 0, left + 1, left).astype(np.int32), column, cut, level, rows,
            counts / np.maximum(rows, 1e-300)[:, None])


def _train(blocks: list[tuple], fold: int) -> tuple[np.ndarray, np.ndarray]:
    own = [(x, y) for x, y, f in blocks if f != fold]
    if not own:
        return np.empty((0, len(blocks[0][0])), np.uint8), np.empty(0, bool)
    return np.ascontiguousarray(np.concatenate([x for x, _ in own], axis=1).T), np.concatenate([y for _, y in own]) > 0


def _grow_all(groups, variants, depth: int, asked: list[int], seed: int):
    """Per partition: (group, (block number, block)) -> ((fold, variant, tree), arrays)."""
    def run(items):
        mine: dict[int, list] = {}
        for g, (k, (n, x, y, fold)) in items:
            mine.setdefault(g, []).append((k, np.frombuffer(x, np.uint8).reshape(-1, n), np.frombuffer(y, np.float64), fold))
        for g, found in mine.items():
            # In the order of their numbers: a draw means the same row in every run.
            blocks, last = [b[1:] for b in sorted(found, key=lambda b: b[0])], None
            for fold, t in groups[g]:
                if fold != last:
                    (x, yes), last = _train(blocks, fold), fold
                weight = np.ones(len(x))
                if len(x):
                    rng = np.random.default_rng([seed, fold, t])
                    weight = np.bincount(rng.integers(0, len(x), rng.poisson(len(x))), minlength=len(x))
                drawn = np.flatnonzero(weight)
                rows = x[drawn], yes[drawn], weight[drawn]
                root = root_sums(*rows) if len(variants) > 1 else None
                for v, (min_leaf, _) in enumerate(variants):
                    yield (fold, v, t), grow(*rows, depth, min_leaf, asked[v], np.random.default_rng([seed, fold, t, 1]), root=root)

    return run


def leaves(tree, flat: np.ndarray, n_columns: int) -> np.ndarray:
    """The leaf of every row of ``flat`` (rows x columns bins)."""
    at = np.zeros(len(flat) // n_columns, np.int64)
    here = np.arange(len(at))
    while len(here := here[tree.column[at[here]] >= 0]):
        node = at[here]
        at[here] = tree.left[node] + (flat[here * n_columns + tree.column[node]] > tree.cut[node])
    return at


def _leads(tree, depth: int, min_split: int) -> np.ndarray:
    """By node: the lead of yes over no at the first closed node on its way."""
    shut, lead = tree.closed(depth, min_split), tree.shares[:, 1] - tree.shares[:, 0]
    for level in range(int(tree.level.max(initial=0))):
        at = np.flatnonzero((tree.level == level) & shut & (tree.column >= 0))
        for child in (tree.left[at], tree.right[at]):
            lead[child], shut[child] = lead[at], True
    return lead


def _score_all(points: list[list], n_columns: int):
    """Per partition, sorted by (part, kind, variant, tree): blocks, then trees one by one ->
    (variant, point, fold, hits, said, actual)."""
    from churnlens.plans.pruning import Nodes

    def run(items):
        x, y, votes, at, flat = [], [], None, None, None
        for (part, kind, v, _), value in items:
            if not kind:
                x.append(np.frombuffer(value[1], np.uint8).reshape(-1, value[0]).T)
                y.append(np.frombuffer(value[2], np.float64) > 0)
                continue
            fold, t, arrays = value
            if not x:  # a part without rows
                continue
            if flat is None:
                flat, real = np.concatenate(x).ravel(), np.concatenate(y)
            if at != (fold, v):
                if at is not None:
                    yield from counted(at, votes, real)
                at = fold, v
                ends = sorted({p.trees for p in points[v]})
                shapes = list(dict.fromkeys((p.depth, p.min_split) for p in points[v]))
                votes = {s: np.zeros((len(ends), len(real))) for s in shapes}
            tree = Nodes(np.zeros(1, np.int64), *arrays)
            stretch = int(np.searchsorted(ends, t, side="right"))
            if stretch == len(ends):
                continue
            leads = {s: _leads(tree, *s) for s in shapes}
            for a in range(0, len(real), STEP):
                leaf = leaves(tree, flat[a * n_columns:(a + STEP) * n_columns], n_columns)
                for s in shapes:
                    votes[s][stretch, a:a + STEP] += leads[s][leaf]
        if at is not None:
            yield from counted(at, votes, real)

    def counted(at, votes, real):
        fold, v = at
        ends = sorted({p.trees for p in points[v]})
        sums = {s: np.cumsum(each, axis=0) for s, each in votes.items()}
        for k, p in enumerate(points[v]):
            # Shares of a tie do not add up to 0 exactly.
            said = sums[p.depth, p.min_split][ends.index(p.trees)] > 1e-9
            yield v, k, fold, int((said & real).sum()), int(said.sum()), int(real.sum())

    return run


class Dealer:
    """The binned rows of ``df`` (features vector of ``n_columns``, label 0/1, fold), kept for
    several forests; rows without a fold take no part."""

    def __init__(self, df: DataFrame, n_columns: int, fold_col: str = "fold"):
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        df = df.where(F.col(fold_col).isNotNull())
        self.sc, self.n_columns = spark.sparkContext, n_columns
        counts = {(r[0], r[1]): r[2] for r in df.groupBy(F.col(fold_col).cast("long"), F.col("label").cast("double")).count().collect()}
        if not {y for _, y in counts} <= {0.0, 1.0}:
            raise ValueError("two classes are needed")
        self.folds = sorted({f for f, _ in counts})
        self.rows = {f: sum(n for (g, _), n in counts.items() if g == f) for f in self.folds}
        edges = boosting.column_edges(df, n_columns, boosting.BINS)
        self.blocks = (boosting._binned(df, edges, fold_col).rdd
                       .mapPartitionsWithIndex(lambda i, rows: (((i, k), (r.n, r.x, r.y, r.fold)) for k, r in enumerate(rows)))
                       .persist(StorageLevel.MEMORY_AND_DISK))

    def scores(self, variants: Sequence[tuple[int, str]], points: list[list], seed: int = 0) -> list[list[tuple[float, float]]]:
        """For each variant (min_leaf, subset) its points' mean precision and recall over the
        folds (0 where nothing is said, or nothing there to find)."""
        trees, depth = (max(getattr(p, a) for each in points for p in each) for a in ("trees", "depth"))
        tasks, folds = self.sc.defaultParallelism, self.folds
        items = [(f, t) for f in folds for t in range(trees)]
        share = -(-len(items) // tasks)
        groups = [items[k:k + share] for k in range(0, len(items), share)]  # of few folds each
        asked = [n_asked(subset, self.n_columns, trees) for _, subset in variants]
        grown = (self.blocks.flatMap(lambda b: [(g, b) for g in range(len(groups))]).partitionBy(len(groups), int)
                 .mapPartitions(_grow_all(groups, list(variants), depth, asked, seed)))
        each = max(1, tasks // len(folds), -(-max(self.rows.values()) // PART))  # parts of a fold
        place = {f: range(k * each, (k + 1) * each) for k, f in enumerate(folds)}
        rows = self.blocks.map(lambda b: ((place[b[1][3]][sum(b[0]) % each], 0, 0, b[0]), b[1]))
        sent = grown.flatMap(lambda g: [((p, 1, g[0][1], (g[0][2], 0)), (g[0][0], g[0][2], g[1])) for p in place[g[0][0]]])
        found = (rows.union(sent).repartitionAndSortWithinPartitions(each * len(folds), lambda key: key[0])
                 .mapPartitions(_score_all(points, self.n_columns)).collect())
        sums: dict[tuple, np.ndarray] = {}
        for v, k, f, *counts in found:
            sums[v, k, f] = sums.get((v, k, f), np.zeros(3)) + counts
        ratio = lambda a, b: float(a / b) if b else 0.0
        return [[(float(np.mean([ratio(sums[v, k, f][0], sums[v, k, f][1]) for f in folds])),
                  float(np.mean([ratio(sums[v, k, f][0], sums[v, k, f][2]) for f in folds]))) for k in range(len(points[v]))]
                for v in range(len(variants))]
