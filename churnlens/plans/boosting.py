"""Many gradient-boosted models fitted in lock step.

A sweep fits the same boosting on dozens of column sets, folds and parameters.  Fitted one
after another, every tree level of every model is a pass of its own over the rows.  Here
all models grow their trees together: columns are binned once, each row carries its score
under every model, and a level of all models' trees is one pass that sums (rows,
residuals, curvature) per (model, node, column, bin).  Sums are added per model, and the
task that adds them picks the model's splits, so the driver gets a few numbers per model
and node, whatever the rows.  Where the sums of all tasks are no more than ``DIRECT`` bytes
(a few models, a few tasks), the driver adds them itself, which saves a shuffle a pass.  17 column sets x 5 folds x 100 trees of depth 3 are 300
passes instead of 25,500.

The first m trees of a model are the m-tree model, so every tree count is scored on the
way (``staged``): a grid over the number of trees costs one fit.

Boosting: binomial loss, least-squares splits of the residuals by the improvement
n_l n_r / (n_l + n_r) (mean_l - mean_r)^2, leaves by one Newton step, shrunk by ``rate``;
a node splits if it has ``min_split`` rows and both sides keep ``min_leaf``.  Of equal
splits the first column of the model, then the lowest bin, wins.  Columns are cut at up to
``BINS`` - 1 quantiles.

The rows stand in blocks of numpy arrays, a few thousand rows each, in a persisted RDD:
per-partition state that every pass updates; columns and the scores of a model lie
together, so a pass reads them in order.  A block's rows are of one fold: it carries scores
of the models that train on it or are scored on it, and a level sums it for those only that
train on it.  Every core gets its share of the rows.  The
state is checkpointed every ``FOLD`` trees, so a lost executor costs its blocks' last
trees; the state before goes as soon as the next one stands.

Curvature is only needed where leaves come out: above a model's last level a node's total
is summed, not its bins.  Row counts of the root are the same for all models that train on
a block.

Binned rows are small (a byte a column).  While those that a task's models need are at most
``WHOLE`` bytes, the models are dealt to tasks instead of the rows: a shuffle hands every task
the blocks its models train on or are scored on, and it grows their trees without a pass
between the levels.  Above that, for fits of fewer than ``FOLD`` trees and for one model,
passes over dealt rows as above.  Both grow the same trees (up to rounding).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir, ship_package

BINS = 32
BLOCK = 8192           # rows of a block
ROWS_PER_TASK = 262_144
LEAST_ROWS = 2_048     # fewer rows are no task of their own
MASKED = 8             # nodes of a level that are told apart one by one
FOLD = 25              # trees between checkpoints
DIRECT = 1 << 23       # bytes of all tasks' sums that the driver adds up itself
WHOLE = 1 << 27        # bytes of binned rows that a task may hold
CHUNK = 16_384         # of them, rows worked on at a time


class Model(NamedTuple):
    columns: tuple[int, ...]       # positions in the feature vector
    fold: int | None = None        # held out; None: all rows train
    depth: int = 3
    min_split: int = 2
    min_leaf: int = 1


def own_rows(fold: int) -> int:
    """Fold number of rows that only the models holding out ``fold`` train on (synthetic
    rows drawn from that training part); no model is scored on them."""
    return -2 - fold


def _trains(fold: int | None, held: int | None) -> bool:
    if fold is not None and fold < -1:
        return held is not None and fold == own_rows(held)
    return fold != held


def _concerned(models: list[Model], fold: int) -> list[int]:
    """Models that rows of ``fold`` train or are scored by."""
    return [m for m, model in enumerate(models) if fold == model.fold or _trains(fold, model.fold)]


class Tree(NamedTuple):
    """One tree of every model; node i has the children 2i and 2i + 1."""
    column: np.ndarray  # (models, nodes), -1: no split
    bin: np.ndarray     # rows with a larger bin go right
    value: np.ndarray

    @classmethod
    def empty(cls, models: int, depth: int) -> "Tree":
        nodes = 2 << depth
        return cls(np.full((models, nodes), -1, np.int16), np.zeros((models, nodes), np.int16), np.zeros((models, nodes)))

    def nodes(self, m: int, x: np.ndarray, levels: int) -> np.ndarray:
        """The node of model ``m`` that each row of ``x`` (columns, rows) is in after ``levels`` levels."""
        at = self.roots(x.shape[1])
        for level in range(levels):
            at = self.down(m, x, at, level)
        return at.astype(np.intp)

    def roots(self, rows: int) -> np.ndarray:
        return np.ones(rows, np.uint8 if self.column.shape[1] <= 256 else np.int32)

    def down(self, m: int, x: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """The nodes after ``level`` + 1 levels of rows that are in ``at`` after ``level``."""
        first, last = 1 << level, 2 << level
        here = [(k, c, b) for k, c, b in zip(range(first, last), self.column[m, first:last].tolist(), self.bin[m, first:last].tolist()) if c >= 0]
        if not here:
            return at
        if len(here) <= MASKED:
            steps = [(at == k) * ((x[c] > b) + at.dtype.type(k)) for k, c, b in here]  # from k to 2 k or 2 k + 1
            return at + sum(steps[1:], steps[0])
        c = self.column[m][at]
        down = 2 * at.astype(np.intp) + (x[np.maximum(c, 0), np.arange(x.shape[1])] > self.bin[m][at])
        return np.where(c >= 0, down, at).astype(at.dtype)


class Fit(NamedTuple):
    precision: np.ndarray    # (trees + 1, models): held-out rows, after each number of trees
    recall: np.ndarray
    importance: np.ndarray   # (models, columns), each model's sums to 1 if it split at all
    trees: list[Tree]
    start: np.ndarray        # score before the first tree
    edges: list[np.ndarray]  # per column: upper bounds of its bins but the last


def best_splits(model: Model, sums: np.ndarray) -> list[tuple]:
    """Of sums (nodes, columns, bins, 3): per node (column or -1, bin, improvement, rows,
    residual and curvature sums, the same of the left side)."""
    left = np.cumsum(sums, axis=2)
    total = left[:, :, -1:, :]
    nl, rl = left[..., 0], left[..., 1]
    nr, rr = total[..., 0] - nl, total[..., 1] - rl
    ok = (nl >= max(1, model.min_leaf)) & (nr >= max(1, model.min_leaf)) & (total[..., 0] >= model.min_split)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, nl * nr / (nl + nr) * (rl / nl - rr / nr) ** 2, -1.0)
    # Sums come in no fixed order: gains that differ by rounding only count as equal.
    flat = gain.reshape(len(gain), -1)
    most = flat.max(axis=1)
    out = []
    for k, g in enumerate(flat):
        at = int(np.argmax(g >= most[k] - 1e-9 * abs(most[k])))
        c, b = divmod(at, gain.shape[2])
        split = most[k] > 1e-12
        out.append((model.columns[c] if split else -1, b, float(most[k]), tuple(total[k, 0, 0]), tuple(left[k, c, b])))
    return out


def _chances(scores: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scores, -500, 500)))


def _sums(models: list[Model], tree: Tree, level: int, bins: int):
    """Per partition: (model, sums (columns, 3, nodes x bins) of ``level``), and, at the root, what the
    held-out rows are classified as: (-1 - model, [true positives, predicted, actual])."""
    first, nodes = 1 << level, 1 << level
    size = nodes * bins  # behind the nodes' bins: rows that do not count

    def run(blocks):
        found: dict[int, np.ndarray] = {}
        for x, y, fold, scores in blocks:
            roots: dict[int, np.ndarray] = {}  # counts of the root by column
            wide = x.astype(np.intp)
            for m, score in zip(_concerned(models, fold), scores):
                model = models[m]
                if level >= model.depth:
                    continue
                if fold == model.fold and not level:
                    said = score > 0
                    new = np.array([(said & (y > 0)).sum(), said.sum(), (y > 0).sum()], float)
                    found[-1 - m] = found.get(-1 - m, 0) + new
                if not _trains(fold, model.fold):
                    continue
                p = _chances(score)
                residual, curvature = y - p, p * (1 - p)
                new = np.zeros((len(model.columns), 3, size))
                if level:
                    at = tree.nodes(m, x, level) - first
                    at[at < 0] = nodes
                    if not (at < nodes).any():
                        continue
                    base = at * bins
                else:
                    at = np.zeros(len(y), np.intp)
                for k, c in enumerate(model.columns):
                    if level:
                        key = base + wide[c]
                        new[k, 0] = np.bincount(key, minlength=size)[:size]
                    else:
                        key = wide[c]
                        if c not in roots:
                            roots[c] = np.bincount(key, minlength=size)[:size]
                        new[k, 0] = roots[c]
                    new[k, 1] = np.bincount(key, residual, minlength=size)[:size]
                    if level == model.depth - 1:
                        new[k, 2] = np.bincount(key, curvature, minlength=size)[:size]
                if level < model.depth - 1:
                    new[0, 2, ::bins] = np.bincount(at, curvature, minlength=nodes)[:nodes]
                found[m] = found[m] + new if m in found else new
        return iter(found.items())

    return run


def _sum_bytes(models: list[Model], level: int, bins: int) -> int:
    """Bytes of the sums of ``level`` from one task, whatever its rows."""
    return sum(8 * 3 * len(model.columns) * (bins << level) for model in models if level < model.depth)


def _picked(models: list[Model], level: int, bins: int):
    def run(item):
        m, sums = item
        if m < 0:
            return m, sums
        return m, best_splits(models[m], sums.reshape(-1, 3, 1 << level, bins).transpose(2, 0, 3, 1))

    return run


def _binned(df: DataFrame, edges: list[np.ndarray], fold_col: str) -> DataFrame:
    """Blocks (n, x by columns, y, fold) of packed arrays, a block of rows of one fold."""
    def run(batches):
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.append(np.nonzero(np.diff(folds))[0] + 1, batch.num_rows)
            for k, end in ((k, e) for s, e in zip(np.append(0, ends[:-1]), ends) for k in range(s, e, BLOCK)):
                part = batch.slice(k, min(BLOCK, end - k))
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                cut = np.stack([np.searchsorted(e, x[:, c]) for c, e in enumerate(edges)]).astype(np.uint8)
                packed = [cut, part.column("y").to_numpy(zero_copy_only=False).astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows])] + [pa.array([a.tobytes()], pa.binary()) for a in packed]
                                                 + [pa.array([folds[k]])], names=["n", "x", "y", "fold"])

    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"),
                     F.col(fold_col).cast("long").alias("fold"))
    return rows.sortWithinPartitions("fold").mapInArrow(run, "n long, x binary, y binary, fold long")


class _Rows:
    """The binned rows of a model in one task, and what its next tree needs of them."""

    def __init__(self, model: Model, blocks: list[tuple], start: float):
        self.x = np.concatenate([x[list(model.columns)] for x, _, _ in blocks], axis=1) if blocks else np.empty((len(model.columns), 0), np.uint8)
        self.y = np.concatenate([y for _, y, _ in blocks]) if blocks else np.empty(0)
        self.score = np.full(len(self.y), start)
        self.parts = [slice(s, s + CHUNK) for s in range(0, len(self.y), CHUNK)]


def _histograms(rows: _Rows, at: np.ndarray, slot: np.ndarray, slots: int, residual: np.ndarray, bins: int) -> np.ndarray:
    """(slots, columns, bins, 3): counts and residual sums of the nodes that have a slot."""
    found = np.zeros((len(rows.x), 2, slots * bins))
    for part in rows.parts:
        mine = slot[at[part]]
        here = np.flatnonzero(mine >= 0)
        if not len(here):
            continue
        keys, own = np.take(rows.x[:, part], here, axis=1) + mine[here] * bins, residual[part][here]
        for k, key in enumerate(keys):
            found[k, 0] += np.bincount(key, minlength=slots * bins)
            found[k, 1] += np.bincount(key, own, minlength=slots * bins)
    return _with_curvature(found.reshape(len(rows.x), 2, slots, bins).transpose(2, 0, 3, 1))


def _with_curvature(sums: np.ndarray) -> np.ndarray:
    """A place for the third sum, which leaves get by themselves here."""
    return np.concatenate([sums, np.zeros((*sums.shape[:-1], 1))], axis=-1)


def _grown(model: Model, blocks: list[tuple], start: float, trees: int, rate: float, bins: int, n_columns: int) -> tuple:
    """``model`` fitted on blocks (x, y, fold): (held-out counts after each number of trees,
    importances before they are scaled, trees of one model)."""
    rows = _Rows(model, [b for b in blocks if _trains(b[2], model.fold)], start)
    held = _Rows(model, [b for b in blocks if b[2] == model.fold], start)
    own = model._replace(columns=tuple(range(len(model.columns))))
    counts = np.stack([np.bincount(x, minlength=bins) for x in rows.x]).astype(float)  # the root's, the same for all trees
    residual, curvature, at = np.empty(len(rows.y)), np.empty(len(rows.y)), Tree.empty(1, model.depth).roots(len(rows.y))
    importance, says, grown = np.zeros(n_columns), [], []

    def classified():
        said, real = held.score > 0, held.y > 0
        says.append((float((said & real).sum()), float(said.sum()), float(real.sum())))

    for _ in range(trees):
        classified()
        tree, gains = Tree.empty(1, model.depth), np.zeros(n_columns)
        nodes = tree.column.shape[1]
        sums = np.zeros((len(rows.x), bins))
        at.fill(1)
        for part in rows.parts:
            p = _chances(rows.score[part])
            residual[part], curvature[part] = rows.y[part] - p, p * (1 - p)
            for k, x in enumerate(rows.x[:, part]):
                sums[k] += np.bincount(x, residual[part], minlength=bins)
        level, here = 0, {1: _with_curvature(np.stack([counts, sums], axis=-1)[None])[0]} if len(rows.y) else {}
        while here:
            split = {}
            for k, (c, b, gain, total, left) in zip(here, best_splits(own, np.stack(list(here.values())))):
                if c >= 0:
                    tree.column[0, k], tree.bin[0, k] = c, b
                    gains[model.columns[c]] += gain
                    split[k] = 2 * k + (left[0] > total[0] / 2)  # the child of fewer rows
            for part in rows.parts:
                at[part] = tree.down(0, rows.x[:, part], at[part], level)
            level += 1
            if level == model.depth or not split:
                break
            slot = np.full(nodes, -1, np.int64)
            slot[list(split.values())] = np.arange(len(split))
            few = _histograms(rows, at, slot, len(split), residual, bins)
            # What a node's smaller child has not is in the other.
            here = dict(sorted(x for (k, child), new in zip(split.items(), few) for x in ((child, new), (child ^ 1, here[k] - new))))
        leaf = np.zeros((nodes, 2))
        for part in rows.parts:
            for j, weight in enumerate((residual, curvature)):
                leaf[:, j] += np.bincount(at[part], weight[part], minlength=nodes)
        for k in range(nodes // 2 - 1, 0, -1):
            if tree.column[0, k] >= 0:
                leaf[k] += leaf[2 * k] + leaf[2 * k + 1]
        tree.value[0] = [_leaf((0, *x)) for x in leaf]
        for part in rows.parts:
            rows.score[part] += rate * tree.value[0][at[part]]
        for part in held.parts:
            held.score[part] += rate * tree.value[0][tree.nodes(0, held.x[:, part], model.depth)]
        importance += gains / max(gains.sum(), 1e-300)
        tree.column[0] = np.where(tree.column[0] >= 0, np.array(model.columns, np.int16)[tree.column[0]], -1)
        grown.append(tree)
    classified()
    return np.array(says), importance, grown


def _dealt(models: list[Model], tasks: int) -> list[list[int]]:
    """The models of each task: the widest first, each to the task that has least to do."""
    groups: list[list[int]] = [[] for _ in range(min(tasks, len(models)))]
    work = [0] * len(groups)
    for m in sorted(range(len(models)), key=lambda m: (-len(models[m].columns) * models[m].depth, m)):
        g = work.index(min(work))
        groups[g].append(m)
        work[g] += (len(models[m].columns) + 3) * models[m].depth
    return groups


def _fit_dealt(blocks, models: list[Model], groups: list[list[int]], start: np.ndarray, trees: int, rate: float, bins: int, n_columns: int):
    """Every model's result of ``_grown``, the models of a group in one task."""
    def sent(r):
        return [(g, (r.n, r.x, r.y, r.fold)) for g, group in enumerate(groups) if _concerned([models[m] for m in group], r.fold)]

    def run(items):
        mine: dict[int, list[tuple]] = {}
        for g, (n, x, y, fold) in items:
            mine.setdefault(g, []).append((np.frombuffer(x, np.uint8).reshape(-1, n), np.frombuffer(y, np.float64), fold))
        for g, own in mine.items():
            for m in groups[g]:
                yield m, _grown(models[m], own, start[m], trees, rate, bins, n_columns)

    return dict(blocks.rdd.flatMap(sent).partitionBy(len(groups), int).mapPartitions(run).collect())


def _one_fit(found: dict, models: list[Model], depth: int, trees: int, n_columns: int):
    """(held-out counts (trees + 1, models, 3), importances, trees of all models)."""
    says, importance = np.zeros((trees + 1, len(models), 3)), np.zeros((len(models), n_columns))
    grown = [Tree.empty(len(models), depth) for _ in range(trees)]
    for m, (said, gained, own) in found.items():
        says[:, m], importance[m] = said, gained
        for tree, part in zip(grown, own):
            for whole, column in zip(tree, part):
                whole[m, :column.shape[1]] = column[0]
    return says, importance, grown


def column_edges(df: DataFrame, n_columns: int, bins: int) -> list[np.ndarray]:
    """Per column of the vectors: upper bounds of its bins but the last."""
    shares = [(k + 1) / bins for k in range(bins - 1)]
    # A group a column: summaries, one a task and column, are merged in a task a column.
    cuts = {r.c: r.cut for r in df.select(F.posexplode(vector_to_array("features")).alias("c", "v")).groupBy("c").agg(F.percentile_approx("v", shares, 10_000).alias("cut")).collect()}
    return [np.unique(np.array(cuts.get(c) or [], float)) for c in range(n_columns)]


def fit(df: DataFrame, n_columns: int, models: list[Model], trees: int = 100, rate: float = 0.1, fold_col: str = "fold",
        bins: int = BINS) -> Fit:
    """Fit ``models`` on ``df`` (features vector of ``n_columns``, label 0/1, fold)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    counts = {(r[0], r[1]): r[2] for r in df.groupBy(F.col(fold_col).cast("long"), F.col("label").cast("int")).count().collect()}
    start = np.zeros(len(models))
    for m, model in enumerate(models):
        no, yes = (sum(n for (f, y), n in counts.items() if y == label and _trains(f, model.fold)) for label in (0, 1))
        start[m] = np.log(max(yes, 1e-9) / max(no, 1e-9)) if yes + no else 0.0
    n = sum(counts.values())
    tasks = max(1, -(-n // ROWS_PER_TASK), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    edges = column_edges(df.coalesce(tasks), n_columns, bins)
    depth = max(m.depth for m in models)
    blocks = _binned(df.repartition(tasks), edges, fold_col)
    groups = _dealt(models, spark.sparkContext.defaultParallelism)
    widest = max(sum(c for (f, _), c in counts.items() if _concerned([models[m] for m in g], f)) for g in groups) * n_columns
    if len(models) > 1 and trees >= FOLD and widest <= WHOLE:
        says, importance, grown = _one_fit(_fit_dealt(blocks, models, groups, start, trees, rate, bins, n_columns), models, depth, trees, n_columns)
        return _scored(says, importance, grown, start, edges)

    def first(r):
        y = np.frombuffer(r.y, np.float64)
        return np.frombuffer(r.x, np.uint8).reshape(-1, r.n), y, r.fold, np.tile(start[_concerned(models, r.fold), None], (1, r.n))

    state = blocks.rdd.map(first).persist(StorageLevel.MEMORY_AND_DISK)
    adders = max(1, min(tasks, len(models) // 8))
    importance = np.zeros((len(models), n_columns))
    grown: list[Tree] = []
    says: list[np.ndarray] = []

    def collected(tree, level):
        sums, picked = state.mapPartitions(_sums(models, tree, level, bins)), _picked(models, level, bins)
        if tasks > 1 and tasks * _sum_bytes(models, level, bins) <= DIRECT:
            added: dict[int, np.ndarray] = {}
            for m, new in sums.collect():
                added[m] = added[m] + new if m in added else new
            return dict(map(picked, added.items()))
        if tasks > 1:  # one task has added its rows up already
            sums = sums.reduceByKey(np.add, adders)
        return dict(sums.map(picked).collect())

    def classified(found):
        says.append(np.array([found.get(-1 - m, np.zeros(3)) for m in range(len(models))]))

    old = None
    for t in range(trees):
        tree = Tree.empty(len(models), depth)
        gains = np.zeros_like(importance)
        for level in range(depth):
            found = collected(tree, level)
            if not level:
                classified(found)
                if old is not None:  # the pass has read it for the last time
                    old.unpersist()
            for m in (m for m in found if m >= 0):
                for k, (column, cut, gain, total, left) in enumerate(found[m]):
                    node = (1 << level) + k
                    tree.value[m, node] = _leaf(total)
                    if column >= 0:
                        tree.column[m, node], tree.bin[m, node] = column, cut
                        tree.value[m, 2 * node] = _leaf(left)
                        tree.value[m, 2 * node + 1] = _leaf(np.subtract(total, left))
                        gains[m, column] += gain
        importance += gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)
        grown.append(tree)
        old, state = state, state.map(_added(models, tree, depth, rate)).persist(StorageLevel.MEMORY_AND_DISK)
        if t % FOLD == FOLD - 1:
            state.checkpoint()
            state.count()
    classified(collected(Tree.empty(len(models), depth), 0))
    for last in (old, state):
        if last is not None:
            last.unpersist()
    return _scored(np.stack(says), importance, grown, start, edges)


def _scored(says: np.ndarray, importance: np.ndarray, grown: list[Tree], start: np.ndarray, edges: list[np.ndarray]) -> Fit:
    tp, said, real = np.moveaxis(says, -1, 0)
    importance /= np.maximum(importance.sum(axis=1, keepdims=True), 1e-300)
    return Fit(np.where(said > 0, tp / np.maximum(said, 1), 0.0), np.where(real > 0, tp / np.maximum(real, 1), 0.0),
               importance, grown, start, edges)


def _leaf(sums) -> float:
    return float(sums[1] / sums[2]) if abs(sums[2]) > 1e-150 else 0.0


def _added(models: list[Model], tree: Tree, depth: int, rate: float):
    def run(block):
        x, y, fold, scores = block
        new = np.empty_like(scores)
        for k, m in enumerate(_concerned(models, fold)):
            new[k] = scores[k] + rate * tree.value[m][tree.nodes(m, x, depth)]
        return x, y, fold, new

    return run


def predict_scores(found: Fit, x: np.ndarray, rate: float = 0.1) -> np.ndarray:
    """(rows, models): scores of unbinned rows, positive for class 1."""
    cut = np.stack([np.searchsorted(e, x[:, c]) for c, e in enumerate(found.edges)])
    scores = np.tile(found.start, (len(x), 1))
    for tree in found.trees:
        depth = tree.column.shape[1].bit_length() - 2
        for m in range(scores.shape[1]):
            scores[:, m] += rate * tree.value[m][tree.nodes(m, cut, depth)]
    return scores
