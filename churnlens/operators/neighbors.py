"""Exact k-nearest neighbours through a metric index (K5, shared with SMOTE).

No pairs are materialised and no cross join is planned.

* **Cells.** Up to ``pivots`` reference points, drawn from a sample of stated size, are
  pivots; every reference row belongs to its nearest one.  Rows of a cell are ordered by
  their distance to the pivot and cut into rings of at most ``block_rows`` rows, so a cell
  that holds a third of all rows is many blocks.  A ring keeps its smallest and largest
  distance.
* **Own ring.** A query is compared with one ring first: the one of its nearest pivot whose
  distances are nearest to its own.  The k-th distance found there is its bound.  With too
  few rows there, the bound is the reach (distance to the pivot plus the cell's radius) of
  the cells that hold k rows together.
* **Other rings.** By the triangle inequality a row at distance r from pivot p is at least
  ``|d(q, p) - r|`` away, and at least ``(d(q, p) - d(q, own)) / 2``.  A ring whose lower
  bound is above the query's bound cannot hold a neighbour; the query goes to all others,
  which hand back only rows within the bound.
* **Distances** in a ring come from one matrix product, with a margin for its rounding; only
  pairs that may count are measured column by column.
* **Groups.** ``outside`` finds, for every group, the nearest rows outside it.  One search
  does for all groups: a ring hands back what is among the nearest outside any of them, and
  the bound is the farthest of their k-th distances.
* **Ties.** Bounds are compared with a margin for rounding and keep equals, so ties go to the
  smaller reference id whatever the cells.  Of equal points (of a group) only the k + 1
  smallest ids are indexed: no other copy can be among the k nearest.

Pivots, sample and block size decide the work, never the answer.  Every task holds one ring
and one slice of its queries; nothing but the pivots and one row per cell reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.ranking import ordinal_within
from churnlens.operators.kstarts import plus_plus
from churnlens.session import ensure_checkpoint_dir, ship_package

BLOCK_ROWS = 1_024
PIVOTS = 512         # most cells
SAMPLE = 16          # sampled reference rows per pivot
CELLS = 1_000_000    # distances held at a time
PAIRS = 16_384       # (query, cell) rows handed on at a time, each with the query's coordinates
MARGIN = 1e-9        # of the lengths compared, for rounding
ROUNDING = 1e-12     # of the squared lengths in a product, some thousand roundings


def _sq_dist(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, summed over dimensions left to right (as SQL would)."""
    acc = np.zeros((q.shape[0], x.shape[0]))
    for j in range(q.shape[1]):
        d = q[:, None, j] - x[None, :, j]
        acc += d * d
    return acc


def _products(q: np.ndarray, x: np.ndarray):
    """Squared distances by one matrix product, and the most that rounding can add or take."""
    c = x.mean(axis=0)
    q, x = q - c, x - c
    size = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)
    return size - 2 * (q @ x.T), ROUNDING * size


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest value of every row; infinite with fewer."""
    return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def _limits(d: np.ndarray, k: int, group: np.ndarray | None, own: np.ndarray | None) -> np.ndarray:
    """Per row of ``d`` the k-th smallest value; with the groups of its columns the largest of
    the k-th values outside each group but the row's own."""
    most = _kth(d, k)
    for f in [] if group is None else np.unique(group):
        most = np.maximum(most, np.where(own == f, -np.inf, _kth(d[:, group != f], k)))
    return most


def _wanted(row: np.ndarray, k: int, group: np.ndarray | None, own: np.ndarray | None, groups) -> np.ndarray:
    """Of pairs in order of (row, distance, id): those among the first k of their row or, with
    the groups of the pairs, outside any group but the row's own (``own``, by pair)."""
    first = np.searchsorted(row, row)
    if group is None:
        return np.arange(len(row)) - first < k
    keep = np.zeros(len(row), bool)
    for f in groups:
        out = group != f
        before = np.cumsum(out) - out
        keep |= out & (own != f) & (before - before[first] < k)
    return keep


def _pivot_distances(x: np.ndarray, pivots: np.ndarray):
    """Slices of rows with their distances to all pivots, few enough to hold."""
    step = max(1, CELLS // len(pivots))
    for s in range(0, len(x), step):
        yield slice(s, s + step), np.sqrt(_sq_dist(x[s:s + step], pivots))


def _own_cell(column: str, pivots: np.ndarray):
    """Add the nearest pivot and the distance to it."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            cell, dist = np.empty(len(b), "int32"), np.empty(len(b))
            for at, d in _pivot_distances(np.stack(b[column]).astype(float), pivots):
                cell[at] = d.argmin(1)
                dist[at] = d.min(1)
            yield b.assign(_cell=cell, _dist=dist)

    return run


def _ring_topk(k: int, exclude_self: bool, groups=None):
    """Every query of one slice with its k nearest rows of one ring, as arrays, and the bound
    they set (``_kth``, squared).  With ``_limit`` only rows within it, and only queries that
    have any.  With ``groups`` (labels are groups): the k nearest outside every group."""

    def run(query: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        limited = "_limit" in query
        names = ["id"] if limited else ["id", "x", "_own", "_cell", "_ring"]
        if not len(query) or not len(ref):
            return pd.DataFrame({c: [] for c in (*names, "refs", "dists", "labels", *([] if limited else ["_kth"]))})
        ref = ref.sort_values("_rid")
        x, ids, labels = np.stack(ref["_x"]).astype(float), ref["_rid"].to_numpy(), ref["_ry"].to_numpy(dtype=float)
        q, qid, own = np.stack(query["x"]).astype(float), query["id"].to_numpy(), query["_own"].to_numpy(dtype=float)
        group = None if groups is None else labels
        found = {"refs": [], "dists": [], "labels": []}
        bounds, kept = [], []
        step = max(1, CELLS // len(ref))
        for s in range(0, len(query), step):
            part = slice(s, s + step)
            with np.errstate(all="ignore"):
                near, slack = _products(q[part], x)
                same = qid[part, None] == ids[None, :] if exclude_self else None
                if exclude_self:
                    near[same] = np.inf
                most = query["_limit"].to_numpy(dtype=float)[part] if limited else _limits(near + slack, k, group, own[part])
                # Undefined products (lengths beyond a double's range) are measured.
                may = ~(near - slack > most[:, None])
            if exclude_self:
                may &= ~same
            row, col = np.nonzero(may)
            d = np.zeros(len(row))
            with np.errstate(over="ignore"):
                for j in range(x.shape[1]):  # left to right, as SQL would
                    e = q[part][row, j] - x[col, j]
                    d += e * e
            within = np.isfinite(d) & ~(limited & (d > most[row]))
            row, col, d = row[within], col[within], d[within]
            # Positions stand for ids: the ring is in id order.
            order = np.lexsort((col, d, row))
            row, col, d = row[order], col[order], d[order]
            keep = _wanted(row, k, None if group is None else group[col], own[part][row], groups)
            row, col, d = row[keep], col[keep], d[keep]
            cuts = np.searchsorted(row, np.arange(len(q[part]) + 1))
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a == b and limited:
                    continue
                kept.append(s + i)
                found["refs"].append(ids[col[a:b]].tolist())
                found["dists"].append(d[a:b].tolist())
                found["labels"].append(labels[col[a:b]].tolist())
            if not limited:
                last = np.where(cuts[1:] > cuts[:-1], d[np.maximum(cuts[1:] - 1, 0)] if len(d) else np.inf, np.inf)
                bounds.append(np.where(np.isfinite(most), last, np.inf))
        out = query[names].iloc[kept].reset_index(drop=True).assign(**{c: pd.Series(v, dtype=object) for c, v in found.items()})
        return out if limited else out.assign(_kth=np.concatenate(bounds))

    return run


def _open_cells(pivots: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, exclude_self: bool):
    """Every query with the cells that may hold one of its k nearest: distance to their pivot
    and the query's bound.  Handed on in frames of ``PAIRS`` rows: a batch of queries with all
    its cells would repeat the coordinates up to ``PIVOTS`` times at once."""

    def run(batches):
        for b in batches:
            for at, d in _pivot_distances(np.stack(b["x"]).astype(float), pivots) if len(b) else ():
                part = b.iloc[at]
                if "_kth" in part:
                    kth = np.sqrt(part["_kth"].to_numpy(dtype=float))
                else:
                    kth = np.array([np.sqrt(max(v)) if len(v) >= k else np.inf for v in part["dists"]])
                # Cells by reach: those that hold k rows together bound the k-th distance.
                reach = d + hi
                order = reach.argsort(1)
                held = rows[order].cumsum(1) >= k + exclude_self
                enough = np.where(held.any(1), np.take_along_axis(reach, order, 1)[np.arange(len(d)), held.argmax(1)], np.inf)
                bound = np.minimum(kth, enough)
                least = np.maximum(np.maximum(d - hi, lo - d), (d - d.min(1, keepdims=True)) / 2)
                # An undefined or infinite length keeps the cell.
                qi, cell = np.nonzero(~(least > bound[:, None] + MARGIN * (d + hi + bound[:, None])))
                for s in range(0, len(qi), PAIRS):
                    q, c = qi[s:s + PAIRS], cell[s:s + PAIRS]
                    yield part.iloc[q][[c for c in ("id", "x", "_own") if c in part]].reset_index(drop=True).assign(
                        _home=part["_cell"].to_numpy()[q], _done=part["_ring"].to_numpy()[q],
                        _cell=c.astype("int32"), _dist=d[q, c], _bound=bound[q])

    return run


def _points(df: DataFrame) -> DataFrame:
    bad = F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.withColumn("x", F.when(bad, F.raise_error(F.lit("kNN needs finite coordinates"))).otherwise(F.col("x")))


def _kind(df: DataFrame) -> str:
    return dict(df.dtypes)["id"]


@dataclass
class MetricIndex:
    """Reference rows dealt to rings of cells; see the module.  ``build`` makes one."""

    rows: DataFrame              # _rid, _x, _ry, _cell, _ring
    rings: DataFrame             # _cell, _ring, _lo, _hi, _rows
    pivots: np.ndarray
    cell_rows: np.ndarray
    cell_lo: np.ndarray
    cell_hi: np.ndarray
    cell_held: np.ndarray        # rows of a cell that count towards k, whatever group is left out
    groups: list | None          # groups that can be left out, if the labels are groups
    kind: str
    block_rows: int

    @classmethod
    def build(cls, ref: DataFrame, k: int, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS,
              groups: list | None = None) -> "MetricIndex | None":
        """Index ``ref`` (id, x, optional y) for searches of up to ``k``; None for no rows.
        With ``groups`` (a few numbers) y is a row's group, for ``outside``."""
        spark = ref.sparkSession
        ship_package(spark)
        ensure_checkpoint_dir(spark)
        y = F.col("y").cast("double") if "y" in ref.columns else F.lit(None).cast("double")
        r = _points(ref).select(F.col("id").alias("_rid"), F.col("x").alias("_x"), y.alias("_ry"))
        copies = Window.partitionBy("_x", *(["_ry"] if groups else [])).orderBy("_rid")
        r = r.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).drop("_copy").checkpoint()
        n = r.count()
        if not n:
            return None
        cells = max(1, min(pivots, n // block_rows))
        sample = r.orderBy(F.xxhash64("_rid")).limit(SAMPLE * cells).select("_x").collect()
        centers = plus_plus(np.array([s._x for s in sample], dtype=float).reshape(len(sample), -1), cells, np.random.default_rng(0))
        dealt = r.mapInPandas(_own_cell("_x", centers), f"_rid {_kind(ref)}, _x array<double>, _ry double, _cell int, _dist double")
        if n <= block_rows:
            dealt = dealt.withColumn("_ring", F.lit(0).cast("long")).checkpoint()
        else:
            dealt = ordinal_within(dealt, ["_cell"], ["_dist", "_rid"], "_i", "_in_cell").withColumn(
                "_ring", F.floor(F.col("_i") / block_rows)).drop("_i", "_in_cell")
        rings = dealt.groupBy("_cell", "_ring").agg(F.min("_dist").alias("_lo"), F.max("_dist").alias("_hi"),
                                                    F.count(F.lit(1)).alias("_rows")).checkpoint()
        count, lo, hi = np.zeros(cells), np.full(cells, np.inf), np.full(cells, -np.inf)
        for c in rings.groupBy("_cell").agg(F.sum("_rows").alias("n"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).collect():
            count[c._cell], lo[c._cell], hi[c._cell] = c.n, c.lo, c.hi
        held = count
        if groups:
            inside = {(c._cell, c._ry): c.n for c in dealt.where(F.col("_ry").isin(groups)).groupBy("_cell", "_ry").agg(F.count(F.lit(1)).alias("n")).collect()}
            held = count - np.array([max(inside.get((c, g), 0) for g in groups) for c in range(cells)])
        return cls(dealt.drop("_dist"), rings, centers, count, lo, hi, held, groups, _kind(ref), block_rows)

    def _least(self):
        """Lower bound of the distance from a query at ``_dist`` from the pivot to a row of the ring."""
        return F.greatest(F.col("_dist") - F.col("_hi"), F.col("_lo") - F.col("_dist"), F.lit(0.0))

    def _compare(self, asked: DataFrame, k: int, exclude_self: bool, kind: str) -> DataFrame:
        """Top k of every (query, ring) of ``asked``, within ``_limit`` if there is one.  A ring
        with many queries takes them in slices."""
        limited = ["_limit"] if "_limit" in asked.columns else []
        asked = asked.select("id", "x", "_own", "_cell", "_ring", *limited).checkpoint()
        slices = asked.groupBy("_cell", "_ring").agg(F.ceil(F.count(F.lit(1)) / self.block_rows).cast("int").alias("_slices")).checkpoint()
        left = asked.join(slices, ["_cell", "_ring"]).withColumn("_slice", F.pmod(F.xxhash64("id"), "_slices").cast("int"))
        right = self.rows.join(slices, ["_cell", "_ring"]).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
        return (left.drop("_slices").groupBy("_cell", "_ring", "_slice").cogroup(right.drop("_slices").groupBy("_cell", "_ring", "_slice"))
                .applyInPandas(_ring_topk(k, exclude_self, self.groups), f"id {kind}, " + ("" if limited else "x array<double>, _own double, _cell int, _ring long, ")
                               + f"refs array<{self.kind}>, dists array<double>, labels array<double>" + ("" if limited else ", _kth double")))

    def own_rings(self, query: DataFrame) -> DataFrame:
        """(id, x, _own, _cell, _ring): the ring that every query meets first, ``_own`` its group if it has one.  Every cell has a ring but
        those whose pivot equals an earlier one, which no query is nearest to either."""
        kind = _kind(query)
        own = F.col("y").cast("double") if self.groups else F.lit(None).cast("double")
        q = _points(query).select("id", "x", own.alias("_own")).mapInPandas(
            _own_cell("x", self.pivots), f"id {kind}, x array<double>, _own double, _cell int, _dist double").withColumn("_q", F.monotonically_increasing_id()).checkpoint()
        first = q.select("_q", "_cell", "_dist").join(self.rings, "_cell").groupBy("_q").agg(F.min_by("_ring", F.struct(self._least(), "_ring")).alias("_ring"))
        return q.join(first, "_q").select("id", "x", "_own", "_cell", "_ring")

    def open_rings(self, found: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """(id, x, _own, _cell, _ring, _rows, _limit): the rings that bounds cannot exclude, the own one
        left out, and the squared bound."""
        kind = _kind(found)
        cells = found.select("id", "x", "_own", "_cell", "_ring", "_kth").mapInPandas(
            _open_cells(self.pivots, self.cell_held, self.cell_lo, self.cell_hi, k, exclude_self),
            f"id {kind}, x array<double>, _own double, _home int, _done long, _cell int, _dist double, _bound double")
        far = self._least() > F.col("_bound") + MARGIN * (F.col("_dist") + F.col("_hi") + F.col("_bound"))
        limit = F.when(F.isnan("_bound"), float("inf")).otherwise(F.col("_bound") * F.col("_bound") * (1 + MARGIN))
        # Spark's order puts NaN above all: undefined lengths are kept by name.
        unknown = F.isnan("_dist") | F.isnan("_bound") | F.isnan(self._least())
        return (cells.join(self.rings, "_cell").where((unknown | ~far) & ~((F.col("_cell") == F.col("_home")) & (F.col("_ring") == F.col("_done"))))
                .select("id", "x", "_own", "_cell", "_ring", "_rows", limit.alias("_limit")))

    def _found(self, query: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """(query_id, ref_id, sq_dist, label): every pair that can count."""
        kind = _kind(query)
        found = self._compare(self.own_rings(query), k, exclude_self, kind)
        parts = ["id", "refs", "dists", "labels"]
        if self.cell_rows.sum() > self.block_rows or len(self.pivots) > 1:
            found = found.checkpoint()
            more = self._compare(self.open_rings(found, k, exclude_self), k, exclude_self, kind)
            found = found.select(*parts).unionByName(more.select(*parts))
        return found.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("refs", "dists", "labels")).alias("n")).select(
            "query_id", F.col("n.refs").alias("ref_id"), F.col("n.dists").alias("sq_dist"), F.col("n.labels").alias("label"))

    def search(self, query: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        near = self._found(query, k, exclude_self).select(
            "query_id", "ref_id", "sq_dist", F.when(~F.isnan("label"), F.col("label")).alias("ref_label"))
        w = Window.partitionBy("query_id").orderBy("sq_dist", "ref_id")
        return near.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)

    def outside(self, query: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """(query_id, left_out, ref_id, sq_dist, rank): for every group but the query's own (``y``)
        the k nearest rows outside it.  The index has ``groups``."""
        if len(self.groups) == 1:  # its rows ask for nothing
            query = query.where(F.col("y") != self.groups[0])
        near = self._found(query, k, exclude_self).join(query.select(F.col("id").alias("query_id"), F.col("y").cast("double").alias("_own")), "query_id")
        each = (near.withColumn("left_out", F.explode(F.array(*[F.lit(float(g)) for g in self.groups])))
                .where((F.col("left_out") != F.col("_own")) & (F.col("left_out") != F.col("label"))))
        w = Window.partitionBy("query_id", "left_out").orderBy("sq_dist", "ref_id")
        return each.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("query_id", "left_out", "ref_id", "sq_dist", "rank")

    def work(self, query: DataFrame, k: int, exclude_self: bool = False) -> dict:
        """Pairs that a search compares, against all pairs: {"compared", "all"}."""
        own = self.own_rings(query).checkpoint()
        found = self._compare(own, k, exclude_self, _kind(query)).checkpoint()
        first = own.join(self.rings, ["_cell", "_ring"]).agg(F.sum("_rows")).first()[0] or 0
        more = self.open_rings(found, k, exclude_self).agg(F.sum("_rows")).first()[0] or 0
        return {"compared": int(first + more), "all": int(own.count() * self.cell_rows.sum())}


def knn(ref: DataFrame, query: DataFrame, k: int = 5, exclude_self: bool = False,
        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, ref_id, sq_dist, ref_label, rank 0..k-1) for the k nearest
    reference rows of every query row.

    Both frames carry ``id`` (any type) and ``x`` (array<double>); ``ref`` also
    ``y`` (double label, may be null).  A null or non-finite coordinate is an error; without
    reference rows there are no neighbours.
    """
    index = MetricIndex.build(ref, k, block_rows)
    if index is None:
        return ref.sparkSession.createDataFrame(
            [], f"query_id {_kind(query)}, ref_id {_kind(ref)}, sq_dist double, ref_label double, rank int")
    return index.search(query, k, exclude_self)


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """Majority vote of the k nearest training labels (uniform weights; a tie
    goes to the smaller label).  Returns (id, prediction)."""
    nb = knn(train, test, k)
    votes = nb.groupBy("query_id", "ref_label").agg(F.count(F.lit(1)).alias("v"))
    w = Window.partitionBy("query_id").orderBy(F.desc("v"), "ref_label")
    return (votes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select(F.col("query_id").alias("id"), F.col("ref_label").alias("prediction")))


def as_points(df: DataFrame, cols, id_col: str, label: str | None = None, keep=()) -> DataFrame:
    """(id, x array<double>, y, ``keep`` columns) from feature columns."""
    sel = [F.col(f"`{id_col}`").alias("id"),
           F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x")]
    if label is not None:
        sel.append(F.col(f"`{label}`").cast("double").alias("y"))
    return df.select(*sel, *keep)
