"""K-means from several starts for several k, in lock step.

All runs (k, start) move together: one pass over the rows assigns each row to its nearest
centre of every run that still moves and sums rows, cost and coordinates per (run,
centre).  The driver sees starts x sum(k) sums a pass, whatever the rows.  Of the starts
of one k the one of least cost is kept (of equals, the first).

Starts are drawn by k-means++ on ``INIT_ROWS`` rows, drawn by hash; every pass covers all
rows.  A centre without rows stays where it is.  Rows with a null, a null coordinate or a
coordinate that is not finite take no part; without rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.session import ship_package

INIT_ROWS = 4096
SLICE_ROWS = 4096  # rows measured at a time


class Best(NamedTuple):
    centers: np.ndarray  # (k, columns)
    cost: float          # sum of squared distances to the nearest centre
    costs: list[float]   # of every start


def finite(points: DataFrame, x_col: str = "x") -> DataFrame:
    bad = F.exists(x_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return points.where(F.col(x_col).isNotNull() & ~bad)


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of ``x``, each drawn by its squared distance to those drawn before."""
    at = [int(rng.integers(len(x)))]
    d = ((x - x[at[0]]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = d.sum()
        at.append(int(rng.choice(len(x), p=d / total)) if total > 0 else int(rng.integers(len(x))))
        d = np.minimum(d, ((x - x[at[-1]]) ** 2).sum(axis=1))
    return x[at]


def _pass(runs: list[np.ndarray], shift: np.ndarray):
    """Per partition: (run, centre, rows, cost, sums).  Rows by centre are summed as one matrix
    product a run and slice."""
    width = len(shift)
    names = ["run", "center", "n", "cost", *(f"s{j}" for j in range(width))]

    def run(batches: Iterable[pa.RecordBatch]):
        sums = [np.zeros((len(c), 2 + width)) for c in runs]
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width) - shift
            for s in range(0, len(x), SLICE_ROWS):
                part = x[s:s + SLICE_ROWS]
                many = np.hstack([np.ones((len(part), 1)), np.zeros((len(part), 1)), part])
                for r, c in enumerate(runs):
                    near = np.argmin((c ** 2).sum(axis=1)[:, None] - 2 * c @ part.T, axis=0)
                    many[:, 1] = ((part - c[near]) ** 2).sum(axis=1)
                    sums[r] += (near == np.arange(len(c))[:, None]).astype(float) @ many
        run_of = np.repeat(np.arange(len(runs)), [len(c) for c in runs])
        center = np.concatenate([np.arange(len(c)) for c in runs])
        out = np.concatenate(sums)
        yield pa.RecordBatch.from_arrays([pa.array(run_of, pa.int32()), pa.array(center, pa.int32()),
                                          *(pa.array(np.ascontiguousarray(v)) for v in out.T)], names=names)

    return run


def kmeans_starts(points: DataFrame, ks: Sequence[int], starts: int = 10, seed: int = 0, max_iter: int = 300,
                  tol: float = 1e-4) -> dict[int, Best]:
    """The best of ``starts`` runs for every k over ``points`` (x array<double>).

    A run stands still once its centres move by at most ``tol`` times the mean variance of
    the columns (sum of squares), or after ``max_iter`` passes; its cost is that of the
    centres returned."""
    spark = points.sparkSession
    ship_package(spark)
    # Dealt to all cores, after the draw's hash: every pass has a task a core, not a shuffle partition.
    rows = (finite(points).select("x", F.xxhash64("x", F.monotonically_increasing_id(), F.lit(seed)).alias("_h"))
            .repartition(spark.sparkContext.defaultParallelism, "_h").persist(StorageLevel.MEMORY_AND_DISK))
    try:
        drawn = rows.orderBy("_h").limit(INIT_ROWS)
        sample = [r.x for r in drawn.select("x").collect()]
        if not sample:
            return {}
        width = len(sample[0])
        spread = rows.agg(*[F.avg(F.col("x")[j]) for j in range(width)], *[F.var_pop(F.col("x")[j]) for j in range(width)]).first()
        shift, limit = np.array(spread[:width], float), tol * float(np.mean(spread[width:]))
        x = np.array(sample, float) - shift
        names = [(k, s) for k in ks for s in range(starts)]
        centers = {(k, s): plus_plus(x, k, np.random.default_rng([seed, k, s])) for k, s in names}
        cost: dict[tuple[int, int], float] = {}
        schema = "run int, center int, n double, cost double, " + ", ".join(f"s{j} double" for j in range(width))
        sums = [F.sum(c).alias(c) for c in ["n", "cost", *(f"s{j}" for j in range(width))]]
        moving = list(names)
        for step in range(max_iter):
            passed = rows.select("x").mapInArrow(_pass([centers[m] for m in moving], shift), schema).groupBy("run", "center").agg(*sums)
            got = np.array([tuple(r) for r in passed.collect()], float)
            still = []
            for i, m in enumerate(moving):
                part = got[got[:, 0] == i]
                cost[m] = float(part[:, 3].sum())
                new = centers[m].copy()
                full = part[part[:, 2] > 0]
                new[full[:, 1].astype(int)] = full[:, 4:] / full[:, 2:3]
                if ((new - centers[m]) ** 2).sum() > limit and step < max_iter - 1:
                    centers[m] = new
                    still.append(m)
            moving = still
            if not moving:
                break
    finally:
        rows.unpersist()
    out = {}
    for k in ks:
        best = min(range(starts), key=lambda s: (cost[k, s], s))
        out[k] = Best(centers[k, best] + shift, cost[k, best], [cost[k, s] for s in range(starts)])
    return out


def nearest(x_col: str, centers: np.ndarray) -> Column:
    """Position of the nearest centre (of equals the first), as a column expression."""
    table = F.from_json(F.lit(str(np.asarray(centers).tolist())), "array<array<double>>")
    d = F.transform(table, lambda c: F.aggregate(F.zip_with(c, F.col(x_col), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")
