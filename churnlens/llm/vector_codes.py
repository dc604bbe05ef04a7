"""Product codes of vectors: one codebook for each part of the vector.

Vectors become integers (``floor(scale * x)``) and are cut into equal consecutive
parts.  A part's codebook starts as that part of the vectors with the smallest ids;
each round assigns every part to its nearest entry and moves the entries to the floor
of the mean of their parts.

Assignment keeps adaptive bounds.  Every part stores its ``b`` closest entries, each
with a lower bound on its distance, in order, and one outer bound for all other
entries.  After the entries have moved, the bounds shrink by the entries' drift (the
outer one by the largest).  The exact distance to the entry held so far then settles
most parts; listed entries whose bound does not exceed it are measured in integers, and
only a part whose outer bound does not exceed it is measured against all entries.  Ties
always reach the integer comparison, where the lower index wins, so the bounds never
change a result.  ``b`` adapts: once the entries have moved, a sample of at most about
``MEASURED`` rows tells how many listed entries the parts consult, and the round stores
as many as all but ``SPARE`` of them need (this decides the work, not the result).  The bounds are stored with the rows in the shared folder between rounds,
so an executor's loss costs its tasks only.

To the driver go the entries' sums (parts x entries rows, whatever the input) and the
first vectors (at most ``entries`` rows).

Defined results: rows without a vector, or with null or non-finite components, are left
out, and so are vectors of another length than the first kept vector's, or of a length
that the parts do not divide; a repeated id starts one entry (its smallest vector);
rows without an id start none; with fewer ids than entries there are fewer entries, and
without any id there is no code (nothing is returned); repeated rows are coded each;
components are clipped where sums of squares would leave 64 bits (beyond +-2^19 at 64
dimensions); extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir, ship_package

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
FIRST_B = 4         # listed entries of the first round
SPARE = 0.02        # share of parts that may need more entries than are listed
MEASURED = 100_000  # rows of the sample that decides the lists' length
SLICE = 2048        # rows measured at a time
_HAIR = 1e-9        # bounds are floating point: nearer than this counts as uncertain
_DOWN = 1 - 1e-6    # float32 bounds are rounded down

_STATE = "id long, label int, ints binary, near binary, lower binary, outer binary"


def integers(flat: np.ndarray, dims: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as int64 rows, clipped where squares could overflow."""
    most = math.isqrt((1 << 60) // dims)
    return np.clip(np.floor(flat.astype(np.float64) * scale), -most, most).astype(np.int64).reshape(-1, dims)


def all_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows x entries) in integers."""
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        apart = x[:, k, None] - book[None, :, k]
        out += apart * apart
    return out


def listed(dist: np.ndarray, b: int):
    """Of exact distances to all entries: (nearest entries in order, lower bounds, outer
    bound); equal distances in index order."""
    b = min(b, dist.shape[1])
    order = np.argsort(dist, axis=1, kind="stable")[:, :b + 1]
    near = np.sqrt(np.take_along_axis(dist, order, 1).astype(np.float64))
    outer = near[:, b] if near.shape[1] > b else np.full(len(dist), np.inf)
    return order[:, :b].astype(np.uint8), near[:, :b], outer


def reassign(x, book, drift, near, lower, outer, b: int):
    """One part of many rows after its entries have moved by ``drift``: (squared distance
    to the nearest entry, near, lower, outer, need) with lists of ``b`` entries.  ``need``
    is the number of listed entries consulted, or one more than were listed."""
    n, width = near.shape
    own = near[:, 0]
    apart = x - book[own]
    best = (apart * apart).sum(axis=1)
    reach = np.sqrt(best.astype(np.float64)) * (1 + _HAIR) + _HAIR
    lower = lower.astype(np.float64) - drift[near]
    outer = outer.astype(np.float64) - drift.max()
    doubt = lower <= reach[:, None]
    doubt[:, 0] = False
    full = outer <= reach
    need = np.where(full, width + 1, np.where(doubt.any(axis=1), width - doubt[:, ::-1].argmax(axis=1), 1))
    # Listed entries in doubt, in integers; the entry held so far is known.
    exact = np.full((n, width), np.iinfo(np.int64).max)
    exact[:, 0] = best
    r, c = np.nonzero(doubt & ~full[:, None])
    apart = x[r] - book[near[r, c]]
    exact[r, c] = (apart * apart).sum(axis=1)
    best = exact.min(axis=1)
    winner = np.where(exact == best[:, None], near, len(book)).min(axis=1)
    known = exact != np.iinfo(np.int64).max
    lower = np.where(known, np.sqrt(np.where(known, exact, 0).astype(np.float64)), np.maximum(lower, 0))
    order = np.lexsort((near, lower, near != winner[:, None]), axis=1)
    near, lower = np.take_along_axis(near, order, 1), np.take_along_axis(lower, order, 1)
    if b < width:
        outer = np.minimum(outer, lower[:, b:].min(axis=1))
        near, lower = near[:, :b], lower[:, :b]
    elif b > width:  # places that a full search will fill
        near = np.hstack([near, np.repeat(near[:, :1], b - width, axis=1)])
        lower = np.hstack([lower, np.full((n, b - width), np.inf)])
    if full.any():
        dist = all_distances(x[full], book)
        best[full] = dist.min(axis=1)
        found = listed(dist, near.shape[1])
        got = found[0].shape[1]
        near[full], lower[full] = found[0][:, :1], np.inf
        near[full, :got], lower[full, :got] = found[0], found[1]
        outer[full] = found[2]
    return best, near, lower, outer, need


def _lists(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _rows(column, kind, *shape) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _binary(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    return pa.array([row.tobytes() for row in a], pa.binary())


def _packed(ids, labels, ints, near, lower, outer) -> pa.RecordBatch:
    small = lambda v: np.where(np.isinf(v), np.inf, np.maximum(v, 0) * _DOWN).astype(np.float32)
    return pa.RecordBatch.from_arrays(
        [ids, labels, _binary(ints.astype(np.int32)), _binary(near), _binary(small(lower)), _binary(small(outer))],
        names=["id", "label", "ints", "near", "lower", "outer"])


def _slices(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            yield batch.slice(k, SLICE)


def _first(books, dims: int, b: int, scale: int):
    def run(batches):
        for part in _slices(batches):
            ints = integers(part.column("v").flatten().to_numpy(zero_copy_only=False), dims, scale)
            cut = ints.reshape(len(ints), len(books.value), -1)
            made = [listed(all_distances(cut[:, p], book), b) for p, book in enumerate(books.value)]
            near, lower, outer = (np.stack(m, axis=1) for m in zip(*made))
            yield _packed(part.column("id"), part.column("label"), ints, near, lower, outer)

    return run


def _again(part, books, drifts, parts: int, dims: int, width: int, b: int):
    ints = _rows(part.column("ints"), np.int32, dims).astype(np.int64)
    cut = ints.reshape(len(ints), parts, -1)
    near, lower = _rows(part.column("near"), np.uint8, parts, width), _rows(part.column("lower"), np.float32, parts, width)
    outer = _rows(part.column("outer"), np.float32, parts)
    made = [reassign(cut[:, p], books[p], drifts[p], near[:, p], lower[:, p], outer[:, p], b) for p in range(parts)]
    return ints, *(np.stack(m, axis=1) for m in zip(*made))


def _next(books, drifts, parts: int, dims: int, width: int, b: int):
    def run(batches):
        for part in _slices(batches):
            ints, _, near, lower, outer, _ = _again(part, books.value, drifts.value, parts, dims, width, b)
            yield _packed(part.column("id"), part.column("label"), ints, near, lower, outer)

    return run


def _needs(books, drifts, parts: int, dims: int, width: int):
    """Per task: how many parts need k listed entries."""
    def run(batches):
        needs = np.zeros(258, np.int64)
        for part in _slices(batches):
            needs += np.bincount(_again(part, books.value, drifts.value, parts, dims, width, width)[-1].ravel(), minlength=258)
        used = np.flatnonzero(needs)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(needs[used], pa.int64())], names=["need", "n"])

    return run


def _last(books, drifts, parts: int, dims: int, width: int):
    def run(batches):
        for part in _slices(batches):
            _, best, near, *_ = _again(part, books.value, drifts.value, parts, dims, width, 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), _binary(near[:, :, 0]), pa.array(best.sum(axis=1), pa.int64())],
                names=["id", "label", "code", "error"])

    return run


_SUMS = "part int, entry int, n long, sums array<long>"


def _sums(parts: int, dims: int, width: int, entries: int):
    """Per task: rows and component sums per (part, entry)."""
    def run(batches):
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, dims // parts), np.int64)
        for part in _slices(batches):
            cut = _rows(part.column("ints"), np.int32, parts, dims // parts)
            own = _rows(part.column("near"), np.uint8, parts, width)[:, :, 0]
            for p in range(parts):
                count[p] += np.bincount(own[:, p], minlength=entries)
                np.add.at(total[p], own[:, p], cut[:, p])
        at, to = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(to, pa.int32()), pa.array(count[at, to], pa.int64()),
             pa.array(total[at, to].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _collected(state: DataFrame, parts: int, dims: int, width: int, entries: int):
    """At most parts x entries rows (part, entry, n, s0, s1, ...)."""
    sums = state.select("ints", "near").mapInArrow(_sums(parts, dims, width, entries), _SUMS)
    each = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(dims // parts)]
    return sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()


def _moved(books: np.ndarray, found) -> tuple[np.ndarray, np.ndarray]:
    """Entries at the floor of their parts' mean, and how far each has moved."""
    new = books.copy()
    for r in found:
        new[r.part, r.entry] = [r[f"s{k}"] // r.n for k in range(books.shape[2])]
    drift = np.sqrt(((new - books).astype(np.float64) ** 2).sum(axis=2)) * (1 + _HAIR)
    return new, drift


def next_b(needs: dict[int, int], width: int, most: int) -> int:
    """The least list length (2 at least) that all but ``SPARE`` of the parts could do
    with; twice the width, up to ``most``, if too many need more than are listed."""
    left = SPARE * sum(needs.values())
    for k in sorted(needs, reverse=True):
        left -= needs[k]
        if left < 0:
            return min(most, max(2, 2 * width if k > width else k))
    return min(most, max(2, width))


def kept_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(id, v, label) of the rows with a vector of finite components only."""
    finite = F.forall(F.col(vec_col), lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.col(f"`{label_col}`").cast("int") if label_col else F.lit(None).cast("int")
    return (df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
            .select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(vec_col).alias("v"), label.alias("label")))


def first_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray | None:
    """(parts, entries, width) of the vectors with the smallest ids; None without any."""
    first = kept.agg(F.min("id").alias("id")).first().id
    if first is None:
        return None
    dims = kept.where(F.col("id") == first).agg(F.size(F.min("v"))).first()[0]
    if dims % parts:
        return None
    fit = kept.where(F.size("v") == dims)
    last = fit.where("id is not null").select("id").distinct().orderBy("id").limit(entries).agg(F.max("id")).first()[0]
    rows = fit.where(F.col("id") <= last).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    ints = integers(np.array([r.v for r in rows], np.float64).ravel(), dims, scale)
    return ints.reshape(len(rows), parts, dims // parts).transpose(1, 0, 2).copy()


_CODES = "id long, label int, code binary, error long"


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             first_b: int = FIRST_B) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(rows (id, label, code, error), codebooks, list lengths of the rounds).  ``code``
    holds one byte for each part; ``error`` is the sum of the squared distances."""
    if not 1 <= entries <= 256:
        raise ValueError("a code byte tells at most 256 entries apart")
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    kept = kept_vectors(df, id_col, vec_col, label_col)
    books = first_books(kept, parts, entries, scale)
    if books is None:
        return spark.createDataFrame([], _CODES), np.empty((parts, 0, 0), np.int64), []
    share = spark.sparkContext.broadcast
    dims, n = parts * books.shape[2], books.shape[1]
    kept = kept.where(F.size("v") == dims)
    b = max(1, min(first_b, n))
    widths = [b]
    state = kept.mapInArrow(_first(share(books), dims, b, scale), _STATE).checkpoint()
    drift = None
    for k in range(rounds):
        found = _collected(state, parts, dims, b, n)
        books, drift = _moved(books, found)
        if k + 1 < rounds:
            args = share(books), share(drift), parts, dims, b
            part = min(1.0, MEASURED / sum(r.n for r in found if r.part == 0))
            needs = (state.sample(part, seed=k).mapInArrow(_needs(*args), "need int, n long")
                     .groupBy("need").agg(F.sum("n").alias("n")).collect())
            b = next_b({r.need: r.n for r in needs}, b, max(1, n // 4))
            widths.append(b)
            state = state.mapInArrow(_next(*args, b), _STATE).checkpoint()
    if drift is None:
        drift = np.zeros((parts, n))
    return state.mapInArrow(_last(share(books), share(drift), parts, dims, b), _CODES), books, widths


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
