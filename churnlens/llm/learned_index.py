"""Approximate nearest neighbours by learned partitions (largest inner product).

1. A bounded sample of the vectors (``SAMPLE`` for each partition, at most
   ``MAX_PARTS`` partitions) is linked to its own nearest neighbours, in Spark tasks.
2. The sample's neighbour graph is cut into parts of nearly equal size with few edges
   between them: parts grow from seeds by their strongest links, then vertices move to
   the part that holds most of their neighbours, while it has room.
3. A multinomial logistic regression (``pyspark.ml``) learns which part a vector's
   neighbours lie in: each sampled vector counts with its own part and with the parts
   of its neighbours.
4. Every row of the table is indexed: it is stored in its most probable partition.
5. A query goes to its most probable partitions, as many as a bounded set of
   calibration queries needs to find the share ``TARGET`` of their true neighbours (an
   exact search of these over all rows, one pass), and at least to as many as hold k
   rows.  The rows met there are ranked by their exact inner product.

Small partitions share a bin of at most ``BLOCK`` rows, in which a query still meets only
the partitions it asks for and leaves one list of k rows; a partition above ``BLOCK`` rows
is dealt into bins by row.  Queries are dealt into blocks by id, and a task holds one bin
and one block, so a partition with a third of all rows is no bottleneck.  Only the sample, the classifier and counts per partition reach the
driver; their sizes are bounded by ``MAX_PARTS``.  The share of the table that a query
meets depends on the data: few partitions where vectors cluster, over half of them where
all directions are alike; the calibration measures it.

Defined results: rows without an id, and vectors that are null, empty, all zero, hold
null or non-finite components, or differ in length from the first one (by id), take no
part; an id that repeats counts once, with its best score as a candidate and its
smallest vector as a query; ties go to the smaller id; fewer than k candidates are all
returned; extra columns are not read; no vectors or no queries give an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.session import ensure_checkpoint_dir, ship_package

ROWS_PER_PART = 1024
LEAST_PARTS, MAX_PARTS = 8, 512
SAMPLE = 64            # sampled rows for each partition
LINKS = 10             # neighbours of a sampled row in the graph
ROOM = 1.1             # most rows of a part, as a multiple of the mean
CALIBRATION = 256      # queries whose true neighbours are searched exactly
TARGET = 0.95          # share of true neighbours that the probes must hold
BLOCK = 8192           # rows of a bin
QUERY_BLOCK = 1024     # queries of a block
_SLICE = 4096


# --- the sample's graph and its parts --------------------------------------------------

def balanced_parts(neighbours: np.ndarray, parts: int, room: float = ROOM, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """A part for each vertex of the graph of ``neighbours`` (vertices x links): sizes of
    at most ``room`` times the mean, few edges cut."""
    n = len(neighbours)
    links: list[Counter] = [Counter() for _ in range(n)]
    for i, row in enumerate(neighbours.tolist()):
        for j in row:
            if j >= 0 and j != i:
                links[i][j] += 1
                links[j][i] += 1
    rng = np.random.default_rng(seed)
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    seeds = iter(rng.permutation(n).tolist())
    for p in range(parts):
        share = (n - int(size.sum())) // (parts - p)
        pull: Counter = Counter()
        heap: list[tuple[int, int]] = []
        while size[p] < share:
            while heap and (part[heap[0][1]] >= 0 or -heap[0][0] != pull[heap[0][1]]):
                heapq.heappop(heap)
            v = heapq.heappop(heap)[1] if heap else next(s for s in seeds if part[s] < 0)
            part[v] = p
            size[p] += 1
            for w, weight in links[v].items():
                if part[w] < 0:
                    pull[w] += weight
                    heapq.heappush(heap, (-pull[w], w))
    most = max(1, int(np.ceil(room * n / parts)))
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(n).tolist():
            near: Counter = Counter()
            for w, weight in links[v].items():
                near[int(part[w])] += weight
            own = int(part[v])
            better = [(weight, -p) for p, weight in near.items() if size[p] < most and weight > near[own]]
            if better and size[own] > 1:
                to = -max(better)[1]
                part[v], moved = to, moved + 1
                size[own] -= 1
                size[to] += 1
        if not moved:
            break
    return part


def _neighbour_lists(sample, links: int):
    """Positions -> the positions of each row's nearest other rows of the sample."""
    def run(batches):
        x = sample.value
        k = min(links, len(x) - 1)
        for batch in batches:
            at = batch.column(0).to_numpy()
            for a in range(0, len(at), 512):
                rows = at[a:a + 512]
                scores = x[rows] @ x.T
                scores[np.arange(len(rows)), rows] = -np.inf
                near = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k else np.empty((len(rows), 0), int)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(near.tolist(), pa.list_(pa.int32()))],
                                                 names=["at", "near"])

    return run


# --- exact scores ----------------------------------------------------------------------

def matrix(column) -> np.ndarray:
    return np.stack(list(column)).astype(np.float64) if len(column) else np.empty((0, 0))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of equally many rows, summed from the first component to the last,
    so that equal vectors score equally wherever they stand."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _kept(qi, ids, ri, score, k: int):
    """Of (query, id, row, score) the k best ids of each query, best first."""
    by = np.lexsort((-score, ids, qi))
    qi, ids, ri, score = qi[by], ids[by], ri[by], score[by]
    once = np.ones(len(qi), bool)
    once[1:] = (qi[1:] != qi[:-1]) | (ids[1:] != ids[:-1])
    qi, ids, ri, score = qi[once], ids[once], ri[once], score[once]
    by = np.lexsort((ids, -score, qi))
    qi, ids, ri, score = qi[by], ids[by], ri[by], score[by]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[best], ids[best], ri[best], score[best]


def best_rows(qid, q, rid, x, k: int):
    """(query position, row position, score) of each query's k best rows with other ids;
    an id counts once."""
    order = np.argsort(rid, kind="stable")
    ids, x = rid[order], x[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, int)
    longest = np.linalg.norm(x, axis=1).max() if len(x) else 0.0
    out = []
    for a in range(0, len(q) if len(ids) else 0, 256):
        some = q[a:a + 256]
        scores = some @ x.T
        scores[qid[a:a + 256, None] == ids[None, :]] = -np.inf
        least = np.full(len(some), -np.inf)
        if len(starts) > k:
            by_id = np.maximum.reduceat(scores, starts, axis=1) if len(starts) < len(ids) else scores
            least = np.partition(by_id, len(starts) - k, axis=1)[:, len(starts) - k]
        # A matrix product rounds by position: look a hair below, then score exactly.
        hair = 1e-12 * np.linalg.norm(some, axis=1) * longest + 1e-300
        qi, at = np.nonzero((scores >= (least - hair)[:, None]) & (scores > -np.inf))
        qi, _, at, score = _kept(qi, ids[at], at, exact_scores(some[qi], x[at]), k)
        out.append((qi + a, order[at], score))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


# --- the index -------------------------------------------------------------------------

class Index(NamedTuple):
    rows: DataFrame           # id, v, part, salt: checkpointed
    weights: np.ndarray       # parts x (dims + 1), the last column is the intercept
    sizes: np.ndarray         # rows per part


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part, vectors of any length."""
    fit = F.forall(F.col(vec_col), lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (df.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & fit & F.exists(F.col(vec_col), lambda x: x != 0))
            .select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(vec_col).alias("v")))


def part_probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logits, which order the parts as their probabilities do."""
    return x @ weights[:, :-1].T + weights[:, -1]


def _indexed(weights):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, _SLICE):
                part = batch.slice(k, _SLICE)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                own = part_probabilities(x, weights.value).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int32())], names=[*part.schema.names, "part"])

    return run


def _classifier(spark, x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """Weights of a multinomial logistic regression of a row's part and its neighbours'."""
    weights = np.zeros((parts, x.shape[1] + 1))
    if len(set(part.tolist())) < 2:
        return weights
    at = np.concatenate([np.arange(len(x)), np.repeat(np.arange(len(x)), near.shape[1])])
    to = np.concatenate([part, part[near].ravel()])
    w = np.concatenate([np.ones(len(x)), np.full(near.size, 1 / max(1, near.shape[1]))])
    votes = pd.DataFrame({"at": at, "label": to, "w": w}).groupby(["at", "label"], as_index=False)["w"].sum()
    points = spark.createDataFrame(list(enumerate(x.tolist())), "at long, x array<double>")
    votes = spark.createDataFrame([(int(i), float(p), float(v)) for i, p, v in votes.to_numpy()], "at long, label double, w double")
    train = points.join(votes, "at").select(array_to_vector("x").alias("features"), "label", "w").checkpoint()
    model = LogisticRegression(family="multinomial", weightCol="w", maxIter=40, regParam=1e-4, standardization=False).fit(train)
    found = np.hstack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()[:, None]])
    weights[:len(found)] = np.nan_to_num(found, neginf=-1e9)
    return weights


def build(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", rows_per_part: int = ROWS_PER_PART,
          sample: int = SAMPLE, seed: int = 0) -> Index | None:
    """Fit on a bounded sample, index every row; None without any vector."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    rows = usable(df, id_col, vec_col)
    first = rows.agg(F.min("id").alias("id")).first().id
    if first is None:
        return None
    dims = rows.where(F.col("id") == first).agg(F.size(F.min("v"))).first()[0]
    rows = rows.where(F.size("v") == dims).withColumn("salt", F.monotonically_increasing_id())
    n = rows.count()
    parts = max(1, min(max(LEAST_PARTS, n // rows_per_part), MAX_PARTS, n // 2))
    want = parts * sample
    # A share of the rows by a hash of their place, about ``want``; never more than twice that.
    share = min(1.0, want / n)
    picked = rows.where(F.pmod(F.xxhash64("salt", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    picked = picked.select("id", "v").limit(2 * want).toPandas().sort_values("id", kind="stable")
    x = matrix(picked["v"])
    parts = max(1, min(parts, len(x) // 2))
    shared = spark.sparkContext.broadcast(x)
    lists = (spark.range(len(x)).mapInArrow(_neighbour_lists(shared, LINKS), "at long, near array<int>")
             .toPandas().sort_values("at"))
    near = np.array(lists["near"].tolist(), dtype=np.int64).reshape(len(x), -1)
    weights = _classifier(spark, x, near, balanced_parts(near, parts, seed=seed), parts)
    kind = dict(rows.dtypes)["v"]
    indexed = rows.mapInArrow(_indexed(spark.sparkContext.broadcast(weights)),
                              f"id long, v {kind}, salt long, part int").checkpoint()
    sizes = np.zeros(parts, np.int64)
    for r in indexed.groupBy("part").count().collect():
        sizes[r.part] = r["count"]
    return Index(indexed, weights, sizes)


# --- search ----------------------------------------------------------------------------

_FOUND = "query_id long, vec_id long, score double"


def _brute(queries, k: int):
    """Each task's k best rows for every one of a bounded set of queries, with their parts."""
    def run(batches):
        qid, q = queries.value
        best = None
        for batch in batches:
            for a in range(0, batch.num_rows, _SLICE):
                part = batch.slice(a, _SLICE)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                rid = part.column("id").to_numpy()
                qi, ri, score = best_rows(qid, q, rid, x, k)
                got = pd.DataFrame({"query_id": qid[qi], "vec_id": rid[ri], "score": score,
                                    "part": part.column("part").to_numpy()[ri].astype(np.int64)})
                best = got if best is None else pd.concat([best, got])
                best = (best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                        .drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k))
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, vec_id, score, ...) per query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _probe_ranks(x: np.ndarray, index: Index) -> np.ndarray:
    """For each vector, the parts from the most to the least probable."""
    return np.argsort(-part_probabilities(x, index.weights), axis=1, kind="stable")


def calibrate(index: Index, queries: DataFrame, k: int, target: float = TARGET, most: int = CALIBRATION) -> tuple[int, np.ndarray]:
    """(probes, recall by number of probes): measured on at most ``most`` of ``queries``
    (id, v), the first by a hash of their id, against an exact search over all rows."""
    spark = index.rows.sparkSession
    some = queries.orderBy(F.xxhash64("id"), "id").limit(most).collect()
    qid, q = np.array([r.id for r in some]), matrix([r.v for r in some])
    true = index.rows.select("id", "v", "part").mapInArrow(
        _brute(spark.sparkContext.broadcast((qid, q)), k), _FOUND + ", part long")
    true = _top(true.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max_by("part", "score").alias("part")), k)
    held = true.select("query_id", "part").toPandas()  # at most ``most`` x k rows
    order = _probe_ranks(q, index)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    at = place[pd.Index(qid).get_indexer(held["query_id"]), held["part"].to_numpy(dtype=np.int64)] if len(held) else np.empty(0, int)
    recall = np.cumsum(np.bincount(at, minlength=len(index.sizes))) / max(1, len(at))
    return (int(np.searchsorted(recall, min(target, recall[-1]) - 1e-12)) + 1 if len(at) else 1), recall


def bins(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bin, number of bins) of each part: small parts share a bin of at most
    ``block`` rows, a larger part has bins of its own."""
    first, many, at, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, block
    for p, n in enumerate(sizes.tolist()):
        if n > block:
            first[p], many[p] = at + 1, -(-n // block)
            at, room = int(at + 1 + many[p]), block
        else:
            if n > room:
                at, room = at + 1, block
            first[p], room = at, room - n
    return first, many


def _routed(weights, sizes: np.ndarray, first: np.ndarray, probes: int, k: int):
    """One row for each query and (first) bin: the parts that the query asks for there,
    the ``probes`` most probable ones and more until they hold k + 1 rows."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, _SLICE):
                part = batch.slice(a, _SLICE)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                order = np.argsort(-part_probabilities(x, weights.value), axis=1, kind="stable")
                enough = (np.cumsum(sizes[order], axis=1) <= k).sum(axis=1) + 1
                take = np.minimum(np.maximum(enough, probes), order.shape[1])
                rows, at, parts = [], [], []
                for i, (o, t) in enumerate(zip(order, take)):
                    asked = o[:t][sizes[o[:t]] > 0]
                    for b in np.unique(first[asked]).tolist():
                        rows.append(i)
                        at.append(b)
                        parts.append(asked[first[asked] == b].tolist())
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(rows, pa.int64())).columns, pa.array(at, pa.int32()),
                                                  pa.array(parts, pa.list_(pa.int32()))], names=["id", "v", "bin", "parts"])

    return run


def _meet(qs: pd.DataFrame, rs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a bin for each of its queries, part by part."""
    qid, rid, own = qs["id"].to_numpy(), rs["id"].to_numpy(), rs["part"].to_numpy()
    none = np.empty(0, np.int64)
    found = [(none, none, none, np.empty(0))]
    if len(qs) and len(rs):
        q, x = matrix(qs["v"]), matrix(rs["v"])
        asked = np.repeat(np.arange(len(qs)), qs["parts"].map(len))
        parts = np.concatenate([np.asarray(p, np.int64) for p in qs["parts"]])
        for p in np.unique(own):
            some, rows = asked[parts == p], np.flatnonzero(own == p)
            qi, ri, score = best_rows(qid[some], q[some], rid[rows], x[rows], k)
            found.append((some[qi], rid[rows][ri], rows[ri], score))
    qi, ids, _, score = _kept(*(np.concatenate(c) for c in zip(*found)), k)
    return pd.DataFrame({"query_id": qid[qi].astype(np.int64), "vec_id": ids.astype(np.int64), "score": score.astype(float)})


def search(index: Index | None, queries: DataFrame, k: int = 20, probes: int | None = None, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score, probes): the k rows of largest inner product found
    for each query (id, v), its own id left out, best first."""
    spark = queries.sparkSession
    out = "query_id long, rank int, vec_id long, score double, probes int"
    if index is None:
        return spark.createDataFrame([], out)
    queries = (queries.where(F.size("v") == index.weights.shape[1] - 1).groupBy("id").agg(F.min("v").alias("v")).checkpoint())
    if queries.isEmpty():
        return spark.createDataFrame([], out)
    if probes is None:
        probes, _ = calibrate(index, queries, k, target)
    first, many = bins(index.sizes, BLOCK)
    routed = queries.mapInArrow(_routed(spark.sparkContext.broadcast(index.weights), index.sizes, first, probes, k),
                                f"id long, v {dict(queries.dtypes)['v']}, bin int, parts array<int>").checkpoint()
    # A row per part at most: how many blocks of queries each of its bins meets.
    asks = {r.bin: -(-r["count"] // QUERY_BLOCK) for r in routed.groupBy("bin").count().collect()}
    plan = spark.createDataFrame([(p, b, m, asks[b]) for p, (b, m) in enumerate(zip(first.tolist(), many.tolist())) if b in asks],
                                 "part int, bin int, rows int, asks int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda salt, n: F.pmod(F.xxhash64(salt), F.col(n)).cast("int")
    qs = (routed.join(F.broadcast(plan.select("bin", "rows", "asks").distinct()), "bin")
          .select("bin", "id", "v", "parts", dealt("id", "asks").alias("a"), upto("rows").alias("r")))
    rs = (index.rows.join(F.broadcast(plan), "part")
          .select("bin", "id", "v", "part", dealt("salt", "rows").alias("r"), upto("asks").alias("a")))
    found = qs.groupBy("bin", "a", "r").cogroup(rs.groupBy("bin", "a", "r")).applyInPandas(lambda x, y: _meet(x, y, k), _FOUND)
    # By query alone: the ids of one query's few candidates are told apart where they meet.
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score",
                                 F.lit(probes).alias("probes"))


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            target: float = TARGET) -> DataFrame:
    """``search`` of the rows of ``df`` that ``is_query`` names, over all its rows."""
    return search(build(df, id_col, vec_col), usable(df.where(is_query), id_col, vec_col), k, target=target)
