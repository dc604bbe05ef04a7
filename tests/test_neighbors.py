"""Nearest neighbours through cells and rings: equal to all pairs, with fewer compared."""

import numpy as np
import pytest

from churnlens.operators import neighbors as nbr

KIND = "id long, x array<double>, y double"


def _df(spark, m, first=0):
    return spark.createDataFrame([(first + i, r.tolist(), float(i % 3)) for i, r in enumerate(m)], KIND)


def _brute(ref, query, k, same=False):
    out = {}
    for i, q in enumerate(query):
        d = np.zeros(len(ref))
        for j in range(ref.shape[1]):
            d += (q[j] - ref[:, j]) ** 2
        if same:
            d[i] = np.inf
        order = np.lexsort((np.arange(len(ref)), d))[:k]
        out[i] = [(int(j), d[j]) for j in order if np.isfinite(d[j])]
    return out


def _got(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.ref_id, r.sq_dist))
    return out


@pytest.mark.parametrize("shape", ["clusters", "grid", "line"])
def test_equal_to_all_pairs(spark, shape):
    rng = np.random.default_rng(3)
    if shape == "clusters":
        ref = rng.normal(size=(400, 3)) + 50 * rng.integers(0, 4, (400, 1))
        query = rng.normal(size=(60, 3)) + 50 * rng.integers(0, 5, (60, 1))
    elif shape == "grid":  # ties everywhere
        ref, query = rng.integers(0, 5, (400, 3)).astype(float), rng.integers(0, 5, (60, 3)).astype(float)
    else:
        ref, query = np.arange(400.0)[:, None] ** 2, rng.integers(0, 160_000, (60, 1)).astype(float)
    assert _got(nbr.knn(_df(spark, ref), _df(spark, query), 5, block_rows=16).collect()) == _brute(ref, query, 5)


def test_self_left_out_and_a_third_at_one_point(spark):
    rng = np.random.default_rng(4)
    ref = rng.normal(size=(240, 2))
    ref[::3] = [0.5, 0.5]
    df = _df(spark, ref)
    got = _got(nbr.knn(df, df, 4, exclude_self=True, block_rows=8).collect())
    assert got == _brute(ref, ref, 4, same=True)
    # Only k + 1 copies of the common point are kept.
    assert nbr.MetricIndex.build(df, 4, block_rows=8).rows.count() == 160 + 5


def test_more_neighbours_than_rows_in_a_ring_or_at_all(spark):
    rng = np.random.default_rng(5)
    ref, query = rng.normal(size=(50, 2)), rng.normal(size=(9, 2))
    for k in (20, 80):
        assert _got(nbr.knn(_df(spark, ref), _df(spark, query), k, block_rows=7).collect()) == _brute(ref, query, k)


def test_bounds_leave_most_pairs_out(spark):
    rng = np.random.default_rng(6)
    ref = rng.normal(size=(1200, 3)) + 40 * rng.integers(0, 12, (1200, 1))
    query = _df(spark, ref[:200])
    index = nbr.MetricIndex.build(_df(spark, ref), 5, block_rows=40)
    work = index.work(query, 5)
    assert work["all"] == 200 * 1200
    assert work["compared"] < 0.25 * work["all"]
    assert index.rings.agg({"_rows": "max"}).first()[0] <= 40


def test_no_reference_rows_and_null_labels(spark):
    query = _df(spark, np.zeros((2, 2)))
    assert nbr.knn(query.limit(0), query).count() == 0
    ref = spark.createDataFrame([(1, [0.0, 0.0], None), (2, [1.0, 0.0], 1.0)], KIND)
    got = {r.ref_id: r.ref_label for r in nbr.knn(ref, query.limit(1), 2).collect()}
    assert got == {1: None, 2: 1.0}


def test_open_cells_are_handed_on_in_small_frames(monkeypatch):
    import numpy as np
    import pandas as pd

    from churnlens.operators import neighbors as nbr

    rng = np.random.default_rng(2)
    x, pivots = rng.normal(size=(3000, 3)), rng.normal(size=(64, 3))
    batch = pd.DataFrame({"id": range(3000), "x": list(x), "_cell": 0, "_ring": 0, "dists": [[9.0] * 5] * 3000})
    rows, lo, hi = np.full(64, 10.0), np.zeros(64), np.full(64, 2.0)

    def frames():
        return list(nbr._open_cells(pivots, rows, lo, hi, 5, False)([batch]))

    small = frames()
    assert max(map(len, small)) <= nbr.PAIRS  # before: one frame with all pairs of the batch
    monkeypatch.setattr(nbr, "PAIRS", 10**9)
    monkeypatch.setattr(nbr, "CELLS", 10**9)
    whole = frames()
    assert len(whole) == 1 and len(small) > 5
    got = pd.concat(small, ignore_index=True)
    assert got.drop(columns="x").equals(whole[0].drop(columns="x")) and all((a == b).all() for a, b in zip(got["x"], whole[0]["x"]))


def _parts(rows, folds, k):
    """For every fold and row outside it, the k nearest rows outside it, all pairs compared."""
    want = {}
    for f in folds:
        part = [r for r in rows if r[2] != f and r[2] in folds]
        x, ids = np.array([r[1] for r in part]).reshape(len(part), -1), [r[0] for r in part]
        for a in rows:
            if a[2] != f and part:
                d = np.zeros(len(part))
                for j in range(x.shape[1]):
                    d += (a[1][j] - x[:, j]) ** 2
                near = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != a[0]][:k]
                if near:
                    want[f, a[0]] = near
    return want


@pytest.mark.parametrize("shape", ["clusters", "grid", "blocks", "lonely"])
def test_folds_share_one_index(spark, shape, monkeypatch):
    from churnlens.operators import resample as rs

    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3)) * 1e5 + 1e7 * rng.integers(0, 4, (300, 1))
    fold = rng.integers(0, 4, 300)
    if shape == "grid":  # ties and copies everywhere
        x = rng.integers(0, 4, (300, 3)).astype(float)
    if shape == "blocks":  # rows of a cell are rows of a fold
        x = x + 1e9 * fold[:, None]
    if shape == "lonely":  # a fold of two rows, one of none
        fold = np.where(np.arange(300) < 2, 2, fold % 2)
    rows = [(i, r.tolist(), int(f)) for i, (r, f) in enumerate(zip(x, fold))]
    built, build = [], nbr.MetricIndex.build.__func__

    def small(cls, ref, k, **kw):
        built.append(1)
        return build(cls, ref, k, block_rows=16, **kw)

    monkeypatch.setattr(nbr.MetricIndex, "build", classmethod(small))
    monkeypatch.setattr(nbr, "knn", lambda ref, query, k, exclude_self: nbr.MetricIndex.build(ref, k).search(query, k, exclude_self))
    monkeypatch.setattr(rs, "knn", nbr.knn)
    got = {}
    for r in rs.fold_neighbors(spark.createDataFrame(rows, "id long, x array<double>, fold int"), [0, 1, 2, 3], 4).orderBy("rank").collect():
        got.setdefault((r.fold, r.base_id), []).append(r.nb_id)
    assert got == _parts(rows, [0, 1, 2, 3], 4)
    assert len(built) == 1  # an index and a search a fold before


def test_rings_hand_back_rows_within_the_bound_only():
    import pandas as pd

    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3)) + 1e4
    ref = pd.DataFrame({"_rid": range(200), "_x": list(x), "_ry": 0.0})
    query = pd.DataFrame({"id": [900, 901], "x": [x[0], x[0] + 50], "_own": np.nan, "_cell": 0, "_ring": 0})
    every = nbr._ring_topk(5, False)(query, ref)
    assert every["refs"].map(len).tolist() == [5, 5] and every["dists"][0] == sorted(((x - x[0]) ** 2).sum(1))[:5]
    assert (every["_kth"] == every["dists"].map(max)).all()
    some = nbr._ring_topk(5, False)(query.assign(_limit=[every["dists"][0][1], 1.0]), ref)
    assert some["id"].tolist() == [900] and some["refs"][0] == every["refs"][0][:2]


def test_lengths_beyond_doubles_are_measured():
    import pandas as pd

    ref = pd.DataFrame({"_rid": [1, 2, 3], "_x": [np.array([v]) for v in (1e200, 1e200 + 1e185, -1e200)], "_ry": 0.0})
    query = pd.DataFrame({"id": [9], "x": [np.array([1e200])], "_own": np.nan, "_cell": 0, "_ring": 0})
    assert nbr._ring_topk(2, False)(query, ref)["refs"].tolist() == [[1]]
    assert nbr._ring_topk(1, False)(query, ref)["refs"].tolist() == [[1]]
